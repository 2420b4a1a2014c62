"""The event bus, handlers, and streaming reads."""
