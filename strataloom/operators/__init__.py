"""Operators on histories, deltas, graphs and events, as DataFrame functions."""
