"""Versioned entity and relation analytics on Spark."""

from .config import Config
from .errors import (
    BatchSizeExceededError,
    ConcurrentWriteError,
    EventLoopLimitError,
    HandlerError,
    HeadMismatchError,
    LeaseExpiredError,
    LockContentionError,
    MetadataUnavailableError,
    MigrationError,
    MigrationTokenError,
    MissingUpgraderError,
    SchemaOutdatedError,
    StorageBackendError,
    StoreError,
    TypeSchemaDiff,
    UninitializedStorageError,
    ValidationError,
)
from .expressions import left, right
from .model import Entity, Event, EventDeadLetter, Field, Meta, Relation, Schedule, meta
from .plans.query import FrameProvider, Layout, Path, avg, count, max, min, sum
from .schema import MigrationPreview, MigrationResult, load_upgraders, upgrader
from .session import Session
from .streaming.handlers import CommitContext, HandlerContext, on_commit, on_commit_entity, on_commit_relation, on_event, on_schedule

__version__ = "0.1.0"

__all__ = [
    "BatchSizeExceededError", "CommitContext", "ConcurrentWriteError", "Config", "Entity", "Event", "EventDeadLetter", "EventLoopLimitError", "Field", "FrameProvider",
    "HandlerContext", "HandlerError", "HeadMismatchError", "Layout", "LeaseExpiredError", "LockContentionError", "Meta", "MetadataUnavailableError", "MigrationError", "MigrationPreview",
    "MigrationResult", "MigrationTokenError", "MissingUpgraderError", "Path", "Relation", "Schedule", "SchemaOutdatedError", "Session", "StorageBackendError",
    "StoreError", "TypeSchemaDiff", "UninitializedStorageError", "ValidationError", "avg", "count", "left", "load_upgraders", "max", "meta", "min", "on_commit",
    "on_commit_entity", "on_commit_relation", "on_event", "on_schedule", "right", "sum", "upgrader",
]
