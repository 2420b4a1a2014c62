"""Errors that the library raises."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class StoreError(Exception):
    """Base of all errors of this library."""


class ValidationError(StoreError, ValueError):
    """Data do not fit their declared type."""


class MetadataUnavailableError(StoreError):
    """meta() of an object that no query returned."""

    def __init__(self):
        super().__init__("only objects that a query returned have metadata")


@dataclass
class TypeSchemaDiff:
    """How a type's declared fields differ from the stored ones."""

    type_kind: str
    type_name: str
    stored_version: int
    added_fields: list[str] = field(default_factory=list)
    removed_fields: list[str] = field(default_factory=list)
    changed_fields: dict[str, dict[str, Any]] = field(default_factory=dict)


class SchemaOutdatedError(StoreError):
    """Declared types differ from stored ones; `diffs` says how."""

    def __init__(self, diffs: list[TypeSchemaDiff]):
        self.diffs = diffs
        super().__init__(f"declared fields differ from stored ones: {', '.join(d.type_name for d in diffs)}; migrate() shows and applies the change")


class MigrationError(StoreError):
    """A migration failed."""


class MigrationTokenError(MigrationError):
    """The token is not that of the current plan and head commit."""


class MissingUpgraderError(MigrationError):
    """Steps between schema versions have no upgrader; `missing` has the versions by type."""

    def __init__(self, missing: dict[str, list[int]]):
        self.missing = missing
        super().__init__("no upgrader for " + "; ".join(f"{t} from version {', '.join(map(str, v))}" for t, v in missing.items()))


class HandlerError(StoreError):
    """Handlers are not usable as given."""


class BatchSizeExceededError(StoreError):
    def __init__(self, count: int, limit: int):
        self.count, self.limit = count, limit
        super().__init__(f"{count} intents in one commit; max_batch_size is {limit}")


class EventLoopLimitError(StoreError):
    def __init__(self, depth: int, limit: int):
        self.depth, self.limit = depth, limit
        super().__init__(f"an event at depth {depth} of its chain; max_event_chain_depth is {limit}")


class CommitChainDepthError(StoreError):
    def __init__(self, depth: int, limit: int):
        self.depth, self.limit = depth, limit
        super().__init__(f"commit handlers caused commits to depth {depth}; max_commit_chain_depth is {limit}")


class LockContentionError(StoreError):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms
        super().__init__(f"the write lock was not free within {timeout_ms} ms")


class ConcurrentWriteError(StoreError):
    def __init__(self, message: str = "another writer committed first; try again"):
        super().__init__(message)


class HeadMismatchError(ConcurrentWriteError):
    """The head moved while a commit was written."""


class LeaseExpiredError(StoreError):
    def __init__(self):
        super().__init__("the lease ended before the commit")


class UninitializedStorageError(StoreError):
    def __init__(self, storage_uri: str):
        self.storage_uri = storage_uri
        super().__init__(f"nothing is stored at {storage_uri}; initialise it first")


class StorageBackendError(StoreError):
    def __init__(self, operation: str, detail: str):
        self.operation, self.detail = operation, detail
        super().__init__(f"{operation}: {detail}")
