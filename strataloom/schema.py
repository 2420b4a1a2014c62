"""Declared against stored types: differences, validation, and migration between versions."""

from __future__ import annotations

import base64
import hashlib
import importlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .errors import ConcurrentWriteError, MigrationError, MigrationTokenError, MissingUpgraderError, SchemaOutdatedError, TypeSchemaDiff
from .model import Entity
from .operators import temporal
from .sources.store import Store, keys_of, payload_of
from .types import FieldType

Upgraders = dict[tuple[str, int], Callable[[dict[str, Any]], dict[str, Any]]]


def diff(cls: type, stored: dict[str, Any] | None) -> TypeSchemaDiff:
    """What changed from the stored schema (None: nothing stored) to the class."""
    new = cls.schema()
    old = stored["schema"] if stored else {"fields": {}}
    a, b = old["fields"], new["fields"]
    changed = {n: {"stored": a[n], "code": b[n]} for n in a if n in b and a[n] != b[n]}
    for part in ("left", "right", "instance_key"):
        if stored and old.get(part) != new.get(part):
            changed[f"({part})"] = {"stored": old.get(part), "code": new.get(part)}
    return TypeSchemaDiff(cls.kind, cls.type_name, stored["schema_version_id"] if stored else 0, sorted(set(b) - set(a)), sorted(set(a) - set(b)), changed)


def validate(store: Store, types: list[type]) -> dict[type, int]:
    """The schema version of each type. New types are registered; changed ones are an error that lists all."""
    versions: dict[type, int] = {}
    diffs = []
    for cls in types:
        stored = store.current_schema(cls.kind, cls.type_name)
        if stored is None:
            versions[cls] = store.add_schema(cls)
        elif stored["hash"] == cls.schema_hash():
            versions[cls] = stored["schema_version_id"]
        else:
            diffs.append(diff(cls, stored))
    if diffs:
        raise SchemaOutdatedError(diffs)
    return versions


def upgrader(type_name: str, *, from_version: int):
    """Marks a function from the fields of one schema version to those of the next."""

    def mark(function):
        function.upgrades = (type_name, from_version)
        return function

    return mark


def load_upgraders(module: str) -> Upgraders:
    """All marked functions of a module."""
    found: Upgraders = {}
    for value in vars(importlib.import_module(module)).values():
        key = getattr(value, "upgrades", None)
        if callable(value) and key is not None:
            if key in found:
                raise MigrationError(f"two upgraders for {key[0]} from version {key[1]}")
            found[key] = value
    return found


@dataclass
class MigrationPreview:
    has_changes: bool
    token: str
    diffs: list[TypeSchemaDiff] = field(default_factory=list)
    estimated_rows: dict[str, int] = field(default_factory=dict)
    types_requiring_upgraders: list[str] = field(default_factory=list)
    types_schema_only: list[str] = field(default_factory=list)
    missing_upgraders: dict[str, list[int]] = field(default_factory=dict)


@dataclass
class MigrationResult:
    success: bool
    types_migrated: list[str] = field(default_factory=list)
    rows_migrated: dict[str, int] = field(default_factory=dict)
    new_schema_versions: dict[str, int] = field(default_factory=dict)
    duration_s: float = 0.0


def token_of(diffs: list[TypeSchemaDiff], head: int | None) -> str:
    """Names one plan at one head: a token of another plan or head does not fit."""
    plan = json.dumps([asdict(d) for d in sorted(diffs, key=lambda d: (d.type_kind, d.type_name))], sort_keys=True)
    return base64.urlsafe_b64encode(f"{hashlib.sha256(plan.encode()).hexdigest()}@{head}".encode()).decode()


def _changed(store: Store, types: list[type]) -> list[tuple[type, dict[str, Any]]]:
    out = []
    for cls in types:
        stored = store.current_schema(cls.kind, cls.type_name)
        if stored is not None and stored["hash"] != cls.schema_hash():
            out.append((cls, stored))
    return out


def _stored_latest(store: Store, cls: type, stored: dict[str, Any]):
    rows = store.raw_history(cls.kind, cls.type_name, payload=payload_of(stored["schema"]))
    return temporal.latest(rows, keys_of(cls.kind)).where(F.col("schema_version_id") <= stored["schema_version_id"])


def preview(store: Store, types: list[type], upgraders: Upgraders | None = None) -> MigrationPreview:
    """What a migration would do; counts run as Spark jobs."""
    changed = _changed(store, types)
    diffs = [diff(c, s) for c, s in changed]
    out = MigrationPreview(bool(diffs), token_of(diffs, store.head()), diffs)
    for cls, stored in changed:
        rows = _stored_latest(store, cls, stored).count()
        out.estimated_rows[cls.type_name] = rows
        (out.types_requiring_upgraders if rows else out.types_schema_only).append(cls.type_name)
        version = stored["schema_version_id"]
        if rows and (cls.type_name, version) not in (upgraders or {}):
            out.missing_upgraders[cls.type_name] = [version]
    return out


def migrate(store: Store, types: list[type], upgraders: Upgraders | None = None, token: str | None = None, force: bool = False, owner: str = "migration", lock_timeout_ms: int = 5000, lease_ms: int = 30_000) -> MigrationResult:
    """Rewrites the latest rows of all changed types under new schema versions, in one commit.

    Rows run through their upgrader on the executors. The plan is made anew under the lock: token is that of the
    preview, unless force is set.
    """
    began, upgraders = time.time(), upgraders or {}
    with store.locked(owner, lock_timeout_ms, lease_ms):
        head = store.head()
        plan = preview(store, types, upgraders)
        if not plan.has_changes:
            return MigrationResult(True, duration_s=time.time() - began)
        if not force and token != plan.token:
            raise MigrationTokenError("the token is of another plan or another head commit")
        if plan.missing_upgraders:
            raise MissingUpgraderError(plan.missing_upgraders)
        rows, result = {}, MigrationResult(True)
        changed = _changed(store, types)
        for cls, stored in changed:
            version = stored["schema_version_id"] + 1
            if plan.estimated_rows[cls.type_name]:
                latest = _stored_latest(store, cls, stored)
                rows[cls.kind, cls.type_name] = (_upgraded(latest, cls, stored, upgraders[cls.type_name, stored["schema_version_id"]]), version)
            result.types_migrated.append(cls.type_name)
            result.rows_migrated[cls.type_name] = plan.estimated_rows[cls.type_name]
            result.new_schema_versions[cls.type_name] = version
        if rows:
            try:
                store.publish(rows, {"operation": "migration", "types": result.types_migrated, "rows": result.rows_migrated}, head or 0)
            except ConcurrentWriteError:
                raise
            except Exception as e:
                raise MigrationError(_told(e)) from e
        for cls, _ in changed:
            store.add_schema(cls)
        result.duration_s = time.time() - began
        return result


def _told(error: Exception) -> str:
    """The line of an executor's error that names the row."""
    lines = [x for x in str(error).splitlines() if "upgrading " in x]
    return lines[-1].strip() if lines else str(error)


def _upgraded(latest, cls: type, stored: dict[str, Any], upgrade):
    """latest with `fields` of the class's shape."""
    old = {n: FieldType.from_spec(s) for n, s in stored["schema"]["fields"].items()}
    new = {n: (f.type, f.initial() if f.has_default else None, f.has_default) for n, f in cls.data_fields().items()}
    key, name = keys_of(cls.kind), cls.type_name
    key_field = cls.key_field if issubclass(cls, Entity) else None

    def upgraded(row):
        identity = tuple(row[k] for k in key)
        data = {n: t.from_row(row["fields"][n]) for n, t in old.items()}
        try:
            got = upgrade(dict(data))
            if unknown := set(got) - set(new):
                raise ValueError(f"unknown fields {sorted(unknown)}")
            values = []
            for n, (kind, initial, has_default) in new.items():
                if n not in got and not has_default and not kind.nullable:
                    raise ValueError(f"field {n} is missing")
                values.append(kind.to_row(kind.check(got.get(n, initial), n)))
            if key_field and str(got[key_field]) != identity[0]:
                raise ValueError("an upgrader cannot change the key")
        except Exception as e:
            raise RuntimeError(f"upgrading {name} {identity}: {e}; old fields {data}") from e
        return (*identity, 0, tuple(values) or (None,))

    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in key], T.StructField("seq", T.LongType()), T.StructField("fields", cls.payload())])
    shape = T.StructType([T.StructField("fields", cls.payload())])
    before = T.StructType([latest.schema["fields"]])

    # The upgrader takes and gives Python dictionaries; rows travel to it and back in batches.
    def batches(it):
        arrow = to_arrow_schema(schema)
        for batch in it:
            out = []
            for row in batch.to_pylist():
                *identity, seq, values = upgraded(row | _plain({"fields": row["fields"]}, before))
                out.append(dict(zip(key, identity, strict=True)) | {"seq": seq} | _nested((values,), shape))
            yield pa.RecordBatch.from_pylist(out, arrow)

    return latest.select(*key, "fields").mapInArrow(batches, schema)


def _nested(value: Any, kind: T.DataType) -> Any:
    """A row's value as Arrow takes it: structs as dictionaries, maps as pairs."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _nested(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.MapType):
        return [(k, _nested(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.ArrayType):
        return [_nested(v, kind.elementType) for v in value]
    return value


def _plain(value: Any, kind: T.DataType) -> Any:
    """The reverse for maps, which come as pairs: dictionaries."""
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return {k: _plain(v, kind.valueType) for k, v in value}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    return value
