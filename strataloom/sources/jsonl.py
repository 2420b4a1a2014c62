"""Interchange as JSON lines: one object a line, with its identity and fields.

    {"type_kind": "entity", "type_name": ..., "key": ..., "fields": {...}[, "commit_id": ...]}
    {"type_kind": "relation", "type_name": ..., "left_key": ..., "right_key": ...[, "instance_key": ...], "fields": {...}}
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError, ValidationError
from ..operators import delta
from ..plans.query import Mode, state
from ..session import Session
from .store import keys_of


class ImportConflictError(StoreError):
    def __init__(self, conflicts: list[dict[str, Any]], count: int | None = None):
        self.conflicts = conflicts
        self.count = len(conflicts) if count is None else count
        super().__init__(f"{self.count} rows in conflict with stored ones; nothing was imported")


@dataclass
class ImportReport:
    inserts: int = 0
    updates: int = 0
    skips: int = 0
    conflicts: list[dict[str, Any]] = field(default_factory=list)  # examples, at most 100 a type
    conflict_count: int = 0
    commit_id: int | None = None


def export_df(session: Session, cls: type, as_of: int | None = None, history_since: int | None = None, with_metadata: bool = False) -> DataFrame:
    """The rows of a type as JSON lines, in a column `value`; fields that are JSON text stay values."""
    mode = Mode("since", history_since) if history_since is not None else Mode("as_of", as_of) if as_of is not None else Mode()
    rows, _ = state(session.store, cls, mode)
    fields = F.struct(*[(F.parse_json(F.col(f"fields.{n}")) if f.type.kind == "json" else F.col(f"fields.{n}")).alias(n) for n, f in cls.data_fields().items()] or [F.lit(None).alias("none")]).alias("fields")
    key = [F.when(F.col(k) != "", F.col(k)).alias(k) if k == "instance_key" else F.col(k) for k in keys_of(cls.kind)]
    columns = [F.lit(cls.kind).alias("type_kind"), F.lit(cls.type_name).alias("type_name"), *key, fields]
    if with_metadata:
        columns.append(F.col("commit_id"))
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def export(session: Session, types: list[type], folder: str, **how: Any) -> dict[str, str]:
    """Writes each type's lines to a folder of its own; the paths by type name."""
    out = {}
    for cls in types:
        path = f"{folder.rstrip('/')}/{cls.kind}-{cls.type_name}.jsonl"
        export_df(session, cls, **how).write.mode("overwrite").text(path)
        out[cls.type_name] = path
    return out


def read_lines(session: Session, path: str, types: list[type]) -> dict[type, DataFrame]:
    """Each type's lines of a file or folder as expected state: identity, seq, fields.

    A line that is no JSON, or of an unknown type, is an error that names file and text.
    """
    lines = session.spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) != ''")
    head = "type_kind string, type_name string, key string, left_key string, right_key string, instance_key string, fields string, _bad string"
    parsed = lines.withColumn("row", F.from_json("value", head, {"columnNameOfCorruptRecord": "_bad"})).withColumn("seq", F.monotonically_increasing_id())
    known = [f"{c.kind}/{c.type_name}" for c in types]
    bad = parsed.where(F.col("row._bad").isNotNull() | ~F.coalesce(F.concat_ws("/", "row.type_kind", "row.type_name").isin(known), F.lit(False))).select("file", "value").first()
    if bad is not None:
        raise ValidationError(f"{bad['file']}: no line of a known type: {bad['value'][:200]}")
    out = {}
    for cls in types:
        mine = parsed.where((F.col("row.type_kind") == cls.kind) & (F.col("row.type_name") == cls.type_name))
        shape = T.StructType([*cls.payload().fields, T.StructField("_bad", T.StringType())])
        typed = mine.withColumn("typed", F.from_json("row.fields", shape, {"columnNameOfCorruptRecord": "_bad"}))
        required = [n for n, f in cls.data_fields().items() if not f.has_default and not f.type.nullable and f.type.kind != "json"]
        values = []
        for n, f in cls.data_fields().items():
            value = F.col(f"typed.{n}")
            if f.has_default and f.initial() is not None:
                value = F.when(F.get_json_object("row.fields", f"$.{n}").isNull(), F.lit(f.type.to_row(f.initial())) if f.type.kind == "primitive" else value).otherwise(value)
            values.append(value.alias(n))
        wrong = F.col("typed._bad").isNotNull() | F.col("typed").isNull()
        for n in required:
            wrong |= F.col(f"typed.{n}").isNull()
        broken = typed.where(wrong).select("file", "value").first()
        if broken is not None:
            raise ValidationError(f"{broken['file']}: fields do not fit {cls.type_name}: {broken['value'][:200]}")
        key = [F.coalesce("row.instance_key", F.lit("")).alias(k) if k == "instance_key" else F.col(f"row.{k}").alias(k) for k in keys_of(cls.kind)]
        out[cls] = typed.select(*key, "seq", F.struct(*(values or [F.lit(None).cast("boolean").alias("_none")])).alias("fields"))
    return out


def load(session: Session, path: str, types: list[type], apply: bool = False, on_conflict: str = "abort", precondition: str | None = None, meta: dict[str, str] | None = None) -> ImportReport:
    """Classifies lines against current state; with apply commits inserts and updates as one commit.

    Any conflict stops all. Lines stay on the executors; only counts and examples of conflicts (at most 100 a type) come back.
    """
    session._validated()
    report = ImportReport()
    rows: dict[type, DataFrame] = {}
    for cls, expected in read_lines(session, path, types).items():
        key = keys_of(cls.kind)
        current = session.store.latest_rows(cls, expected).select(*key, "commit_id", "fields")
        plan = delta.import_plan(expected, current, key, on_conflict, precondition).persist()
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        report.inserts += counts.get("insert", 0)
        report.updates += counts.get("update", 0)
        report.skips += counts.get("skip", 0)
        report.conflict_count += counts.get("conflict", 0)
        if counts.get("conflict"):
            report.conflicts += [{"type_name": cls.type_name} | {k: r[k] for k in key} for r in plan.where("action = 'conflict'").select(*key).limit(100).collect()]
        rows[cls] = plan.where(F.col("action").isin("insert", "update")).select(*key, "seq", "fields")
    if not apply:
        return report
    if report.conflicts:
        raise ImportConflictError(report.conflicts, report.conflict_count)
    with session.store.locked(session.id, session.config.lock_timeout_ms, session.config.lease_ttl_ms):
        report.commit_id = session._publish(rows, {"operation": "import"} | (meta or {}))
    return report
