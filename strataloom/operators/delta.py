"""Reconciliation: expected state against current state, as one join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .temporal import ENTITY_KEY

INSERT, UPDATE, NOOP = "insert", "update", "noop"


def _comparable(column: Column, kind: T.DataType) -> Column:
    """The column in a form that <=> takes: maps become sorted entries, at any depth."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        inner = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.transform(entries, lambda e: _comparable(e, inner)) if _has_map(kind.valueType) else entries
    if isinstance(kind, T.ArrayType) and _has_map(kind.elementType):
        return F.transform(column, lambda e: _comparable(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(column.isNotNull(), F.struct(*[_comparable(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return column


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def same(a: Column, b: Column, kind: T.DataType) -> Column:
    """Deep, null-safe equality."""
    return _comparable(a, kind).eqNullSafe(_comparable(b, kind))


def last_intents(expected: DataFrame, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """Of several intents on one identity the last (largest `seq`) wins."""
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    return expected.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def classified(expected: DataFrame, current: DataFrame, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """expected (identity, seq, fields) with `operation`: insert, update or noop against current (identity, fields)."""
    kind = expected.schema["fields"].dataType
    stored = current.select(*key, F.col("fields").alias("_stored"), F.lit(True).alias("_there"), *([F.col("commit_id").alias("current_commit_id")] if "commit_id" in current.columns else []))
    joined = last_intents(expected, key).join(stored, list(key), "left")
    operation = F.when(F.col("_there").isNull(), INSERT).when(same(F.col("fields"), F.col("_stored"), kind), NOOP).otherwise(UPDATE)
    return joined.withColumn("operation", operation).drop("_stored", "_there")


def delta(expected: DataFrame, current: DataFrame, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """The rows that a commit must append."""
    return classified(expected, current, key).where(F.col("operation") != NOOP)


def import_plan(rows: DataFrame, current: DataFrame, key: Sequence[str] = ENTITY_KEY, on_conflict: str = "abort", precondition: str | None = None) -> DataFrame:
    """rows with `action`: insert, update, skip or conflict.

    on_conflict says what an existing, different identity is: a conflict (abort), skipped (skip) or updated (upsert).
    precondition, must_exist, must_not_exist or if_commit_id:N, makes rows that break it conflicts.
    """
    if on_conflict not in ("abort", "skip", "upsert"):
        raise ValueError(f"unknown on_conflict {on_conflict!r}")
    found = classified(rows, current, key)
    there = F.col("operation") != INSERT
    broken = F.lit(False)
    if precondition == "must_exist":
        broken = ~there
    elif precondition == "must_not_exist":
        broken = there
    elif precondition and precondition.startswith("if_commit_id:"):
        broken = there & (F.col("current_commit_id") != int(precondition.split(":", 1)[1]))
    elif precondition:
        raise ValueError(f"unknown precondition {precondition!r}")
    existing = {"abort": "conflict", "skip": "skip", "upsert": "update"}[on_conflict]
    action = F.when(broken, "conflict").when(F.col("operation") == INSERT, "insert").when(F.col("operation") == NOOP, "skip").otherwise(existing)
    return found.withColumn("action", action)
