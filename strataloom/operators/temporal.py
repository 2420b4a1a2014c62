"""Versioned state: from a history of versions to latest, point-in-time and range views.

A history has identity columns (`key`, or `left_key, right_key, instance_key`), `commit_id`,
`schema_version_id`, `seq` (order within a commit) and a struct `fields`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY_KEY = ("key",)
RELATION_KEY = ("left_key", "right_key", "instance_key")


def of_version(history: DataFrame, schema_version_id: int | None) -> DataFrame:
    """Only versions written under one schema version; rows without one are left out. None: all."""
    return history if schema_version_id is None else history.where(F.col("schema_version_id") == schema_version_id)


def latest(history: DataFrame, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """The newest version of each identity; of one commit the last.

    The rank limit runs before the shuffle too, so each task sends one version of a key at most.
    """
    newest = Window.partitionBy(*key).orderBy(F.desc("commit_id"), F.desc("seq"))
    return history.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def as_of(history: DataFrame, commit_id: int, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """The newest version of each identity at a commit: the bound comes before the choice."""
    return latest(history.where(F.col("commit_id") <= commit_id), key)


def since(history: DataFrame, commit_id: int) -> DataFrame:
    """Versions after a commit."""
    return history.where(F.col("commit_id") > commit_id)


def changes(history: DataFrame, commit_id: int | None = None, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """The history with `operation`: insert for an identity's first commit, else update_version.

    With a commit_id only its rows; only identities that it touched are looked at.
    """
    if commit_id is not None:
        touched = history.where(F.col("commit_id") == commit_id)
        earlier = history.where(F.col("commit_id") < commit_id).join(touched.select(*key), list(key), "left_semi").select(*key).distinct()
        seen = touched.join(earlier.withColumn("_seen", F.lit(True)), list(key), "left")
        return seen.withColumn("operation", F.when(F.col("_seen"), "update_version").otherwise("insert")).drop("_seen")
    first = F.min("commit_id").over(Window.partitionBy(*key))
    return history.withColumn("operation", F.when(first < F.col("commit_id"), "update_version").otherwise("insert"))


def operations_per_commit(history: DataFrame) -> DataFrame:
    """commit_id, operations."""
    return history.groupBy("commit_id").agg(F.count("*").alias("operations"))


def distinct_identities(history: DataFrame, key: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """One row: how many identities the history has."""
    return history.select(*key).distinct().agg(F.count("*").alias("identities"))


def history_frame(df: DataFrame, key: Sequence[tuple[str, Column]], commit_id: Column, fields: Sequence[tuple[str, Column]], schema_version_id: Column | None = None, seq: Column | None = None) -> DataFrame:
    """A history from any DataFrame: what identifies rows, when they were written, and their payload."""
    version = F.lit(1) if schema_version_id is None else schema_version_id
    return df.select(
        *[c.cast("string").alias(n) for n, c in key],
        commit_id.cast("long").alias("commit_id"),
        version.cast("int").alias("schema_version_id"),
        (F.lit(0) if seq is None else seq).cast("long").alias("seq"),
        F.struct(*[c.alias(n) for n, c in fields]).alias("fields"),
    )
