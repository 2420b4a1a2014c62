"""Endpoints and traversals as set-based joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_endpoint(relations: DataFrame, entities: DataFrame, side: str, how: str = "left") -> DataFrame:
    """relations with the side's entity as a struct column `left` or `right` (key, commit_id, fields), null if missing."""
    entity = F.struct("key", "commit_id", "fields").alias(side)
    return relations.join(entities.select(F.col("key").alias(f"{side}_key"), entity), f"{side}_key", how)


def with_matching_endpoint(relations: DataFrame, entities: DataFrame, side: str) -> DataFrame:
    """The relations whose side's entity is among entities."""
    return relations.join(entities.select(F.col("key").alias(f"{side}_key")), f"{side}_key", "left_semi")


def hops(sources: DataFrame, steps: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """source_key, hop, paths and the edge for each edge that each source reaches.

    steps: the relations of each hop and the side ('left' or 'right') that they are entered by. `paths` counts the
    ways that reach the edge's near end: one row stands for all of them, so a frontier holds a node once.
    """
    frontier = sources.select(F.col("key").alias("source_key"), F.col("key").alias("at"), F.lit(1).cast("long").alias("paths"))
    out = None
    for number, (edges, near) in enumerate(steps, 1):
        far = "right" if near == "left" else "left"
        reached = frontier.join(edges, F.col("at") == F.col(f"{near}_key")).drop("at")
        found = reached.select("source_key", F.lit(number).alias("hop"), "paths", "left_key", "right_key", "instance_key", "commit_id", "fields")
        if out is None:
            out = found
        else:
            out = out.select("source_key", "hop", "paths", "left_key", "right_key", "instance_key", "commit_id", F.to_json("fields").alias("fields")) if out.schema["fields"].dataType.typeName() == "struct" else out
            out = out.unionByName(found.withColumn("fields", F.to_json("fields")))
        if number < len(steps):
            frontier = reached.groupBy("source_key", F.col(f"{far}_key").alias("at")).agg(F.sum("paths").alias("paths"))
    return out


def destinations(sources: DataFrame, steps: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """source_key, destination_key, paths: where each source gets to by all steps; itself without any step."""
    frontier = sources.select(F.col("key").alias("source_key"), F.col("key").alias("destination_key"), F.lit(1).cast("long").alias("paths"))
    for edges, near in steps:
        far = "right" if near == "left" else "left"
        pairs = edges.select(F.col(f"{near}_key").alias("destination_key"), F.col(f"{far}_key").alias("_next"))
        reached = frontier.join(pairs, "destination_key")
        frontier = reached.groupBy("source_key", F.col("_next").alias("destination_key")).agg(F.sum("paths").alias("paths"))
    return frontier
