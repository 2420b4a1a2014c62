"""The event bus's rules as DataFrame functions: which events are free, what state they are in, when to retry.

events: id, namespace, type, created_at, priority, ...; log: the claim log with event_id, handler_id, attempt, kind
(claim, ack, release or dead), session_id, at, lease_until, available_at, error. Times are ISO text in UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claims(log: DataFrame) -> DataFrame:
    """One row for each event and handler: attempts so far, failures, and how it stands."""
    return log.groupBy("event_id", "handler_id").agg(
        F.max("attempt").alias("attempt"),
        F.sum(F.when(F.col("kind").isin("release", "dead"), 1).otherwise(0)).alias("failures"),
        F.max(F.when(F.col("kind") == "ack", F.col("at"))).alias("ack_at"),
        F.max(F.when(F.col("kind") == "dead", F.col("at"))).alias("dead_lettered_at"),
        F.max(F.when(F.col("kind") == "claim", F.col("attempt"))).alias("claimed"),
        F.max(F.when(F.col("kind") != "claim", F.col("attempt"))).alias("settled"),
        F.max_by("lease_until", F.when(F.col("kind") == "claim", F.col("attempt"))).alias("lease_until"),
        F.max_by("session_id", F.when(F.col("kind") == "claim", F.col("attempt"))).alias("session_id"),
        F.max_by("available_at", F.when(F.col("kind") == "release", F.col("attempt"))).alias("available_at"),
        F.max_by("error", F.when(F.col("kind").isin("release", "dead"), F.col("attempt"))).alias("last_error"),
    )


_STANDS = ("attempt", "failures", "ack_at", "dead_lettered_at", "claimed", "settled", "lease_until", "available_at")


def _free(now: str) -> Column:
    """Whether an event's claims, joined to it, leave it to a handler."""
    held = F.coalesce(F.col("claimed") > F.coalesce("settled", F.lit(-1)), F.lit(False)) & F.coalesce(F.col("lease_until") > now, F.lit(False))
    return F.col("ack_at").isNull() & F.col("dead_lettered_at").isNull() & ~held & F.coalesce(F.col("available_at") <= now, F.lit(True))


def offers(events: DataFrame, log: DataFrame, wants: DataFrame, now: str, limit: int) -> DataFrame:
    """The events that each handler may take, at most `limit` a handler: highest priority first, then oldest.

    wants: handler_id, type, rank (the handlers' order), a row for each handler and type. One join serves all handlers;
    the limit runs before the rows of a handler meet.
    """
    stand = claims(log).select(F.col("event_id").alias("id"), "handler_id", *_STANDS)
    turn = Window.partitionBy("handler_id").orderBy(F.desc("priority"), "created_at", "id")
    free = events.join(F.broadcast(wants), "type").join(stand, ["id", "handler_id"], "left").where(_free(now))
    return free.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)


def claimable(events: DataFrame, log: DataFrame, handler_id: str, types: Sequence[str], now: str) -> DataFrame:
    """The events that one handler may take, with `failures` and the last `attempt`: highest priority first, then oldest."""
    mine = claims(log.where(F.col("handler_id") == handler_id)).select(F.col("event_id").alias("id"), *_STANDS)
    return events.where(F.col("type").isin(list(types))).join(mine, "id", "left").where(_free(now)).orderBy(F.desc("priority"), "created_at", "id")


def backoff_ms(failures: Column | int, base_ms: int, most_ms: int) -> Column:
    """The wait after the failures so far, without jitter: doubles up to a bound."""
    column = F.lit(failures) if isinstance(failures, int) else failures
    return F.least(F.lit(base_ms).cast("double") * F.pow(F.lit(2.0), column), F.lit(most_ms).cast("double")).cast("long")


def statuses(events: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """events with `status`: dead_letter, acked, claimed, retry or pending, over all handlers."""
    held = (F.col("claimed") > F.coalesce("settled", F.lit(-1))) & (F.col("lease_until") > now)
    flags = claims(log).groupBy("event_id").agg(
        F.max(F.col("dead_lettered_at").isNotNull()).alias("dead"),
        F.min(F.col("ack_at").isNotNull()).alias("acked"),
        F.max(F.coalesce(held, F.lit(False))).alias("held"),
        F.max(F.col("failures") > 0).alias("failed"),
    )
    status = F.when(F.col("dead"), "dead_letter").when(F.col("acked"), "acked").when(F.col("held"), "claimed").when(F.col("failed"), "retry").otherwise("pending")
    return events.join(flags, F.col("id") == F.col("event_id"), "left").withColumn("status", status).drop("event_id", "dead", "acked", "held", "failed")


def namespaces(events: DataFrame, log: DataFrame, sessions: DataFrame, now: str, alive_since: str) -> DataFrame:
    """namespace, events and counts by status, live sessions."""
    counted = statuses(events, log, now).groupBy("namespace").agg(
        F.count("*").alias("events"),
        *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("pending", "claimed", "retry", "acked", "dead_letter")],
    )
    live = sessions.where(F.col("heartbeat_at") >= alive_since).groupBy("namespace").agg(F.count("*").alias("live_sessions"))
    return counted.join(live, "namespace", "full_outer").fillna(0)


def causal_depth_ok(depth: Column, most: int) -> Column:
    """Whether events of a chain may still be enqueued."""
    return depth <= most
