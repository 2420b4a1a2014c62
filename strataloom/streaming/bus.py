"""The event bus: append-only JSON files that are both a batch table and a streaming source.

    events/<namespace>/<type>/<day>/<id>.json       the event: envelope and payload
    claims/<namespace>/<handler>/<day>/<...>.json   the claim log; creating a claim's file is what claims
    sessions/<namespace>/<id>.json                  heartbeats

A handler's poll reads the events of its types and its own claims, and cleanup drops whole days; the day of a claim is
that of its event. Two sessions cannot claim the same attempt, as one step of the store creates its file. An event is delivered at
least once to each handler: a claim whose lease ended is free again.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import EventLoopLimitError, HandlerError
from ..model import Event, EventDeadLetter
from ..operators import events as rules
from ..sources.store import Store, now

EVENTS = "id string, namespace string, type string, payload string, created_at string, priority int, root_event_id string, chain_depth int"
LOG = "event_id string, handler_id string, attempt int, kind string, session_id string, at string, lease_until string, available_at string, error string"
SESSIONS = "session_id string, namespace string, started_at string, heartbeat_at string, metadata string"


def iso(t: dt.datetime) -> str:
    return t.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")


def _safe(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9.-]", "_", text)


@dataclass
class Claimed:
    event: Event
    attempt: int
    failures: int
    lease_until: dt.datetime


class EventBus:
    def __init__(self, store: Store, config: Config):
        self.store, self.config, self.spark, self.files = store, config, store.spark, store.files

    # --- tables ----------------------------------------------------------------------------------------------------

    def _table(self, folder: str, schema: str, namespace: str | None, parts: Sequence[str] = ()) -> DataFrame:
        """The rows of a folder; of some of a namespace's parts, or of all namespaces."""
        found = [f"{namespace}/{_safe(p)}" for p in parts] or ([namespace] if namespace else self.files.names(folder))
        paths = [f"{self.files.root}/{folder}/{n}" for n in found if self.files.exists(f"{folder}/{n}")]
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        return reader.json(paths) if paths else self.spark.createDataFrame([], schema)

    def events_df(self, namespace: str | None = None, types: Sequence[str] = ()) -> DataFrame:
        return self._table("events", EVENTS, namespace, types)

    def log_df(self, namespace: str | None = None, handlers: Sequence[str] = ()) -> DataFrame:
        return self._table("claims", LOG, namespace, handlers)

    def sessions_df(self, namespace: str | None = None) -> DataFrame:
        return self._table("sessions", SESSIONS, namespace)

    # --- events ----------------------------------------------------------------------------------------------------

    def stamped(self, event: Event, parent: Event | None = None) -> Event:
        """The event named, dated and placed in its chain; an error if the chain is too long."""
        event.id, event.created_at = event.id or str(uuid.uuid4()), iso(now())
        root, depth = (event.root_event_id, 0) if parent is None else (parent.root_event_id or parent.id, parent.chain_depth + 1)
        if depth > self.config.max_event_chain_depth:
            raise EventLoopLimitError(depth, self.config.max_event_chain_depth)
        event.root_event_id, event.chain_depth = root or event.id, depth
        return event

    def enqueue(self, event: Event, namespace: str, parent: Event | None = None) -> str:
        return self._put(self._row(self.stamped(event, parent), namespace))

    def _put(self, row: dict[str, Any]) -> str:
        self.files.create_json(f"events/{row['namespace']}/{_safe(row['type'])}/{row['created_at'][:10]}/{row['id']}.json", row)
        return row["id"]

    def _found(self, namespace: str, event_id: str) -> dict[str, Any] | None:
        for name in self.files.matching(f"events/{namespace}/*/*/{event_id}.json"):
            return self.files.read_json(name)
        return None

    def _row(self, event: Event, namespace: str) -> dict[str, Any]:
        payload = {n: f.type.to_row(event.__dict__[n]) for n, f in event.data_fields().items()}
        envelope = {k: getattr(event, k) for k in ("id", "created_at", "priority", "root_event_id", "chain_depth")}
        return envelope | {"namespace": namespace, "type": event.event_type, "payload": json.dumps(payload, default=str)}

    @staticmethod
    def event_of(row: Any, registry: dict[str, type[Event]]) -> Event:
        cls = registry.get(row["type"])
        if cls is None:
            raise HandlerError(f"no class for events of type {row['type']!r}")
        payload = json.loads(row["payload"])
        event = cls(**{n: f.type.from_row(payload.get(n)) if f.type.kind == "json" else payload.get(n) for n, f in cls.data_fields().items()})
        event.id, event.created_at, event.priority = row["id"], row["created_at"], row["priority"]
        event.root_event_id, event.chain_depth = row["root_event_id"], row["chain_depth"]
        return event

    def _note(self, namespace: str, handler_id: str, event: Event, attempt: int, kind: str, **more: Any) -> bool:
        name = f"claims/{namespace}/{_safe(handler_id)}/{event.created_at[:10]}/{event.id}~{attempt:06d}~{kind}.json"
        return self.files.claim(name, {"event_id": event.id, "handler_id": handler_id, "attempt": attempt, "kind": kind, "at": iso(now()), **more})

    def offers(self, namespace: str, wants: Sequence[tuple[str, str]], limit: int, total: int) -> list[Any]:
        """What handlers may take now, handler by handler; wants: (handler, event type) in the handlers' order.

        At most `limit` a handler and `total` in all: the total goes to the first handlers.
        """
        if not wants:
            return []
        order = {h: i for i, h in enumerate(dict.fromkeys(h for h, _ in wants))}
        frame = self.spark.createDataFrame([(h, t, order[h]) for h, t in wants], "handler_id string, type string, rank int")
        events = self.events_df(namespace, sorted({t for _, t in wants}))
        free = rules.offers(events, self.log_df(namespace, sorted(order)), frame, iso(now()), limit)
        return free.orderBy("rank", "turn").limit(total).collect()

    def take(self, offer: Any, session_id: str, registry: dict[str, type[Event]]) -> Claimed | None:
        """Claims an offered event; None if another session was first."""
        event = self.event_of(offer, registry)
        attempt = 0 if offer["attempt"] is None else offer["attempt"] + 1
        until = now() + dt.timedelta(milliseconds=self.config.event_claim_lease_ms)
        mine = self._note(offer["namespace"], offer["handler_id"], event, attempt, "claim", session_id=session_id, lease_until=iso(until))
        return Claimed(event, attempt, offer["failures"] or 0, until) if mine else None

    def claim(self, namespace: str, handler_id: str, session_id: str, types: Sequence[str], limit: int, registry: dict[str, type[Event]]) -> list[Claimed]:
        """Takes up to `limit` free events for one handler."""
        taken = [self.take(o, session_id, registry) for o in self.offers(namespace, [(handler_id, t) for t in types], limit, limit)]
        return [c for c in taken if c is not None]

    def ack(self, namespace: str, handler_id: str, claimed: Claimed) -> None:
        self._note(namespace, handler_id, claimed.event, claimed.attempt, "ack")

    def release(self, namespace: str, handler_id: str, claimed: Claimed, error: str) -> bool:
        """Gives a failed event back, later each time; True if it was given up and a dead letter enqueued."""
        event, failures = claimed.event, claimed.failures + 1
        if failures < self.config.event_max_attempts:
            wait = min(self.config.event_backoff_base_ms * 2**claimed.failures, self.config.event_backoff_max_ms) + random.randint(0, 100)
            self._note(namespace, handler_id, event, claimed.attempt, "release", error=error, available_at=iso(now() + dt.timedelta(milliseconds=wait)))
            return False
        self._note(namespace, handler_id, event, claimed.attempt, "dead", error=error)
        letter = self.stamped(EventDeadLetter(event_id=event.id, handler_id=handler_id, attempts=failures, last_error=error))
        self._put(self._row(letter, namespace) | {"root_event_id": event.root_event_id, "chain_depth": event.chain_depth})
        return True

    def replay(self, namespace: str, event_id: str) -> str | None:
        """A new event with the old one's payload, at depth 0."""
        row, new = self._found(namespace, event_id), str(uuid.uuid4())
        return None if row is None else self._put(row | {"id": new, "root_event_id": new, "chain_depth": 0, "created_at": iso(now())})

    def cleanup(self, namespace: str, before: dt.datetime) -> int:
        """Deletes events created before a time, with their claims: whole days, and one by one those of the last day."""
        bound = iso(before)
        last, deleted, ids = bound[:10], 0, set()
        for name in self.files.matching(f"events/{namespace}/*/*"):
            day = name.rsplit("/", 1)[1]
            if day < last:
                deleted += len(self.files.names(name))
                self.files.delete(name)
            elif day == last:
                rows = self.spark.read.schema(EVENTS).json(f"{self.files.root}/{name}").where(F.col("created_at") < bound).select("id")
                old = {r["id"] for r in rows.toLocalIterator()}
                for event_id in old:
                    self.files.delete(f"{name}/{event_id}.json")
                ids |= old
        for name in self.files.matching(f"claims/{namespace}/*/*"):
            day = name.rsplit("/", 1)[1]
            if day < last:
                self.files.delete(name)
            elif day == last:
                for claim in self.files.names(name):
                    if claim.split("~")[0] in ids:
                        self.files.delete(f"{name}/{claim}")
        return deleted + len(ids)

    # --- sessions and introspection -----------------------------------------------------------------------------------

    def register(self, session_id: str, namespace: str, metadata: dict[str, Any]) -> None:
        t = iso(now())
        self.files.write_json(f"sessions/{namespace}/{session_id}.json", {"session_id": session_id, "namespace": namespace, "started_at": t, "heartbeat_at": t, "metadata": json.dumps(metadata)})

    def heartbeat(self, session_id: str, namespace: str) -> None:
        row = self.files.read_json(f"sessions/{namespace}/{session_id}.json")
        if row is not None:
            self.files.write_json(f"sessions/{namespace}/{session_id}.json", row | {"heartbeat_at": iso(now())})

    def _alive_since(self) -> str:
        return iso(now() - dt.timedelta(milliseconds=self.config.session_ttl_ms))

    def list_sessions(self, namespace: str) -> list[dict[str, Any]]:
        rows = self.sessions_df(namespace).withColumn("alive", F.col("heartbeat_at") >= self._alive_since())
        return [r.asDict() for r in rows.orderBy("started_at").collect()]

    def list_namespaces(self) -> list[dict[str, Any]]:
        rows = rules.namespaces(self.events_df(), self.log_df(), self.sessions_df(), iso(now()), self._alive_since())
        return [r.asDict() for r in rows.orderBy("namespace").collect()]

    def list_events(self, namespace: str, limit: int = 100, status: str | None = None) -> list[dict[str, Any]]:
        rows = rules.statuses(self.events_df(namespace), self.log_df(namespace), iso(now()))
        if status:
            rows = rows.where(F.col("status") == status)
        return [r.asDict() for r in rows.orderBy(F.desc("created_at"), "id").limit(limit).collect()]

    def list_dead_letters(self, namespace: str, limit: int = 100) -> list[dict[str, Any]]:
        rows = rules.claims(self.log_df(namespace)).where("dead_lettered_at is not null")
        rows = rows.select("event_id", "handler_id", F.col("failures").alias("attempts"), "last_error", "dead_lettered_at")
        return [r.asDict() for r in rows.orderBy(F.desc("dead_lettered_at"), "event_id").limit(limit).collect()]

    def inspect_event(self, namespace: str, event_id: str) -> dict[str, Any] | None:
        row = self._found(namespace, event_id)
        if row is None:
            return None
        found = rules.claims(self.log_df(namespace).where(F.col("event_id") == event_id)).orderBy("handler_id").collect()
        return row | {"claims": [r.asDict() for r in found]}

    # --- streaming -----------------------------------------------------------------------------------------------------

    def stream(self, namespace: str, event: type[Event] | None = None) -> DataFrame:
        """New events as a stream; with an event class its payload is a struct."""
        folder = f"events/{namespace}" if event is None else f"events/{namespace}/{_safe(event.event_type)}"
        if not self.files.exists(folder):
            self.files._fs.mkdirs(self.files._at(folder))
        rows = self.spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(f"{self.files.root}/{folder}")
        if event is None:
            return rows
        return rows.where(F.col("type") == event.event_type).withColumn("payload", F.from_json("payload", event.payload()))
