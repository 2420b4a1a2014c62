"""Handlers: functions that events or commits call."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any, Generic, TypeVar

from pyspark.sql import functions as F

from ..errors import CommitChainDepthError, HandlerError
from ..expressions import Filter, Logic, compiled
from ..model import Entity, Event, Relation
from ..operators import temporal
from ..plans.query import _field, entity_of, relation_of

if TYPE_CHECKING:
    from ..session import Session

E = TypeVar("E", bound=Event)


@dataclass(frozen=True)
class Handler:
    """What a decorated function is called for."""

    kind: str
    function: Callable[..., Any]
    priority: int = 100
    event: type[Event] | None = None
    cls: type | None = None
    when: Filter | None = None
    cron: str | None = None
    allow_self_trigger: bool = False

    @property
    def id(self) -> str:
        return f"{self.function.__module__}.{self.function.__qualname__}"

    @property
    def file_name(self) -> str:
        return re.sub(r"[^A-Za-z0-9.-]", "_", self.id)


def _decorator(kind: str, **how: Any):
    def mark(function):
        function.handles = Handler(kind, function, **how)
        return function

    return mark


def on_event(event: type[Event], *, priority: int = 100):
    """Called with a HandlerContext for each event of the class; higher priorities go first."""
    return _decorator("event", event=event, priority=priority)


def on_commit(when: Filter | None = None, allow_self_trigger: bool = False, priority: int = 100):
    """Called with a CommitContext for each commit of others, with allow_self_trigger also for its own.

    when: only for commits that changed an object of the condition's class that satisfies it.
    """
    return _decorator("commit", when=when, cls=_owner(when), allow_self_trigger=allow_self_trigger, priority=priority)


def on_commit_entity(cls: type[Entity], *, when: Filter | None = None, allow_self_trigger: bool = False, priority: int = 100):
    """Called for each changed entity of the class that satisfies `when`."""
    return _decorator("commit_entity", cls=cls, when=when, allow_self_trigger=allow_self_trigger, priority=priority)


def on_commit_relation(cls: type[Relation], *, when: Filter | None = None, allow_self_trigger: bool = False, priority: int = 100):
    return _decorator("commit_relation", cls=cls, when=when, allow_self_trigger=allow_self_trigger, priority=priority)


def _owner(condition: Filter | None) -> type | None:
    """The class whose fields a condition looks at."""
    if condition is None:
        return None
    owners = {_owner(c) for c in condition.parts} if isinstance(condition, Logic) else {condition.ref.owner}
    if len(owners) != 1 or None in owners:
        raise HandlerError("a condition on commits looks at the fields of one class")
    return owners.pop()


def on_schedule(cron: str, *, priority: int = 100):
    """Called once at each match of the cron expression while a commit loop runs."""
    return _decorator("schedule", cron=cron, priority=priority)


def handlers_of(functions: Iterable[Callable[..., Any]]) -> list[Handler]:
    """Checked, in order of priority (descending), then of name."""
    out: list[Handler] = []
    for f in functions:
        if not callable(f):
            raise HandlerError(f"{f!r} is not callable")
        h = getattr(f, "handles", None)
        if not isinstance(h, Handler):
            raise HandlerError(f"{getattr(f, '__qualname__', f)} is not decorated as a handler")
        if any(x.id == h.id for x in out):
            raise HandlerError(f"{h.id} is given twice")
        out.append(h)
    if len({h.kind == "event" for h in out}) > 1:
        raise HandlerError("event handlers and commit handlers run in separate calls")
    return sorted(out, key=lambda h: (-h.priority, h.id))


@dataclass
class HandlerContext(Generic[E]):
    """What an event handler works with. Nothing is stored unless it calls commit()."""

    event: E
    session: Session
    lease_until: dt.datetime | None = None
    commit_meta: dict[str, str] = field(default_factory=dict)
    emitted: list[Event] = field(default_factory=list)

    def ensure(self, obj: Any) -> None:
        self.session.ensure(obj)

    def emit(self, event: Event) -> None:
        """The event is enqueued once the handler has succeeded."""
        self.emitted.append(event)

    def add_commit_meta(self, key: str, value: str) -> None:
        self.commit_meta[key] = value

    def commit(self, *, event: Event | None = None) -> int | None:
        meta, self.commit_meta = self.commit_meta, {}
        return self.session._commit(event=event, meta=meta, parent=self.event, lease_until=self.lease_until)


@dataclass
class CommitContext:
    """What a commit handler works with; its intents are committed when it returns."""

    session: Session
    commit: dict[str, Any] | None = None
    changes: list[dict[str, Any]] = field(default_factory=list)
    obj: Any = None
    commit_meta: dict[str, str] = field(default_factory=dict)

    def ensure(self, obj: Any) -> None:
        self.session.ensure(obj)

    def add_commit_meta(self, key: str, value: str) -> None:
        self.commit_meta[key] = value


def changed_objects(session: Session, handler: Handler, commit_id: int) -> Iterator[Any]:
    """The handler's objects that a commit wrote, a partition at a time: a pruned scan of the commit's files."""
    cls, key = handler.cls, temporal.ENTITY_KEY if issubclass(handler.cls, Entity) else temporal.RELATION_KEY
    rows = session.store.history(cls, lower=commit_id - 1, upper=commit_id)
    if handler.when is not None:
        rows = rows.where(compiled(handler.when, lambda ref: _field(cls, ref, F.col("fields"))))
    for r in temporal.latest(rows, key).orderBy(*key).toLocalIterator():
        yield entity_of(cls, r["key"], r["commit_id"], r["fields"]) if issubclass(cls, Entity) else relation_of(cls, r)


def _calls(session: Session, handler: Handler, commit: dict[str, Any]) -> Iterator[CommitContext]:
    """The calls that a commit makes of a handler."""
    touched = {(t["kind"], t["type_name"]) for t in session.store.manifest(commit["id"])["types"]}
    if handler.cls is not None and (handler.cls.kind, handler.cls.type_name) not in touched:
        return
    if handler.kind != "commit":
        yield from (CommitContext(session, commit, obj=o) for o in changed_objects(session, handler, commit["id"]))
    elif handler.when is None or next(changed_objects(session, handler, commit["id"]), None) is not None:
        yield CommitContext(session, commit, session.list_commit_changes(commit["id"]))


def dispatch_commits(session: Session, handlers: list[Handler]) -> int:
    """Calls commit handlers for every commit after the namespace's cursor; the last commit seen.

    A handler is not called for commits that it made itself, unless it allows that, nor twice for one commit: that
    it has handled a commit is noted in the store until the cursor has passed it, so a loop that broke off goes on
    where it was. Commits that handlers make are one deeper than the commit that caused them; the depth is bounded.
    """
    files, most = session.store.files, session.config.max_commit_chain_depth
    cursor = f"cursors/{session.namespace}.json"
    after = (files.read_json(cursor) or {"commit_id": 0})["commit_id"]
    while due := [i for i in session.store.commit_ids() if i > after]:
        commit = session.store.get_commit(min(due))
        depth = int(commit["metadata"].get("chain_depth", 0)) + 1
        notes = f"dispatched/{session.namespace}/{commit['id']:012d}"
        for h in handlers:
            note = f"{notes}/{h.file_name}.json"
            own = commit["metadata"].get("handler") == h.id and not h.allow_self_trigger
            if h.kind == "schedule" or own or files.exists(note):
                continue
            for ctx in _calls(session, h, commit):
                h.function(ctx)
                if session.pending and depth > most:
                    session.discard()
                    raise CommitChainDepthError(depth, most)
                session._commit(meta={"handler": h.id, "chain_depth": str(depth)} | ctx.commit_meta)
            files.write_json(note, {"handler": h.id})
        after = commit["id"]
        files.write_json(cursor, {"commit_id": after})
        files.delete(notes)
    return after
