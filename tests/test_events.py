"""The event bus, handlers, schedules, commit handlers, streaming."""

from __future__ import annotations

import datetime as dt

import pytest

import strataloom as sl
from strataloom import Config, Schedule, Session
from strataloom.functions.cron import Cron
from strataloom.operators import events as rules

from .models import Arrived, Refresh, Sensor

FAST = Config(event_poll_interval_ms=1, event_backoff_base_ms=0, event_backoff_max_ms=0, event_max_attempts=2)
CALLS: list = []


@sl.on_event(Refresh, priority=200)
def sync(ctx):
    CALLS.append(("refresh", ctx.event.origin))
    ctx.ensure(Sensor(code=ctx.event.origin, place="n", height=1))
    ctx.add_commit_meta("handler", "refresh")
    ctx.emit(Arrived(code=ctx.event.origin))
    ctx.commit()


@sl.on_event(Arrived)
def imported(ctx):
    CALLS.append(("arrived", ctx.event.code, ctx.event.chain_depth))
    ctx.ensure(Sensor(code="never", place="n", height=1))  # not committed


@sl.on_event(Refresh)
def failing(ctx):
    raise RuntimeError("no luck")


def test_events_flow(spark, tmp_path):
    CALLS.clear()
    s = Session(str(tmp_path / "e"), spark=spark, entity_types=[Sensor], config=FAST)
    assert s.commit(event=Refresh(origin="c1")) is None
    s.run([imported, sync], max_iterations=2)
    assert CALLS == [("refresh", "c1"), ("arrived", "c1", 1)]
    assert [c.code for c in s.query().entities(Sensor).collect()] == ["c1"]
    assert s.list_commits()[0]["metadata"]["handler"] == "refresh"
    s.run([imported, sync], max_iterations=1)
    assert len(CALLS) == 2  # acknowledged events do not come back
    events = s.bus.list_events("default")
    assert {e["type"]: e["status"] for e in events} == {"refresh": "acked", "arrived": "acked"}
    assert len({e["root_event_id"] for e in events}) == 1
    new = s.bus.replay("default", next(e["id"] for e in events if e["type"] == "refresh"))
    assert s.bus.inspect_event("default", new)["chain_depth"] == 0
    assert s.bus.list_namespaces()[0]["events"] == 3 and s.bus.list_sessions("default")[0]["alive"]
    assert s.bus.cleanup("default", dt.datetime.now(dt.UTC) + dt.timedelta(days=1)) == 3
    assert s.bus.list_events("default") == []


def test_retry_and_dead_letters(spark, tmp_path):
    s = Session(str(tmp_path / "d"), spark=spark, entity_types=[Sensor], config=FAST)
    s.commit(event=Refresh(origin="x"))
    s.run([failing], max_iterations=1)
    assert s.bus.list_events("default")[0]["status"] == "retry"
    import time

    time.sleep(0.2)
    s.run([failing], max_iterations=1)
    (letter,) = s.bus.list_dead_letters("default")
    assert letter["attempts"] == 2 and "no luck" in letter["last_error"]
    assert {e["type"] for e in s.bus.list_events("default")} == {"refresh", "event.dead_letter"}


def test_leases(spark, tmp_path):
    s = Session(str(tmp_path / "l"), spark=spark, entity_types=[Sensor], config=Config(event_claim_lease_ms=300))
    s.bus.enqueue(Refresh(origin="x"), "default")
    registry = {"refresh": Refresh}
    (first,) = s.bus.claim("default", "h", "s1", ["refresh"], 10, registry)
    assert s.bus.claim("default", "h", "s2", ["refresh"], 10, registry) == []
    assert len(s.bus.claim("default", "other", "s2", ["refresh"], 10, registry)) == 1
    import time

    time.sleep(0.4)
    (second,) = s.bus.claim("default", "h", "s2", ["refresh"], 10, registry)  # the lease ended
    assert second.attempt == first.attempt + 1
    s.bus.ack("default", "h", second)
    assert s.bus.claim("default", "h", "s2", ["refresh"], 10, registry) == []
    s.ensure(Sensor(code="a", place="a", height=1))
    with pytest.raises(sl.LeaseExpiredError):
        s._commit(lease_until=first.lease_until)


def test_chain_limit(spark, tmp_path):
    s = Session(str(tmp_path / "q"), spark=spark, config=Config(max_event_chain_depth=1))
    parent = Refresh(origin="x")
    s.bus.enqueue(parent, "default")
    child = Refresh(origin="y")
    s.bus.enqueue(child, "default", parent)
    with pytest.raises(sl.EventLoopLimitError):
        s.bus.enqueue(Refresh(origin="z"), "default", child)


def test_handler_errors(spark, tmp_path):
    s = Session(str(tmp_path / "x"), spark=spark)
    for bad in ([lambda ctx: None], [sync, sync], [5]):
        with pytest.raises(sl.HandlerError):
            s.run(bad, max_iterations=1)


def test_commit_handlers(spark, tmp_path):
    seen = []

    @sl.on_commit_entity(Sensor, when=Sensor.height > 10)
    def adults(ctx):
        seen.append(ctx.obj.code)
        if ctx.obj.height < 12:
            ctx.ensure(Sensor(code=ctx.obj.code + "x", place="n", height=ctx.obj.height + 1))

    @sl.on_commit(priority=1)
    def every(ctx):
        seen.append(len(ctx.changes))

    s = Session(str(tmp_path / "o"), spark=spark, entity_types=[Sensor])
    s.ensure([Sensor(code="a", place="n", height=11), Sensor(code="b", place="n", height=5)])
    s.run([every, adults])
    # Its own commit does not call `adults` again.
    assert seen == ["a", 2, 1]
    s.run([every, adults])
    assert len(seen) == 3


def test_commit_handlers_go_on_after_a_crash(spark, tmp_path):
    calls = []

    @sl.on_commit(priority=9)
    def first(ctx):
        calls.append("first")

    @sl.on_commit(priority=1)
    def second(ctx):
        calls.append("second")
        if calls.count("second") == 1:
            raise RuntimeError("broken off")

    s = Session(str(tmp_path / "g"), spark=spark, entity_types=[Sensor])
    s.ensure(Sensor(code="a", place="p", height=1))
    s.commit()
    with pytest.raises(RuntimeError):
        s.run([first, second])
    s.run([first, second])
    assert calls == ["first", "second", "second"]


def test_own_commits_and_conditions_on_commits(spark, tmp_path):
    calls = []

    @sl.on_commit_entity(Sensor, allow_self_trigger=True)
    def climbs(ctx):
        calls.append(ctx.obj.height)
        if ctx.obj.height < 3:
            ctx.ensure(Sensor(code="a", place="p", height=ctx.obj.height + 1))

    @sl.on_commit(when=(Sensor.height > 2) & (Sensor.place == "p"))
    def high(ctx):
        calls.append([c["key"] for c in ctx.changes])

    s = Session(str(tmp_path / "i"), spark=spark, entity_types=[Sensor])
    s.ensure(Sensor(code="a", place="p", height=1))
    s.run([climbs, high])
    assert calls == [1, 2, 3, ["a"]]
    with pytest.raises(sl.HandlerError):
        sl.on_commit(when=(Sensor.height > 2) | (Refresh.origin == "x"))


def test_old_events_go_by_the_day(spark, tmp_path):
    s = Session(str(tmp_path / "r"), spark=spark, entity_types=[Sensor], config=Config(event_poll_interval_ms=1, event_retention_ms=36 * 3_600_000))
    t = dt.datetime.now(dt.UTC)
    kept = []
    for hours in (1, 20, 40, 80, 200):
        event = s.bus.stamped(Refresh(origin=str(hours)))
        event.created_at = (t - dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S.%f")
        s.bus._put(s.bus._row(event, "default"))
        s.bus._note("default", "h", event, 0, "ack")
        kept += [event.id] * (hours < 36)
    s.run([sync], max_iterations=1)
    assert {e["id"] for e in s.bus.list_events("default") if e["type"] == "refresh"} == set(kept)
    assert {r["event_id"] for r in s.bus.log_df("default", ["h"]).collect()} == set(kept)


def test_streaming(spark, tmp_path):
    CALLS.clear()
    s = Session(str(tmp_path / "st"), spark=spark, entity_types=[Sensor], config=FAST)
    s.commit(event=Refresh(origin="c7"))
    q = s.stream_events([sync], str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    assert ("refresh", "c7") in CALLS and s.query().entities(Sensor).count() == 1
    typed = s.bus.stream("default", Refresh).select("payload.origin")
    out = typed.writeStream.format("memory").queryName("sync_events").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert [r.origin for r in spark.sql("select origin from sync_events").collect()] == ["c7"]


def test_cron(spark):
    c = Cron.parse("*/15 9-17 * * 1,2,3,4,5")
    assert c.matches(dt.datetime(2024, 1, 1, 9, 30)) and not c.matches(dt.datetime(2024, 1, 6, 9, 30))
    assert c.next_after(dt.datetime(2024, 1, 5, 17, 45)) == dt.datetime(2024, 1, 8, 9, 0)
    assert Cron.parse("0 0 13 * 5").next_after(dt.datetime(2024, 1, 1)) == dt.datetime(2024, 9, 13)  # day and weekday
    assert Cron.parse("0 0 * * 7").weekday == Cron.parse("0 0 * * 0").weekday
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            Cron.parse(bad)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    fires = [r.ts for r in c.fires_between(spark, start, start + dt.timedelta(days=7)).orderBy("ts").collect()]
    assert len(fires) == 5 * 9 * 4 and fires[0].hour == 9
    assert Schedule(event=Refresh(origin="a"), cron="* * * * *").cron == "* * * * *"
    assert spark.range(4).select(rules.backoff_ms(__import__("pyspark").sql.functions.col("id"), 250, 1000).alias("w")).toPandas().w.tolist() == [250, 500, 1000, 1000]
