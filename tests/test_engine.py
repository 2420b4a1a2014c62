"""Sessions, queries, traversals, history, schemas."""

from __future__ import annotations

import collections
import json

import pytest

import strataloom as sl
from strataloom import Config, Entity, Field, Session, count, left, right
from strataloom.errors import StorageBackendError
from strataloom.sources import store

from .models import Beside, Mount, Probe, Reading, Sensor, Service, Station

TYPES = {"entity_types": [Sensor, Station, Reading, Probe], "relation_types": [Mount, Beside, Service]}


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    """Four sensors, three stations and their mounts by commit 1, six readings by commit 2."""
    s = Session(str(tmp_path_factory.mktemp("field")), spark=spark, **TYPES)
    with s:
        s.ensure(Sensor(code=c, place=p, height=h, note=n, grade=g, live=on) for c, p, h, n, g, on in [
            ("a", "ridge", 120, "icy", "fine", True), ("b", "river", 8, None, "plain", True), ("c", "roof", 35, "dusty", "fine", False), ("d", "bridge", 15, None, "plain", True),
        ])
        s.ensure([Station(site="n", power=2.5), Station(site="m", power=7.25, net="coast"), Station(site="k", power=0.5, net="coast")])
        s.ensure(Mount(left_key=x, right_key=y, slots=n, firm=f) for x, y, n, f in [("a", "n", 4, True), ("a", "m", 6, False), ("b", "m", 1, True), ("c", "k", 9, True)])
    s.ensure(Reading(number=i, level=i * 1.5, unit="mm" if i % 3 else "cm") for i in range(1, 7))
    assert s.commit() == 2
    return s


def codes(rows):
    return "".join(sorted(r.code for r in rows))


@pytest.mark.parametrize(
    "condition,want",
    [
        (lambda: Sensor.height > 15, "ac"),
        (lambda: (Sensor.height >= 15) & (Sensor.height <= 35), "cd"),
        (lambda: Sensor.height < 15, "b"),
        (lambda: (Sensor.grade == "fine") & Sensor.live.is_true(), "a"),
        (lambda: Sensor.live.is_false(), "c"),
        (lambda: Sensor.note.is_null(), "bd"),
        (lambda: Sensor.note.is_not_null(), "ac"),
        (lambda: Sensor.note != "icy", "c"),  # null is neither equal nor different
        (lambda: ~(Sensor.note == "icy"), "c"),
        (lambda: Sensor.place.startswith("ri") | Sensor.place.endswith("oof"), "abc"),
        (lambda: Sensor.place.contains("ridge"), "ad"),
        (lambda: Sensor.place.startswith("%") | Sensor.place.contains("_"), ""),
        (lambda: Sensor.grade.in_(["fine", "other"]), "ac"),
        (lambda: Sensor.grade.in_([]), ""),
    ],
)
def test_conditions(field, condition, want):
    assert codes(field.query().entities(Sensor).where(condition()).collect()) == want


def test_python_comparisons_that_mislead_are_refused():
    with pytest.raises(TypeError):
        Sensor.note == None  # noqa: B015, E711
    with pytest.raises(TypeError):
        Sensor.live == True  # noqa: B015, E712


def test_pages(field):
    q = field.query().entities(Sensor)
    by_height = q.order_by(Sensor.height)
    assert [x.code for x in by_height.collect()] == ["b", "d", "c", "a"] and [x.code for x in q.order_by(Sensor.height, desc=True).limit(1).collect()] == ["a"]
    assert [x.code for x in by_height.offset(1).limit(2).collect()] == ["d", "c"] and [x.code for x in by_height.offset(3).collect()] == ["a"]
    assert by_height.first().code == "b" and q.where(Sensor.height > 1000).first() is None
    assert {x.code for x in q.order_by(Sensor.note).limit(2).collect()} == {"b", "d"}  # nulls are smallest


def test_metadata(field):
    found = field.query().entities(Reading).where(Reading.number == 4).first()
    assert (found.meta().key, found.meta().commit_id, found.meta().type_name, found.level) == ("4", 2, "Reading", 6.0)
    with pytest.raises(sl.MetadataUnavailableError):
        Reading(number=9, level=1.0).meta()


def test_aggregates(field):
    q, level = field.query().entities(Reading), Reading.level
    assert (q.count(), q.sum(level), q.avg(level), q.min(level), q.max(level)) == (6, 31.5, 5.25, 1.5, 9.0)
    assert q.where(Reading.unit == "none").sum(level) is None and q.count_where(level > 5) == 3
    groups = {r["unit"]: (r["n"], r["all"]) for r in q.group_by(Reading.unit).agg(n=sl.count(), all=sl.sum(level))}
    assert groups == {"mm": (4, 18.0), "cm": (2, 13.5)}
    for limit, want in ((15, ["mm"]), (1, ["cm", "mm"]), (99, [])):
        assert sorted(r["unit"] for r in q.group_by(Reading.unit).having(sl.sum(level) > limit).agg(n=sl.count())) == want


def test_relations_and_endpoints(field):
    q = field.query().relations(Mount)
    near, far = left(Mount), right(Mount)
    for condition, want in (
        (near.grade == "fine", 3),
        (far.net == "coast", 3),
        ((Mount.slots > 4) & (near.grade == "fine"), 2),
        ((near.place == "river") | (Mount.slots == 4), 2),
        (~(near.grade == "fine"), 1),
        ((near.grade == "fine") & (far.power > 5), 1),
    ):
        assert q.where(condition).count() == want
    assert (q.sum(Mount.slots), q.avg(Mount.slots), q.min(Mount.slots), q.max(Mount.slots)) == (20, 5.0, 1, 9)
    found = q.where(Mount.slots == 6).first()
    assert (found.left.place, found.right.net, found.left_key, found.meta().right_key, found.firm) == ("ridge", "coast", "a", "m", False)
    assert {r["grade"]: r["slots"] for r in q.group_by(near.grade).agg(slots=sl.sum(Mount.slots))} == {"fine": 19, "plain": 1}
    assert {r["net"]: r["n"] for r in q.group_by(far.net).agg(n=sl.count())} == {"inland": 1, "coast": 3}
    with pytest.raises(ValueError):
        near.grade.any_path("x")


def test_traversal(field):
    q = field.query().entities(Sensor)
    (path,) = q.where(Sensor.place == "ridge").via(Mount).collect()
    assert [r.right_key for r in path.relations] == ["m", "n"] and {e.site for e in path.entities[1:]} == {"m", "n"}
    assert sorted(x.site for x in q.where(Sensor.grade == "fine").via(Mount).without_relations()) == ["k", "m", "n"]
    (alone,) = q.via(Mount).where(Sensor.code == "d").collect()
    assert alone.relations == [] and alone.entities == [alone.source]
    # Sensor -> Station -> Sensor: the second hop is entered from the right side.
    (both,) = q.where(Sensor.code == "b").via(Mount).via(Mount).collect()
    assert sorted((r.left_key, r.right_key) for r in both.relations) == [("a", "m"), ("b", "m"), ("b", "m")]
    ends = {(r.source_key, r.destination_key): r.paths for r in q.via(Mount).via(Mount).destinations_df().collect()}
    assert ends == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1, ("c", "c"): 1}
    for t in (q.via(Mount), q.via(Mount).via(Mount), q.where(Sensor.place == "nowhere").via(Mount)):
        assert sorted((p.source.code, [(type(r), r.meta()) for r in p.relations]) for p in t.collect()) == [(p.source.code, [(type(r), r.meta()) for r in p.relations]) for p in t.iterate()]
        told = collections.Counter({(r.type_name, r.key): 0 for r in t.without_relations_df().collect()})
        for r in t.without_relations_df().collect():
            told[r.type_name, r.key] += r.times
        assert told == collections.Counter((type(e).type_name, e.key) for e in t.without_relations())


def test_fields_by_name(field):
    q = field.query().entities(Sensor)
    assert [e.code for e in q.order_by("code", desc=True).collect()] == [e.code for e in q.order_by(Sensor.code, desc=True).collect()]
    assert {r["place"] for r in q.group_by("place").agg(n=count())} == {e.place for e in q.collect()}
    mounts = field.query().relations(Mount)
    assert sorted(map(str, mounts.group_by("left.place").agg(n=count()))) == sorted(map(str, mounts.group_by(left(Mount).place).agg(n=count())))
    with pytest.raises(ValueError, match="invalid path"):
        q.order_by("a b")


def test_other_engine(spark, tmp_path):
    Session(str(tmp_path / "e"), spark=spark, entity_types=[Sensor])
    (tmp_path / "e" / "engine.json").write_text(json.dumps({"engine": "v9"}))
    with pytest.raises(StorageBackendError, match="'v9'"):
        Session(str(tmp_path / "e"), spark=spark, entity_types=[Sensor])


def test_history_and_noop(spark, tmp_path):
    s = Session(str(tmp_path / "h"), spark=spark, entity_types=[Sensor])

    def written(*heights):
        s.ensure(Sensor(code=c, place="p", height=h) for c, h in heights)
        return s.commit()

    assert [written(("x", 1)), written(("x", 1)), written(("x", 2), ("y", 7), ("x", 3))] == [1, None, 2]
    q = s.query().entities(Sensor).where(Sensor.code == "x")
    assert [v.height for v in q.with_history().collect()] == [1, 3]  # the last intent of a commit wins
    assert [v.height for v in q.history_since(1).collect()] == [3] and [v.height for v in q.with_history().limit(1).collect()] == [1]
    assert [v.height for v in q.as_of(1).collect()] == [1]
    assert q.as_of(0).collect() == [] and q.as_of(2).first() == q.first()
    told = {"type_kind": "entity", "type_name": "Sensor"}
    assert s.list_commit_changes(2) == [told | {"key": "x", "operation": "update_version"}, told | {"key": "y", "operation": "insert"}]
    assert [c["id"] for c in s.list_commits()] == [2, 1] and s.get_commit(9) is None
    assert s.store.count_commit_operations(2) == 2 and s.store.count_latest(Sensor) == 2
    assert s.store.point(Sensor, "x")["fields"]["height"] == 3
    assert [len(b) for b in s.store.latest_batches(Sensor, 1)] == [1, 1]
    assert s.store.manifest(2)["types"][0]["rows"] == 2 and s.store.verify_files(1) == s.store.verify_files(2) == []
    path = s.store.manifest(1)["types"][0]["path"]
    name = s.store.manifest(1)["types"][0]["files"][0]["name"]
    s.store.files._put(f"{path}/{name.removesuffix('.parquet')}-more.parquet", s.store.files.read(f"{path}/{name}"), True)
    assert s.store.verify_files(1) == [path]


def test_versioned_endpoints(spark, tmp_path):
    """Conditions on endpoints see the endpoints under the query's mode; hydration sees the latest unless told."""
    s = Session(str(tmp_path / "v"), spark=spark, **TYPES)
    for grade, power in (("plain", 1.0), ("fine", 2.0), ("plain", 3.0)):
        s.ensure([Sensor(code="a", place="p", height=1, grade=grade), Station(site="n", power=power), Mount(left_key="a", right_key="n", slots=1)])
        s.commit()
    q = s.query().relations(Mount)
    assert [q.where(left(Mount).grade == "fine").as_of(n).count() for n in (1, 2, 3)] == [0, 1, 0]
    assert [q.where(right(Mount).power >= 2.0).as_of(n).count() for n in (1, 2, 3)] == [0, 1, 1]
    assert [q.as_of(2).collect(m)[0].left.grade for m in ("latest", "as_of")] == ["plain", "fine"]
    assert q.with_history().count() == 1


def test_keyed_relations(spark, tmp_path):
    s = Session(str(tmp_path / "k"), spark=spark, relation_types=[Service])
    s.ensure(Service(left_key="a", right_key="n", visit=v, crew=c) for v, c in [("spring", "two"), ("fall", "one")])
    s.commit()
    found = s.query().relations(Service).collect()
    assert sorted((r.visit, r.instance_key, r.crew, r.left) for r in found) == [("fall", "fall", "one", None), ("spring", "spring", "two", None)]
    assert "visit" not in found[0].model_dump()
    for bad in ({}, {"visit": " "}):
        with pytest.raises(ValueError):
            Service(left_key="a", right_key="n", crew="x", **bad)


def test_paths_and_lists(spark, tmp_path):
    s = Session(str(tmp_path / "p"), spark=spark, entity_types=[Probe])

    def probe(pid, grid, mark, pings, labels, extra):
        return Probe(pid=pid, survey={"spot": {"grid": grid, "sheet": 3}, "mark": mark}, pings=[{"sort": k, "at": t} for k, t in pings], labels=labels, extra=extra, rates={"r": mark / 2})

    s.ensure([probe("x", "J4", 12, [("echo", 5), ("drop", 9)], ["deep", "old"], {"k": {"n": 3, "e": None, "ok": True}}), probe("y", "B2", 4, [("drop", 2)], ["old"], {"k": {"n": "q"}}), probe("z", "J4", 20, [], [], {})])
    s.commit()
    s.ensure(probe("y", "B2", 4, [("drop", 2)], ["old"], {"k": {"n": "q"}}))
    assert s.commit() is None  # maps and lists compare deeply
    q = s.query().entities(Probe)
    for condition, want in (
        (Probe.survey.path("spot.grid") == "J4", "xz"),
        (Probe.survey["mark"] > 10, "xz"),
        (Probe.rates["r"] <= 6.0, "xy"),
        (Probe.rates["none"].is_null(), "xyz"),
        (Probe.extra.path("k.n") == 3, "x"),
        (Probe.extra.path("k.n") == "q", "y"),
        (Probe.extra.path("k.e").is_null(), "xyz"),
        (Probe.extra.path("k.ok").is_true(), "x"),
        (Probe.pings.any_path("sort") == "drop", "xy"),
        (~(Probe.pings.any_path("at") > 4), "yz"),
        (Probe.pings.any_path("sort").in_(["echo", "none"]), "x"),
        (Probe.labels.any_path("any") == "deep", "x"),
    ):
        assert "".join(sorted(p.pid for p in q.where(condition).collect())) == want
    assert q.count_where(Probe.pings.any_path("sort") == "echo") == 1
    assert (q.avg_len(Probe.pings), q.avg_len(Probe.labels), q.avg(Probe.survey.path("mark"))) == (1.0, 1.0, 12.0)
    assert {r["survey.spot.grid"]: r["n"] for r in q.group_by(Probe.survey.path("spot.grid")).agg(n=sl.count())} == {"J4": 2, "B2": 1}
    found = q.where(Probe.pid == "x").first()
    assert found.extra == {"k": {"n": 3, "e": None, "ok": True}} and found.pings[1] == {"sort": "drop", "at": 9}
    for bad in ("", "a..b", "a b", "1a"):
        with pytest.raises(ValueError):
            Probe.survey.path(bad)
    with pytest.raises(ValueError):
        q.where(Probe.survey.path("nope") == 1).collect()


def test_declarations():
    with pytest.raises(TypeError):
        type("NoKey", (Entity,), {"__annotations__": {"a": Field[str]}})
    with pytest.raises(TypeError):
        type("Two", (Entity,), {"__annotations__": {"a": Field[str], "b": Field[str]}, "a": Field(primary_key=True), "b": Field(primary_key=True)})
    for bad in ({"height": "tall"}, {}, {"height": 1, "width": 2}):
        with pytest.raises(sl.ValidationError):
            Sensor(code="c", place="p", **bad)
    assert Sensor(code="c", place="p", height="7").height == 7


def test_batches_and_locks(spark, tmp_path):
    s = Session(str(tmp_path / "b"), spark=spark, entity_types=[Reading], config=Config(max_batch_size=1, lock_timeout_ms=100))
    s.ensure(Reading(number=n, level=0.0) for n in range(2))
    with pytest.raises(sl.BatchSizeExceededError):
        s.commit()
    assert s.list_commits() == []
    s.discard()
    with s.store.locked("other"):
        s.ensure(Reading(number=1, level=0.0))
        with pytest.raises(sl.LockContentionError):
            s.commit()
    for bad in ("text", 5, [5]):
        with pytest.raises(TypeError):
            s.ensure(bad)


def test_commits_on_a_moved_head_are_made_anew(spark, tmp_path):
    """A writer that another one overtook appends what differs from the new head, or nothing."""
    s, t = (Session(str(tmp_path / "s"), spark=spark, entity_types=[Reading]) for _ in range(2))
    s.ensure(Reading(number=1, level=0.0))
    s.commit()
    publish = s.store.publish

    def overtaken(rows, metadata, made_at=None):
        s.store.publish = publish
        s.store.release_lock(s.id)  # as if the lease had ended
        t.ensure(Reading(number=1, level=5.0))
        assert t.commit() == 2
        return publish(rows, metadata, made_at)

    for level, commit in ((5.0, None), (6.0, 4)):
        s.store.publish = overtaken
        s.ensure(Reading(number=1, level=level))
        if commit is None:
            assert s.commit() is None
        else:
            t.ensure(Reading(number=2, level=1.0))
            assert t.commit() == 3
            s.store.publish = publish
            assert s.commit() == commit
    assert [v.level for v in s.query().entities(Reading).where(Reading.number == 1).with_history().collect()] == [0.0, 5.0, 6.0]
    with pytest.raises(sl.HeadMismatchError):
        s.store.publish({}, {}, made_at=1)
    s.config = Config(commit_attempts=1)
    s.store.publish = lambda rows, metadata, made_at=None: publish(rows, metadata, made_at - 1)
    s.ensure(Reading(number=1, level=9.0))
    with pytest.raises(sl.HeadMismatchError):
        s.commit()


def test_a_lock_outlives_its_lease_while_it_is_held(spark, tmp_path):
    import time

    s = Session(str(tmp_path / "w"), spark=spark, entity_types=[Reading])
    with s.store.locked("slow", lease_ms=300):
        time.sleep(1)
        assert not s.store.acquire_lock("other", timeout_ms=50)
    assert s.store.acquire_lock("other", timeout_ms=50)


def v1():
    class Mast(Entity, name="Mast"):
        id: Field[str] = Field(primary_key=True)
        width: Field[str]

    return Mast


def v2():
    class Mast(Entity, name="Mast"):
        id: Field[str] = Field(primary_key=True)
        span: Field[str]
        bolts: Field[int] = 5

    return Mast


def test_migration(spark, tmp_path):
    uri = str(tmp_path / "m")
    old, new = v1(), v2()
    with Session(uri, spark=spark, entity_types=[old]) as s:
        s.ensure([old(id="1", width="a"), old(id="2", width="b")])
    s = Session(uri, spark=spark, entity_types=[new])
    with pytest.raises(sl.SchemaOutdatedError) as e:
        s.validate()
    assert (e.value.diffs[0].added_fields, e.value.diffs[0].removed_fields) == (["bolts", "span"], ["width"])
    plan = s.migrate()
    assert plan.has_changes and plan.estimated_rows == {"Mast": 2} and plan.missing_upgraders == {"Mast": [1]}

    @sl.upgrader("Mast", from_version=1)
    def up(fields):
        return {"id": fields["id"], "span": fields["width"] + " wide"}

    @sl.upgrader("Mast", from_version=1)
    def bad(fields):
        return {"id": fields["id"]}

    with pytest.raises(sl.MigrationTokenError):
        s.migrate(dry_run=False, token="no", upgraders={("Mast", 1): up})
    with pytest.raises(sl.MissingUpgraderError):
        s.migrate(dry_run=False, force=True)
    with pytest.raises(sl.MigrationError, match="span"):
        s.migrate(dry_run=False, force=True, upgraders={("Mast", 1): bad})
    assert s.store.head() == 1
    done = s.migrate(dry_run=False, token=plan.token, upgraders={("Mast", 1): up})
    assert done.rows_migrated == {"Mast": 2} and done.new_schema_versions == {"Mast": 2}
    q = s.query().entities(new)
    assert sorted((p.id, p.span, p.bolts) for p in q.collect()) == [("1", "a wide", 5), ("2", "b wide", 5)]
    # Reads never cross to the earlier schema version.
    assert q.as_of(1).collect() == [] and q.as_of(1).diagnostics["reason"] == "commit_before_activation"
    assert len(q.with_history().collect()) == 2
    assert not s.migrate().has_changes


def test_long_logs(spark, tmp_path, monkeypatch):
    """Index entries are sealed, and many manifests are read by executors."""
    monkeypatch.setattr(store, "INDEX_ENTRIES", 2)
    s = Session(str(tmp_path / "l"), spark=spark, entity_types=[Sensor, Station])
    for n in range(6):
        s.ensure(Sensor(code=f"c{n}", place="n", height=n) if n != 3 else Station(site="s", power=1.0))
        s.commit()
    index = s.store.files.read_json("index/entity/Sensor.json")
    assert (len(index["sealed"]), len(index["entries"])) == (2, 1) and s.store.verify_index()[0]["ok"]

    def commits(opened, *span):
        return [e["min_commit_id"] for e in opened.entries("entity", "Sensor", *span)]

    assert commits(s.store) == [1, 2, 3, 5, 6] and commits(s.store, 2, 5) == [3, 5] and commits(s.store, 6) == []
    assert len(s.query().entities(Sensor).history_since(2).collect()) == 3
    # A sealed file is lost: readers take the manifests, verify tells, repair mends.
    s.store.files.delete(index["sealed"][0]["file"])
    monkeypatch.setattr(store, "MANIFESTS_AT_ONCE", 1)
    fresh = store.Store(spark, str(tmp_path / "l"))
    assert commits(fresh) == [1, 2, 3, 5, 6]
    told = next(x for x in fresh.verify_index() if x["type_name"] == "Sensor")
    assert told["missing_commits"] == [1, 2] and told["missing_files"] == [index["sealed"][0]["file"]]
    fresh.repair_index()
    assert all(x["ok"] for x in fresh.verify_index()) and commits(fresh) == [1, 2, 3, 5, 6]
    # A commit that comes while files are merged is behind the new index, not lost.
    merged, late = fresh.raw_history, []

    def slow(*args, **how):
        if not late:
            late.append(s.ensure(Sensor(code="late", place="n", height=0)))
            assert s.commit() == 7
        return merged(*args, **how)

    monkeypatch.setattr(fresh, "raw_history", slow)
    fresh.compact("Sensor", apply=True)
    assert sorted(e.code for e in s.query().entities(Sensor).collect()) == ["c0", "c1", "c2", "c4", "c5", "late"]


def test_maintenance(spark, tmp_path):
    s = Session(str(tmp_path / "c"), spark=spark, entity_types=[Sensor])
    for n in range(4):
        s.ensure(Sensor(code=f"c{n % 2}", place="n", height=n))
        s.commit()
    before = s.query().entities(Sensor).with_history().collect()
    s.store.files.write_json("index/entity/Sensor.json", {"entries": [], "max_indexed_commit": 4})
    assert s.store.verify_index()[0]["missing_commits"] == [1, 2, 3, 4]
    s.store.repair_index()
    assert s.store.verify_index()[0]["ok"]
    assert s.store.compact(apply=True)[0]["files"] == 4
    assert len(s.store.entries("entity", "Sensor")) == 1 and s.store.verify_index()[0]["ok"]
    assert s.query().entities(Sensor).with_history().collect() == before
    s.ensure(Sensor(code="c9", place="n", height=9))
    assert s.commit() == 5 and s.query().entities(Sensor).count() == 3
    assert s.store.info()["head_commit_id"] == 5
    s.store.drop_type("entity", "Sensor", purge_history=True)
    assert s.store.types() == [] and s.query().entities(Sensor).collect() == []
    again = Session(str(tmp_path / "c"), spark=spark, entity_types=[Sensor])
    again.ensure(Sensor(code="new", place="n", height=1))
    again.commit()
    assert [c.code for c in again.query().entities(Sensor).collect()] == ["new"]


def test_single_versions_need_no_choice(field):
    def plan(q):
        return q.state_df()._jdf.queryExecution().optimizedPlan().toString()

    q = field.query().entities(Station)
    assert field.store.layout(Station).single and "Window" not in plan(q)
    assert field.query().entities(Station).as_of(0).collect() == [] and q.as_of(1).count() == 3
    field.ensure(Station(site="n", power=1.0))
    field.commit()
    assert not field.store.layout(Station).single and "Window" in plan(q)
    assert sorted(p.power for p in q.collect()) == [0.5, 1.0, 7.25]


def test_locks_and_manifests_are_exclusive(spark, tmp_path):
    s = Session(str(tmp_path / "x"), spark=spark, entity_types=[Sensor])
    f = s.store.files
    assert f.create_json("manifests/000000000001.json", {"a": 1}) and not f.create_json("manifests/000000000001.json", {"a": 2})
    assert f.read_json("manifests/000000000001.json") == {"a": 1} and f.names("manifests") == ["000000000001.json"]
    assert f.claim("l.json", {"o": 1}) and not f.claim("l.json", {"o": 2})
    assert not f.take("l.json", {"o": 2}) and f.read_json("l.json") == {"o": 1}
    assert f.take("l.json", {"o": 1}) and not f.take("l.json", {"o": 1}) and not f.exists("l.json")
    assert s.store.acquire_lock("a", lease_ms=1) and s.store.acquire_lock("b", timeout_ms=500)  # a's lease ended
    assert not s.store.renew_lock("a") and s.store.renew_lock("b")
    s.store.release_lock("a")
    assert f.read_json("lock.json")["owner"] == "b"


def test_racing_commits(spark, tmp_path):
    s = Session(str(tmp_path / "r"), spark=spark, entity_types=[Sensor])
    s.ensure(Sensor(code="a", place="a", height=1))
    head = s.store.head
    s.store.head = lambda: head() or 0
    s.commit()
    s.store.head = lambda: 0  # has not seen the first commit
    s.ensure(Sensor(code="b", place="b", height=1))
    with pytest.raises(sl.ConcurrentWriteError):
        s.commit()
    s.store.head = head
    assert s.query().entities(Sensor).count() == 1 and len(s.list_commits()) == 1


def test_uris(spark):
    from strataloom.sources.store import Store, parse_uri

    assert parse_uri("s3://bucket/x") == "s3a://bucket/x" and parse_uri("/a/b") == "file:///a/b" and parse_uri("hdfs://n/x") == "hdfs://n/x"
    assert parse_uri(":memory:", "hdfs://n/tmp").startswith("hdfs://n/tmp/store-")
    with pytest.raises(sl.StorageBackendError):
        parse_uri("sqlite:///x.db")
    with pytest.raises(sl.UninitializedStorageError):
        Store(spark, "/nonexistent/folder", create=False)
    s = Session(":memory:", spark=spark, entity_types=[Sensor])
    s.ensure(Sensor(code="a", place="a", height=1))
    assert s.commit() == 1
    with pytest.raises(sl.StorageBackendError):
        s.store.initialise()
