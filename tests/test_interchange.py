"""JSON lines and the command line."""

from __future__ import annotations

import argparse
import json
import os

import pytest

import strataloom as sl
from strataloom import Session
from strataloom.cli import main, parser, settings
from strataloom.sources import jsonl

from .models import Mount, Sensor, Service, Station

MODELS = os.path.join(os.path.dirname(__file__), "models.py")


@pytest.fixture
def session(spark, tmp_path):
    s = Session(str(tmp_path / "a"), spark=spark, entity_types=[Sensor, Station], relation_types=[Mount, Service])
    s.ensure([Sensor(code="c1", place="Alice", height=30), Station(site="p1", power=1.5), Mount(left_key="c1", right_key="p1", slots=3), Service(left_key="c1", right_key="p1", visit="s", crew="r")])
    s.commit()
    return s


def test_round_trip(session, spark, tmp_path):
    types = [Sensor, Station, Mount, Service]
    paths = jsonl.export(session, types, str(tmp_path / "out"), with_metadata=True)
    line = json.loads(spark.read.text(paths["Service"]).first().value)
    assert line == {"type_kind": "relation", "type_name": "Service", "left_key": "c1", "right_key": "p1", "instance_key": "s", "fields": {"crew": "r"}, "commit_id": 1}
    other = Session(str(tmp_path / "b"), spark=spark, entity_types=[Sensor, Station], relation_types=[Mount, Service])
    report = jsonl.load(other, str(tmp_path / "out"), types)
    assert (report.inserts, report.commit_id) == (4, None) and other.list_commits() == []
    report = jsonl.load(other, str(tmp_path / "out"), types, apply=True, meta={"who": "me"})
    assert report.commit_id == 1 and other.get_commit(1)["metadata"]["who"] == "me"
    assert other.query().relations(Service).first() == session.query().relations(Service).first()
    assert jsonl.load(other, str(tmp_path / "out"), types, apply=True).skips == 4


def test_conflicts(session, tmp_path):
    path = tmp_path / "in.jsonl"

    def line(key, height):
        return json.dumps({"type_kind": "entity", "type_name": "Sensor", "key": key, "fields": {"code": key, "place": "Alice", "height": height}})

    path.write_text(line("c1", 31) + "\n" + line("c2", 5) + "\n")
    with pytest.raises(jsonl.ImportConflictError):
        jsonl.load(session, str(path), [Sensor], apply=True)
    assert session.list_commits()[0]["id"] == 1
    assert jsonl.load(session, str(path), [Sensor], on_conflict="skip").skips == 1
    assert jsonl.load(session, str(path), [Sensor], on_conflict="upsert", precondition="must_not_exist").conflicts[0]["key"] == "c1"
    assert len(jsonl.load(session, str(path), [Sensor], on_conflict="upsert", precondition="must_exist").conflicts) == 1
    assert jsonl.load(session, str(path), [Sensor], on_conflict="upsert", precondition="if_commit_id:1").updates == 1
    r = jsonl.load(session, str(path), [Sensor], apply=True, on_conflict="upsert")
    assert (r.inserts, r.updates, r.commit_id) == (1, 1, 2)
    assert session.query().entities(Sensor).where(Sensor.code == "c2").first().grade == "plain"
    for bad in ("not json", json.dumps({"type_kind": "entity", "type_name": "Nope", "key": "x", "fields": {}}), line("c3", "x")):
        path.write_text(bad + "\n")
        with pytest.raises(sl.ValidationError, match="in.jsonl"):
            jsonl.load(session, str(path), [Sensor])


def test_cli(spark, tmp_path, capsys):
    uri = str(tmp_path / "cli")

    def call(*args, code=0):
        assert main(["--store", uri, "--models", MODELS, "--json", *args], spark) == code
        out = capsys.readouterr().out
        return json.loads(out) if code == 0 else None

    call("info", code=3)
    call("init")
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"type_kind": "entity", "type_name": "Sensor", "key": f"c{n}", "fields": {"code": f"c{n}", "place": "N", "height": n}}) + "\n" for n in range(5)))
    assert call("import", str(path), "--apply", "--meta", "a=b")[0]["commit_id"] == 1
    rows = call("entities", "Sensor", "--filter", "height", "gte", "2", "--order-by", "height", "--desc", "--limit", "2")
    assert [r["code"] for r in rows] == ["c4", "c3"]
    assert call("commits", "--meta", "a=b")[0]["id"] == 1 and call("commits", "--meta", "a=c") == []
    assert len(call("examine", "1")["changes"]) == 5
    assert call("info")["types"][0]["rows"] in (0, 5)
    assert call("traverse", "Sensor", "--via", "Beside")[0]["relations"] == []
    assert call("index-verify", "--type", "Sensor")[0]["ok"] and call("compact")[0]["applied"] is False
    assert call("verify") and call("schema-history", "Sensor")[0]["version"] == 1
    assert call("migrate")[0]["has_changes"] is False
    assert call("namespaces") == [] and call("events") == [] and call("cleanup") == [{"deleted": 0}]
    call("entities", "Nope", code=7)
    assert call("schema-export", "--from-store", "--type", "Sensor", "--version", "1", "--with-hash")[0]["hash"] == Sensor.schema_hash()
    assert "hash" not in call("schema-export", "--type", "Sensor", "--kind", "entity")[0]
    call("schema-export", "--type", "Sensor", "--version", "1", code=2)
    call("schema-export", "--from-store", "--type", "Sensor", "--version", "9", code=7)
    told, out = call("schema-export"), tmp_path / "schemas.yaml"
    assert call("schema-export", "--format", "yaml", "--output", str(out))[0]["schemas"] == len(told)
    assert pytest.importorskip("yaml").safe_load(out.read_text()) == told
    call("entities", "Sensor", "--filter", "height", "like", "2", code=2)
    call("schema-drop", "Sensor", code=2)  # relations depend on it
    assert call("export", "--output", str(tmp_path / "o"), "--type", "Sensor")[0]["type_name"] == "Sensor"
    plan = call("schema-drop", "Reading")[0]
    call("schema-drop", "Reading", "--apply", "--token", "no", code=6)
    assert call("schema-drop", "Reading", "--apply", "--token", plan["token"])[0]["commit_id"] == 2
    plan = call("schema-drop", "Sensor", "--with-dependents", "--purge-history")
    assert [p["type_name"] for p in plan][-1] == "Sensor" and len(plan) == 4
    call("schema-drop", "Sensor", "--with-dependents", "--purge-history", "--apply", "--token", plan[0]["token"])
    assert "Sensor" not in [t["type_name"] for t in call("info")["types"]]
    assert main(["--store", uri, "--models", MODELS, "commits"], spark) == 0 and "created_at" in capsys.readouterr().out


def test_cli_globals(spark, tmp_path, capsys, monkeypatch):
    for name in ("STRATALOOM_STORE", "STRATALOOM_DB", "STRATALOOM_CONFIG"):
        monkeypatch.delenv(name, raising=False)
    here, there = str(tmp_path / "here"), str(tmp_path / "there")

    def call(*args):
        code = main(["--json", *args], spark)
        return code, capsys.readouterr()

    assert call("commits")[0] == 2  # no datastore
    assert call("--db", here, "init")[0] == 0 and call("--storage-uri", f"file://{here}", "--db", here, "commits")[0] == 0
    code, said = call("--store", there, "--db", here, "commits")
    assert code == 2 and "different datastores" in said.err
    monkeypatch.setenv("STRATALOOM_STORE", there)
    assert call("commits")[0] == 3 and call("--db", here, "commits")[0] == 0
    path = tmp_path / "settings.toml"
    path.write_text('default_namespace = "lab"\n')
    args = argparse.Namespace(**vars(parser().parse_args(["--db", here, "--config", str(path), "info"])))
    assert settings(args.config).default_namespace == "lab" and settings(None).default_namespace == "default"
    path.write_text("no_such = 1\n")
    code, said = call("--db", here, "--config", str(path), "commits")
    assert code == 2 and "no_such" in said.err
    path.write_text("[")
    assert call("--db", here, "--config", str(path), "commits")[0] == 2 and call("--db", here, "--config", str(tmp_path / "none"), "commits")[0] == 2


def test_conflicts_are_counted_whole(session, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"type_kind": "entity", "type_name": "Sensor", "key": f"n{i}", "fields": {"code": f"n{i}", "place": "N", "height": i}}) + "\n" for i in range(150)))
    report = jsonl.load(session, str(path), [Sensor], precondition="must_exist")
    assert (report.conflict_count, len(report.conflicts)) == (150, 100)
    with pytest.raises(jsonl.ImportConflictError, match="150 rows"):
        jsonl.load(session, str(path), [Sensor], precondition="must_exist", apply=True)
