"""Operators against brute force on random histories and graphs."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import delta, graph, temporal

SCHEMA = "key string, commit_id long, schema_version_id int, seq long, fields struct<a: long, m: map<string, long>>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for commit in range(1, 15):
        for seq, key in enumerate(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))):
            out.append((key, commit, rng.choice([1, 2, None]), seq, (rng.randint(0, 2), {"x": rng.randint(0, 1), "y": 1})))
    return out


@pytest.fixture(scope="module")
def history(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def newest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        out[r[0]] = r
    return out


def as_dict(df):
    return {r.key: (r.commit_id, r.seq) for r in df.collect()}


def test_state_at_every_commit(history, rows):
    head = max(r[1] for r in rows)
    assert as_dict(temporal.as_of(history, head)) == as_dict(temporal.latest(history))
    for commit in range(0, head + 2, 3):
        want = {k: (r[1], r[3]) for k, r in newest([r for r in rows if r[1] <= commit]).items()}
        assert as_dict(temporal.as_of(history, commit)) == want
        assert temporal.since(history, commit).count() == sum(r[1] > commit for r in rows)


def test_schema_versions_never_mix(history, rows):
    for version in (1, 2):
        want = {k: (r[1], r[3]) for k, r in newest([r for r in rows if r[2] == version]).items()}
        assert as_dict(temporal.latest(temporal.of_version(history, version))) == want


def test_changes_name_inserts(history, rows):
    first = {}
    for r in rows:
        first[r[0]] = min(first.get(r[0], 99), r[1])
    want = collections.Counter((r[0], r[1], "insert" if first[r[0]] == r[1] else "update_version") for r in rows)
    assert collections.Counter((r.key, r.commit_id, r.operation) for r in temporal.changes(history).collect()) == want
    one = collections.Counter((r.key, r.commit_id, r.operation) for r in temporal.changes(history, 7).collect())
    assert one == collections.Counter({k: n for k, n in want.items() if k[1] == 7})


def test_delta_is_idempotent(history, rows):
    expected = temporal.as_of(history, 12).drop("commit_id", "schema_version_id")
    current = temporal.as_of(history, 5)
    a, b = newest([r for r in rows if r[1] <= 12]), newest([r for r in rows if r[1] <= 5])
    want = {k: "insert" if k not in b else "noop" if b[k][4] == r[4] else "update" for k, r in a.items()}
    assert {r.key: r.operation for r in delta.classified(expected, current.select("key", "fields")).collect()} == want
    after = current.select("key", "fields").join(expected.select("key"), "key", "left_anti").unionByName(expected.select("key", "fields"))
    assert delta.delta(expected, after).count() == 0


def test_paths_are_counted(spark):
    rng = random.Random(2)
    edges = [(str(rng.randrange(8)), str(rng.randrange(8)), "", 1, (0, {})) for _ in range(20)]
    df = spark.createDataFrame(edges, "left_key string, right_key string, instance_key string, commit_id long, fields struct<a: long, m: map<string, long>>")
    sources = spark.createDataFrame([(str(i),) for i in range(8)], "key string")
    want = collections.Counter()
    for s in range(8):
        for a in edges:
            for b in edges:
                for c in edges:
                    if a[0] == str(s) and a[1] == b[0] and c[1] == b[1]:  # the last hop goes back by the right side
                        want[str(s), c[0]] += 1
    steps = [(df, "left"), (df, "left"), (df, "right")]
    assert {(r.source_key, r.destination_key): r.paths for r in graph.destinations(sources, steps).collect()} == dict(want)
    hops = graph.hops(sources, steps).where("hop = 3").groupBy("source_key").agg(F.sum("paths").alias("n")).collect()
    assert {r.source_key: r.n for r in hops} == {s: n for s in {k[0] for k in want} if (n := sum(v for k, v in want.items() if k[0] == s))}
