"""The queries that compare or cut whole histories, against their SQL and by hand, on users that appear late."""

from __future__ import annotations

import collections
import json

import pytest

from strataloom import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    # 30 users come back all the time; users 100 to 149 appear past the first 1,000 commits, each once or twice.
    rows = [(i, i * 7 % 30 if i % 40 or i < 1000 else 100 + i // 40 % 50) for i in range(3000)]
    rows = [(i, u, ("click", "view")[i % 2], float(i % 3), json.dumps({"k": i % 5})) for i, u in rows]
    # The last event of user 3 repeats the state before it, so that a newer version is a noop.
    rows += [(3000 + i, 3, "view", 1.0, "{}") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01' AS ts").repartition(3).write.parquet(f"{out}/events.parquet")
    return out, rows


def sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(con.execute(queries.ORACLES[name]).fetchall())


NAMES = ["delta_whole_states", "import_conflict_whole_states", "import_abort_whole_states", "history_as_of_share", "history_schema_boundary_share"]


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, folder, name):
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, folder[0]).collect())
    assert got and got == sql(folder[0], name)


def test_every_user_is_classified(spark, folder):
    path, rows = folder
    latest = {}
    for i, u, *state in rows:
        latest[u] = (i + 1, state)
    head = rows[-1][0] + 1
    want = {}
    for percent in queries.SHARES:
        at = {u: s for i, u, *s in rows if i + 1 <= head * percent // 100}
        want |= {(percent, u): "insert" if u not in at else "noop" if at[u] == s else "update" for u, (_, s) in latest.items()}
    got = {(r.percent, r.user_id): r.operation for r in queries.delta_whole_states(spark, path).collect()}
    assert got == want and len(got) == 2 * len(latest)
    assert set(collections.Counter(got.values())) == {"insert", "update", "noop"}
    assert got[1, 120] == "insert"  # appears after commit 900


def test_live_sessions_are_counted(spark, folder):
    path, rows = folder
    got = {r.namespace: r.live_sessions for r in queries.event_namespace_live_sessions(spark, path).collect()}
    users = {u for _, u, *_ in rows}
    assert got == {f"ns{k}": len([u for u in users if u % 3 == k and u % 4]) for k in range(3)}
    for name in ("event_namespace_live_sessions", "event_namespace_rollup"):
        assert sorted(tuple(r) for r in queries.QUERIES[name](spark, path).collect()) == sql(path, name)
