"""The queries through a datastore against their SQL, over the smallest of the driver's tables."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from strataloom import store_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def test_store_queries_are_their_sql(spark, sql):
    for name, query in store_queries.QUERIES.items():
        df = query(spark, FOLDER)
        columns = sorted(df.columns)
        told = sql.execute(store_queries.ORACLES[name])
        places = [[d[0] for d in told.description].index(c) for c in columns]
        want = sorted((tuple(r[i] for i in places) for r in told.fetchall()), key=str)
        found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
        assert len(places) == len(told.description) and found == want, name
