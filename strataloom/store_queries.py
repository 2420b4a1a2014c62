"""Operators that need a datastore, over the driver's tables: each writes or reads a commit log, each with SQL beside it.

A store is made once a session and folder, in the shared folder, by these commits:

1. all customers as accounts, all orders as purchases, a relation between them, the conversations as a keyed relation
2. accounts as expected state again, a third of them with 1000 more on their balance; the rest differs in nothing
3. purchases again, a quarter of them cancelled at twice the price, and their relations
4. accounts again, a fifth of them moved to another segment
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, schema
from .config import Config
from .expressions import left, right
from .model import Entity, Event, Field, Relation
from .operators import delta
from .plans.query import TraversalQuery, avg, count, sum
from .queries import Nation, PartOf, Region, graph_of
from .session import Session
from .sources import jsonl
from .sources.store import keys_of
from .streaming.handlers import handlers_of, on_commit_entity, on_event


class Account(Entity):
    custkey: Field[int] = Field(primary_key=True)
    name: Field[str]
    balance: Field[float]
    segment: Field[str]
    owing: Field[bool]


class Purchase(Entity):
    orderkey: Field[int] = Field(primary_key=True)
    status: Field[str]
    price: Field[float]


class Talk(Entity):
    conv: Field[int] = Field(primary_key=True)


class Buys(Relation[Account, Purchase]):
    status: Field[str]
    price: Field[float]


class Spoke(Relation[Talk, Talk]):
    turn: Field[str] = Field(instance_key=True)
    role: Field[str]


TYPES: dict[str, Any] = {"entity_types": [Account, Purchase, Talk], "relation_types": [Buys, Spoke]}


def _rows(df: DataFrame, cls: type, identity: list[str | Column], **fields: Column) -> DataFrame:
    """Expected state: identity, seq, fields."""
    key = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(k) for k, c in zip(keys_of(cls.kind), identity, strict=True)]
    values = F.struct(*[fields[n].alias(n) for n in cls.data_fields()]).cast(cls.payload())
    return df.select(*key, F.lit(0).cast("long").alias("seq"), values.alias("fields"))


def _accounts(spark: SparkSession, sf_dir: str, raised: bool, moved: bool) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    balance = F.when(F.lit(raised) & (F.col("c_custkey") % 3 == 0), F.col("c_acctbal") + 1000).otherwise(F.col("c_acctbal"))
    segment = F.when(F.lit(moved) & (F.col("c_custkey") % 5 == 0), "MOVED").otherwise(F.col("c_mktsegment"))
    return _rows(df, Account, ["c_custkey"], custkey=F.col("c_custkey"), name=F.col("c_name"), balance=balance, segment=segment, owing=F.col("c_acctbal") < 0)


def _purchases(spark: SparkSession, sf_dir: str, cancelled: bool) -> dict[type, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.lit(cancelled) & (F.col("o_orderkey") % 4 == 0)
    status, price = F.when(gone, "X").otherwise(F.col("o_orderstatus")), F.when(gone, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    return {
        Purchase: _rows(df, Purchase, ["o_orderkey"], orderkey=F.col("o_orderkey"), status=status, price=price),
        Buys: _rows(df, Buys, ["o_custkey", "o_orderkey", F.lit("")], status=status, price=F.col("o_totalprice")),
    }


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    return _rows(df, Spoke, ["conv_id", "conv_id", "turn"], role=F.col("role"))


def _new(spark: SparkSession, **how: Any) -> Session:
    """A session on a new store in the shared folder."""
    return Session(":memory:", spark=spark, **(how or TYPES))


def _commit(s: Session, rows: dict[type, DataFrame], **meta: str) -> int | None:
    s._validated()
    with s.store.locked(s.id):
        return s._publish(rows, meta)


_MADE: dict[tuple[str, str], Session] = {}


def store_of(spark: SparkSession, sf_dir: str) -> Session:
    """The store of a folder's tables, made when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        s = _new(spark)
        _commit(s, {Account: _accounts(spark, sf_dir, False, False), Spoke: _spoken(spark, sf_dir)} | _purchases(spark, sf_dir, False), step="first")
        _commit(s, {Account: _accounts(spark, sf_dir, True, False)}, step="raised")
        _commit(s, _purchases(spark, sf_dir, True), step="cancelled")
        _commit(s, {Account: _accounts(spark, sf_dir, True, True)}, step="moved")
        _MADE[key] = s
    return _MADE[key]


def _small(spark: SparkSession, sf_dir: str) -> Session:
    """A store of its own, for queries that change it: accounts in two commits."""
    s = _new(spark, entity_types=[Account])
    _commit(s, {Account: _accounts(spark, sf_dir, False, False)})
    _commit(s, {Account: _accounts(spark, sf_dir, True, False)})
    return s


def _frame(spark: SparkSession, rows: list[tuple], schema_: str) -> DataFrame:
    return spark.createDataFrame(rows, schema_)


#: The versions of accounts and purchases, as the commits write them.
_ACCOUNTS = """a AS (SELECT c_custkey::BIGINT AS custkey, c_acctbal AS b1, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 0 END AS b2,
    c_mktsegment AS s1, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS s4, c_name AS name FROM customer),
av AS (SELECT custkey, 1::BIGINT AS commit_id, b1 AS balance, s1 AS segment FROM a
    UNION ALL SELECT custkey, 2, b2, s1 FROM a WHERE custkey % 3 = 0 UNION ALL SELECT custkey, 4, b2, s4 FROM a WHERE custkey % 5 = 0)"""
_PURCHASES = """o AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS st1, o_totalprice AS price,
    CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS st3, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS p3 FROM orders)"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    """Registers a query under its function's name; its SQL may use a, av and o."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        with_ = [text for names, text in (("av?", _ACCOUNTS), ("o", _PURCHASES)) if re.search(rf"(FROM|JOIN) {names}\b", sql)]
        ORACLES[f.__name__] = (f"WITH {', '.join(with_)} " if with_ else "") + sql
        return f

    return add


def _account_columns(q: Any) -> DataFrame:
    return q.to_df().select("custkey", F.col("_commit_id").alias("commit_id"), "balance", "segment")


# --- versions ---------------------------------------------------------------------------------------------------------


@_query("SELECT custkey, CASE WHEN custkey % 5 = 0 THEN 4 WHEN custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS commit_id, b2 AS balance, s4 AS segment FROM a ")
def store_latest(spark, sf_dir):
    """The latest state through manifests, files and the choice of versions (SC-04, SC-06, T-01, T-02)."""
    return _account_columns(store_of(spark, sf_dir).query().entities(Account))


@_query("SELECT custkey, CASE WHEN custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS commit_id, b2 AS balance, s1 AS segment FROM a ")
def store_as_of(spark, sf_dir):
    return _account_columns(store_of(spark, sf_dir).query().entities(Account).as_of(3))


@_query("SELECT custkey, commit_id, balance, segment FROM av ")
def store_history(spark, sf_dir):
    return _account_columns(store_of(spark, sf_dir).query().entities(Account).with_history())


@_query("SELECT custkey, commit_id, balance, segment FROM av WHERE commit_id > 2")
def store_history_since(spark, sf_dir):
    return _account_columns(store_of(spark, sf_dir).query().entities(Account).history_since(2))


@_query("SELECT custkey, 1::BIGINT AS commit_id, b1 AS balance, s1 AS segment FROM a WHERE b1 > 5000")
def store_as_of_filtered(spark, sf_dir):
    """A condition on the state at the first commit: later versions do not matter (F-03, T-04)."""
    return _account_columns(store_of(spark, sf_dir).query().entities(Account).as_of(1).where(Account.balance > 5000))


@_query("SELECT custkey, 1 AS commit_id, 0 AS version FROM a WHERE false")
def store_before_the_first_commit(spark, sf_dir):
    q = store_of(spark, sf_dir).query().entities(Account).as_of(0)
    return q.to_df().select("custkey", F.col("_commit_id").cast("int").alias("commit_id"), F.col("_schema_version_id").alias("version"))


@_query("SELECT 'commit_before_activation' AS reason, 'Account' AS type_name, 1 AS activation")
def store_diagnostics(spark, sf_dir):
    """Why a read is empty (T-08, T-09, T-10)."""
    told = store_of(spark, sf_dir).query().entities(Account).as_of(0).diagnostics
    return _frame(spark, [(told["reason"], told["type_name"], told["activation_commit_id"])], "reason string, type_name string, activation int")


@_query("SELECT custkey, orderkey, CASE WHEN orderkey % 4 = 0 THEN 3 ELSE 1 END::BIGINT AS commit_id, st3 AS status FROM o ")
def store_relation_latest(spark, sf_dir):
    """The latest state of a relation (SC-05, T-03)."""
    df = store_of(spark, sf_dir).query().relations(Buys).state_df()
    return df.select(F.col("left_key").cast("long").alias("custkey"), F.col("right_key").cast("long").alias("orderkey"), "commit_id", "fields.status")


@_query("SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY ALL")
def store_keyed_relation(spark, sf_dir):
    df = store_of(spark, sf_dir).query().relations(Spoke).state_df()
    return df.select(F.col("left_key").cast("long").alias("conv_id"), F.col("instance_key").cast("long").alias("turn"), "fields.role")


@_query("SELECT custkey, commit_id, 1 AS version FROM av ")
def store_raw_rows(spark, sf_dir):
    """All rows of a type, identities only (SC-14)."""
    df = store_of(spark, sf_dir).store.raw_history("entity", "Account", identity_only=True)
    return df.select(F.col("key").cast("long").alias("custkey"), "commit_id", F.col("schema_version_id").alias("version"))


@_query("SELECT count(*) AS identities FROM customer")
def store_count_latest(spark, sf_dir):
    return _frame(spark, [(store_of(spark, sf_dir).store.count_latest(Account),)], "identities long")


@_query("SELECT custkey FROM a WHERE b1 < 0")
def store_is_true(spark, sf_dir):
    """is_true (F-10)."""
    return store_of(spark, sf_dir).query().entities(Account).where(Account.owing.is_true()).to_df().select("custkey")


@_query("SELECT segment, count(*) AS n, round(avg(balance), 4) AS average FROM (SELECT s4 AS segment, b2 AS balance FROM a) GROUP BY 1 HAVING count(*) > 10")
def store_group_having(spark, sf_dir):
    df = store_of(spark, sf_dir).query().entities(Account).group_by(Account.segment).having(count() > 10).agg_df(n=count(), average=avg(Account.balance))
    return df.withColumn("average", F.round("average", 4))


# --- files, commits, catalog --------------------------------------------------------------------------------------------


@_query("SELECT unnest([2, 4]) AS commit_id")
def store_file_resolution(spark, sf_dir):
    """The files that a range of commits opens (SC-07)."""
    found = store_of(spark, sf_dir).store.entries("entity", "Account", 1, 4)
    return _frame(spark, [(e["min_commit_id"],) for e in found], "commit_id int")


@_query("SELECT unnest(['first', 'raised', 'cancelled', 'moved']) AS step, unnest([1, 2, 3, 4]) AS id")
def store_commit_log(spark, sf_dir):
    """The manifests as a table (SC-08, T-11)."""
    df = store_of(spark, sf_dir).store.commits_df()
    return df.select(F.get_json_object("metadata", "$.step").alias("step"), F.col("id").cast("int").alias("id"))


@_query("SELECT 3 AS id, 'cancelled' AS step")
def store_commit_metadata(spark, sf_dir):
    """The commits whose metadata say so (F-19), newest first."""
    found = [c for c in store_of(spark, sf_dir).list_commits(limit=100) if c["metadata"].get("step") == "cancelled"]
    return _frame(spark, [(c["id"], c["metadata"]["step"]) for c in found], "id int, step string")


@_query("""SELECT 'entity' AS type_kind, orderkey, NULL::BIGINT AS custkey, 'update_version' AS operation FROM o WHERE orderkey % 4 = 0
           UNION ALL SELECT 'relation', orderkey, custkey, 'update_version' FROM o WHERE orderkey % 4 = 0""")
def store_commit_changes(spark, sf_dir):
    """What a commit changed, over all types (T-12, U-02, SC-17)."""
    df = store_of(spark, sf_dir).store.changes_df(3)
    return df.select("type_kind", F.coalesce("key", "right_key").cast("long").alias("orderkey"), F.col("left_key").cast("long").alias("custkey"), "operation")


@_query("""SELECT 1 AS commit_id, (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) AS operations
           UNION ALL SELECT 2, count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 3, 2 * count(*) FROM orders WHERE o_orderkey % 4 = 0
           UNION ALL SELECT 4, count(*) FROM customer WHERE c_custkey % 5 = 0""")
def store_operations_per_commit(spark, sf_dir):
    store = store_of(spark, sf_dir).store
    return _frame(spark, [(i, store.count_commit_operations(i)) for i in store.commit_ids()], "commit_id int, operations long")


@_query("""SELECT unnest(['Account', 'Purchase', 'Buys', 'Spoke', 'Talk']) AS type_name, unnest(['entity', 'entity', 'relation', 'relation', 'entity']) AS kind, 1 AS version,
           unnest([1, 1, 1, 1, NULL]) AS activation""")
def store_catalog(spark, sf_dir):
    """Types, their schemas and from which commit on they hold (SC-15, SC-16, SK-06)."""
    store = store_of(spark, sf_dir).store
    active = {x["type_name"]: x["activation_commit_id"] for x in store.info()["current_layouts"]}
    return _frame(spark, [(x["type_name"], x["kind"], x["schema_version_id"], active.get(x["type_name"])) for x in store.list_schemas()], "type_name string, kind string, version int, activation int")


@_query("SELECT custkey, 'MOVED' AS segment, b2 AS balance FROM a WHERE custkey = (SELECT max(custkey) FROM a WHERE custkey % 5 = 0)")
def store_point(spark, sf_dir):
    """One identity: the key goes to the scan (SC-09)."""
    key = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 5 = 0").agg(F.max("c_custkey")).first()[0]
    f = store_of(spark, sf_dir).store.point(Account, str(key))["fields"]
    return _frame(spark, [(f["custkey"], f["segment"], f["balance"])], "custkey long, segment string, balance double")


@_query("SELECT orderkey, custkey, st3 AS status, price FROM o WHERE orderkey = (SELECT max(orderkey) FROM o WHERE orderkey % 4 = 0)")
def store_point_relation(spark, sf_dir):
    """SC-10."""
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 4 = 0").agg(F.max_by("o_custkey", "o_orderkey").alias("c"), F.max("o_orderkey").alias("o")).first()
    f = store_of(spark, sf_dir).store.point(Buys, str(r["c"]), str(r["o"]))["fields"]
    return _frame(spark, [(r["o"], r["c"], f["status"], f["price"])], "orderkey long, custkey long, status string, price double")


@_query("SELECT i::INT AS batch, least(400, n - 400 * i)::INT AS size FROM (SELECT count(*) AS n FROM customer), range(0, 1000000) t(i) WHERE 400 * i < n")
def store_batches(spark, sf_dir):
    """The latest rows in batches (SC-11)."""
    sizes = [len(b) for b in store_of(spark, sf_dir).store.latest_batches(Account, 400)]
    return _frame(spark, list(enumerate(sizes)), "batch int, size int")


@_query("SELECT 4 AS before, 4 AS after, NULL::INT AS written")
def store_noop_commit(spark, sf_dir):
    """Expected state that is there already writes nothing (SK-02, SK-04)."""
    s = store_of(spark, sf_dir)
    before = s.store.head()
    written = _commit(s, {Account: _accounts(spark, sf_dir, True, True)} | _purchases(spark, sf_dir, True))
    return _frame(spark, [(before, s.store.head(), written)], "before int, after int, written int")


@_query("SELECT CASE WHEN orderkey % 4 = 0 THEN 'update' ELSE 'noop' END AS operation, count(*) AS n FROM o GROUP BY 1")
def store_relation_delta(spark, sf_dir):
    """The first state of a relation against its latest (SK-03, J-07)."""
    s = store_of(spark, sf_dir)
    key = keys_of("relation")
    found = delta.classified(_purchases(spark, sf_dir, False)[Buys], s.store.latest_rows(Buys).select(*key, "fields"), key)
    return found.groupBy("operation").agg(F.count("*").alias("n"))


@_query("SELECT 'Account' AS type_name, count(*)::BIGINT AS n, true AS sound FROM customer")
def store_manifest_rows(spark, sf_dir):
    """The rows and checksums that a manifest tells (SK-07)."""
    store = store_of(spark, sf_dir).store
    (told,) = [t for t in store.manifest(1)["types"] if t["type_name"] == "Account"]
    return _frame(spark, [("Account", told["rows"], not store.verify_files(1))], "type_name string, n long, sound boolean")


# --- endpoints with versions ----------------------------------------------------------------------------------------------


@_query("SELECT orderkey FROM o JOIN a USING (custkey) WHERE s4 = 'MOVED'")
def store_endpoint_latest(spark, sf_dir):
    """A condition on an endpoint of several versions sees the latest (J-02, F-14)."""
    df = store_of(spark, sf_dir).query().relations(Buys).where(left(Buys).segment == "MOVED").state_df()
    return df.select(F.col("right_key").cast("long").alias("orderkey"))


@_query("SELECT orderkey FROM o JOIN a USING (custkey) WHERE b1 > 8000")
def store_endpoint_as_of(spark, sf_dir):
    """... and under as_of the endpoint at that commit."""
    df = store_of(spark, sf_dir).query().relations(Buys).where(left(Buys).balance > 8000).as_of(1).state_df()
    return df.select(F.col("right_key").cast("long").alias("orderkey"))


@_query("SELECT orderkey FROM o WHERE st1 = 'F' AND p3 > 200000")
def store_endpoint_mixed(spark, sf_dir):
    """The relation's own condition at its first commit, the right endpoint's at the latest, in two reads."""
    s = store_of(spark, sf_dir).query()
    then = s.relations(Buys).where(Buys.status == "F").as_of(2).state_df().select("left_key", "right_key")
    now = s.relations(Buys).where(right(Buys).price > 200000).state_df().select("left_key", "right_key")
    return then.join(now, ["left_key", "right_key"]).select(F.col("right_key").cast("long").alias("orderkey"))


@_query("SELECT orderkey, s4 AS latest, s1 AS then FROM o LEFT JOIN a USING (custkey)")
def store_hydrated_modes(spark, sf_dir):
    """Endpoints as structs, in their latest state and in that of the query's commit (P-03, J-03)."""
    q = store_of(spark, sf_dir).query().relations(Buys).as_of(2)
    latest, then = (q.hydrated_df(m).select("left_key", "right_key", F.col("left.fields.segment").alias(n)) for m, n in (("latest", "latest"), ("as_of", "then")))
    return latest.join(then, ["left_key", "right_key"]).select(F.col("right_key").cast("long").alias("orderkey"), "latest", "then")


@_query("SELECT s4 AS segment, count(*) AS n, round(sum(price), 2) AS total FROM o JOIN a USING (custkey) GROUP BY 1")
def store_group_left(spark, sf_dir):
    df = store_of(spark, sf_dir).query().relations(Buys).group_by(left(Buys).segment).agg_df(n=count(), total=sum(Buys.price))
    return df.withColumn("total", F.round("total", 2))


@_query("SELECT custkey AS source, orderkey AS reached, 1::BIGINT AS paths FROM o JOIN a USING (custkey) WHERE s4 = 'MOVED' AND b2 > 0")
def store_traversal(spark, sf_dir):
    """A hop from sources that two conditions choose (G-01, G-03)."""
    q = store_of(spark, sf_dir).query().entities(Account).where(Account.segment == "MOVED").via(Buys).where(Account.balance > 0)
    return q.destinations_df().select(F.col("source_key").cast("long").alias("source"), F.col("destination_key").cast("long").alias("reached"), "paths")


@_query("SELECT n_nationkey::BIGINT AS source, 1 AS hops, r_name AS ends, n_regionkey::BIGINT AS lone FROM nation JOIN region ON n_regionkey = r_regionkey")
def traversal_paths(spark, sf_dir):
    """Paths as objects, their entities, and the far ends alone (G-04, G-05, G-06); nations and regions are few by nature."""
    q: TraversalQuery = graph_of(spark, sf_dir).query().entities(Nation).via(PartOf)
    paths, ends = q.collect(), q.without_relations()
    rows = [(p.source.n_nationkey, len(p.relations), p.entities[-1].r_name, e.r_regionkey) for p, e in zip(paths, ends, strict=True)]
    return _frame(spark, rows, "source long, hops int, ends string, lone long")


# --- interchange ----------------------------------------------------------------------------------------------------------


@_query("SELECT custkey, b2 AS balance, s4 AS segment, CASE WHEN custkey % 5 = 0 THEN 4 WHEN custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS commit_id FROM a ")
def store_export(spark, sf_dir):
    """Lines of JSON with their commits (SK-11)."""
    lines = jsonl.export_df(store_of(spark, sf_dir), Account, with_metadata=True)
    row = F.from_json("value", "key string, commit_id long, fields struct<balance: double, segment: string>")
    return lines.select(row.alias("r")).select(F.col("r.key").cast("long").alias("custkey"), "r.fields.balance", "r.fields.segment", "r.commit_id")


def _exported(spark: SparkSession, sf_dir: str, types: list[type], **how: Any) -> str:
    s = store_of(spark, sf_dir)
    folder = f"{s.store.files.root}-lines-{uuid.uuid4().hex[:8]}"
    jsonl.export(s, types, folder, **how)
    return folder


@_query("SELECT orderkey, custkey, st3 AS status, price FROM o ")
def store_export_and_import(spark, sf_dir):
    """A relation written as lines and read into another store (SC-12, SK-11, SK-12)."""
    other = _new(spark)
    jsonl.load(other, _exported(spark, sf_dir, [Buys]), [Buys], apply=True)
    df = other.query().relations(Buys).state_df()
    return df.select(F.col("right_key").cast("long").alias("orderkey"), F.col("left_key").cast("long").alias("custkey"), "fields.status", "fields.price")


@_query("""SELECT 'upsert' AS on_conflict, 0 AS inserts, count(*) FILTER (custkey % 3 = 0 OR custkey % 5 = 0) AS updates, count(*) FILTER (custkey % 3 <> 0 AND custkey % 5 <> 0) AS skips, 0 AS conflicts FROM a
           UNION ALL SELECT 'abort', 0, 0, count(*) FILTER (custkey % 3 <> 0 AND custkey % 5 <> 0), count(*) FILTER (custkey % 3 = 0 OR custkey % 5 = 0) FROM a""")
def store_import_report(spark, sf_dir):
    """Old lines against the latest state, under two rules (SK-12)."""
    s, folder = store_of(spark, sf_dir), _exported(spark, sf_dir, [Account], as_of=1)
    found = [(rule, jsonl.load(s, folder, [Account], on_conflict=rule)) for rule in ("upsert", "abort")]
    return _frame(spark, [(rule, r.inserts, r.updates, r.skips, r.conflict_count) for rule, r in found], "on_conflict string, inserts int, updates long, skips long, conflicts long")


# --- maintenance and schemas ------------------------------------------------------------------------------------------------


@_query("SELECT custkey, commit_id, balance, 1 AS files FROM av WHERE commit_id < 4")
def store_compacted(spark, sf_dir):
    """All versions after the files of all commits have become one (SK-13)."""
    s = _small(spark, sf_dir)
    s.store.compact(apply=True)
    files = len(s.store.entries("entity", "Account"))
    return _account_columns(s.query().entities(Account).with_history()).select("custkey", "commit_id", "balance", F.lit(files).alias("files"))


@_query("SELECT custkey, commit_id, 2 AS missing, true AS sound FROM av WHERE commit_id < 4")
def store_index_repaired(spark, sf_dir):
    """An index that lost its entries, told and made anew from the manifests (SK-14, SK-15)."""
    s = _small(spark, sf_dir)
    s.store.files.write_json("index/entity/Account.json", {"entries": [], "max_indexed_commit": 2})
    missing = len(s.store.verify_index()[0]["missing_commits"])
    s.store.repair_index()
    sound = s.store.verify_index()[0]["ok"]
    return _account_columns(s.query().entities(Account).with_history()).select("custkey", "commit_id", F.lit(missing).alias("missing"), F.lit(sound).alias("sound"))


def _second() -> type:
    class Account(Entity, name="Account"):
        custkey: Field[int] = Field(primary_key=True)
        sector: Field[str]
        cents: Field[int]
        rank: Field[int] = 7

    return Account


def _upgrade(fields: dict[str, Any]) -> dict[str, Any]:
    return {"custkey": fields["custkey"], "sector": fields["segment"].lower(), "cents": round(fields["balance"] * 100)}


@_query("SELECT custkey, lower(s1) AS sector, round(b2 * 100)::BIGINT AS cents, 7::BIGINT AS rank, 3::BIGINT AS commit_id FROM a ")
def store_migrated(spark, sf_dir):
    """The latest rows under a second schema, through an upgrader (SK-18, SK-19, M-03, X-1)."""
    s, new = _small(spark, sf_dir), _second()
    plan = schema.preview(s.store, [new], {("Account", 1): _upgrade})
    schema.migrate(s.store, [new], {("Account", 1): _upgrade}, plan.token)
    return s.store.query().entities(new).to_df().select("custkey", "sector", "cents", "rank", F.col("_commit_id").alias("commit_id"))


@_query("SELECT 'cents,rank,sector' AS added, 'balance,name,owing,segment' AS removed, count(*)::BIGINT AS n, 'Account' AS needs FROM customer")
def store_migration_preview(spark, sf_dir):
    """What a migration would do, before it is done (M-01, M-02, M-04)."""
    plan = schema.preview(_small(spark, sf_dir).store, [_second()])
    d = plan.diffs[0]
    return _frame(spark, [(",".join(d.added_fields), ",".join(d.removed_fields), plan.estimated_rows["Account"], ",".join(plan.missing_upgraders))], "added string, removed string, n long, needs string")


@_query("SELECT 0::BIGINT AS n, 0::BIGINT AS types, 3 AS head")
def store_dropped_type(spark, sf_dir):
    """A type dropped with its history (SK-16)."""
    s = _small(spark, sf_dir)
    head = s.store.drop_type("entity", "Account", purge_history=True)
    return _frame(spark, [(s.query().entities(Account).count(), len(s.store.types()), head)], "n long, types long, head int")


# --- events -------------------------------------------------------------------------------------------------------------------


class Seen(Event):
    nation: Field[int]


class Told(Event):
    nation: Field[int]


@on_event(Seen, priority=10)
def _even(ctx):
    if ctx.event.nation % 2:
        raise RuntimeError("odd")
    ctx.emit(Told(nation=ctx.event.nation))


def _bus(spark: SparkSession, sf_dir: str) -> Session:
    """An event for each nation, and one pass of a handler that fails for the odd ones; nations are few by nature."""
    s = _new(spark, entity_types=[Account])
    s.config = s.bus.config = Config(event_backoff_base_ms=3_600_000, event_backoff_max_ms=3_600_000)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
        s.bus.enqueue(Seen(nation=r[0]), "default")
    found = handlers_of([_even])
    s.run_once(found, {"seen": Seen, "told": Told})
    return s


@_query("""SELECT n_nationkey::BIGINT AS nation, 'seen' AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'acked' ELSE 'retry' END AS status, 0 AS depth FROM nation
           UNION ALL SELECT n_nationkey, 'told', 'pending', 1 FROM nation WHERE n_nationkey % 2 = 0""")
def bus_pass(spark, sf_dir):
    """Events enqueued, claimed, acknowledged or given back, and what handlers emit (E-01 to E-04, E-06, E-09, E-11, E-12, E-13)."""
    s = _bus(spark, sf_dir)
    depth = {r["id"]: (json.loads(r["payload"])["nation"], r["chain_depth"]) for r in s.bus.events_df("default").collect()}
    rows = [(depth[e["id"]][0], e["type"], e["status"], depth[e["id"]][1]) for e in s.bus.list_events("default", 1000)]
    return _frame(spark, rows, "nation long, type string, status string, depth int")


@_query("SELECT n_nationkey::BIGINT AS nation FROM nation WHERE n_nationkey % 2 = 0")
def bus_second_claim(spark, sf_dir):
    """What another handler may still take: everything; what the first one may: nothing, until its wait is over (E-02, J-08, J-09)."""
    s = _bus(spark, sf_dir)
    assert not s.bus.claim("default", handlers_of([_even])[0].id, "other", ["seen"], 1000, {"seen": Seen})
    found = s.bus.claim("default", "another", "other", ["told"], 1000, {"told": Told})
    return _frame(spark, [(c.event.nation,) for c in found], "nation long")


@_query("SELECT count(*) + count(*) FILTER (n_nationkey % 2 = 0) AS deleted, 1::BIGINT AS kept FROM nation")
def bus_cleanup(spark, sf_dir):
    """Events and claims of past days dropped, a replayed event kept (E-07, E-08)."""
    import datetime as dt

    from .sources.store import now

    s = _bus(spark, sf_dir)
    first = s.bus.list_events("default", 1)[0]["id"]
    bound = now()
    s.bus.replay("default", first)
    deleted = s.bus.cleanup("default", bound + dt.timedelta(microseconds=1))
    return _frame(spark, [(deleted, s.bus.events_df("default").count())], "deleted long, kept long")


@_query("SELECT r_regionkey::BIGINT AS region, r_name AS name FROM region WHERE r_regionkey > 1")
def commit_handler_calls(spark, sf_dir):
    """A commit handler with a condition, called for the regions of a commit (E-14, F-16)."""
    calls: list[tuple] = []

    @on_commit_entity(Region, when=Region.r_regionkey > 1)
    def each(ctx):
        calls.append((ctx.obj.r_regionkey, ctx.obj.r_name))

    s = _new(spark, entity_types=[Region])
    df = spark.read.parquet(f"{sf_dir}/region.parquet")
    _commit(s, {Region: _rows(df, Region, ["r_regionkey"], r_regionkey=F.col("r_regionkey"), r_name=F.col("r_name"))})
    s.run([each])
    return _frame(spark, calls, "region long, name string")


# --- the command line -----------------------------------------------------------------------------------------------------------


def _called(spark: SparkSession, sf_dir: str, *args: str) -> list[dict[str, Any]]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(["--store", store_of(spark, sf_dir).store.files.root, "--models", "strataloom.store_queries", "--json", *args], spark)
    assert code == 0, out.getvalue()
    return json.loads(out.getvalue())


@_query("SELECT custkey, b2 AS balance FROM a WHERE s4 = 'MOVED' AND b2 >= 2000 ORDER BY b2 DESC, custkey LIMIT 20")
def cli_entities(spark, sf_dir):
    """Conditions, order and page from the command line (F-18, M-06, M-10)."""
    rows = _called(spark, sf_dir, "entities", "Account", "--filter", "segment", "eq", '"MOVED"', "--filter", "balance", "gte", "2000", "--order-by", "balance", "--desc", "--limit", "20")
    return _frame(spark, [(r["custkey"], r["balance"]) for r in rows], "custkey long, balance double")


@_query("SELECT unnest([4, 3, 2, 1]) AS id, unnest(['moved', 'cancelled', 'raised', 'first']) AS step")
def cli_commits(spark, sf_dir):
    """M-07."""
    rows = _called(spark, sf_dir, "commits")
    return _frame(spark, [(r["id"], r["metadata"]["step"] if isinstance(r["metadata"], dict) else json.loads(r["metadata"])["step"]) for r in rows], "id int, step string")


@_query("SELECT custkey, 'update_version' AS operation FROM a WHERE custkey % 5 = 0")
def cli_examine(spark, sf_dir):
    """M-07."""
    rows = _called(spark, sf_dir, "examine", "4")
    return _frame(spark, [(int(r["key"]), r["operation"]) for r in (rows["changes"] if isinstance(rows, dict) else rows)], "custkey long, operation string")

