"""The query operators over the driver's tables, each with SQL for the same result.

Tables become histories: `customer`, `orders`, `part` ... are entities written by one commit, `orders` is also a
relation from customers to orders, and `events` is a history of user states: each event is a version of its user's
state, written by a commit of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any, TypedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import left, right
from .functions.cron import Cron
from .model import Entity, Field, Relation
from .operators import delta, graph, temporal
from .operators import events as event_rules
from .plans.query import FrameProvider, Layout, avg, count, max, min, sum


class Region(Entity):
    r_regionkey: Field[int] = Field(primary_key=True)
    r_name: Field[str]


class Nation(Entity):
    n_nationkey: Field[int] = Field(primary_key=True)
    n_name: Field[str]
    n_regionkey: Field[int]


class Customer(Entity):
    c_custkey: Field[int] = Field(primary_key=True)
    c_name: Field[str]
    c_nationkey: Field[int]
    c_acctbal: Field[float]
    c_mktsegment: Field[str]


class Order(Entity):
    o_orderkey: Field[int] = Field(primary_key=True)
    o_orderstatus: Field[str]
    o_totalprice: Field[float]
    o_orderpriority: Field[str]


class Document(Entity):
    doc_id: Field[int] = Field(primary_key=True)
    lang: Field[str]
    source: Field[str]
    n_chars: Field[int]


class Labelled(Entity):
    doc_id: Field[int] = Field(primary_key=True)
    quality: Field[int]
    toxic: Field[int]


class UserState(Entity):
    user_id: Field[int] = Field(primary_key=True)
    event_type: Field[str]
    value: Field[float]
    props: Field[dict[str, Any]]


class Seen(TypedDict):
    kind: str
    value: float


class UserLog(Entity):
    user_id: Field[int] = Field(primary_key=True)
    seen: Field[list[Seen]]


class Placed(Relation[Customer, Order]):
    status: Field[str]
    price: Field[float]


class LivesIn(Relation[Customer, Nation]):
    pass


class PartOf(Relation[Nation, Region]):
    pass


class LabelOf(Relation[Document, Labelled]):
    n_chars: Field[int]


class Said(Relation[Document, Labelled]):
    """A keyed relation: one instance for each turn of a conversation."""

    turn: Field[str] = Field(instance_key=True)
    role: Field[str]


_KEYS = {Region: "r_regionkey", Nation: "n_nationkey", Customer: "c_custkey", Order: "o_orderkey", Document: "doc_id", Labelled: "doc_id"}
_TABLES = {Region: "region", Nation: "nation", Customer: "customer", Order: "orders", Document: "documents", Labelled: "labels"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(spark: SparkSession, sf_dir: str, cls: type) -> DataFrame:
    df = _table(spark, sf_dir, _TABLES[cls])
    return temporal.history_frame(df, [("key", F.col(_KEYS[cls]))], F.lit(1), [(n, F.col(n)) for n in cls._fields])


def _relation(df: DataFrame, left_key: str, right_key: str, fields: list[tuple[str, str]], instance: str | None = None) -> DataFrame:
    key = [("left_key", F.col(left_key)), ("right_key", F.col(right_key)), ("instance_key", F.col(instance) if instance else F.lit(""))]
    return temporal.history_frame(df, key, F.lit(1), [(n, F.col(c)) for n, c in fields] or [("_none", F.lit(None).cast("boolean"))])


def graph_of(spark: SparkSession, sf_dir: str) -> FrameProvider:
    """All types over the tables of a folder. Only those that a query uses are read.

    Tables whose keys are unique are marked as single versions; the versions of `UserState` are not.
    """
    p, single = FrameProvider(spark), Layout(single=True)

    def table(name: str) -> DataFrame:
        return _table(spark, sf_dir, name)

    for cls in _TABLES:
        p.add(cls, lambda cls=cls: _entity(spark, sf_dir, cls), single)

    def states() -> DataFrame:
        fields = [(n, F.col(n)) for n in ("user_id", "event_type", "value", "props")]
        return temporal.history_frame(table("events"), [("key", F.col("user_id"))], F.col("event_id") + 1, fields)

    def logs() -> DataFrame:
        seen = F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("kind"), "value")))
        rows = table("events").groupBy("user_id").agg(seen.alias("seen"))
        return temporal.history_frame(rows, [("key", F.col("user_id"))], F.lit(1), [("user_id", F.col("user_id")), ("seen", F.col("seen"))])

    p.add(UserState, states)
    p.add(UserLog, logs, single)
    p.add(Placed, lambda: _relation(table("orders"), "o_custkey", "o_orderkey", [("status", "o_orderstatus"), ("price", "o_totalprice")]), single)
    p.add(LivesIn, lambda: _relation(table("customer"), "c_custkey", "c_nationkey", []), single)
    p.add(PartOf, lambda: _relation(table("nation"), "n_nationkey", "n_regionkey", []), single)
    p.add(LabelOf, lambda: _relation(table("documents"), "doc_id", "doc_id", [("n_chars", "n_chars")]), single)
    p.add(Said, lambda: _relation(table("conversations"), "conv_id", "conv_id", [("role", "role")], "turn"))
    return p


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _customers(spark, sf_dir):
    return graph_of(spark, sf_dir).query().entities(Customer)


def _orders(spark, sf_dir):
    return graph_of(spark, sf_dir).query().entities(Order)


def _placed(spark, sf_dir):
    return graph_of(spark, sf_dir).query().relations(Placed)


def _states(spark, sf_dir):
    return graph_of(spark, sf_dir).query().entities(UserState)


# --- predicates -----------------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000 AND c_nationkey >= 3 AND c_nationkey < 20")
def entity_filter_cmp(spark, sf_dir):
    """> >= < <= on typed columns (F-03, F-11): reaches the scan as pushed filters."""
    c = Customer
    q = _customers(spark, sf_dir).where((c.c_acctbal > 5000) & (c.c_acctbal <= 9000) & (c.c_nationkey >= 3) & (c.c_nationkey < 20))
    return q.to_df().select("c_custkey", "c_acctbal")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey != 5")
def entity_filter_eq_ne(spark, sf_dir):
    return _customers(spark, sf_dir).where((Customer.c_mktsegment == "BUILDING") & (Customer.c_nationkey != 5)).to_df().select("c_custkey", "c_mktsegment")


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4)")
def entity_filter_in(spark, sf_dir):
    return _customers(spark, sf_dir).where(Customer.c_mktsegment.in_(["BUILDING", "MACHINERY"]) & Customer.c_nationkey.in_([1, 2, 3, 4])).to_df().select("c_custkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer') AND (ends_with(c_name, '7') OR contains(c_name, '00'))")
def entity_filter_like(spark, sf_dir):
    return _customers(spark, sf_dir).where(Customer.c_name.startswith("Customer") & (Customer.c_name.endswith("7") | Customer.c_name.contains("00"))).to_df().select("c_custkey", "c_name")


@_query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'BUILDING')")
def entity_filter_not_or(spark, sf_dir):
    return _customers(spark, sf_dir).where(~((Customer.c_acctbal > 0) | (Customer.c_mktsegment == "BUILDING"))).to_df().select("c_custkey")


@_query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE (l.quality IS NULL OR l.toxic = 1) AND (d.n_chars < 2000 OR l.toxic = 1)")
def filter_null_endpoint(spark, sf_dir):
    """is_null on an endpoint (F-08, F-14): a missing endpoint satisfies no condition on it."""
    q = graph_of(spark, sf_dir).query().relations(LabelOf)
    q = q.where(right(LabelOf).quality.is_null() | (right(LabelOf).toxic == 1)).where((LabelOf.n_chars < 2000) | (right(LabelOf).toxic == 1))
    return q.hydrated_df().select(F.col("left_key").cast("long").alias("doc_id"), F.col("right.fields.quality").alias("quality"))


@_query("SELECT DISTINCT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.lang = 'en'")
def filter_not_null_endpoint(spark, sf_dir):
    q = graph_of(spark, sf_dir).query().relations(LabelOf).where(right(LabelOf).quality.is_not_null() & (left(LabelOf).lang == "en"))
    return q.to_df().select(F.col("left_key").cast("long").alias("doc_id"))


@_query("SELECT user_id, event_id + 1 AS commit_id, (props->>'$.k')::DOUBLE AS k FROM events WHERE (props->>'$.k')::DOUBLE > 90")
def json_path_filter(spark, sf_dir):
    """A path into JSON text (F-12), on all versions."""
    df = _states(spark, sf_dir).with_history().where(UserState.props.path("k") > 90).to_df()
    return df.select("user_id", F.col("_commit_id").alias("commit_id"), F.get_json_object("props", "$.k").cast("double").alias("k"))


# --- order, page, aggregates ------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
def entity_order_limit_offset(spark, sf_dir):
    """One sort key and a page (S-01, S-04, S-05); balances are distinct where the page is cut."""
    return _customers(spark, sf_dir).order_by(Customer.c_acctbal).offset(20).limit(10).to_df().select("c_custkey", "c_acctbal")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def entity_top_k(spark, sf_dir):
    return _orders(spark, sf_dir).order_by(Order.o_totalprice, desc=True).limit(25).to_df().select("o_orderkey", "o_totalprice")


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1")
def entity_first(spark, sf_dir):
    return _customers(spark, sf_dir).order_by(Customer.c_custkey).limit(1).to_df().select("c_custkey", "c_name")


@_query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average,
           min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders WHERE o_orderstatus = 'F'""")
def entity_scalar_aggs(spark, sf_dir):
    p = Order.o_totalprice
    df = _orders(spark, sf_dir).where(Order.o_orderstatus == "F").aggregate_df(n=count(), total=sum(p), average=avg(p), lowest=min(p), highest=max(p))
    return df.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


@_query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average
           FROM orders GROUP BY 1 HAVING max(o_totalprice) > 1000""")
def entity_group_having(spark, sf_dir):
    p = Order.o_totalprice
    df = _orders(spark, sf_dir).group_by(Order.o_orderpriority).having(max(p) > 1000).agg_df(n=count(), total=sum(p), average=avg(p))
    return df.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


@_query("SELECT (props->>'$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def group_by_json_path(spark, sf_dir):
    df = _states(spark, sf_dir).with_history().group_by(UserState.props.path("k")).agg_df(n=count())
    return df.withColumnRenamed("props.k", "k")


# --- versions ---------------------------------------------------------------------------------------------------------


@_query("SELECT user_id, event_type, event_id + 1 AS commit_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def history_latest(spark, sf_dir):
    return _states(spark, sf_dir).to_df().select("user_id", "event_type", F.col("_commit_id").alias("commit_id"))


@_query("SELECT user_id, event_type, event_id + 1 AS commit_id FROM events WHERE event_id + 1 <= 400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def history_as_of(spark, sf_dir):
    return _states(spark, sf_dir).as_of(400).to_df().select("user_id", "event_type", F.col("_commit_id").alias("commit_id"))


@_query("SELECT user_id, event_id + 1 AS commit_id, round(value, 4) AS value FROM events")
def history_all(spark, sf_dir):
    return _states(spark, sf_dir).with_history().to_df().select("user_id", F.col("_commit_id").alias("commit_id"), F.round("value", 4).alias("value"))


@_query("SELECT user_id, event_id + 1 AS commit_id FROM events WHERE event_id + 1 > 500")
def history_since(spark, sf_dir):
    return _states(spark, sf_dir).history_since(500).to_df().select("user_id", F.col("_commit_id").alias("commit_id"))


@_query("""SELECT user_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
           WHERE event_type = 'click'""")
def history_filter_after_latest(spark, sf_dir):
    """Conditions look at the latest version only: they come after the choice."""
    return _states(spark, sf_dir).where(UserState.event_type == "click").to_df().select("user_id", "event_type")


@_query("""SELECT user_id, event_id + 1 AS commit_id FROM events WHERE event_id >= 300 AND event_id + 1 <= 700
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def history_schema_boundary(spark, sf_dir):
    """as_of with two schema versions, the second active from commit 301 (T-07, T-08)."""
    p = graph_of(spark, sf_dir)
    split = p.history(UserState).withColumn("schema_version_id", F.when(F.col("commit_id") > 300, 2).otherwise(1))
    p.add(UserState, split, Layout(2, 301))
    return p.query().entities(UserState).as_of(700).to_df().select("user_id", F.col("_commit_id").alias("commit_id"))


def _commit_at(spark: SparkSession, sf_dir: str, percent: int) -> int:
    """The commit at a share of all commits of the states."""
    head = graph_of(spark, sf_dir).history(UserState).agg(F.max("commit_id")).first()[0]
    return (head or 0) * percent // 100


@_query("""SELECT user_id, event_type, event_id + 1 AS commit_id FROM events WHERE event_id + 1 <= (SELECT max(event_id) + 1 FROM events) * 50 // 100
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def history_as_of_share(spark, sf_dir):
    """as_of at half of all commits, so that the input grows with the table."""
    return _states(spark, sf_dir).as_of(_commit_at(spark, sf_dir, 50)).to_df().select("user_id", "event_type", F.col("_commit_id").alias("commit_id"))


@_query("""SELECT user_id, event_id + 1 AS commit_id FROM events WHERE event_id + 1 > (SELECT max(event_id) + 1 FROM events) * 30 // 100
           AND event_id + 1 <= (SELECT max(event_id) + 1 FROM events) * 70 // 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def history_schema_boundary_share(spark, sf_dir):
    """as_of at 70 % of all commits, with a second schema version active after 30 % of them."""
    p, last = graph_of(spark, sf_dir), _commit_at(spark, sf_dir, 30)
    split = p.history(UserState).withColumn("schema_version_id", F.when(F.col("commit_id") > last, 2).otherwise(1))
    p.add(UserState, split, Layout(2, last + 1))
    return p.query().entities(UserState).as_of(_commit_at(spark, sf_dir, 70)).to_df().select("user_id", F.col("_commit_id").alias("commit_id"))


@_query("SELECT user_id FROM events WHERE false")
def history_before_activation(spark, sf_dir):
    p = graph_of(spark, sf_dir)
    p.add(UserState, p.history(UserState), Layout(1, 301))
    return p.query().entities(UserState).as_of(300).to_df().select("user_id")


@_query("""SELECT user_id, event_id + 1 AS commit_id,
           CASE WHEN min(event_id) OVER (PARTITION BY user_id) < event_id THEN 'update_version' ELSE 'insert' END AS operation FROM events""")
def commit_changes(spark, sf_dir):
    df = temporal.changes(graph_of(spark, sf_dir).history(UserState))
    return df.select(F.col("key").cast("long").alias("user_id"), "commit_id", "operation")


@_query("""SELECT user_id, CASE WHEN (SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id) < event_id THEN 'update_version' ELSE 'insert' END AS operation
           FROM events e WHERE event_id = 776""")
def commit_changes_of_one(spark, sf_dir):
    df = temporal.changes(graph_of(spark, sf_dir).history(UserState), 777)
    return df.select(F.col("key").cast("long").alias("user_id"), "operation")


@_query("SELECT event_id // 100 AS bucket, count(*) AS operations FROM events GROUP BY 1")
def commit_op_counts(spark, sf_dir):
    h = graph_of(spark, sf_dir).history(UserState).withColumn("commit_id", F.floor((F.col("commit_id") - 1) / 100))
    return temporal.operations_per_commit(h).select(F.col("commit_id").alias("bucket"), "operations")


@_query("SELECT count(DISTINCT user_id) AS identities FROM events")
def distinct_latest_counts(spark, sf_dir):
    return temporal.distinct_identities(graph_of(spark, sf_dir).history(UserState))


@_query("SELECT user_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 1")
def point_lookup(spark, sf_dir):
    h = graph_of(spark, sf_dir).history(UserState).where(F.col("key") == "7")
    return temporal.latest(h).select(F.col("key").cast("long").alias("user_id"), F.col("fields.event_type").alias("event_type"))


# --- lists ------------------------------------------------------------------------------------------------------------


@_query("SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase')")
def any_path_exists(spark, sf_dir):
    return graph_of(spark, sf_dir).query().entities(UserLog).where(UserLog.seen.any_path("kind") == "purchase").to_df().select("user_id")


@_query("SELECT count(*) AS n FROM (SELECT user_id FROM events GROUP BY user_id HAVING bool_or(value > 50) AND NOT bool_or(event_type = 'error'))")
def count_where(spark, sf_dir):
    q = graph_of(spark, sf_dir).query().entities(UserLog).where((UserLog.seen.any_path("value") > 50) & ~(UserLog.seen.any_path("kind") == "error"))
    return q.aggregate_df(n=count())


@_query("SELECT round(avg(n), 6) AS value FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def avg_len(spark, sf_dir):
    return graph_of(spark, sf_dir).query().entities(UserLog).avg_len_df(UserLog.seen).select(F.round("value", 6).alias("value"))


# --- relations --------------------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def endpoint_filter_left(spark, sf_dir):
    q = _placed(spark, sf_dir).where((left(Placed).c_mktsegment == "BUILDING") & (Placed.price > 100000))
    return q.to_df().select(F.col("right_key").cast("long").alias("o_orderkey"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def endpoint_filter_right(spark, sf_dir):
    return _placed(spark, sf_dir).where(right(Placed).o_orderpriority == "1-URGENT").to_df().select(F.col("right_key").cast("long").alias("o_orderkey"))


@_query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE (c_mktsegment = 'BUILDING' OR o_totalprice > 200000) AND NOT (c_nationkey = 3 AND o_orderstatus = 'F')""")
def endpoint_filter_mixed(spark, sf_dir):
    """Conditions that mix endpoints and the relation under OR and NOT (D-5)."""
    q = _placed(spark, sf_dir).where(((left(Placed).c_mktsegment == "BUILDING") | (Placed.price > 200000)) & ~((left(Placed).c_nationkey == 3) & (Placed.status == "F")))
    return q.to_df().select(F.col("right_key").cast("long").alias("o_orderkey"))


@_query("SELECT o_orderkey, c_name, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def relation_hydrated(spark, sf_dir):
    df = _placed(spark, sf_dir).hydrated_df()
    return df.select(F.col("right_key").cast("long").alias("o_orderkey"), F.col("left.fields.c_name").alias("c_name"), F.col("right.fields.o_orderpriority").alias("o_orderpriority"))


@_query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders")
def relation_scalar_aggs(spark, sf_dir):
    p = Placed.price
    df = _placed(spark, sf_dir).aggregate_df(n=count(), total=sum(p), average=avg(p), lowest=min(p), highest=max(p))
    return df.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


@_query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
           GROUP BY 1 HAVING count(*) > 10""")
def relation_group_left(spark, sf_dir):
    """Flagship: relations grouped by a field of their left endpoint, with a having condition."""
    df = _placed(spark, sf_dir).group_by(left(Placed).c_mktsegment).having(count() > 10).agg_df(n=count(), total=sum(Placed.price))
    return df.withColumn("total", F.round("total", 2))


@_query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def relation_group_right(spark, sf_dir):
    return _placed(spark, sf_dir).group_by(right(Placed).o_orderpriority).agg_df(n=count())


@_query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY 1")
def relation_group_field(spark, sf_dir):
    return _placed(spark, sf_dir).group_by(Placed.status).agg_df(n=count(), average=avg(Placed.price)).withColumn("average", F.round("average", 4))


@_query("SELECT conv_id, count(DISTINCT turn) AS instances FROM conversations GROUP BY 1")
def keyed_relation_latest(spark, sf_dir):
    """Instances of keyed relations are identities of their own."""
    df = graph_of(spark, sf_dir).query().relations(Said).to_df()
    return df.groupBy(F.col("left_key").cast("long").alias("conv_id")).agg(F.count("*").alias("instances"))


# --- traversals -------------------------------------------------------------------------------------------------------


@_query("SELECT o_custkey AS source, o_orderkey AS reached FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def traverse_one_hop(spark, sf_dir):
    df = _customers(spark, sf_dir).where(Customer.c_mktsegment == "MACHINERY").via(Placed).edges_df()
    return df.select(F.col("source_key").cast("long").alias("source"), F.col("right_key").cast("long").alias("reached"))


@_query("""SELECT c_custkey AS source, 1 AS hop, c_custkey::BIGINT AS l, c_nationkey::BIGINT AS r FROM customer
           UNION ALL SELECT c_custkey, 2, n_nationkey::BIGINT, n_regionkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def traverse_two_hop(spark, sf_dir):
    df = _customers(spark, sf_dir).via(LivesIn).via(PartOf).edges_df()
    return df.select(F.col("source_key").cast("long").alias("source"), "hop", F.col("left_key").cast("long").alias("l"), F.col("right_key").cast("long").alias("r"))


@_query("SELECT c_custkey AS source, count(o_orderkey) AS edges FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def traverse_zero_hop(spark, sf_dir):
    """Sources without edges stay in the result."""
    t = _customers(spark, sf_dir).via(Placed)
    sources = t.source.state_df().select(F.col("key").alias("source_key"))
    edges = t.edges_df().groupBy("source_key").agg(F.sum("paths").alias("edges"))
    return sources.join(edges, "source_key", "left").select(F.col("source_key").cast("long").alias("source"), F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


@_query("SELECT c_custkey AS source, n_regionkey::BIGINT AS destination, 1::BIGINT AS paths FROM customer JOIN nation ON c_nationkey = n_nationkey")
def traverse_destinations(spark, sf_dir):
    df = _customers(spark, sf_dir).via(LivesIn).via(PartOf).destinations_df()
    return df.select(F.col("source_key").cast("long").alias("source"), F.col("destination_key").cast("long").alias("destination"), "paths")


@_query("""SELECT n1.n_nationkey::BIGINT AS source, n2.n_nationkey::BIGINT AS destination, 1::BIGINT AS paths
           FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey""")
def traverse_back(spark, sf_dir):
    """Out over a relation and back over the same one: the second hop enters by the right side."""
    df = graph_of(spark, sf_dir).query().entities(Nation).via(PartOf).via(PartOf).destinations_df()
    return df.select(F.col("source_key").cast("long").alias("source"), F.col("destination_key").cast("long").alias("destination"), "paths")


@_query("""SELECT c_custkey AS source, 1 AS hop, 'Nation' AS type_name, n_nationkey::BIGINT AS key, 1::BIGINT AS times, n_name AS name
           FROM customer JOIN nation ON c_nationkey = n_nationkey
           UNION ALL SELECT c_custkey, 2, 'Nation', n_nationkey::BIGINT, 1, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def traverse_without_relations(spark, sf_dir):
    """The entities that a traversal meets: the second relation does not start at customers, so its left end counts."""
    df = _customers(spark, sf_dir).via(LivesIn).via(PartOf).without_relations_df()
    return df.select(F.col("source_key").cast("long").alias("source"), "hop", "type_name", F.col("key").cast("long").alias("key"), "times", F.get_json_object("fields", "$.n_name").alias("name"))


@_query("""SELECT c_custkey AS source, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END AS hop, count(*)::BIGINT AS entities
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 0 GROUP BY ALL""")
def traverse_without_relations_alone(spark, sf_dir):
    """Sources that reach nothing stand for themselves at hop 0."""
    df = _customers(spark, sf_dir).via(Placed).without_relations_df()
    return df.groupBy(F.col("source_key").cast("long").alias("source"), "hop").agg(F.sum("times").alias("entities"))


# --- reconciliation ---------------------------------------------------------------------------------------------------


def _expected(spark, sf_dir):
    p = graph_of(spark, sf_dir)
    current = temporal.as_of(p.history(UserState), 600)
    expected = temporal.as_of(p.history(UserState), 900)
    return expected, current


_TWO_STATES = """WITH c AS (SELECT user_id, event_type, value, props, event_id FROM events WHERE event_id + 1 <= 600 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    x AS (SELECT user_id, event_type, value, props FROM events WHERE event_id + 1 <= 900 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    j AS (SELECT x.user_id, CASE WHEN c.user_id IS NULL THEN 'insert'
        WHEN (x.event_type, x.value, x.props) IS NOT DISTINCT FROM (c.event_type, c.value, c.props) THEN 'noop' ELSE 'update' END AS operation, c.event_id + 1 AS current_commit_id
        FROM x LEFT JOIN c USING (user_id)) """


@_query(_TWO_STATES + "SELECT user_id, operation FROM j")
def delta_insert_update_noop(spark, sf_dir):
    expected, current = _expected(spark, sf_dir)
    df = delta.classified(expected.drop("commit_id"), current.drop("commit_id"))
    return df.select(F.col("key").cast("long").alias("user_id"), "operation")


@_query(_TWO_STATES + "SELECT user_id, CASE WHEN current_commit_id <> 500 AND operation <> 'insert' THEN 'conflict' WHEN operation = 'noop' THEN 'skip' ELSE operation END AS action FROM j")
def import_conflict_classification(spark, sf_dir):
    expected, current = _expected(spark, sf_dir)
    df = delta.import_plan(expected.drop("commit_id"), current, on_conflict="upsert", precondition="if_commit_id:500")
    return df.select(F.col("key").cast("long").alias("user_id"), "action")


@_query(_TWO_STATES + "SELECT user_id, CASE operation WHEN 'noop' THEN 'skip' WHEN 'update' THEN 'conflict' ELSE operation END AS action FROM j")
def import_abort_classification(spark, sf_dir):
    expected, current = _expected(spark, sf_dir)
    df = delta.import_plan(expected.drop("commit_id"), current)
    return df.select(F.col("key").cast("long").alias("user_id"), "action")


#: Shares of all commits, in percent, at which the whole state is compared: the first leaves inserts and updates, the last updates and noops.
SHARES = (1, 99)


def _whole(spark, sf_dir, classify: Callable[[DataFrame, DataFrame, int], DataFrame], column: str) -> DataFrame:
    """classify(expected, current, commit) for each share: the latest state of all events against the state at the share's commit."""
    history = graph_of(spark, sf_dir).history(UserState)
    out = None
    for percent in SHARES:
        commit = _commit_at(spark, sf_dir, percent)
        found = classify(temporal.latest(history).drop("commit_id"), temporal.as_of(history, commit), commit)
        one = found.select(F.lit(percent).alias("percent"), F.col("key").cast("long").alias("user_id"), column)
        out = one if out is None else out.unionByName(one)
    return out


_WHOLE_STATES = """WITH b AS (SELECT percent, (SELECT max(event_id) + 1 FROM events) * percent // 100 AS bound FROM (SELECT unnest([1, 99]) AS percent)),
    c AS (SELECT percent, user_id, event_type, value, props, event_id FROM events JOIN b ON event_id + 1 <= bound QUALIFY row_number() OVER (PARTITION BY percent, user_id ORDER BY event_id DESC) = 1),
    x AS (SELECT percent, bound, user_id, event_type, value, props FROM b CROSS JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)),
    j AS (SELECT x.percent, x.bound, x.user_id, CASE WHEN c.user_id IS NULL THEN 'insert'
        WHEN (x.event_type, x.value, x.props) IS NOT DISTINCT FROM (c.event_type, c.value, c.props) THEN 'noop' ELSE 'update' END AS operation, c.event_id + 1 AS current_commit_id
        FROM x LEFT JOIN c ON x.percent = c.percent AND x.user_id = c.user_id) """


@_query(_WHOLE_STATES + "SELECT percent, user_id, operation FROM j")
def delta_whole_states(spark, sf_dir):
    return _whole(spark, sf_dir, lambda expected, current, _: delta.classified(expected, current.drop("commit_id")), "operation")


@_query(_WHOLE_STATES + """SELECT percent, user_id, CASE WHEN current_commit_id <> bound AND operation <> 'insert' THEN 'conflict' WHEN operation = 'noop' THEN 'skip' ELSE operation END AS action FROM j""")
def import_conflict_whole_states(spark, sf_dir):
    return _whole(spark, sf_dir, lambda expected, current, commit: delta.import_plan(expected, current, on_conflict="upsert", precondition=f"if_commit_id:{commit}"), "action")


@_query(_WHOLE_STATES + "SELECT percent, user_id, CASE operation WHEN 'noop' THEN 'skip' WHEN 'update' THEN 'conflict' ELSE operation END AS action FROM j")
def import_abort_whole_states(spark, sf_dir):
    return _whole(spark, sf_dir, lambda expected, current, _: delta.import_plan(expected, current), "action")


@_query("SELECT 'customer' AS type_name, c_custkey AS id FROM customer UNION ALL SELECT 'nation', n_nationkey::BIGINT FROM nation")
def export_rows(spark, sf_dir):
    """Interchange lines of two types, read back."""
    p = graph_of(spark, sf_dir)
    lines = None
    for cls in (Customer, Nation):
        rows = p.query().entities(cls).state_df()
        one = rows.select(F.to_json(F.struct(F.lit("entity").alias("type_kind"), F.lit(cls.type_name.lower()).alias("type_name"), "key", "fields")).alias("value"))
        lines = one if lines is None else lines.unionByName(one)
    row = F.from_json("value", "type_name string, key string")
    return lines.select(row.alias("r")).select("r.type_name", F.col("r.key").cast("long").alias("id"))


# --- event bus --------------------------------------------------------------------------------------------------------


def _bus(spark, sf_dir):
    """Events of the table as bus events, with a claim log derived from them: by event id, one in 2 is claimed,
    of these one in 3 acknowledged, one in 5 released, one in 7 given up."""
    e = _table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events = e.select(F.format_string("%012d", "event_id").alias("id"), F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"), F.col("event_type").alias("type"), stamp.alias("created_at"), (F.col("event_id") % 4).cast("int").alias("priority"), (F.col("event_id") % 30).cast("int").alias("chain_depth"))
    base = e.where("event_id % 2 = 0").select(F.col("event_id").alias("n"), F.format_string("%012d", "event_id").alias("event_id"), F.lit("h").alias("handler_id"), F.lit(0).alias("attempt"))
    none = F.lit(None).cast("string")

    def log(rows: DataFrame, kind: str, lease=none, available=none, error=none) -> DataFrame:
        return rows.select("event_id", "handler_id", "attempt", F.lit(kind).alias("kind"), F.lit("s").alias("session_id"), F.lit("2024-01-01").alias("at"), lease.alias("lease_until"), available.alias("available_at"), error.alias("error"))

    claimed = log(base, "claim", lease=F.when(F.col("n") % 4 == 0, "2024-02-01").otherwise("2023-12-01"))
    acked = log(base.where("n % 3 = 0"), "ack")
    released = log(base.where("n % 5 = 0 and n % 3 != 0"), "release", available=F.when(F.col("n") % 20 == 0, "2024-02-01").otherwise("2023-12-01"), error=F.lit("e"))
    dead = log(base.where("n % 7 = 0 and n % 3 != 0 and n % 5 != 0"), "dead", error=F.lit("e"))
    return events, claimed.unionByName(acked).unionByName(released).unionByName(dead)


def _sessions(spark, sf_dir):
    """A session of each user of the table; those of one user in four are past their time to live, some end right on it."""
    u = _table(spark, sf_dir, "events").select("user_id").distinct()
    beat = F.when(F.col("user_id") % 4 == 0, "2024-01-13").when(F.col("user_id") % 4 == 1, "2024-01-14").otherwise("2024-01-15")
    return u.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"), beat.alias("heartbeat_at"))


_STATUS = """CASE WHEN event_id % 2 = 1 THEN 'pending' WHEN event_id % 7 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 'dead_letter'
    WHEN event_id % 3 = 0 THEN 'acked' WHEN event_id % 5 = 0 THEN 'retry' WHEN event_id % 4 = 0 THEN 'claimed' ELSE 'pending' END"""


@_query(f"SELECT {_STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def event_status_rollup(spark, sf_dir):
    events, log = _bus(spark, sf_dir)
    return event_rules.statuses(events, log, "2024-01-15").groupBy("status").agg(F.count("*").alias("n"))


@_query(f"""SELECT 'ns' || (user_id % 3) AS namespace, count(*) AS events, count(*) FILTER ({_STATUS} = 'acked') AS acked, count(*) FILTER ({_STATUS} = 'dead_letter') AS dead_letter FROM events GROUP BY 1""")
def event_namespace_rollup(spark, sf_dir):
    events, log = _bus(spark, sf_dir)
    return event_rules.namespaces(events, log, _sessions(spark, sf_dir), "2024-01-15", "2024-01-14").select("namespace", "events", "acked", "dead_letter")


@_query("""SELECT 'ns' || (user_id % 3) AS namespace, count(*) AS events, count(DISTINCT user_id) FILTER (user_id % 4 <> 0) AS live_sessions FROM events GROUP BY 1""")
def event_namespace_live_sessions(spark, sf_dir):
    """Namespaces with the sessions whose last heartbeat is within the time to live."""
    events, log = _bus(spark, sf_dir)
    return event_rules.namespaces(events, log, _sessions(spark, sf_dir), "2024-01-15", "2024-01-14").select("namespace", "events", "live_sessions")


@_query("""SELECT printf('%012d', event_id) AS id FROM events WHERE event_type IN ('click', 'view')
    AND (event_id % 2 = 1 OR (event_id % 3 <> 0 AND CASE WHEN event_id % 5 = 0 THEN event_id % 20 <> 0 WHEN event_id % 7 = 0 THEN false ELSE event_id % 4 <> 0 END))""")
def event_claimable(spark, sf_dir):
    events, log = _bus(spark, sf_dir)
    return event_rules.claimable(events, log, "h", ["click", "view"], "2024-01-15").select("id")


@_query("SELECT event_id, least(250 * 2 ** (event_id % 10), 30000)::BIGINT AS wait_ms FROM events")
def event_backoff(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", event_rules.backoff_ms(F.col("event_id") % 10, 250, 30000).alias("wait_ms"))


@_query("SELECT printf('%012d', event_id) AS id FROM events WHERE event_id % 30 <= 20")
def event_chain_limit(spark, sf_dir):
    events, _ = _bus(spark, sf_dir)
    return events.where(event_rules.causal_depth_ok(F.col("chain_depth"), 20)).select("id")


@_query("""SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 6 AND 20 AND dayofweek(ts) IN (1, 2, 3, 4, 5)""")
def cron_matches(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.where(Cron.parse("*/15 6-20 * * 1-5").column(F.col("ts"))).select("event_id")


@_query("""SELECT ts::TIMESTAMP AS ts FROM range(TIMESTAMP '2024-03-01', TIMESTAMP '2024-04-01', INTERVAL 1 MINUTE) t(ts)
           WHERE minute(ts) IN (0, 30) AND hour(ts) = 12 AND dayofweek(ts) = 0""")
def cron_fires(spark, sf_dir):
    start, end = dt.datetime(2024, 3, 1, tzinfo=dt.UTC), dt.datetime(2024, 4, 1, tzinfo=dt.UTC)
    return Cron.parse("0,30 12 * * 0").fires_between(spark, start, end).select(F.col("ts").cast("timestamp_ntz").alias("ts"))


@_query("SELECT c_custkey AS source, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def relation_chain_hydrated(spark, sf_dir):
    """Two relations with their endpoints, set-based."""
    p = graph_of(spark, sf_dir)
    lives = p.query().relations(LivesIn).hydrated_df().select(F.col("left_key").cast("long").alias("source"), F.col("right_key").alias("nation"), F.col("right.fields.n_name").alias("n_name"))
    part = graph.with_endpoint(p.query().relations(PartOf).state_df(), p.query().entities(Region).state_df(), "right")
    return lives.join(part.select(F.col("left_key").alias("nation"), F.col("right.fields.r_name").alias("r_name")), "nation").drop("nation")
