"""The query API. Queries are immutable; each compiles to one DataFrame and runs only when its result is asked for.

A query's rows come from a provider: `history(cls)` gives the type's versions (see operators.temporal), and
`layout(cls)` its current schema version and the commit from which that holds, or None for an unknown type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby
from operator import itemgetter
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import Exists, FieldRef, Filter, Logic, compiled, endpoints, reference, walk
from ..model import Entity, Meta, Relation
from ..operators import graph, temporal
from ..types import FieldType


@dataclass(frozen=True)
class Layout:
    """The schema version that reads see, and the first commit written under it (0: from the start).

    single: each identity has one version only, so the latest needs no choice: conditions reach the scan and
    nothing is shuffled for it.
    """

    schema_version_id: int | None = None
    activation: int = 0
    single: bool = False


class Provider(Protocol):
    spark: SparkSession

    def history(self, cls: type, lower: int | None = None, upper: int | None = None) -> DataFrame: ...

    def layout(self, cls: type) -> Layout | None: ...


@dataclass(frozen=True)
class Mode:
    """latest, as_of, history or since."""

    name: str = "latest"
    commit_id: int = 0


# --- aggregates -------------------------------------------------------------------------------------------------


@dataclass(frozen=True, eq=False)
class Aggregate:
    """count, sum, avg, min or max; compares with a number to a `having` condition."""

    function: str
    ref: FieldRef | None = None

    def _having(self, op: str, value: Any) -> Having:
        return Having(self, op, value)

    def __gt__(self, value: Any) -> Having:
        return self._having(">", value)

    def __ge__(self, value: Any) -> Having:
        return self._having(">=", value)

    def __lt__(self, value: Any) -> Having:
        return self._having("<", value)

    def __le__(self, value: Any) -> Having:
        return self._having("<=", value)

    def __eq__(self, value: object) -> Having:  # type: ignore[override]
        return self._having("==", value)

    def __ne__(self, value: object) -> Having:  # type: ignore[override]
        return self._having("!=", value)

    __hash__ = None

    def column(self, resolve) -> Column:
        if self.function == "count":
            return F.count("*")
        column, kind = resolve(self.ref)
        if kind.kind == "json" and self.function in ("sum", "avg"):
            column = column.try_cast("double")
        if self.function == "avg":
            column = column.cast("double")
        return getattr(F, self.function)(column)


@dataclass(frozen=True, eq=False)
class Having:
    aggregate: Aggregate
    op: str
    value: Any


def count() -> Aggregate:
    return Aggregate("count")


def sum(ref: FieldRef) -> Aggregate:  # noqa: A001 - the API's name
    return Aggregate("sum", ref)


def avg(ref: FieldRef) -> Aggregate:
    return Aggregate("avg", ref)


def min(ref: FieldRef) -> Aggregate:  # noqa: A001
    return Aggregate("min", ref)


def max(ref: FieldRef) -> Aggregate:  # noqa: A001
    return Aggregate("max", ref)


# --- state under a mode ------------------------------------------------------------------------------------------


def state(provider: Provider, cls: type, mode: Mode) -> tuple[DataFrame, dict[str, Any] | None]:
    """The type's rows under a mode, and why there are none, if that is known without looking.

    Reads never mix schema versions: only the current one's rows count, from its activation on.
    """
    key = temporal.ENTITY_KEY if issubclass(cls, Entity) else temporal.RELATION_KEY
    layout = provider.layout(cls)
    if layout is None:
        return provider.history(cls, upper=-1).limit(0), {"reason": "unknown_type", "type_name": cls.type_name}
    if mode.name == "as_of" and mode.commit_id < layout.activation:
        told = {"reason": "commit_before_activation", "type_name": cls.type_name, "commit_id": mode.commit_id, "activation_commit_id": layout.activation}
        return provider.history(cls, upper=-1).limit(0), told
    if mode.name == "as_of":
        rows = temporal.of_version(provider.history(cls, upper=mode.commit_id), layout.schema_version_id)
        return (rows.where(F.col("commit_id") <= mode.commit_id) if layout.single else temporal.as_of(rows, mode.commit_id, key)), None
    if mode.name == "since":
        rows = temporal.of_version(provider.history(cls, lower=mode.commit_id), layout.schema_version_id)
        return temporal.since(rows, mode.commit_id), None
    rows = temporal.of_version(provider.history(cls), layout.schema_version_id)
    return (rows if mode.name == "history" or layout.single else temporal.latest(rows, key)), None


def _field(cls: type, ref: FieldRef, column: Column) -> tuple[Column, FieldType]:
    """A reference within a struct column of the class's fields."""
    fields = cls._fields
    first = ref.steps[0]
    if first not in fields:
        raise ValueError(f"{cls.__name__} has no field {first!r}")
    if fields[first].instance_key:
        return F.col("instance_key"), fields[first].type
    return walk(column.getField(first), fields[first].type, ref.steps[1:])


# --- queries -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Query:
    provider: Provider
    cls: type
    condition: Filter | None = None
    order: tuple[FieldRef, bool] | None = None
    rows: int | None = None
    skip: int = 0
    mode: Mode = field(default_factory=Mode)

    def where(self, condition: Filter):
        """Further conditions hold too."""
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def order_by(self, ref: FieldRef | str, desc: bool = False):
        """One key, a field or its path; nulls are smallest."""
        return replace(self, order=(self._named(ref), desc))

    def limit(self, n: int):
        return replace(self, rows=n)

    def offset(self, n: int):
        return replace(self, skip=n)

    def as_of(self, commit_id: int):
        """The state right after a commit."""
        return replace(self, mode=Mode("as_of", commit_id))

    def with_history(self):
        """All versions; collect() gives them in order of commits."""
        return replace(self, mode=Mode("history"))

    def history_since(self, commit_id: int):
        """The versions after a commit."""
        return replace(self, mode=Mode("since", commit_id))

    @property
    def diagnostics(self) -> dict[str, Any] | None:
        """Why the result is empty, where that is known without reading rows."""
        return state(self.provider, self.cls, self.mode)[1]

    def _resolve(self, ref: FieldRef) -> tuple[Column, FieldType]:
        return _field(self.cls, ref, F.col("fields"))

    def _named(self, ref: FieldRef | str) -> FieldRef:
        return reference(ref, issubclass(self.cls, Relation)) if isinstance(ref, str) else ref

    def _matching(self) -> DataFrame:
        raise NotImplementedError

    def _page(self, df: DataFrame) -> DataFrame:
        key = temporal.ENTITY_KEY if issubclass(self.cls, Entity) else temporal.RELATION_KEY
        if self.order is not None:
            column, _ = self._order_column()
            df = df.orderBy(column.desc_nulls_last() if self.order[1] else column.asc_nulls_first())
        elif self.mode.name in ("history", "since") and (self.rows is not None or self.skip):
            df = df.orderBy("commit_id", "seq", *key)  # a page of versions is cut in their order
        if self.skip:
            df = df.offset(self.skip)
        return df if self.rows is None else df.limit(self.rows)

    def _order_column(self) -> tuple[Column, FieldType]:
        return self._resolve(self.order[0])

    def state_df(self) -> DataFrame:
        """Identity, commit_id, schema_version_id, seq and the struct `fields` of the result."""
        return self._page(self._matching())

    def count(self) -> int:
        return self._matching().count()

    def count_where(self, condition: Filter) -> int:
        return self.where(condition).count()

    def aggregate_df(self, **aggregates: Aggregate) -> DataFrame:
        """Named aggregates over all matching rows, as one row."""
        return self._prepared().agg(*[a.column(self._resolve).alias(n) for n, a in aggregates.items()])

    def _prepared(self) -> DataFrame:
        return self._matching()

    def _scalar(self, aggregate: Aggregate) -> Any:
        return self.aggregate_df(value=aggregate).first()[0]

    def sum(self, ref: FieldRef) -> Any:
        return self._scalar(sum(ref))

    def avg(self, ref: FieldRef) -> float | None:
        return self._scalar(avg(ref))

    def min(self, ref: FieldRef) -> Any:
        return self._scalar(min(ref))

    def max(self, ref: FieldRef) -> Any:
        return self._scalar(max(ref))

    def avg_len_df(self, ref: FieldRef) -> DataFrame:
        """The average length of a list: no list counts nothing, an empty one 0."""
        column, kind = self._resolve(ref)
        if kind.kind == "json":
            length = F.json_array_length(column)
        elif kind.kind == "list":
            length = F.when(column.isNotNull(), F.size(column))
        else:
            length = F.lit(None).cast("int")
        return self._matching().agg(F.avg(length).alias("value"))

    def avg_len(self, ref: FieldRef) -> float | None:
        return self.avg_len_df(ref).first()[0]

    def group_by(self, ref: FieldRef | str) -> GroupedQuery:
        return GroupedQuery(self, self._named(ref))

    def collect(self) -> list[Any]:
        raise NotImplementedError

    def first(self) -> Any:
        found = self.limit(1).collect()
        return found[0] if found else None


def _rebuilt(cls: type, row: Any) -> dict[str, Any]:
    """The data of an object from a Row of its fields."""
    return {n: f.type.from_row(row[n]) for n, f in cls.data_fields().items()}


def entity_of(cls: type, key: str, commit_id: int, fields: Any) -> Any:
    obj = cls.__new__(cls)
    obj.__dict__.update(_rebuilt(cls, fields))
    obj._meta = Meta(commit_id, cls.type_name, key=key)
    return obj


def relation_of(cls: type, row: Any) -> Any:
    obj = cls.__new__(cls)
    obj.left_key, obj.right_key, obj.instance_key = row["left_key"], row["right_key"], row["instance_key"] or ""
    obj.left = obj.right = None
    obj.__dict__.update(_rebuilt(cls, row["fields"]))
    if cls.instance_field:
        obj.__dict__[cls.instance_field] = obj.instance_key
    obj._meta = Meta(row["commit_id"], cls.type_name, left_key=obj.left_key, right_key=obj.right_key, instance_key=obj.instance_key or None)
    return obj


@dataclass(frozen=True)
class EntityQuery(_Query):
    def _matching(self) -> DataFrame:
        rows, _ = state(self.provider, self.cls, self.mode)
        return rows if self.condition is None else rows.where(compiled(self.condition, self._resolve))

    def to_df(self) -> DataFrame:
        """The fields as columns, with _key, _commit_id and _schema_version_id."""
        meta = [F.col("key").alias("_key"), F.col("commit_id").alias("_commit_id"), F.col("schema_version_id").alias("_schema_version_id")]
        return self.state_df().select(F.col("fields.*"), *meta).drop("_none")

    def sum(self, ref: FieldRef) -> float | None:
        """As a double; null without values."""
        column, _ = self._resolve(ref)
        return self._matching().agg(F.sum(column.try_cast("double") if self._resolve(ref)[1].kind == "json" else column.cast("double"))).first()[0]

    def collect(self) -> list[Any]:
        rows = self.state_df()
        if self.order is None and self.mode.name in ("history", "since"):
            rows = rows.orderBy("commit_id", "seq", "key")
        return [entity_of(self.cls, r["key"], r["commit_id"], r["fields"]) for r in rows.select("key", "commit_id", "fields").collect()]

    def via(self, relation: type[Relation]) -> TraversalQuery:
        """A traversal from the entities that the conditions choose; order, page and mode do not carry over."""
        return TraversalQuery(EntityQuery(self.provider, self.cls, self.condition), (relation,))


def _conjuncts(condition: Filter) -> list[Filter]:
    if isinstance(condition, Logic) and condition.op == "and":
        return [c for p in condition.parts for c in _conjuncts(p)]
    return [condition]


@dataclass(frozen=True)
class RelationQuery(_Query):
    def _endpoint_rows(self, side: str) -> DataFrame:
        return state(self.provider, getattr(self.cls, f"{side}_type"), self.mode)[0]

    def _resolve(self, ref: FieldRef) -> tuple[Column, FieldType]:
        if ref.endpoint:
            return _field(getattr(self.cls, f"{ref.endpoint}_type"), ref, F.col(f"{ref.endpoint}.fields"))
        return _field(self.cls, ref, F.col("fields"))

    def _matching(self) -> DataFrame:
        rows, _ = state(self.provider, self.cls, self.mode)
        if self.condition is None:
            return rows
        mixed = []
        sides: dict[str, list[Filter]] = {}
        for part in _conjuncts(self.condition):
            used = endpoints(part)
            if not used:
                rows = rows.where(compiled(part, self._resolve))
            elif len(used) == 1 and not _looks_at_relation(part):
                sides.setdefault(next(iter(used)), []).append(part)
            else:
                mixed.append(part)
        for side, parts in sides.items():
            # Conditions on one endpoint alone are semi-joins, and one version must satisfy all of them.
            owner = getattr(self.cls, f"{side}_type")
            entities = self._endpoint_rows(side)
            for part in parts:
                entities = entities.where(compiled(part, lambda ref, o=owner: _field(o, ref, F.col("fields"))))
            rows = graph.with_matching_endpoint(rows, entities, side)
        if mixed:
            columns = rows.columns
            for side in sorted(set().union(*(endpoints(p) for p in mixed))):
                rows = graph.with_endpoint(rows, self._endpoint_rows(side), side)
            for part in mixed:
                # A missing endpoint satisfies no condition on it, as with the semi-joins above.
                rows = rows.where(compiled(part, self._resolve, lambda ref: F.col(ref.endpoint).isNotNull() if ref.endpoint else None))
            if self.mode.name in ("history", "since"):  # several versions of an endpoint may match
                rows = rows.dropDuplicates([*temporal.RELATION_KEY, "commit_id", "seq"])
            rows = rows.select(columns)
        return rows

    def _order_column(self) -> tuple[Column, FieldType]:
        if self.order[0].endpoint:
            raise ValueError("order relations by their own fields")
        return super()._order_column()

    def to_df(self) -> DataFrame:
        """The fields as columns, with the keys, _commit_id and _schema_version_id."""
        meta = [F.col("commit_id").alias("_commit_id"), F.col("schema_version_id").alias("_schema_version_id")]
        return self.state_df().select("left_key", "right_key", "instance_key", F.col("fields.*"), *meta).drop("_none")

    def hydrated_df(self, endpoint_mode: str = "latest") -> DataFrame:
        """state_df with the endpoints as structs `left` and `right` (null if missing).

        endpoint_mode: the endpoints' latest state, or 'as_of' for their state under this query's mode.
        """
        mode = self.mode if endpoint_mode == "as_of" else Mode()
        rows = self.state_df()
        for side in ("left", "right"):
            rows = graph.with_endpoint(rows, state(self.provider, getattr(self.cls, f"{side}_type"), mode)[0], side)
        return rows

    def collect(self, endpoint_mode: str = "latest") -> list[Any]:
        rows = self.hydrated_df(endpoint_mode)
        if self.order is not None:  # joins do not keep the order
            column, _ = self._order_column()
            rows = rows.orderBy(column.desc_nulls_last() if self.order[1] else column.asc_nulls_first())
        elif self.mode.name in ("history", "since"):
            rows = rows.orderBy("commit_id", "seq", *temporal.RELATION_KEY)
        out = []
        for r in rows.collect():
            obj = relation_of(self.cls, r)
            for side in ("left", "right"):
                if r[side] is not None:
                    setattr(obj, side, entity_of(getattr(self.cls, f"{side}_type"), r[side]["key"], r[side]["commit_id"], r[side]["fields"]))
            out.append(obj)
        return out


def _looks_at_relation(condition: Filter) -> bool:
    if isinstance(condition, Logic):
        return any(_looks_at_relation(p) for p in condition.parts)
    return isinstance(condition, Exists) or condition.ref.endpoint is None


@dataclass(frozen=True)
class GroupedQuery:
    """Groups by one key; null is a group."""

    query: _Query
    ref: FieldRef
    conditions: tuple[Having, ...] = ()

    def having(self, condition: Having) -> GroupedQuery:
        """The condition on groups; a later one takes the place of an earlier one."""
        return replace(self, conditions=(condition,))

    def agg_df(self, **aggregates: Aggregate) -> DataFrame:
        """The group's key, named by its path, and the aggregates."""
        for name, a in aggregates.items():
            if not isinstance(a, Aggregate):
                raise TypeError(f"{name} is no aggregate")
        q = self.query
        rows = q._matching()
        used = {r.endpoint for r in [self.ref, *(a.ref for a in aggregates.values()), *(h.aggregate.ref for h in self.conditions)] if r is not None and r.endpoint}
        for side in sorted(used):
            rows = graph.with_endpoint(rows, q._endpoint_rows(side), side, "inner")
        label = self.ref.label
        columns = [a.column(q._resolve).alias(n) for n, a in aggregates.items()]
        hidden = [h.aggregate.column(q._resolve).alias(f"_having_{i}") for i, h in enumerate(self.conditions)]
        grouped = rows.groupBy(q._resolve(self.ref)[0].alias(label)).agg(*columns, *hidden)
        for i, h in enumerate(self.conditions):
            c = F.col(f"_having_{i}")
            grouped = grouped.where({">": c > h.value, ">=": c >= h.value, "<": c < h.value, "<=": c <= h.value, "==": c == h.value, "!=": c != h.value}[h.op])
        return grouped.drop(*[f"_having_{i}" for i in range(len(self.conditions))])

    def agg(self, **aggregates: Aggregate) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.agg_df(**aggregates).collect()]


@dataclass
class Path:
    """A source and all relations that a traversal met from it, hop by hop."""

    source: Any
    relations: list[Any] = field(default_factory=list)

    @property
    def entities(self) -> list[Any]:
        """The source, then of each relation the end that it leads to from where the path has been."""
        out, been = [self.source], {self.source.meta().key if self.source._meta else self.source.key}
        for r in self.relations:
            forward = r.left_key in been
            out.append(r.right if forward else r.left)
            been.add(r.right_key if forward else r.left_key)
        return out


@dataclass(frozen=True)
class TraversalQuery:
    """Hops over relations from source entities. A relation is entered by the side whose type stands there."""

    source: EntityQuery
    steps: tuple[type[Relation], ...] = ()

    def via(self, relation: type[Relation]) -> TraversalQuery:
        return replace(self, steps=(*self.steps, relation))

    def where(self, condition: Filter) -> TraversalQuery:
        """A further condition on the source."""
        return replace(self, source=self.source.where(condition))

    def _sides(self) -> list[str]:
        at, out = self.source.cls, []
        for relation in self.steps:
            near = "left" if relation.left_type is at else "right"
            at = relation.right_type if near == "left" else relation.left_type
            out.append(near)
        return out

    def _plan(self) -> list[tuple[DataFrame, str]]:
        return [(state(self.source.provider, r, Mode())[0], near) for r, near in zip(self.steps, self._sides(), strict=True)]

    def edges_df(self) -> DataFrame:
        """source_key, hop, paths and the edge; sources without edges have no row."""
        return graph.hops(self.source.state_df(), self._plan())

    def destinations_df(self) -> DataFrame:
        """source_key, destination_key, paths after the last hop."""
        return graph.destinations(self.source.state_df(), self._plan())

    def without_relations_df(self) -> DataFrame:
        """without_relations as rows: source_key, hop, type_name, key, times and its fields as JSON.

        An entity that is not stored has null fields; a source that reaches nothing stands for itself, at hop 0.
        """
        source = self.source
        start = source.state_df().select("key", F.to_json("fields").alias("fields"))
        edges, out = self.edges_df(), []
        for number, relation in enumerate(self.steps, 1):
            side = "right" if issubclass(source.cls, relation.left_type) else "left"
            cls = getattr(relation, f"{side}_type")
            ends = edges.where(F.col("hop") == number).groupBy("source_key", F.col(f"{side}_key").alias("key")).agg(F.sum("paths").alias("times"))
            stored = state(source.provider, cls, Mode())[0].select("key", F.to_json("fields").alias("fields"))
            out.append(ends.join(stored, "key", "left").select("source_key", F.lit(number).alias("hop"), F.lit(cls.type_name).alias("type_name"), "key", "times", "fields"))
        # Who leaves by the first hop reaches something.
        alone = start if edges is None else start.join(edges.where("hop = 1").select(F.col("source_key").alias("key")), "key", "left_anti")
        whole = alone.select(F.col("key").alias("source_key"), F.lit(0).alias("hop"), F.lit(source.cls.type_name).alias("type_name"), "key", F.lit(1).cast("long").alias("times"), "fields")
        for part in out:
            whole = whole.unionByName(part)
        return whole

    def _found(self) -> list[tuple[type[Relation], DataFrame]]:
        """For each hop its relations with both ends, source_key and paths, in the sources' order."""
        provider, out = self.source.provider, []
        at = self.source.state_df().select("key")
        frontier = at.select(F.col("key").alias("source_key"), F.col("key").alias("at"), F.lit(1).cast("long").alias("paths"))
        for relation, (edges, near) in zip(self.steps, self._plan(), strict=True):
            far = "right" if near == "left" else "left"
            reached = frontier.join(edges, F.col("at") == F.col(f"{near}_key")).drop("at")
            whole = reached
            for side in ("left", "right"):
                whole = graph.with_endpoint(whole, state(provider, getattr(relation, f"{side}_type"), Mode())[0], side)
            out.append((relation, whole.orderBy("source_key", *temporal.RELATION_KEY)))
            frontier = reached.groupBy("source_key", F.col(f"{far}_key").alias("at")).agg(F.sum("paths").alias("paths"))
        return out

    @staticmethod
    def _met(relation: type[Relation], row: Any) -> list[Relation]:
        obj = relation_of(relation, row)
        for side in ("left", "right"):
            if row[side] is not None:
                setattr(obj, side, entity_of(getattr(relation, f"{side}_type"), row[side]["key"], row[side]["commit_id"], row[side]["fields"]))
        return [obj] * row["paths"]

    def collect(self) -> list[Path]:
        """One path for each source, also for those that reach nothing."""
        paths = {s.meta().key: Path(s) for s in self.source.collect()}
        for relation, found in self._found():
            for r in found.collect():
                paths[r["source_key"]].relations += self._met(relation, r)
        return list(paths.values())

    def iterate(self) -> Iterator[Path]:
        """As collect, in the order of the sources' keys: the driver holds a partition of each hop at a time."""
        hops = [(relation, groupby(found.toLocalIterator(), key=itemgetter("source_key"))) for relation, found in self._found()]
        ahead = [next(groups, None) for _, groups in hops]
        sources = self.source.state_df().select("key", "commit_id", "seq", "fields").orderBy("key", "commit_id", "seq")
        for key, versions in groupby(sources.toLocalIterator(), key=itemgetter("key")):
            *_, last = versions
            path = Path(entity_of(self.source.cls, key, last["commit_id"], last["fields"]))
            for i, (relation, groups) in enumerate(hops):
                if ahead[i] is not None and ahead[i][0] == key:
                    for r in ahead[i][1]:
                        path.relations += self._met(relation, r)
                    ahead[i] = next(groups, None)
            yield path

    def without_relations(self) -> list[Any]:
        """The far entity of every relation of every hop; sources that reach nothing stand for themselves."""
        out = []
        for path in self.collect():
            if not path.relations:
                out.append(path.source)
            out += [r.right if isinstance(path.source, type(r).left_type) else r.left for r in path.relations]
        return out


@dataclass(frozen=True)
class QueryBuilder:
    provider: Provider

    def entities(self, cls: type[Entity]) -> EntityQuery:
        return EntityQuery(self.provider, cls)

    def relations(self, cls: type[Relation]) -> RelationQuery:
        return RelationQuery(self.provider, cls)


@dataclass
class FrameProvider:
    """Histories that are DataFrames already: any table can be queried as entities or relations.

    A history may be a function that returns one: it is called when a query first needs it.
    """

    spark: SparkSession
    frames: dict[type, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    layouts: dict[type, Layout] = field(default_factory=dict)

    def add(self, cls: type, history: DataFrame | Callable[[], DataFrame], layout: Layout | None = None) -> FrameProvider:
        self.frames[cls] = history
        self.layouts[cls] = layout or Layout()
        return self

    def history(self, cls: type, lower: int | None = None, upper: int | None = None) -> DataFrame:
        if callable(self.frames[cls]):
            self.frames[cls] = self.frames[cls]()
        return self.frames[cls]

    def layout(self, cls: type) -> Layout | None:
        return self.layouts.get(cls)

    def query(self) -> QueryBuilder:
        return QueryBuilder(self)
