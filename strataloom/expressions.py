"""Filter expressions over fields, and their one compiler to Spark columns.

Comparisons follow SQL's three-valued logic. A path goes through structs, typed maps and JSON text alike; a
missing step is null. `any_path` is true if an element of a list satisfies the comparison.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import FieldType

_STEP = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Comparisons that only look at whether or how a value is there.
_UNARY = {"is_null", "is_not_null"}


def checked_path(path: str) -> tuple[str, ...]:
    """The steps of a dotted path; an error if one is no identifier."""
    steps = tuple(path.split(".")) if path else ()
    if not steps or not all(_STEP.match(s) for s in steps):
        raise ValueError(f"invalid path {path!r}")
    return steps


def reference(path: str, endpoints: bool = False) -> FieldRef:
    """The field at a dotted path; with endpoints, 'left.' and 'right.' lead to the ends of a relation."""
    side, _, rest = path.partition(".")
    if endpoints and side in ("left", "right") and rest:
        return FieldRef(checked_path(rest), endpoint=side)
    return FieldRef(checked_path(path))


class Filter:
    """A condition; combine with &, | and ~."""

    def __and__(self, other: Filter) -> Filter:
        return Logic("and", (self, other))

    def __or__(self, other: Filter) -> Filter:
        return Logic("or", (self, other))

    def __invert__(self) -> Filter:
        return Logic("not", (self,))

    def __bool__(self) -> bool:
        raise TypeError("a condition has no truth value: combine with &, | and ~")


@dataclass(frozen=True, eq=False)
class Comparison(Filter):
    ref: FieldRef
    op: str
    value: Any = None


@dataclass(frozen=True, eq=False)
class Exists(Filter):
    ref: FieldRef
    steps: tuple[str, ...]
    op: str
    value: Any = None


@dataclass(frozen=True, eq=False)
class Logic(Filter):
    op: str
    parts: tuple[Filter, ...]


class _Operators:
    """The comparisons that fields and list elements share."""

    def _compare(self, op: str, value: Any = None) -> Filter:
        raise NotImplementedError

    def _literal(self, op: str, value: Any) -> Filter:
        if value is None:
            raise TypeError("compare with None by is_null() or is_not_null()")
        if isinstance(value, bool):
            raise TypeError("compare with a bool by is_true() or is_false()")
        return self._compare(op, value)

    def __eq__(self, value: Any) -> Filter:  # type: ignore[override]
        return self._literal("==", value)

    def __ne__(self, value: Any) -> Filter:  # type: ignore[override]
        return self._literal("!=", value)

    __hash__ = None

    def __gt__(self, value: Any) -> Filter:
        return self._literal(">", value)

    def __ge__(self, value: Any) -> Filter:
        return self._literal(">=", value)

    def __lt__(self, value: Any) -> Filter:
        return self._literal("<", value)

    def __le__(self, value: Any) -> Filter:
        return self._literal("<=", value)

    def in_(self, values: Any) -> Filter:
        return self._compare("in", list(values))

    def is_null(self) -> Filter:
        return self._compare("is_null")

    def is_not_null(self) -> Filter:
        return self._compare("is_not_null")


class FieldRef(_Operators):
    """A field, or a path below it, of a type or of an endpoint ('left' or 'right') of a relation."""

    def __init__(self, steps: tuple[str, ...], owner: type | None = None, endpoint: str | None = None):
        self.steps, self.owner, self.endpoint = steps, owner, endpoint

    @property
    def label(self) -> str:
        return ".".join(self.steps)

    def _compare(self, op: str, value: Any = None) -> Filter:
        return Comparison(self, op, value)

    def startswith(self, prefix: str) -> Filter:
        return Comparison(self, "startswith", prefix)

    def endswith(self, suffix: str) -> Filter:
        return Comparison(self, "endswith", suffix)

    def contains(self, part: str) -> Filter:
        return Comparison(self, "contains", part)

    def is_true(self) -> Filter:
        return Comparison(self, "==", True)

    def is_false(self) -> Filter:
        return Comparison(self, "==", False)

    def path(self, path: str) -> FieldRef:
        return FieldRef(self.steps + checked_path(path), self.owner, self.endpoint)

    def __getitem__(self, step: str) -> FieldRef:
        return self.path(step)

    def any_path(self, path: str) -> AnyRef:
        if self.endpoint:
            raise ValueError("any_path is for fields of the queried type, not of its endpoints")
        return AnyRef(self, checked_path(path))

    def __iter__(self):
        raise TypeError("a field is no sequence")


class AnyRef(_Operators):
    """Some element of a list field."""

    def __init__(self, ref: FieldRef, steps: tuple[str, ...]):
        self.ref, self.steps = ref, steps

    def _compare(self, op: str, value: Any = None) -> Filter:
        return Exists(self.ref, self.steps, op, value)


class _Endpoint:
    def __init__(self, relation: type, side: str):
        self._relation, self._side = relation, side

    def __getattr__(self, name: str) -> FieldRef:
        if name.startswith("_"):
            raise AttributeError(name)
        owner = getattr(self._relation, f"{self._side}_type")
        if name not in owner._fields:
            raise AttributeError(f"{owner.__name__} has no field {name}")
        return FieldRef((name,), owner, self._side)


def left(relation: type) -> Any:
    """The fields of the relation's left entity."""
    return _Endpoint(relation, "left")


def right(relation: type) -> Any:
    """The fields of the relation's right entity."""
    return _Endpoint(relation, "right")


def endpoints(expression: Filter | None) -> set[str]:
    """The endpoints that a condition looks at."""
    if expression is None:
        return set()
    if isinstance(expression, Logic):
        return set().union(*(endpoints(p) for p in expression.parts))
    side = expression.ref.endpoint
    return {side} if side else set()


def walk(column: Column, kind: FieldType, steps: tuple[str, ...]) -> tuple[Column, FieldType]:
    """The column and type at the end of a path. Once in JSON text, the rest of the path is read from it."""
    while steps and kind.kind != "json":
        step, steps = steps[0], steps[1:]
        if kind.kind == "struct":
            inner = dict(kind.fields).get(step)
            if inner is None:
                raise ValueError(f"no field {step!r} in {kind.name}")
            column, kind = column.getField(step), inner
        elif kind.kind == "map":
            column, kind = F.try_element_at(column, F.lit(step)), kind.item
        else:
            raise ValueError(f"path step {step!r} below a {kind.name or kind.kind}")
    if steps:
        column = F.get_json_object(column, "$." + ".".join(steps))
    return column, kind


def json_as(column: Column, value: Any) -> Column:
    """Text of a JSON value, compared with `value`: read as the value's type; JSON null is null."""
    if isinstance(value, bool):
        return F.when(column == "true", True).when(column == "false", False)
    if isinstance(value, int | float):
        return column.try_cast("double")
    return column


def compare(column: Column, kind: FieldType, op: str, value: Any) -> Column:
    if op == "is_null":
        return column.isNull()
    if op == "is_not_null":
        return column.isNotNull()
    if kind.kind == "json":
        sample = next(iter(value), "") if op == "in" else value
        column = json_as(column, sample)
    if op == "in":
        return column.isin(list(value)) if value else column.isNull() & F.lit(False)
    if op in ("startswith", "endswith", "contains"):
        return getattr(column, op)(F.lit(value))
    return {"==": column == value, "!=": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]


def compiled(expression: Filter, resolve, present=None) -> Column:
    """The condition as a column. resolve(ref): the column and type of a reference.

    present(ref): whether what the reference belongs to is there at all (None: it is); if not, all is unknown.
    """
    if isinstance(expression, Logic):
        parts = [compiled(p, resolve, present) for p in expression.parts]
        if expression.op == "not":
            return ~parts[0]
        return parts[0] & parts[1] if expression.op == "and" else parts[0] | parts[1]
    column, kind = resolve(expression.ref)
    if isinstance(expression, Comparison):
        out = compare(column, kind, expression.op, expression.value)
        there = present(expression.ref) if present else None
        return out if there is None else F.when(there, out)
    if kind.kind == "json":  # the list is JSON text
        column, item = F.from_json(column, "array<string>"), FieldType("json", nullable=True)
    elif kind.kind == "list":
        item = kind.item
    else:
        return F.lit(False)

    def one(element: Column) -> Column:
        if item.kind == "primitive" or (item.kind == "list"):
            return compare(element, item, expression.op, expression.value)  # elements without fields compare as they are
        at, of = walk(element, item, expression.steps)
        return compare(at, of, expression.op, expression.value)

    return F.coalesce(F.exists(column, one), F.lit(False))
