"""Field types: from annotations to Spark types, checks, and a canonical description for drift detection.

What Spark can type is typed (structs for TypedDicts, arrays, maps); `Any`, mixed unions, recursive shapes and
dictionaries of unknown values are JSON text in a string column and are read by path.
"""

from __future__ import annotations

import datetime as dt
import json
import types
import typing
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import ValidationError

_PRIMITIVES: dict[Any, T.DataType] = {
    str: T.StringType(),
    int: T.LongType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    dt.datetime: T.TimestampType(),
    dt.date: T.DateType(),
    bytes: T.BinaryType(),
}


@dataclass(frozen=True)
class FieldType:
    """kind: primitive, list, map, struct or json."""

    kind: str
    name: str = ""
    nullable: bool = False
    item: FieldType | None = None
    fields: tuple[tuple[str, FieldType], ...] = ()
    total: bool = True

    def spark(self) -> T.DataType:
        if self.kind == "primitive":
            return next(t for k, t in _PRIMITIVES.items() if k.__name__ == self.name)
        if self.kind == "list":
            return T.ArrayType(self.item.spark())
        if self.kind == "map":
            return T.MapType(T.StringType(), self.item.spark())
        if self.kind == "struct":
            return T.StructType([T.StructField(n, t.spark()) for n, t in self.fields])
        return T.StringType()

    def spec(self) -> dict[str, Any]:
        out: dict[str, Any] = {"kind": self.kind}
        if self.name:
            out["name"] = self.name
        if self.nullable:
            out["nullable"] = True
        if self.item is not None:
            out["item"] = self.item.spec()
        if self.kind == "struct":
            out |= {"fields": {n: t.spec() for n, t in self.fields}, "total": self.total}
        return out

    @staticmethod
    def from_spec(spec: dict[str, Any]) -> FieldType:
        return FieldType(
            spec["kind"],
            spec.get("name", ""),
            spec.get("nullable", False),
            FieldType.from_spec(spec["item"]) if "item" in spec else None,
            tuple((n, FieldType.from_spec(s)) for n, s in spec.get("fields", {}).items()),
            spec.get("total", True),
        )

    def check(self, value: Any, where: str) -> Any:
        """The value as this type holds it; an error if it does not fit."""

        def wrong() -> ValidationError:
            return ValidationError(f"{where}: {value!r} is no {self.name or self.kind}")

        if value is None:
            if self.nullable or self.kind == "json":
                return None
            raise wrong()
        if self.kind == "json":
            try:
                json.dumps(value)
            except (TypeError, ValueError):
                raise wrong() from None
            return value
        if self.kind == "list":
            if not isinstance(value, list | tuple):
                raise wrong()
            return [self.item.check(v, f"{where}[{i}]") for i, v in enumerate(value)]
        if self.kind == "map":
            if not isinstance(value, dict):
                raise wrong()
            return {str(k): self.item.check(v, f"{where}.{k}") for k, v in value.items()}
        if self.kind == "struct":
            if not isinstance(value, dict):
                raise wrong()
            known = dict(self.fields)
            if extra := [k for k in value if k not in known]:
                raise ValidationError(f"{where}: unknown keys {extra}")
            if self.total and (missing := [n for n, t in self.fields if n not in value and not t.nullable]):
                raise ValidationError(f"{where}: missing keys {missing}")
            return {n: known[n].check(v, f"{where}.{n}") for n, v in value.items()}
        if self.name == "bool":
            if isinstance(value, bool):
                return value
        elif self.name == "int":
            if isinstance(value, int) and not isinstance(value, bool):
                return value
            if isinstance(value, float) and value.is_integer():
                return int(value)
            if isinstance(value, str):
                try:
                    return int(value)
                except ValueError:
                    pass
        elif self.name == "float":
            if isinstance(value, int | float) and not isinstance(value, bool):
                return float(value)
            if isinstance(value, str):
                try:
                    return float(value)
                except ValueError:
                    pass
        elif self.name == "str":
            if isinstance(value, str):
                return value
        elif self.name == "datetime":
            if isinstance(value, dt.datetime):
                return value
            if isinstance(value, str):
                try:
                    return dt.datetime.fromisoformat(value)
                except ValueError:
                    pass
        elif self.name == "date":
            if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
                return value
            if isinstance(value, str):
                try:
                    return dt.date.fromisoformat(value)
                except ValueError:
                    pass
        elif isinstance(value, bytes):
            return value
        raise wrong()

    def to_row(self, value: Any) -> Any:
        """The value for a Spark row: JSON text where the type is json."""
        if value is None:
            return None
        if self.kind == "json":
            return json.dumps(value, sort_keys=True)
        if self.kind == "list":
            return [self.item.to_row(v) for v in value]
        if self.kind == "map":
            return {k: self.item.to_row(v) for k, v in value.items()}
        if self.kind == "struct":
            return tuple(t.to_row(value.get(n)) for n, t in self.fields)
        return value

    def from_row(self, value: Any) -> Any:
        if value is None:
            return None
        if self.kind == "json":
            return json.loads(value)
        if self.kind == "list":
            return [self.item.from_row(v) for v in value]
        if self.kind == "map":
            return {k: self.item.from_row(v) for k, v in value.items()}
        if self.kind == "struct":
            return {n: t.from_row(value[n]) for n, t in self.fields if self.total or value[n] is not None}
        return value


JSON = FieldType("json", nullable=True)


def struct_of(fields: dict[str, FieldType]) -> T.StructType:
    """The Spark struct of fields; of none it has a placeholder, as files cannot hold empty structs."""
    return T.StructType([T.StructField(n, t.spark()) for n, t in fields.items()] or [T.StructField("_none", T.BooleanType())])


def field_type(annotation: Any, seen: tuple[Any, ...] = ()) -> FieldType:
    """The type of an annotation; `T | None` in any spelling is a nullable T."""
    if annotation in _PRIMITIVES:
        return FieldType("primitive", annotation.__name__)
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            inner = field_type(rest[0], seen)
            return inner if not len(args) - len(rest) else FieldType(inner.kind, inner.name, True, inner.item, inner.fields, inner.total)
        return JSON
    if origin in (list, tuple) or annotation is list:
        return FieldType("list", item=field_type(args[0], seen) if args else JSON)
    if origin is dict:
        value = field_type(args[1], seen) if len(args) == 2 else JSON
        return JSON if value.kind == "json" else FieldType("map", item=value)
    if typing.is_typeddict(annotation):
        if annotation in seen:
            return JSON
        hints = typing.get_type_hints(annotation)
        fields = tuple((n, field_type(t, (*seen, annotation))) for n, t in hints.items())
        if any(_has_json(t) for _, t in fields) and _recursive(annotation, annotation, ()):
            return JSON
        return FieldType("struct", annotation.__name__, fields=fields, total=annotation.__total__)
    return JSON


def _has_json(t: FieldType) -> bool:
    return t.kind == "json" or (t.item is not None and _has_json(t.item)) or any(_has_json(x) for _, x in t.fields)


def _recursive(start: Any, at: Any, seen: tuple[Any, ...]) -> bool:
    """Whether a TypedDict holds itself."""
    for a in typing.get_args(at) or (typing.get_type_hints(at).values() if typing.is_typeddict(at) and at not in seen else ()):
        if a is start or _recursive(start, a, (*seen, at)):
            return True
    return False
