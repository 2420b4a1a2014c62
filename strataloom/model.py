"""Entities, relations and events as Python classes; their fields as Spark columns."""

from __future__ import annotations

import copy
import hashlib
import json
import re
import sys
import typing
from dataclasses import dataclass
from typing import Any, ClassVar, Generic, Self, TypeVar

from pyspark.sql import types as T

from .errors import MetadataUnavailableError, ValidationError
from .expressions import FieldRef
from .types import FieldType, field_type, struct_of

V = TypeVar("V")
L = TypeVar("L")
R = TypeVar("R")
_NONE = object()


@dataclass(frozen=True)
class Meta:
    """Where a queried object comes from."""

    commit_id: int
    type_name: str
    key: str | None = None
    left_key: str | None = None
    right_key: str | None = None
    instance_key: str | None = None


class Field(Generic[V]):
    """A declared field. On a class it is a reference to build filters with, on an object its value."""

    def __init__(self, default: Any = _NONE, *, default_factory: Any = None, primary_key: bool = False, instance_key: bool = False, index: bool = False):
        if default is not _NONE and default_factory is not None:
            raise TypeError("a field has a default or a default_factory, not both")
        self.default, self.default_factory = default, default_factory
        self.primary_key, self.instance_key, self.index = primary_key, instance_key, index
        self.name = ""
        self.type: FieldType | None = None
        self.annotation: Any = None

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, obj: Any, owner: type | None = None) -> Any:
        if obj is None:
            return FieldRef((self.name,), owner=owner)
        try:
            return obj.__dict__[self.name]
        except KeyError:
            raise AttributeError(self.name) from None

    def __set__(self, obj: Any, value: Any) -> None:
        obj.__dict__[self.name] = value

    @property
    def has_default(self) -> bool:
        return self.default is not _NONE or self.default_factory is not None

    def initial(self) -> Any:
        return self.default_factory() if self.default_factory is not None else copy.copy(self.default)


def _scope() -> dict[str, Any]:
    """Names visible where a class is being defined, so that local classes resolve."""
    names: dict[str, Any] = {}
    frame = sys._getframe(2)
    while frame is not None and len(names) < 2000:
        for k, v in frame.f_locals.items():
            names.setdefault(k, v)
        if frame.f_code.co_name == "<module>":
            break
        frame = frame.f_back
    return names


def _collect(cls: type, scope: dict[str, Any]) -> dict[str, Field]:
    found: dict[str, Field] = {}
    for base in reversed(cls.__mro__):
        module = vars(sys.modules.get(base.__module__, typing))
        for name, annotation in base.__dict__.get("__annotations__", {}).items():
            if isinstance(annotation, str):
                if not re.match(r"(\w+\.)*Field\b", annotation):
                    continue
                annotation = eval(annotation, dict(module), {**scope, "Field": Field})  # noqa: S307 - the class's own annotation
            if typing.get_origin(annotation) is not Field:
                continue
            declared = base.__dict__.get(name, _NONE)
            field = declared if isinstance(declared, Field) else Field() if declared is _NONE else Field(default=declared)
            field.name, field.annotation = name, typing.get_args(annotation)[0]
            field.type = field_type(field.annotation)
            if not isinstance(declared, Field):
                setattr(base, name, field)
            found[name] = field
    return found


class _Record:
    """What entities, relations and events have in common: checked fields."""

    _fields: ClassVar[dict[str, Field]] = {}

    @classmethod
    def data_fields(cls) -> dict[str, Field]:
        return {n: f for n, f in cls._fields.items() if not f.instance_key}

    def _fill(self, data: dict[str, Any]) -> None:
        if unknown := [k for k in data if k not in self._fields]:
            raise ValidationError(f"{type(self).__name__} has no field {', '.join(unknown)}")
        for name, f in self.data_fields().items():
            if name in data:
                value = data[name]
            elif f.has_default:
                value = f.initial()
            else:
                raise ValidationError(f"{type(self).__name__}.{name} is required")
            self.__dict__[name] = f.type.check(value, f"{type(self).__name__}.{name}")

    def model_dump(self) -> dict[str, Any]:
        return {n: self.__dict__[n] for n in self.data_fields()}

    @classmethod
    def model_validate(cls, data: dict[str, Any]) -> Self:
        return cls(**data)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.model_dump().items())})"

    @classmethod
    def payload(cls) -> T.StructType:
        """The Spark struct of the data fields."""
        return struct_of({n: f.type for n, f in cls.data_fields().items()})


class _Stored(_Record):
    kind: ClassVar[str]
    type_name: ClassVar[str]
    _meta: Meta | None = None

    def meta(self) -> Meta:
        if self._meta is None:
            raise MetadataUnavailableError
        return self._meta

    @classmethod
    def schema(cls) -> dict[str, Any]:
        """The canonical description of the type."""
        out: dict[str, Any] = {"fields": {n: f.type.spec() | ({"primary_key": True} if f.primary_key else {}) | ({"index": True} if f.index else {}) for n, f in cls.data_fields().items()}}
        return out

    @classmethod
    def schema_hash(cls) -> str:
        return schema_hash(cls.schema())


def schema_hash(schema: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Entity(_Stored):
    """A typed record with one primary key field."""

    kind = "entity"
    key_field: ClassVar[str] = ""

    def __init_subclass__(cls, name: str | None = None, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.type_name = name or cls.__name__
        cls._fields = _collect(cls, _scope())
        keys = [n for n, f in cls._fields.items() if f.primary_key]
        if len(keys) != 1:
            raise TypeError(f"entity {cls.type_name} needs exactly one Field(primary_key=True), it has {len(keys)}")
        if any(f.instance_key for f in cls._fields.values()):
            raise TypeError(f"entity {cls.type_name}: instance keys are for relations")
        cls.key_field = keys[0]

    def __init__(self, **data: Any):
        self._fill(data)

    @property
    def key(self) -> str:
        return str(self.__dict__[self.key_field])

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and other.model_dump() == self.model_dump()

    __hash__ = None


class Relation(_Stored, Generic[L, R]):
    """A typed edge between two entities; at most one instance key tells edges of one pair apart."""

    kind = "relation"
    left_type: ClassVar[type[Entity]]
    right_type: ClassVar[type[Entity]]
    instance_field: ClassVar[str | None] = None

    def __init_subclass__(cls, name: str | None = None, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.type_name = name or cls.__name__
        for base in getattr(cls, "__orig_bases__", ()):
            if typing.get_origin(base) is Relation:
                cls.left_type, cls.right_type = typing.get_args(base)
        cls._fields = _collect(cls, _scope())
        if any(f.primary_key for f in cls._fields.values()):
            raise TypeError(f"relation {cls.type_name}: primary keys are for entities")
        keys = [(n, f) for n, f in cls._fields.items() if f.instance_key]
        if len(keys) > 1:
            raise TypeError(f"relation {cls.type_name} has several instance keys")
        if keys and (keys[0][1].annotation is not str or keys[0][1].has_default):
            raise TypeError(f"relation {cls.type_name}: the instance key is a str without a default")
        cls.instance_field = keys[0][0] if keys else None

    def __init__(self, *, left_key: str = "", right_key: str = "", **data: Any):
        self.left_key, self.right_key, self.instance_key = left_key, right_key, ""
        if self.instance_field is not None:
            key = data.pop(self.instance_field, None)
            if key is None:
                raise ValueError(f"{self.type_name} needs its instance key {self.instance_field}")
            if not isinstance(key, str):
                raise TypeError(f"{self.type_name}.{self.instance_field} is a str")
            if not key.strip():
                raise ValueError(f"{self.type_name}.{self.instance_field} is blank")
            self.instance_key = self.__dict__[self.instance_field] = key
        self._fill(data)
        self.left: Any = None
        self.right: Any = None

    @classmethod
    def schema(cls) -> dict[str, Any]:
        out = super().schema() | {"left": cls.left_type.type_name, "right": cls.right_type.type_name}
        return out | ({"instance_key": cls.instance_field} if cls.instance_field else {})

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and (other.left_key, other.right_key, other.instance_key, other.model_dump()) == (self.left_key, self.right_key, self.instance_key, self.model_dump())

    __hash__ = None

    def __repr__(self) -> str:
        own = "".join(f", {k}={v!r}" for k, v in self.model_dump().items())
        return f"{type(self).__name__}(left_key={self.left_key!r}, right_key={self.right_key!r}{f', instance_key={self.instance_key!r}' if self.instance_key else ''}{own})"


def meta(obj: Entity | Relation) -> Meta:
    return obj.meta()


def dotted(class_name: str) -> str:
    """CustomerImported is customer.imported."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", ".", class_name)
    return re.sub(r"\.+", ".", words).lower()


class Event(_Record):
    """A typed message with an envelope: id, created_at, priority, root_event_id, chain_depth."""

    event_type: ClassVar[str] = ""
    default_priority: ClassVar[int] = 100

    def __init_subclass__(cls, event_type: str | None = None, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.event_type = event_type or dotted(cls.__name__)
        own = cls.__dict__.get("priority")
        if isinstance(own, int):
            cls.default_priority = own
        cls._fields = _collect(cls, _scope())

    def __init__(self, **data: Any):
        self._fill(data)
        self.id: str | None = None
        self.created_at: str | None = None
        self.priority: int = type(self).default_priority
        self.root_event_id: str | None = None
        self.chain_depth: int = 0


class EventDeadLetter(Event, event_type="event.dead_letter"):
    """Emitted when a handler gave an event up."""

    event_id: Field[str]
    handler_id: Field[str]
    attempts: Field[int]
    last_error: Field[str]


@dataclass(frozen=True)
class Schedule:
    """An event that is emitted whenever the cron expression matches."""

    event: Event
    cron: str
