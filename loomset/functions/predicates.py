"""Structured predicates: conditions that are data, with a JSON form.

Logic is two-valued: a comparison with NULL is false, and ``Not`` of it true.  Columns leave comparisons as they are, so that
scans can take them over; a filter drops NULL like false, and ``Not`` turns it into false first.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import split

Resolve = Callable[[str], Column]
_KINDS: dict[str, type[Predicate]] = {}


def _value(obj: Any, path: str) -> Any:
    """Attribute of a plain object or dict along a path."""
    if isinstance(obj, dict) and path in obj:
        return obj[path]
    for name in split(path):
        try:
            obj = obj[name] if isinstance(obj, dict) else getattr(obj, name)
        except KeyError as e:
            raise AttributeError(path) from e
    return obj


class Predicate:
    """Base: ``to_column`` for Spark, a call for one Python object, ``to_dict`` for JSON."""

    op: ClassVar[str]

    def __init_subclass__(cls) -> None:
        if hasattr(cls, "op"):
            _KINDS[cls.op] = cls

    def to_column(self, resolve: Resolve) -> Column:
        raise NotImplementedError

    def __call__(self, obj: Any) -> bool:
        raise NotImplementedError

    def _fields(self) -> dict[str, Any]:
        raise NotImplementedError

    def to_dict(self) -> dict[str, Any]:
        return {"type": "predicate", "op": self.op, **self._fields()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Predicate:
        kind = _KINDS.get(data.get("op", ""))
        if kind is None or data.get("type") != "predicate":
            raise ValueError(f"unknown predicate {data.get('op')!r}")
        return kind._read(data)

    @classmethod
    def _read(cls, data: dict[str, Any]) -> Predicate:
        return cls(**{k: v for k, v in data.items() if k not in ("type", "op")})

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Predicate) and self.to_dict() == other.to_dict()

    def __hash__(self) -> int:
        return hash(self.to_json())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self._fields().items())})"


@dataclass(frozen=True)
class Ref:
    """The right side of a comparison is another attribute of the same object."""

    path: str


class _Comparison(Predicate):
    compare: ClassVar[Callable[[Any, Any], Any]]

    def __init__(self, attr: str, value: Any):
        split(attr)
        self.attr, self.value = attr, value

    def to_column(self, resolve: Resolve) -> Column:
        left = resolve(self.attr)
        if self.value is None:
            return left.isNull() if self.op == "eq" else F.lit(False)
        right = resolve(self.value.path) if isinstance(self.value, Ref) else F.lit(self.value)
        return type(self).compare(left, right)

    def __call__(self, obj: Any) -> bool:
        right = _value(obj, self.value.path) if isinstance(self.value, Ref) else self.value
        return bool(type(self).compare(_value(obj, self.attr), right))

    def _fields(self) -> dict[str, Any]:
        return {"attr": self.attr, "value": {"ref": self.value.path} if isinstance(self.value, Ref) else self.value}

    @classmethod
    def _read(cls, data: dict[str, Any]) -> Predicate:
        value = data["value"]
        return cls(data["attr"], Ref(value["ref"]) if isinstance(value, dict) and set(value) == {"ref"} else value)


class Eq(_Comparison):
    op, compare = "eq", operator.eq


class Gt(_Comparison):
    op, compare = "gt", operator.gt


class Lt(_Comparison):
    op, compare = "lt", operator.lt


class Gte(_Comparison):
    op, compare = "gte", operator.ge


class Lte(_Comparison):
    op, compare = "lte", operator.le


class Like(Predicate):
    """``p%``, ``%s``, ``%c%``, ``%`` or an exact text; ``_`` is an ordinary character.  ``sql=True``: full SQL LIKE."""

    op = "like"

    def __init__(self, attr: str, pattern: str, sql: bool = False):
        split(attr)
        if not sql and "%" in pattern.strip("%"):
            raise ValueError(f"% inside the pattern {pattern!r} is not supported")
        self.attr, self.pattern, self.sql = attr, pattern, sql

    def _parts(self) -> tuple[bool, str, bool]:
        return self.pattern.startswith("%"), self.pattern.strip("%"), self.pattern.endswith("%")

    def to_column(self, resolve: Resolve) -> Column:
        text = resolve(self.attr)
        if self.sql:
            return text.like(self.pattern)
        before, core, after = self._parts()
        if before and after:
            found = text.contains(core)
        elif before:
            found = text.endswith(core)
        else:
            found = text.startswith(core) if after else text == core
        return found

    def __call__(self, obj: Any) -> bool:
        text = str(_value(obj, self.attr))
        before, core, after = self._parts()
        if before and after:
            return core in text
        if before:
            return text.endswith(core)
        return text.startswith(core) if after else text == core

    def _fields(self) -> dict[str, Any]:
        return {"attr": self.attr, "pattern": self.pattern} | ({"sql": True} if self.sql else {})


class In(Predicate):
    op = "in"

    def __init__(self, attr: str, values: Any):
        split(attr)
        self.attr, self.values = attr, list(values)

    def to_column(self, resolve: Resolve) -> Column:
        return resolve(self.attr).isin(self.values) if self.values else F.lit(False)

    def __call__(self, obj: Any) -> bool:
        return _value(obj, self.attr) in self.values

    def _fields(self) -> dict[str, Any]:
        return {"attr": self.attr, "values": self.values}


class _Many(Predicate):
    def __init__(self, *predicates: Predicate):
        self.predicates = predicates

    def _fields(self) -> dict[str, Any]:
        return {"predicates": [p.to_dict() for p in self.predicates]}

    @classmethod
    def _read(cls, data: dict[str, Any]) -> Predicate:
        return cls(*map(Predicate.from_dict, data["predicates"]))


class And(_Many):
    op = "and"

    def to_column(self, resolve: Resolve) -> Column:
        return reduce(operator.and_, [p.to_column(resolve) for p in self.predicates], F.lit(True))

    def __call__(self, obj: Any) -> bool:
        return all(p(obj) for p in self.predicates)


class Or(_Many):
    op = "or"

    def to_column(self, resolve: Resolve) -> Column:
        return reduce(operator.or_, [p.to_column(resolve) for p in self.predicates], F.lit(False))

    def __call__(self, obj: Any) -> bool:
        return any(p(obj) for p in self.predicates)


class Not(Predicate):
    op = "not"

    def __init__(self, predicate: Predicate):
        self.predicate = predicate

    def to_column(self, resolve: Resolve) -> Column:
        return ~F.coalesce(self.predicate.to_column(resolve), F.lit(False))

    def __call__(self, obj: Any) -> bool:
        return not self.predicate(obj)

    def _fields(self) -> dict[str, Any]:
        return {"predicate": self.predicate.to_dict()}

    @classmethod
    def _read(cls, data: dict[str, Any]) -> Predicate:
        return cls(Predicate.from_dict(data["predicate"]))


#: Keyword lookups by the last segment of a keyword.
LOOKUPS: dict[str, Callable[[Column, Any], Column]] = {
    "exact": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "has": lambda c, v: F.array_contains(c, v),
    "icontains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "range": lambda c, v: c.between(v[0], v[1]),
    "like": lambda c, v: Like("x", v).to_column(lambda _: c),
}


def parse_lookup(keyword: str) -> tuple[str, str]:
    """Path and lookup of a keyword: its last segment is a lookup if it is the name of one and something stands before it."""
    head, _, last = keyword.rpartition("__")
    return (head, last) if head and last in LOOKUPS else (keyword, "exact")
