"""Paths through references, and column proxies for plain Python functions.

A path is a list of names joined by ``.`` or ``__``.  A column of that very name wins, then a field of a struct column, then
a computed attribute, then a reference, which adds one left join with its target for each different prefix.
Targets are unique by key, so these joins add no row; Catalyst makes them inner joins where a filter allows it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..model import Relation


def split(path: str) -> list[str]:
    """Segments of a path; an empty one is a ValueError."""
    parts = path.replace("__", ".").split(".")
    if not all(parts):
        raise ValueError(f"empty segment in path {path!r}")
    return parts


class Paths:
    """Resolver for one relation; ``df`` is its DataFrame with all joins that the paths so far needed."""

    def __init__(self, relation: Relation):
        self.relation = relation
        self.df: DataFrame = relation.df
        self._joined: dict[tuple[str, ...], tuple[Relation, dict[str, str]]] = {}
        self._open: list[str] = []

    def column(self, path: str) -> Column:
        """The column a path leads to; AttributeError if it leads nowhere."""
        found = self.find(path)
        if isinstance(found, Column):
            return found
        raise AttributeError(f"{path!r} is a reference, not an attribute")

    def find(self, path: str) -> Column | Proxy:
        if path in self.relation.df.columns:
            return F.col(f"`{path}`")
        return self.walk((), split(path))

    def walk(self, prefix: tuple[str, ...], rest: list[str]) -> Column | Proxy:
        relation, names = self._at(prefix)
        for size in range(len(rest), 0, -1):
            name = ".".join(rest[:size])
            kind = relation.df.schema[name].dataType if name in relation.df.columns else None
            if kind is not None and (size == len(rest) or isinstance(kind, T.StructType)):
                return self._fields(F.col(f"`{names.get(name, name)}`"), kind, rest[size:], name)
        head = rest[0]
        if head in relation.computed:
            return self._computed(prefix, head)
        if head in relation.links:
            step = (*prefix, head)
            self._join(step)
            return self.walk(step, rest[1:]) if len(rest) > 1 else Proxy(self, step)
        raise AttributeError(f"{relation.name or 'relation'} has no attribute {'.'.join(rest)!r}")

    def _fields(self, column: Column, kind: T.DataType, rest: list[str], name: str) -> Column:
        while rest:
            if not isinstance(kind, T.StructType):
                raise AttributeError(f"{name!r} has no attribute {'.'.join(rest)!r}")
            # Names with dots may be fields themselves.
            size = next((n for n in range(len(rest), 0, -1) if ".".join(rest[:n]) in kind.names), None)
            if size is None:
                raise AttributeError(f"{name!r} has no attribute {'.'.join(rest)!r}")
            name, rest = ".".join(rest[:size]), rest[size:]
            column, kind = column.getField(name), kind[name].dataType
        return column

    def _computed(self, prefix: tuple[str, ...], name: str) -> Column:
        step = ".".join((*prefix, name))
        if step in self._open:
            raise ValueError(f"computed attributes depend on each other: {' -> '.join([*self._open, step])}")
        self._open.append(step)
        try:
            return self._at(prefix)[0].computed[name](Proxy(self, prefix))
        finally:
            self._open.pop()

    def _at(self, prefix: tuple[str, ...]) -> tuple[Relation, dict[str, str]]:
        return self._joined[prefix] if prefix else (self.relation, {})

    def _join(self, step: tuple[str, ...]) -> None:
        if step in self._joined:
            return
        relation, names = self._at(step[:-1])
        link = relation.links[step[-1]]
        target = link.target()
        mark = "__" + "__".join(step) + "__"
        renamed = {c: mark + c for c in target.df.columns}
        right = target.df.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
        condition = F.lit(True)
        for i, (own, key) in enumerate(zip(link.columns, link.key, strict=True)):
            equal = F.col(f"`{names.get(own, own)}`") == F.col(f"`{renamed[key]}`")
            condition = equal if i == 0 else condition & equal
        self.df = self.df.join(right, condition, "left")
        self._joined[step] = (target, renamed)


class Proxy:
    """Stands for a tuple in a user's function: its attributes are columns, or proxies behind references."""

    def __init__(self, paths: Paths, prefix: tuple[str, ...] = ()):
        self._paths, self._prefix = paths, prefix

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") and name.endswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Any:
        if not self._prefix and name in self._paths.relation.df.columns:
            return F.col(f"`{name}`")
        return self._paths.walk(self._prefix, split(name))


class ItemProxy:
    """Key and value of an item in a user's function."""

    def __init__(self, paths: Paths):
        keys = [F.col(f"`{k}`") for k in paths.relation.key]
        self.key = keys[0] if len(keys) == 1 else F.struct(*keys)
        self.value = Proxy(paths)


class ValueView:
    """A row in a Python UDF: attributes and items of a tuple."""

    def __init__(self, row: Any):
        self._row = row

    def __getattr__(self, name: str) -> Any:
        try:
            value = self._row[name]
        except (KeyError, ValueError) as e:
            raise AttributeError(name) from e
        return ValueView(value) if hasattr(value, "asDict") else value

    __getitem__ = __getattr__


class ItemView:
    def __init__(self, key: Any, value: Any):
        self.key, self.value = key, ValueView(value)


def call(relation: Relation, paths: Paths, function: Callable[[Any], Any], on: str, kind: T.DataType, as_udf: bool = False) -> Column:
    """A user's function of an item, value or key as a column.

    It is first called with a proxy.  If that gives a column, Catalyst sees all of it; if the function needs Python values
    (branches, string methods), it becomes a Python UDF over the stored columns.
    """
    if not as_udf:
        keys = [F.col(f"`{k}`") for k in relation.key]
        proxy = {"item": lambda: ItemProxy(paths), "value": lambda: Proxy(paths), "key": lambda: keys[0] if len(keys) == 1 else F.struct(*keys)}[on]()
        try:
            found = function(proxy)
            if isinstance(found, Column):
                return found
        except (PySparkException, TypeError, ValueError):
            pass
    names, key_names = relation.df.columns, tuple(relation.key)

    def run(row: Any) -> Any:
        key = row[key_names[0]] if len(key_names) == 1 else tuple(row[k] for k in key_names)
        return function(key if on == "key" else ValueView(row) if on == "value" else ItemView(key, row))

    return F.udf(run, kind)(F.struct(*[F.col(f"`{c}`") for c in names]))


def condition(relation: Relation, paths: Paths, predicate: Any, on: str, as_udf: bool = False) -> Column:
    """A structured predicate or a user's function as a condition; NULL counts as false."""
    from .predicates import Predicate

    if isinstance(predicate, Column):
        return predicate
    if isinstance(predicate, Predicate):
        return predicate.to_column(paths.column)
    return call(relation, paths, predicate, on, T.BooleanType(), as_udf)


def column_of(relation: Relation, paths: Paths, key: Any, on: str = "item", kind: T.DataType | None = None) -> Column:
    """A sort or group key: a path, a column or a user's function."""
    if isinstance(key, Column):
        return key
    if isinstance(key, str):
        return paths.column(key)
    if not callable(key):
        raise TypeError(f"{key!r} is neither a path nor callable")
    return call(relation, paths, key, on, kind or T.StringType())
