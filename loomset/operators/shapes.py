"""Projection, renaming, transformation and nesting of rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Paths, Proxy
from ..model import Relation
from .base import Operator, relation_of


class project(Operator):
    """Attributes and paths of each value; the key stays.

    A path is stored under its last segment and wins over an attribute of that name.  Attributes that do not exist are
    skipped.  Computed attributes keep their definition, and fail if what they need is gone.
    """

    params = ("attributes",)

    def __init__(self, source: Any, *attributes: str):
        super().__init__(source)
        if not attributes:
            raise ValueError("project needs at least one attribute")
        self.attributes = attributes

    def compute(self) -> Relation:
        relation = relation_of(self.input)
        paths, columns, computed = Paths(relation), {}, {}
        flat = [a for a in self.attributes if a in relation.df.columns or a in relation.computed]
        for name in flat:
            if name in relation.computed:
                computed[name] = relation.computed[name]
            elif name not in relation.key:
                columns[name] = F.col(f"`{name}`")
        for path in self.attributes:
            if path in flat or not ("." in path or "__" in path):
                continue
            try:
                column = paths.column(path)
            except AttributeError:
                continue
            last = path.replace("__", ".").rpartition(".")[2]
            computed.pop(last, None)
            columns[last] = column
        keys = [F.col(f"`{k}`") for k in relation.key]
        return relation.with_df(paths.df.select(*keys, *[c.alias(n) for n, c in columns.items() if n not in relation.key]), computed=computed)


class rename(Operator):
    """New names for attributes; unknown old names are ignored and of two attributes with one name the later column stays."""

    params = ("names",)

    def __init__(self, source: Any, **names: str):
        super().__init__(source)
        if not names:
            raise ValueError("rename needs at least one attribute")
        if any("." in n or "__" in n for n in names):
            raise ValueError("rename works on one level")
        self.names = names

    def compute(self) -> Relation:
        relation = relation_of(self.input)
        last: dict[str, str] = {}
        for column in relation.df.columns:
            last[self.names.get(column, column)] = column
        df = relation.df.select(*[F.col(f"`{old}`").alias(new) for new, old in last.items()])
        new = lambda columns: tuple(self.names.get(c, c) for c in columns)
        links = {k: type(v)(new(v.columns), v.key, v.target, v.target_name) for k, v in relation.links.items()}
        # Definitions keep reading the old names.
        back = {n: o for o, n in self.names.items()}
        computed = {self.names.get(n, n): _renamed(f, self.names) for n, f in relation.computed.items()} if back else relation.computed
        return relation.with_df(df, key=new(relation.key), links=links, computed=computed)


class _OldNames:
    def __init__(self, proxy: Proxy, names: dict[str, str]):
        self._proxy, self._names = proxy, names

    def __getattr__(self, name: str) -> Any:
        return self._proxy[self._names.get(name, name)]

    __getitem__ = __getattr__


def _renamed(function: Callable[[Any], Column], names: dict[str, str]) -> Callable[[Any], Column]:
    return lambda value: function(_OldNames(value, names))


class transform(Operator):
    """Any function of the whole input."""

    params = ("transformation_function",)

    def __init__(self, source: Any, *, transformation_function: Callable[[Any], Any]):
        super().__init__(source)
        self.transformation_function = transformation_function

    def compute(self) -> Any:
        return self.transformation_function(self.input)


class transform_items(Operator):
    """New items from items.

    ``columns``: output columns from functions of the value's proxy, key columns included if they change; ``keep``: a condition
    on the value, items without it are dropped.  Otherwise ``transformation_function`` takes and returns plain dicts (None drops the
    item) in Arrow batches, with the output's ``schema``.  Of items with equal new keys the last in the input's order stays.
    """

    params = ("transformation_function", "columns", "keep")

    def __init__(self, source: Any, *, transformation_function: Callable[[dict], dict | None] | None = None, schema: str | None = None, columns: dict[str, Callable[[Any], Column]] | None = None, keep: Any = None, key: tuple[str, ...] | None = None, unique: bool = True):
        super().__init__(source)
        if (transformation_function is None) == (columns is None):
            raise ValueError("either columns or a transformation function is needed")
        self.transformation_function, self.schema, self.columns, self.keep, self.key, self.unique = transformation_function, schema, columns, keep, key, unique

    def compute(self) -> Relation:
        relation = relation_of(self.input)
        key = self.key or relation.key
        if self.columns is not None:
            paths = Paths(relation)
            value = Proxy(paths)
            made = {k: F.col(f"`{k}`") for k in key if k not in self.columns} | {n: f(value) for n, f in self.columns.items()}
            holds = self.keep(value) if self.keep is not None else None
            df = paths.df if holds is None else paths.df.where(holds)
            order = [c.alias(f"__o{i}") for i, c in enumerate(relation.order)]
            df = df.select(*[c.alias(n) for n, c in made.items()], *order)
            touched = any(k in self.columns for k in key)
        else:
            function, names = self.transformation_function, T._parse_datatype_string(self.schema).names
            ordinals = [f"__o{i}" for i in range(len(relation.order))]
            source = relation.expanded().select("*", *[c.alias(o) for c, o in zip(relation.order, ordinals, strict=True)])

            def run(batches):
                for batch in batches:
                    rows = []
                    for row in batch.to_dict("records"):
                        found = function({k: v for k, v in row.items() if k not in ordinals})
                        if found is not None:
                            rows.append([found.get(n) for n in names] + [row[o] for o in ordinals])
                    yield pd.DataFrame(rows, columns=[*names, *ordinals])

            kinds = ", ".join(f"{o} {source.schema[o].dataType.simpleString()}" for o in ordinals)
            df, touched = source.mapInPandas(run, f"{self.schema}, {kinds}"), True
        ordinals = [c for c in df.columns if c.startswith("__o")]
        if touched and self.unique:
            df = last_by_key(df, key, F.struct(*ordinals))
        return relation.with_df(df.drop(*ordinals), key=tuple(key), computed={}, default=None, domain=None)


def last_by_key(df: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """Of the rows of each key the one that comes last in the order; partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__v"))
    return best.select(*[F.col(f"`{k}`") for k in key], *[F.col("__v").getField(c).alias(c) for c in rest])


class flatten(Operator):
    """Nested rows as one level of columns with dotted names.

    Structs are expanded to any depth, and references of the relations in a joined row are followed, so the department of
    ``users`` appears as ``users.department.name`` next to ``departments.name``.
    """

    params = ("follow",)

    def __init__(self, source: Any, follow: bool = True):
        super().__init__(source)
        self.follow = follow

    def compute(self) -> Relation:
        relation = relation_of(self.input)
        df = relation.expanded()
        found: dict[str, Column] = {}
        for column in df.columns:
            if column not in relation.key:
                self._leaves(F.col(f"`{column}`"), df.schema[column].dataType, column, found)
        if self.follow:
            for part in getattr(relation, "joined", {}):
                self._references(relation.joined, part, (part,), F.col(f"`{part}`"), found, (part,))
        keys = [F.col(f"`{k}`") for k in relation.key]
        return Relation(df.select(*keys, *[c.alias(n) for n, c in found.items()]), relation.key, relation.name)

    def _leaves(self, column: Column, kind: T.DataType, name: str, out: dict[str, Column]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                self._leaves(column.getField(f.name), f.dataType, f"{name}.{f.name}", out)
        else:
            out[name] = column

    def _references(self, joined: dict[str, Relation], part: str, path: tuple[str, ...], column: Column, out: dict[str, Column], above: tuple[str, ...]) -> None:
        # The target's tuple is in the same row already: an inner join put it there.
        for ref_key, link in joined[part].links.items():
            if link.target_name not in joined:
                continue
            if link.target_name in above:
                raise ValueError(f"references form a cycle: {' -> '.join([*above, link.target_name])}")
            target = F.col(f"`{link.target_name}`")
            step = (*path, ref_key)
            for name in joined[link.target_name].expanded().columns:
                out[".".join((*step, name))] = target.getField(name)
            self._references(joined, link.target_name, step, target, out, (*above, link.target_name))


class disaggregate(Operator):
    """One item for each element of an array attribute; the element's place joins the key."""

    params = ("attribute",)

    def __init__(self, source: Any, attribute: str, place: str = "place"):
        super().__init__(source)
        self.attribute, self.place = attribute, place

    def compute(self) -> Relation:
        relation = relation_of(self.input)
        others = [F.col(f"`{c}`") for c in relation.df.columns if c != self.attribute]
        df = relation.df.select(*others, F.posexplode(self.attribute).alias(self.place, self.attribute))
        return relation.with_df(df, key=(*relation.key, self.place))
