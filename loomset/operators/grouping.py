"""Aggregates, groups and partitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AggregationFunction, SlicedAggregation
from ..functions.paths import Paths, column_of
from ..model import Database, Partitioned, Relation
from .base import Operator, relation_of


def _columns(paths: Paths, aggregates: Mapping[str, Any]) -> list[Column]:
    """Aggregate columns from aggregate objects, or from functions of the value's proxy that return an aggregate column."""
    from ..functions.paths import Proxy

    out = []
    for name, a in aggregates.items():
        column = a.to_column(paths.column) if isinstance(a, AggregationFunction) else a(Proxy(paths))
        out.append(column.alias(name))
    return out


def _aggregated(paths: Paths, keys: list[Column], names: list[str], aggregates: Mapping[str, Any]) -> DataFrame:
    """``aggregates`` of the groups of ``keys``, called ``names``; those of slices are made on their own and joined."""
    sliced = {n: a for n, a in aggregates.items() if isinstance(a, SlicedAggregation)}
    plain = _columns(paths, {n: a for n, a in aggregates.items() if n not in sliced})
    values = {n: paths.column(a.attribute) for n, a in sliced.items()}
    if not sliced:
        return paths.df.groupBy(*keys).agg(*plain)
    df = paths.df.groupBy(*keys).agg(*plain) if plain else None
    own = [f"__g{i}" for i in range(len(names))]
    for name, a in sliced.items():
        rows = paths.df.select(*[k.alias(o) for k, o in zip(keys, own, strict=True)], values[name].alias("__value"))
        side = a.slices(rows, own, "__value", "__made").groupBy(*own).agg(a.merged("__made").alias(name))
        if df is None:
            df = side.select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True)], F.col(f"`{name}`"))
        elif names:
            on = [F.col(f"`{n}`").eqNullSafe(F.col(o)) for n, o in zip(names, own, strict=True)]
            df = df.join(side, on, "inner").drop(*own)
        else:
            df = df.join(side, F.lit(True), "left")
    return df.select(*[F.col(f"`{n}`") for n in (*names, *aggregates)])


class aggregate(Operator):
    """One tuple of aggregates over all items.

    ``strict=True`` raises a ValueError for an empty input, which otherwise gives NULL (0 for sums and counts).
    """

    params = ("aggregates",)

    def __init__(self, source: Any, *, strict: bool = False, **aggregates: Any):
        super().__init__(source)
        self.aggregates, self.strict = aggregates, strict

    def compute(self) -> Any:
        if isinstance(self.input, Database):
            return self.input.with_relations({n: aggregate(r, strict=self.strict, **self.aggregates).result for n, r in self.input.bound().items()}, references=())
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        if self.strict and not relation.df.limit(1).count():
            raise ValueError("an aggregate of an empty relation")
        return Relation(_aggregated(paths, [], [], self.aggregates), (), relation.name)


𝜞 = aggregate


class group_by_aggregate(Operator):
    """Aggregates of each group; the grouping attributes are the key."""

    params = ("keys", "aggregates")

    def __init__(self, source: Any, *keys: str, **aggregates: Any):
        super().__init__(source)
        if not keys:
            raise ValueError("at least one grouping attribute is needed")
        self.keys, self.aggregates = keys, aggregates

    def compute(self) -> Relation:
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        names = [_last(k) if k not in relation.df.columns else k for k in self.keys]
        keys = [paths.column(k).alias(n) for k, n in zip(self.keys, names, strict=True)]
        return Relation(_aggregated(paths, keys, names, self.aggregates), tuple(names), relation.name)


def _last(path: str) -> str:
    return path.replace("__", ".").rpartition(".")[2]


class partition_by_aggregate(Operator):
    """Aggregates of the groups that a function of the item makes."""

    params = ("partitioning_function", "aggregates")

    def __init__(self, source: Any, *, partitioning_function: Any, key_type: T.DataType | None = None, **aggregates: Any):
        super().__init__(source)
        self.partitioning_function, self.key_type, self.aggregates = partitioning_function, key_type, aggregates

    def compute(self) -> Relation:
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        key = column_of(relation, paths, self.partitioning_function, kind=self.key_type).alias("partition")
        return Relation(_aggregated(paths, [key], ["partition"], self.aggregates), ("partition",), relation.name)


class partition(Operator):
    """A database of one relation for each value of a function of the item, kept as one DataFrame."""

    params = ("partitioning_function",)

    def __init__(self, source: Any, *, partitioning_function: Any, key_type: T.DataType | None = None):
        super().__init__(source)
        self.partitioning_function, self.key_type = partitioning_function, key_type

    def compute(self) -> Partitioned:
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        key = column_of(relation, paths, self.partitioning_function, kind=self.key_type)
        df = paths.df.select(*[F.col(f"`{c}`") for c in relation.df.columns], key.alias("__partition"))
        return Partitioned(relation.with_df(df), ("__partition",), hidden=True)


class group_by(Operator):
    """A database of one relation for each value of the attributes."""

    params = ("keys",)

    def __init__(self, source: Any, *keys: str):
        super().__init__(source)
        if not keys:
            raise ValueError("at least one grouping attribute is needed")
        self.keys = keys

    def compute(self) -> Partitioned:
        return Partitioned(relation_of(self.input).materialised(), self.keys)


class cube(Operator):
    """One relation for each combination of the attributes, from one pass over the data."""

    params = ("keys", "aggregates")

    def __init__(self, source: Any, *keys: str, how: str = "cube", **aggregates: Any):
        super().__init__(source)
        if how not in ("cube", "rollup"):
            raise ValueError(f"unknown kind {how!r}")
        self.keys, self.how, self.aggregates = keys, how, aggregates

    def compute(self) -> Database:
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        grouped = getattr(paths.df, self.how)(*self.keys)
        df = grouped.agg(F.grouping_id().alias("__set"), *_columns(paths, self.aggregates))
        out = {}
        for mask in range(1 << len(self.keys)) if self.how == "cube" else [(1 << i) - 1 for i in range(len(self.keys) + 1)]:
            # The bit of an attribute that is summed over is set, the first attribute's bit the highest.
            own = [k for i, k in enumerate(self.keys) if not mask >> (len(self.keys) - 1 - i) & 1]
            rest = [k for k in self.keys if k not in own]
            out["/".join(own) or "all"] = Relation(df.where(F.col("__set") == mask).drop("__set", *rest), tuple(own))
        return Database(out)


def above_average(attribute: str) -> Callable[[Relation], Relation]:
    """A subset predicate: items whose attribute is above its mean."""

    def run(relation: Relation) -> Relation:
        mean = relation.df.agg(F.avg(attribute).alias("__mean"))
        return relation.with_df(relation.df.join(F.broadcast(mean), F.col(f"`{attribute}`") > F.col("__mean")).drop("__mean"))

    return run
