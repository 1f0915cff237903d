"""Aggregates: an attribute path and what becomes of its values."""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most values of a group that a Python function of slices sees at once.
SLICE = 1 << 16


@dataclass(frozen=True)
class AggregationFunction:
    """A Python function of the list of an attribute's values, run as a grouped-aggregate UDF; subclasses stay in the JVM."""

    function: Callable[[list[Any]], Any]
    attribute: str
    returns: str = "double"

    def to_column(self, resolve: Callable[[str], Column]) -> Column:
        function = self.function

        # The hint of a plain value makes this a grouped aggregate.
        def run(values: pd.Series) -> float:
            return function(values.tolist())

        return F.pandas_udf(run, self.returns)(resolve(self.attribute))

    def to_dict(self) -> dict[str, Any]:
        return {"type": "aggregate", "op": type(self).__name__, "attribute": self.attribute}


@dataclass(frozen=True)
class SlicedAggregation(AggregationFunction):
    """A Python function of slices of an attribute's values, so that no task holds a group.

    ``function`` makes any object of a list of at most ``SLICE`` values, ``merge`` one of a list of such objects, and ``finish`` the
    result of the last one.  NULLs are left out; NULL of nothing.  The slices are taken where the rows lie, and only what becomes of them
    is shuffled.
    """

    merge: Callable[[list[Any]], Any] | None = None
    finish: Callable[[Any], Any] = lambda made: made

    def __post_init__(self) -> None:
        if not callable(self.merge):
            raise TypeError("slices need a function that merges what was made of them")

    def slices(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """``keys`` and, as ``name``, what the function makes of each slice; ``df``: columns ``keys`` and ``value``."""
        function, most = self.function, SLICE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _tables(batches, most):
                group = _groups(table, keys)
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                column, made = table.column(value).take(pa.array(order)), []
                for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                    known = pc.drop_null(column.slice(lo, hi - lo))
                    values = known.to_numpy().tolist() if pa.types.is_integer(known.type) or pa.types.is_floating(known.type) else known.to_pylist()
                    made.append(pickle.dumps(function(values)) if values else None)
                first = pa.array(order[starts])
                found = [table.column(k).take(first) for k in keys]
                yield from pa.table([*found, pa.array(made, pa.binary())], [*keys, name]).to_batches()

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{k}`") for k in keys]).schema]
        return df.mapInArrow(run, ", ".join([*fields, f"`{name}` binary"]))

    def merged(self, made: str) -> Column:
        """Aggregate: the result, from the column of what was made of slices."""
        merge, finish = self.merge, self.finish

        def run(parts: pd.Series) -> float:
            found = [pickle.loads(p) for p in parts.tolist() if p is not None]
            return finish(merge(found)) if found else None

        return F.pandas_udf(run, self.returns)(F.col(f"`{made}`"))

    def to_column(self, resolve: Callable[[str], Column]) -> Column:
        """For groupings that cannot take slices first; a task then holds the values of a group."""
        function, merge, finish, most = self.function, self.merge, self.finish, SLICE

        def run(values: pd.Series) -> float:
            known = values.dropna().tolist()
            return finish(merge([function(known[i : i + most]) for i in range(0, len(known), most)])) if known else None

        return F.pandas_udf(run, self.returns)(resolve(self.attribute))


def _tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The batches put together to tables of at most ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        # An empty batch gives nothing.
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            if n + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, equal where all keys are."""
    group = np.zeros(table.num_rows, np.int64)
    for k in keys:
        column = table.column(k).combine_chunks()
        if pa.types.is_nested(column.type):
            column = pa.array([pickle.dumps(v) for v in column.to_pylist()], pa.binary())
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return group


class _BuiltIn(AggregationFunction):
    make: Callable[[Column], Column]

    def __init__(self, attribute: str | None = None):
        object.__setattr__(self, "attribute", attribute)
        object.__setattr__(self, "function", None)

    def to_column(self, resolve: Callable[[str], Column]) -> Column:
        return type(self).make(resolve(self.attribute))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.attribute!r})"


class Max(_BuiltIn):
    """Largest value; NULL of nothing."""

    make = staticmethod(F.max)


class Min(_BuiltIn):
    """Smallest value; NULL of nothing."""

    make = staticmethod(F.min)


class Count(_BuiltIn):
    """Number of items, whether or not they have the attribute."""

    def to_column(self, resolve: Callable[[str], Column]) -> Column:
        return F.count(F.lit(1))


class Sum(_BuiltIn):
    """Sum; 0 of nothing."""

    make = staticmethod(lambda c: F.coalesce(F.sum(c), F.lit(0)))


class Avg(_BuiltIn):
    """Arithmetic mean; NULL of nothing."""

    make = staticmethod(F.avg)


Mean = Avg


class Median(_BuiltIn):
    """Exact median, the mean of the middle two of an even number; NULL of nothing."""

    make = staticmethod(F.median)
