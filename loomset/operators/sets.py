"""Set operations on keys.  Two tuples under one key count as the same, whatever their values."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from ..model import Database, Relation
from .base import Operator, database_of
from .joins import _matching
from .shapes import last_by_key


class _KeySets(Operator):
    def parts(self) -> list[Relation]:
        found = list(database_of(self.input).bound().values())
        if len(found) < 2:
            raise ValueError("a set operation needs at least two relations")
        if len({len(r.key) for r in found}) > 1:
            raise ValueError("the relations' keys differ in length")
        first = found[0]
        return [first, *[r if r.key == first.key else r.with_df(r.df.withColumnsRenamed(dict(zip(r.key, first.key, strict=True))), key=first.key) for r in found[1:]]]


class union(_KeySets):
    """All keys; of a key that several relations have, the last relation's tuple.  Schemas may differ.

    ``disjoint=True`` says that no key comes twice, which saves the shuffle.
    """

    params = ("disjoint",)

    def __init__(self, source: Any, *, disjoint: bool = False):
        super().__init__(source)
        self.disjoint = disjoint

    def compute(self) -> Relation:
        parts = [r.materialised() for r in self.parts()]
        first = parts[0]
        frames = [r.df if self.disjoint else r.df.withColumn("__from", F.lit(i)) for i, r in enumerate(parts)]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if not self.disjoint:
            df = last_by_key(df, first.key, F.col("__from")).drop("__from")
        return first.with_df(df)


class intersect(_KeySets):
    """Tuples of the first relation whose keys all others have."""

    def compute(self) -> Relation:
        first, *others = self.parts()
        first = first.materialised()
        return first.with_df(reduce(lambda df, r: _matching(df, r.items(), first.key, r.key), others, first.df))


class minus(_KeySets):
    """Tuples of the first relation whose keys no other has."""

    def compute(self) -> Relation:
        first, *others = self.parts()
        first = first.materialised()
        return first.with_df(reduce(lambda df, r: _matching(df, r.items(), first.key, r.key, "left_anti"), others, first.df))


difference = minus


class values_union(_KeySets):
    """Different tuples of all relations, keys left out."""

    def compute(self) -> Relation:
        parts = self.parts()
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.values() for r in parts]).distinct()
        return Relation(df, tuple(df.columns))


def V(*relations: Relation) -> Relation:  # noqa: N802
    return union(Database({str(i): r for i, r in enumerate(relations)})).result


def Ʌ(*relations: Relation) -> Relation:  # noqa: N802
    return intersect(Database({str(i): r for i, r in enumerate(relations)})).result
