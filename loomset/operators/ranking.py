"""Ranks, top-k and sorted output.  A relation has no order of its own; ties go by its ordinal column or its key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Paths, column_of
from ..model import Database, Relation
from .base import Operator, relation_of

#: Sort keys of Python functions that no column can express have this type.
KEY_TYPE = T.DoubleType()


#: Sampled rows for each range from which the ranges are cut.
SAMPLE = 30


def numbered(df: DataFrame, order: list[Column], name: str, reverse: bool = False) -> DataFrame:
    """Global row numbers from 0 without bringing all rows into one task; ``reverse`` turns the order of the first column.

    Rows are cut into ranges of the whole order, ties included, so rows of one frequent value are spread as well; a number is its
    range's offset plus its place there.  The cuts are constants in the plan, so counts and numbers agree in any rerun.  To find
    them, the rows are counted and a sample of them is collected.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    df = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    sort = [F.desc(keys[0]) if reverse else F.asc(keys[0]), *keys[1:]]
    ranged = df.withColumn("__range", _range(df, keys, sort, reverse))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__offset"))
    placed = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*sort)) - 1)
    # One row for each range, at most the number of shuffle partitions.
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__place") + F.col("__offset")).cast("long")).drop(*keys, "__range", "__place", "__offset")


def _range(df: DataFrame, keys: list[str], sort: list[Any], reverse: bool) -> Column:
    """Number of cuts at or before the row in the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys)
    share = min(1.0, 2 * SAMPLE * parts / max(1, rows.count()))
    found = [tuple(r) for r in rows.sample(share, 7).limit(4 * SAMPLE * parts).orderBy(*sort).collect()]
    cuts = list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts))) if found else []
    if not cuts:
        return F.lit(0)
    literals = [F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, cut, strict=True)]) for cut in cuts]

    def before(cut: Column, i: int) -> Column:
        """Whether the cut's key ``i`` comes before the row's; NULL is smallest."""
        a, b = (F.col(keys[0]), cut[keys[0]]) if reverse and i == 0 else (cut[keys[i]], F.col(keys[i]))
        return F.coalesce(a < b, a.isNull() & b.isNotNull())

    def at_or_before(cut: Column) -> Column:
        holds = F.lit(True)
        for i in reversed(range(len(keys))):
            holds = before(cut, i) | (cut[keys[i]].eqNullSafe(F.col(keys[i])) & holds)
        return holds

    return F.size(F.filter(F.array(*literals), at_or_before))


def ordered(relation: Relation, paths: Paths, key: Any, reverse: bool) -> list[Column]:
    column = column_of(relation, paths, key, kind=KEY_TYPE)
    return [column.desc() if reverse else column.asc(), *relation.order]


def relations_by(database: Database, key: Callable[[Relation], Any], reverse: bool) -> dict[str, Relation]:
    """The relations of a database in the order of a function of each."""
    if not callable(key):
        raise TypeError("the sort key of a database is a function of a relation")
    return {n: database[n] for n in sorted(database.relations, key=lambda n: key(database[n]), reverse=reverse)}


class rank_by(Operator):
    """Values under their ranks 0 to n-1, smallest sort key first; the old key goes.  Of a database, the relations under theirs.

    ``partition_by``: ranks within each group of these attributes, whose values join the new key.
    """

    params = ("ranking_key", "reverse", "partition_by")

    def __init__(self, source: Any, *, ranking_key: Any, reverse: bool = False, partition_by: tuple[str, ...] = (), keep_key: bool = False):
        super().__init__(source)
        if not (callable(ranking_key) or isinstance(ranking_key, (str, Column))):
            raise TypeError("the ranking key must be a path, a column or callable")
        self.ranking_key, self.reverse, self.partition_by, self.keep_key = ranking_key, reverse, tuple(partition_by), keep_key

    def compute(self) -> Any:
        if isinstance(self.input, Database):
            return self.input.with_relations(dict(enumerate(relations_by(self.input, self.ranking_key, self.reverse).values())), references=())
        relation = relation_of(self.input).materialised()
        paths = Paths(relation)
        column = column_of(relation, paths, self.ranking_key, kind=KEY_TYPE)
        drop = [] if self.keep_key else [k for k in relation.key if k not in self.partition_by]
        if self.partition_by:
            window = Window.partitionBy(*[paths.column(p) for p in self.partition_by]).orderBy(*ordered(relation, paths, column, self.reverse))
            df = paths.df.withColumn("rank", F.row_number().over(window).cast("long") - 1)
            return relation.with_df(df.select("rank", *[F.col(f"`{c}`") for c in relation.df.columns if c not in drop]), key=(*self.partition_by, "rank"))
        df = numbered(paths.df, [column, *relation.order], "rank", self.reverse)
        return relation.with_df(df.select("rank", *[F.col(f"`{c}`") for c in relation.df.columns if c not in drop]), key=("rank",))


class subset(Operator):
    """The k items of smallest (``reverse``: largest) sort keys, or what a function of the whole relation returns.

    On a database the sort key is a function of a relation, or its size.
    """

    params = ("ranking_key", "k", "reverse", "subset_predicate")

    def __init__(self, source: Any, *, ranking_key: Any = None, k: int | None = None, reverse: bool = False, subset_predicate: Callable[[Any], Any] | None = None):
        super().__init__(source)
        if (subset_predicate is None) == (ranking_key is None):
            raise ValueError("either a ranking key with k or a subset predicate is needed")
        if ranking_key is not None and (k is None or k < 1):
            raise ValueError("k must be at least 1")
        if ranking_key is not None and not (callable(ranking_key) or isinstance(ranking_key, (str, Column))):
            raise TypeError("the ranking key must be a path, a column or callable")
        self.ranking_key, self.k, self.reverse, self.subset_predicate = ranking_key, k, reverse, subset_predicate

    def compute(self) -> Any:
        source = self.input
        if self.subset_predicate is not None:
            return self.subset_predicate(source)
        if isinstance(source, Database):
            return source.subset(*list(relations_by(source, self.ranking_key, self.reverse))[: self.k])
        relation = relation_of(source)
        paths = Paths(relation)
        df = paths.df.orderBy(*ordered(relation, paths, self.ranking_key, self.reverse)).limit(self.k)
        return relation.with_df(df.select(*[F.col(f"`{c}`") for c in relation.df.columns]))


class items_sorted_by(Operator):
    """Iterator over the items in order; leaves the algebra, one partition at a time."""

    params = ("sorting_key", "reverse")

    def __init__(self, source: Any, *, sorting_key: Any, reverse: bool = False):
        super().__init__(source)
        if not (callable(sorting_key) or isinstance(sorting_key, (str, Column))):
            raise TypeError("the sorting key must be a path, a column or callable")
        self.sorting_key, self.reverse = sorting_key, reverse

    def compute(self) -> Iterator[Any]:
        if isinstance(self.input, Database):
            return iter(relations_by(self.input, self.sorting_key, self.reverse).items())
        relation = relation_of(self.input)
        paths = Paths(relation)
        df = paths.df.orderBy(*ordered(relation, paths, self.sorting_key, self.reverse)).select(*[F.col(f"`{c}`") for c in relation.df.columns])
        return (row.asDict(recursive=True) for row in df.toLocalIterator())
