"""Joins that follow from the database: semijoin, reduction of a whole database, nested join, co-grouping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Database, JoinPredicate, Reference, Relation
from ..plans.graph import ReferenceGraph
from .base import Operator, database_of

#: Ranges of values into which a join over an inequality deals its rows.
RANGES = 32


def _matching(left: DataFrame, right: DataFrame, left_columns: tuple[str, ...], right_columns: tuple[str, ...], how: str = "left_semi") -> DataFrame:
    """Rows of left with (or without) a partner; only the key columns of the right side travel."""
    names = [f"__m{i}" for i in range(len(right_columns))]
    keys = right.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(right_columns, names, strict=True)])
    match = [F.col(f"`{c}`") == F.col(n) for c, n in zip(left_columns, names, strict=True)]
    condition = match[0]
    for m in match[1:]:
        condition &= m
    return left.join(keys, condition, how)


def _reduced(left: DataFrame, right: DataFrame, reduce: str, edge: Reference, how: str = "left_semi") -> DataFrame:
    if edge.source == reduce:
        return _matching(left, right, edge.columns, edge.key, how)
    return _matching(left, right, edge.key, edge.columns, how)


class semijoin(Operator):
    """The database with relation ``reduce`` cut to the tuples that match one of ``by`` over reference ``ref_key``.

    Whichever of the two holds the reference, its direction is found.  ``anti=True`` keeps the tuples without a match.
    """

    params = ("reduce", "by", "ref_key", "anti")

    def __init__(self, source: Any, *, reduce: str, by: str, ref_key: str, anti: bool = False):
        super().__init__(source)
        self.reduce, self.by, self.ref_key, self.anti = reduce, by, ref_key, anti

    def compute(self) -> Database:
        database = database_of(self.input)
        edges = [r for r in database.references if r.ref_key == self.ref_key and {r.source, r.target} == {self.reduce, self.by}]
        if not edges:
            raise ValueError(f"no reference {self.ref_key!r} between {self.reduce!r} and {self.by!r}")
        left, right = database.relations[self.reduce], database.relations[self.by]
        df = _reduced(left.df, right.df, self.reduce, edges[0], "left_anti" if self.anti else "left_semi")
        return database.with_relations({**database.relations, self.reduce: left.with_df(df, links=left.links)})


class subdatabase(Operator):
    """Every relation cut to the tuples that take part in the join of all relations that are connected to it.

    ``strategy``: ``cascade`` runs two passes of semijoins over the tree of references (a full reduction); ``decompose`` joins only
    the key columns and reduces each relation by the keys that remain, which also serves graphs that are no trees.  ``auto``
    takes decompose for graphs with one pure source, where the join of keys has at most that relation's rows, and for graphs that are
    no tree.  ``keep``: relations that are left whole and reduce no other (outer); ``anti``: of these relations the
    tuples that take no part.  Relations without references pass through.  ``persist`` keeps the join of keys for relations
    that are read in separate jobs; within one job Spark reuses its exchanges.
    """

    params = ("root", "strategy", "keep", "anti")

    def __init__(self, source: Any, *, root: str | None = None, strategy: str = "auto", keep: tuple[str, ...] = (), anti: tuple[str, ...] = (), persist: bool = False):
        super().__init__(source)
        if strategy not in ("auto", "cascade", "decompose"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.root, self.strategy, self.keep, self.anti, self.persist = root, strategy, tuple(keep), tuple(anti), persist

    def compute(self) -> Database:
        database = database_of(self.input)
        graph = ReferenceGraph([n for n in database.relations if n not in self.keep], database.references)
        if self.root is not None and self.root not in database.relations:
            raise ValueError(f"no relation {self.root!r}")
        if graph.trivial:
            return database
        graph.check_acyclic()
        out = {n: r.df for n, r in database.relations.items()}
        for group in graph.components():
            if len(group) == 1:
                continue
            tree = graph.is_tree(group)
            sources = [n for n in graph.pure_sources() if n in group]
            if self.strategy == "cascade" and not tree:
                raise ValueError("a cascade reduces trees only; use decompose")
            if self.strategy == "cascade" or self.strategy == "auto" and tree and len(sources) > 1:
                root = self.root if self.root in group else graph.root(group)
                for step in graph.semijoins(root):
                    out[step.reduce] = _reduced(out[step.reduce], out[step.by], step.reduce, step.reference)
            else:
                out |= _decomposed(database, graph, group, self.persist)
        for name in self.anti:
            whole = database.relations[name]
            out[name] = _matching(whole.df, out[name], whole.key, whole.key, "left_anti")
        return database.with_relations({n: r.with_df(out[n], links=r.links) for n, r in database.relations.items()})


def _key_columns(graph: ReferenceGraph, name: str, key: tuple[str, ...]) -> list[str]:
    used = list(key)
    for edge in graph.touching(name):
        used += edge.columns if edge.source == name else edge.key
    return list(dict.fromkeys(used))


def _join_order(graph: ReferenceGraph, group: list[str], start: str) -> list[str]:
    return [start, *[child for _, child, _ in graph.spanning(start)]]


def _conditions(graph: ReferenceGraph, name: str, present: list[str], column: Any) -> Column | None:
    """Equality over every reference between ``name`` and the relations joined so far."""
    found = None
    for a, b in _referring(graph, name, present, column):
        found = a == b if found is None else found & (a == b)
    return found


def _referring(graph: ReferenceGraph, name: str, present: list[str], column: Any) -> list[tuple[Column, Column]]:
    """Pairs of columns, of the relations joined so far and of ``name``, that its references hold equal."""
    found = []
    for edge in graph.touching(name):
        other = edge.target if edge.source == name else edge.source
        if other in present:
            for a, b in zip(edge.columns, edge.key, strict=True):
                pair = column(edge.source, a), column(edge.target, b)
                found.append(pair[::-1] if edge.source == name else pair)
    return found


def _cuts(value: str, kind: T.DataType, n: int) -> Column:
    """Aggregate: values in order that cut those of column ``value`` into about ``n`` equal ranges; none for types without quantiles."""
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
        return F.array().cast(T.ArrayType(kind))
    known = F.when(~F.isnan(value), F.col(value)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(value)
    return F.percentile_approx(known, [i / n for i in range(1, n)])


def _range(cuts: str, value: str) -> Column:
    """Number of cuts at or below a value; a larger value is in no lower range."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col(value))), F.lit(0))


def _in_ranges(high: DataFrame, low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the ranges, __h and __l, in which those meet whose __high is above __low."""
    low = low.crossJoin(F.broadcast(high.agg(F.max("__high").alias("__most")))).where("__low < __most").drop("__most")
    ranges = low.agg(F.min("__low").alias("__least"), _cuts("__low", low.schema["__low"].dataType, RANGES).alias("__cuts"))
    high = high.crossJoin(F.broadcast(ranges)).where("__high > __least").withColumn("__h", F.explode(F.sequence(F.lit(0), _range("__cuts", "__high")))).drop("__least", "__cuts")
    low = low.crossJoin(F.broadcast(ranges)).withColumn("__l", _range("__cuts", "__low")).drop("__least", "__cuts")
    return high, low


def _range_join(left: DataFrame, right: DataFrame, equal: list[tuple[Column, Column]], sides: tuple[Column, Column], high_left: bool, rest: Column | None) -> DataFrame:
    """Inner join over equalities and one inequality, ``sides[0] > sides[1]``; ``high_left``: the larger side is of ``left``.

    The rows of the smaller side are dealt into ranges of their values, those of the larger side into each range up to their own, so
    rows meet where the inequality holds or both are in one range: the pairs looked at are those of the result and about one in
    ``RANGES`` more.  Rows beyond the other side's extremes are left out first.  The number of tasks is fixed, as few
    bytes of input may give many pairs.
    """
    high, low = (left, right) if high_left else (right, left)
    place = 0 if high_left else 1
    high = high.select("*", sides[0].alias("__high"), *[pair[place].alias(f"__h{i}") for i, pair in enumerate(equal)])
    low = low.select("*", sides[1].alias("__low"), *[pair[1 - place].alias(f"__l{i}") for i, pair in enumerate(equal)])
    for i in range(len(equal)):
        high, low = high.where(F.col(f"__h{i}").isNotNull()), low.where(F.col(f"__l{i}").isNotNull())
    high, low = _in_ranges(high, low)
    keys = [[f"__{side}", *[f"__{side}{i}" for i in range(len(equal))]] for side in "hl"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high, low = high.repartition(tasks, *keys[0]), low.repartition(tasks, *keys[1])
    on = F.col("__high") > F.col("__low")
    for a, b in zip(*keys, strict=True):
        on &= F.col(a) == F.col(b)
    if rest is not None:
        on &= rest
    left, right = (high, low) if high_left else (low, high)
    return left.join(right, on).drop("__high", "__low", *keys[0], *keys[1])


def _decomposed(database: Database, graph: ReferenceGraph, group: list[str], persist: bool) -> dict[str, DataFrame]:
    """Join of the key columns over all edges, then each relation by its keys in it."""
    start = next((n for n in graph.pure_sources() if n in group), group[0])
    column = lambda name, c: F.col(f"`__{name}__{c}`")
    joined, present = None, []
    for name in _join_order(graph, group, start):
        relation = database.relations[name]
        keys = relation.df.select(*[F.col(f"`{c}`").alias(f"__{name}__{c}") for c in _key_columns(graph, name, relation.key)])
        joined = keys if joined is None else joined.join(keys, _conditions(graph, name, present, column), "inner")
        present.append(name)
    if persist:
        joined = joined.persist()
    out = {}
    for name in group:
        relation = database.relations[name]
        names = tuple(f"__{name}__{k}" for k in relation.key)
        out[name] = _matching(relation.df, joined.select(*[F.col(f"`{n}`") for n in names]).distinct(), relation.key, names)
    return out


@dataclass(frozen=True, eq=False)
class Joined(Relation):
    """Rows of one struct for each relation; ``joined`` has the relations, for paths and flattening."""

    joined: Mapping[str, Relation] = field(default_factory=dict)


class join(Operator):
    """Inner join of all relations of a database over its references and join predicates.

    A row has a struct for each relation; the row number is the key.  Graphs may have several sources and several paths to a
    relation, which must then lead to the same tuple (bind a relation under two names for separate roles).  A join predicate given as
    ``above`` is joined by ranges of its values.  Relations without a connection are an error unless ``cross=True``.  Without ``numbered`` the key is an id that grows but has gaps, and no
    global order is made.
    """

    params = ("root", "cross", "numbered")

    def __init__(self, source: Any, *, root: str | None = None, cross: bool = False, numbered: bool = False):
        super().__init__(source)
        self.root, self.cross, self.numbered = root, cross, numbered

    def compute(self) -> Joined:
        database = database_of(self.input)
        if not database.relations:
            raise ValueError("an empty database has no join")
        graph = ReferenceGraph.of(database)
        graph.check_acyclic()
        if self.root is not None and self.root not in database.relations:
            raise ValueError(f"no relation {self.root!r}")
        groups = graph.components()
        linked = {frozenset((a, b)) for p in database.join_predicates for a in p.relations for b in p.relations}
        if len(groups) > 1 and not self.cross and not _connected(groups, linked):
            raise ValueError(f"relations {groups} are not connected; cross=True allows their product")
        bound = database.bound()
        column = lambda name, c: F.col(f"`{name}`").getField(c)
        df, present, pending = None, [], list(database.join_predicates)
        for group in groups:
            start = self.root if self.root in group else next((n for n in graph.pure_sources() if n in group), group[0])
            for name in _join_order(graph, group, start):
                part = bound[name].expanded()
                part = part.select(F.struct(*[F.col(f"`{c}`") for c in part.columns]).alias(name))
                present.append(name)
                if df is None:
                    df = part
                    continue
                on = _conditions(graph, name, present[:-1], column)
                ready = [p for p in pending if set(p.relations) <= set(present)]
                pending = [p for p in pending if p not in ready]
                ranged = next((p for p in ready if p.above is not None and name in p.relations), None)
                if ranged is not None:
                    df = self._ranged(df, part, name, ranged, _referring(graph, name, present[:-1], column), [p for p in ready if p is not ranged])
                    continue
                for p in ready:
                    extra = p.predicate(*[F.col(f"`{r}`") for r in p.relations])
                    on = extra if on is None else on & extra
                df = df.crossJoin(part) if on is None else df.join(part, on, "inner")
        for p in pending:
            df = df.where(p.predicate(*[F.col(f"`{r}`") for r in p.relations]))
        df = df.select(*[F.col(f"`{n}`") for n in database.relations])
        if self.numbered:
            from .ranking import numbered

            order = [F.col(f"`{n}`").getField(k) for n, r in database.relations.items() for k in r.key]
            df = numbered(df, order, "row")
        else:
            df = df.withColumn("row", F.monotonically_increasing_id())
        return Joined(df, ("row",), joined=bound)

    def _ranged(self, df: DataFrame, part: DataFrame, name: str, ranged: JoinPredicate, equal: list[tuple[Column, Column]], others: list[JoinPredicate]) -> DataFrame:
        """``df`` joined with the relation ``name`` in ``part``, with whatever else holds between them as equalities or as conditions on pairs."""
        rest = None
        for p in others:
            sides = [F.col(f"`{r}`") for r in p.relations]
            if p.equal is not None and name in p.relations:
                pair = tuple(f(side) for f, side in zip(p.equal, sides, strict=True))
                equal.append(pair if p.relations[1] == name else pair[::-1])
            else:
                extra = p.predicate(*sides)
                rest = extra if rest is None else rest & extra
        high, low = (f(F.col(f"`{r}`")) for f, r in zip(ranged.above, ranged.relations, strict=True))
        return _range_join(df, part, equal, (high, low), ranged.relations[1] == name, rest)


class partner_counts(Operator):
    """How many tuples of ``partner`` each tuple of ``relation`` joins with; tuples without one are left out.

    What the join of the two would give, grouped by ``by`` (the relation's key by default) and counted, but without its pairs, so that
    the work grows with the rows.  All that holds between the two must be references and join predicates given as ``equal`` or
    ``above``, at most one of these; ``join`` takes any other.  With equalities only, the partners are counted for each value first.  With an
    inequality, the values of both sides are put in order and the partners summed over them, within ranges of values and over the
    ranges before, so that no task holds all tuples of one equality.
    """

    params = ("relation", "partner", "by", "name")

    def __init__(self, source: Any, relation: str, partner: str, *, by: tuple[str, ...] = (), name: str = "count"):
        super().__init__(source)
        self.relation, self.partner, self.by, self.name = relation, partner, tuple(by), name

    def compute(self) -> Relation:
        database = database_of(self.input)
        for name in (self.relation, self.partner):
            if name not in database.relations:
                raise ValueError(f"no relation {name!r}")
        bound = database.bound()
        column = lambda name, c: F.col(f"`{name}`").getField(c)
        graph = ReferenceGraph.of(database)
        equal, above = _referring(graph, self.partner, [self.relation], column), None
        for p in database.join_predicates:
            if not {self.relation, self.partner} & set(p.relations):
                continue
            if set(p.relations) != {self.relation, self.partner} or p.equal is None and (p.above is None or above is not None):
                raise ValueError("only equalities and one inequality between the two relations can be counted; join takes the others")
            sides = [f(F.col(f"`{r}`")) for f, r in zip(p.equal or p.above, p.relations, strict=True)]
            pair = tuple(sides if p.relations[0] == self.relation else sides[::-1])
            if p.equal is not None:
                equal.append(pair)
            else:
                above = pair, p.relations[0] == self.partner
        if not equal and above is None:
            raise ValueError(f"{self.relation!r} and {self.partner!r} are not connected")
        by = self.by or bound[self.relation].key
        if not by:
            raise ValueError(f"{self.relation!r} has no key; by names what to count for")
        on = [f"__e{i}" for i in range(len(equal))]
        whole = []
        for place, name in enumerate((self.relation, self.partner)):
            part = bound[name].expanded()
            part = part.select(F.struct(*[F.col(f"`{c}`") for c in part.columns]).alias(name))
            keys = [pair[place].alias(k) for k, pair in zip(on, equal, strict=True)]
            value = [] if above is None else [above[0][place].alias("__v")]
            kept = [column(name, c).alias(c) for c in by] if place == 0 else []
            side = part.select(*kept, *keys, *value)
            for c in (*on, *(["__v"] if value else [])):
                side = side.where(F.col(c).isNotNull())
            whole.append(side)
        rows, partners = whole
        if above is None:
            counts = partners.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        else:
            counts, on = _beyond(rows.select(*on, "__v"), partners, on, larger=above[1]), [*on, "__v"]
        found = rows.join(counts, on).where("__n > 0").groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.sum("__n").alias(self.name))
        return Relation(found, tuple(by))


def _beyond(rows: DataFrame, partners: DataFrame, on: list[str], larger: bool) -> DataFrame:
    """For each ``on`` and value __v of ``rows``: __n, the number of partners of that ``on`` whose value is larger (or smaller)."""
    points = partners.withColumn("__one", F.lit(1)).unionByName(rows.withColumn("__one", F.lit(0)))
    points = points.groupBy(*on, "__v").agg(F.sum("__one").alias("__own"))
    ranges = points.agg(_cuts("__v", points.schema["__v"].dataType, 2 * RANGES).alias("__cuts"))
    points = points.crossJoin(F.broadcast(ranges)).withColumn("__range", _range("__cuts", "__v")).drop("__cuts")

    def before(sums: str, place: str, by: list[Any]) -> Column:
        window = Window.partitionBy(*by).orderBy(F.desc(place) if larger else F.asc(place)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(sums).over(window), F.lit(0))

    # One row for each range of an equality.
    sums = points.groupBy(*on, "__range").agg(F.sum("__own").alias("__sum"))
    sums = sums.select(*on, "__range", before("__sum", "__range", on or [F.lit(0)]).alias("__base"))
    inside = points.withColumn("__inside", before("__own", "__v", [*on, "__range"]))
    return inside.join(sums, [*on, "__range"]).select(*on, "__v", (F.col("__base") + F.col("__inside")).alias("__n"))


def _connected(groups: list[list[str]], linked: set[frozenset]) -> bool:
    have, rest = set(groups[0]), groups[1:]
    while rest:
        near = next((g for g in rest if any(frozenset((a, b)) in linked for a in have for b in g)), None)
        if near is None:
            return False
        have |= set(near)
        rest.remove(near)
    return True


class cogroup(Operator):
    """Groups of several relations side by side, without padding.

    Without ``grouping_keys``: for each key one struct for each relation, NULL where the relation has no such key.  With
    them (relation name to attribute or attributes): for each value a map from item key to item for each relation, or a list of items where
    a relation has no key.  ``aggregates`` (relation
    name to {name: aggregate}) replaces the maps by their aggregates, which no group's size can overflow.
    """

    params = ("grouping_keys",)

    def __init__(self, source: Any, grouping_keys: Mapping[str, Any] | None = None, aggregates: Mapping[str, Mapping[str, Any]] | None = None):
        super().__init__(source)
        self.grouping_keys, self.aggregates = grouping_keys, aggregates

    def compute(self) -> Relation:
        from ..functions.paths import Paths

        database = database_of(self.input)
        bound = database.bound()
        if len(bound) < 2:
            raise ValueError("cogroup needs at least two relations")
        sides, width = [], None
        for name, relation in bound.items():
            paths = Paths(relation)
            if self.grouping_keys is None:
                by = list(relation.key)
            else:
                if name not in self.grouping_keys:
                    raise KeyError(f"no grouping key for relation {name!r}")
                by = self.grouping_keys[name]
                by = [by] if isinstance(by, str) else list(by)
            if width is not None and len(by) != width:
                raise ValueError("grouping keys differ in length")
            width = len(by)
            keys = [paths.column(b).alias(f"__g{i}") for i, b in enumerate(by)]
            columns = relation.expanded().columns
            value = F.struct(*[(F.col(f"`{c}`") if c in relation.df.columns else paths.column(c)).alias(c) for c in columns if c not in relation.key] or [F.lit(True).alias("present")])
            if self.aggregates is not None:
                made = {n: a.to_column(paths.column) for n, a in self.aggregates.get(name, {}).items()}
                side = paths.df.groupBy(*keys).agg(*[c.alias(f"{name}__{n}") for n, c in made.items()])
            elif self.grouping_keys is None:
                side = paths.df.select(*keys, value.alias(name))
            elif not relation.key:
                side = paths.df.groupBy(*keys).agg(F.collect_list(value).alias(name))
            else:
                key = F.col(f"`{relation.key[0]}`") if len(relation.key) == 1 else F.struct(*[F.col(f"`{k}`") for k in relation.key])
                side = paths.df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
            sides.append(side)
        names = [f"__g{i}" for i in range(width)]
        df = sides[0]
        for side in sides[1:]:
            df = df.join(side, names, "full_outer")
        first = next(iter(bound))
        final = bound[first].key if self.grouping_keys is None else [self.grouping_keys[first]] if isinstance(self.grouping_keys[first], str) else self.grouping_keys[first]
        final = [f.replace("__", ".").rpartition(".")[2] for f in final]
        df = df.select(*[F.col(n).alias(f) for n, f in zip(names, final, strict=True)], *[F.col(f"`{c}`") for c in df.columns if c not in names])
        return Relation(df, tuple(final))


def reference_violations(database: Database, reference: Reference) -> DataFrame:
    """Rows of the source whose reference is set and leads to no tuple of the target."""
    source = database.relations[reference.source].df
    for c in reference.columns:
        source = source.where(F.col(f"`{c}`").isNotNull())
    return _matching(source, database.relations[reference.target].df, reference.columns, reference.key, "left_anti")


def reference_blockers(database: Database, reference: Reference, deleted: DataFrame) -> DataFrame:
    """Rows of the source that refer to tuples in ``deleted``."""
    return _matching(database.relations[reference.source].df, deleted, reference.columns, reference.key)


def rebound(database: Database, name: str, relation: Relation) -> Database:
    return replace(database, relations={**database.relations, name: relation})
