"""Relations, databases and their kin: functions from keys to values, held as lazy DataFrames with metadata.

A relation is a DataFrame with declared key columns.  A reference says that columns of one relation hold the key of another;
references are kept by name on the database and bound to relations when they are read, so a path such as
``customer.nation.n_name`` can be followed from any of them.  Everything is immutable: operators return new objects, and
nothing runs before a Spark action.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ids = itertools.count(1)


@dataclass(frozen=True)
class Reference:
    """``source.ref_key`` is the tuple of ``target`` whose key equals the source's ``columns``."""

    source: str
    ref_key: str
    columns: tuple[str, ...]
    target: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class JoinPredicate:
    """A condition over tuples of several relations; the predicate takes one column proxy for each.

    ``equal`` and ``above`` hold the two sides of a comparison of two relations, each a function of its own tuple, where it was given
    so; joins can then do without looking at pairs that the comparison excludes.
    """

    relations: tuple[str, ...]
    predicate: Callable[..., Column]
    description: str | None = None
    equal: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None
    above: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None


@dataclass(frozen=True)
class Link:
    """A reference as a relation sees it."""

    columns: tuple[str, ...]
    key: tuple[str, ...]
    target: Callable[[], Relation]
    target_name: str


class AttributeFunction:
    """Common face of everything in the model."""

    @property
    def frozen(self) -> bool:
        return True

    def __setitem__(self, key: Any, value: Any) -> None:
        from .errors import ReadOnlyError

        raise ReadOnlyError("results do not change in place; insert, update and delete return new versions")

    __delitem__ = __setitem__


@dataclass(frozen=True, eq=False)
class Relation(AttributeFunction):
    """Key to tuple.

    ``computed``: attribute name to a function of this relation's column proxy, expanded where it is used.
    ``default``: what a missing key maps to, as {column: function of the key columns}; ``domain``: keys it may take.
    ``ordinal``: a column that ranks equal sort keys; without one, the key columns do.
    """

    df: DataFrame
    key: tuple[str, ...]
    name: str | None = None
    links: Mapping[str, Link] = field(default_factory=dict)
    computed: Mapping[str, Callable[[Any], Column]] = field(default_factory=dict)
    default: Mapping[str, Callable[..., Column]] | None = None
    domain: DataFrame | None = None
    constraints: tuple[Any, ...] = ()
    ordinal: str | None = None
    uuid: int = field(default_factory=lambda: next(_ids))

    def __post_init__(self):
        clash = set(self.computed) & set(self.df.columns)
        if clash:
            raise ValueError(f"computed attributes {sorted(clash)} are stored, too")
        missing = [k for k in self.key if k not in self.df.columns]
        if missing:
            raise ValueError(f"key columns {missing} are not in the relation")

    @staticmethod
    def from_rows(spark: SparkSession, rows: list[tuple], schema: str, key: str | tuple[str, ...], name: str | None = None) -> Relation:
        """A literal relation."""
        return Relation(spark.createDataFrame(rows, schema), (key,) if isinstance(key, str) else tuple(key), name)

    def with_df(self, df: DataFrame, **changes: Any) -> Relation:
        """Another version over ``df``: links and computed attributes stay as far as their columns do."""
        have = set(df.columns)
        links = {k: v for k, v in self.links.items() if set(v.columns) <= have}
        return replace(self, **({"df": df, "links": links, "uuid": next(_ids)} | changes))

    @property
    def attributes(self) -> list[str]:
        """Columns outside the key, then computed attributes."""
        return [c for c in self.df.columns if c not in self.key] + list(self.computed)

    @property
    def order(self) -> list[Column]:
        """What breaks ties."""
        return [F.col(f"`{c}`") for c in ((self.ordinal,) if self.ordinal else self.key)]

    def expanded(self) -> DataFrame:
        """The DataFrame with computed attributes as columns."""
        from .functions.paths import Paths

        if not self.computed:
            return self.df
        paths = Paths(self)
        columns = {name: paths.column(name) for name in self.computed}
        return paths.df.withColumns(columns).select(*[F.col(f"`{c}`") for c in [*self.df.columns, *columns]])

    def items(self) -> DataFrame:
        """Stored rows and, if there is a default with a domain, the rows of the domain's other keys."""
        df = self.expanded()
        if self.default is None or self.domain is None:
            return df
        others = self.domain.select(*self.key).distinct().join(df.select(*self.key), list(self.key), "left_anti")
        keys = [F.col(k) for k in self.key]
        return df.unionByName(others.select(*keys, *[f(*keys).alias(c) for c, f in self.default.items()]), allowMissingColumns=True)

    def materialised(self) -> Relation:
        """Computed attributes and domain items become stored ones; default and domain go."""
        return self.with_df(self.items(), computed={}, default=None, domain=None)

    def lookup(self, key: Any) -> dict[str, Any]:
        """The tuple of one key; an AttributeError if there is none."""
        values = key if isinstance(key, tuple) else (key,)
        condition = F.lit(True)
        for column, value in zip(self.key, values, strict=True):
            condition &= F.col(column) == F.lit(value)
        found = self.items().where(condition).take(1)
        if found:
            return {c: v for c, v in found[0].asDict(recursive=True).items() if c not in self.key}
        if self.default is not None and self.domain is None:
            row = self.df.sparkSession.range(1).select(*[f(*[F.lit(v) for v in values]).alias(c) for c, f in self.default.items()]).first()
            return row.asDict(recursive=True)
        raise AttributeError(f"{self.name or 'relation'} has no key {key!r}")

    __getitem__ = __call__ = lookup

    def __contains__(self, key: Any) -> bool:
        try:
            self.lookup(key)
        except AttributeError:
            return False
        return True

    def __len__(self) -> int:
        return self.items().count()

    def __bool__(self) -> bool:
        return True

    def keys(self) -> DataFrame:
        return self.items().select(*self.key)

    def values(self) -> DataFrame:
        return self.items().drop(*self.key)

    def random_item(self, seed: int | None = None) -> dict[str, Any]:
        found = self.items().orderBy(F.rand(seed)).limit(1).collect()
        if not found:
            raise ValueError("an empty relation has no item")
        return found[0].asDict(recursive=True)

    def where(self, predicate: Any = None, **lookups: Any) -> Relation:
        """Rows that meet a predicate and all lookups; see ``operators.filters``."""
        from .operators.filters import where

        return where(self, predicate, **lookups)

    def project(self, *keys: str) -> Relation:
        from .operators.shapes import project

        return project(self, *keys).result

    def rename(self, **names: str) -> Relation:
        from .operators.shapes import rename

        return rename(self, **names).result

    def top(self, k: int, key: Any) -> Relation:
        """The k rows of the smallest keys."""
        from .operators.ranking import subset

        return subset(self, ranking_key=key, k=k).result

    def bottom(self, k: int, key: Any) -> Relation:
        """The k rows of the largest keys."""
        from .operators.ranking import subset

        return subset(self, ranking_key=key, k=k, reverse=True).result

    𝛔 = where
    π = project
    ρ = rename

    def copy(self) -> Relation:
        return replace(self, uuid=next(_ids))

    def update(self, other: Relation) -> Relation:
        """This relation with the rows of ``other`` added, or put in place of rows of the same key."""
        from .operators.sets import union

        return union(Database({"old": self, "new": other})).result

    def index_by(self, *key: str) -> Relation:
        """The same rows under another key."""
        return replace(self, key=tuple(key), uuid=next(_ids))

    def with_computed(self, **computed: Callable[[Any], Column]) -> Relation:
        return replace(self, computed={**self.computed, **computed}, uuid=next(_ids))

    def with_default(self, default: Mapping[str, Callable[..., Column]], domain: DataFrame | None = None) -> Relation:
        return replace(self, default=default, domain=domain, uuid=next(_ids))

    def with_constraint(self, *constraints: Any) -> Relation:
        return replace(self, constraints=(*self.constraints, *constraints), uuid=next(_ids))

    def without_constraint(self, constraint: Any) -> Relation:
        return replace(self, constraints=tuple(c for c in self.constraints if c is not constraint), uuid=next(_ids))

    def __repr__(self) -> str:
        return f"Relation({self.name or '?'}, key={'/'.join(self.key)}, attributes={', '.join(self.attributes)})"


@dataclass(frozen=True, eq=False)
class Relationship(Relation):
    """An N:M link table: its key is the keys of the parts it links, its attributes describe the link."""

    parts: tuple[str, ...] = ()

    def related_values(self, match_index: int, subkey: Any, return_index: int) -> DataFrame:
        """Keys at ``return_index`` of the links whose part at ``match_index`` is ``subkey``; one may come more than once."""
        return self.df.where(F.col(self.key[match_index]) == F.lit(subkey)).select(self.key[return_index])

    def related(self, match_index: int, subkey: Any, return_index: int) -> DataFrame:
        """The tuples instead of their keys, each once."""
        link = self.links[self.parts[return_index]]
        found = self.related_values(match_index, subkey, return_index).distinct()
        return link.target().expanded().join(found, F.col(link.key[0]) == found[self.key[return_index]], "left_semi")


@dataclass(frozen=True, eq=False)
class Database(AttributeFunction):
    """Relation name to relation, in insertion order, with references and join predicates between them."""

    relations: Mapping[str, Relation]
    references: tuple[Reference, ...] = ()
    join_predicates: tuple[JoinPredicate, ...] = ()
    name: str | None = None
    constraints: tuple[Any, ...] = ()
    observers: tuple[Callable[[str, str, Database], None], ...] = ()
    views: Mapping[str, Callable[[Database], Relation]] = field(default_factory=dict)
    uuid: int = field(default_factory=lambda: next(_ids))

    def __getitem__(self, name: str) -> Relation:
        if name not in self.relations:
            if name in self.views:
                return replace(self.views[name](self), name=name)
            raise AttributeError(f"no relation {name!r}")
        links = {r.ref_key: Link(r.columns, r.key, (lambda t=r.target: self[t]), r.target) for r in self.references if r.source == name and r.target in self.relations}
        own = self.relations[name]
        return replace(own, name=name, links={**own.links, **links})

    __call__ = __getitem__

    def __getattr__(self, name: str) -> Relation:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*self.relations, *self.views])

    def __contains__(self, name: str) -> bool:
        return name in self.relations or name in self.views

    def __len__(self) -> int:
        return len(self.relations) + len(self.views)

    def __bool__(self) -> bool:
        return True

    def bound(self) -> dict[str, Relation]:
        return {name: self[name] for name in self}

    def with_relations(self, relations: Mapping[str, Relation], **changes: Any) -> Database:
        """Another version with these relations; references between remaining ones stay."""
        return replace(self, relations=dict(relations), uuid=next(_ids), **changes)

    def subset(self, *names: str) -> Database:
        return self.with_relations({n: self.relations[n] for n in names})

    def with_view(self, name: str, view: Callable[[Database], Relation]) -> Database:
        """A relation that is computed from the database when it is read."""
        return replace(self, views={**self.views, name: view}, uuid=next(_ids))

    def where(self, predicate: Callable[[str], bool]) -> Database:
        """The relations whose names meet the predicate."""
        return self.subset(*[n for n in self.relations if predicate(n)])

    def project_each(self, *attributes: str) -> Database:
        """Every relation projected to those of the attributes that it has."""
        return self.with_relations({n: r.project(*attributes) for n, r in self.bound().items()})

    def to_html(self, sizes: bool = False) -> str:
        from .sources.html import schema_graph

        return schema_graph(self, sizes)

    def __repr__(self) -> str:
        return f"Database({', '.join(self)}; {', '.join(f'{r.source}.{r.ref_key} -> {r.target}' for r in self.references)})"


@dataclass(frozen=True, eq=False)
class DatabaseSet(AttributeFunction):
    """Database name to database."""

    databases: Mapping[str, Database]

    def __getitem__(self, name: str) -> Database:
        if name not in self.databases:
            raise AttributeError(f"no database {name!r}")
        return self.databases[name]

    __call__ = __getitem__

    def __iter__(self) -> Iterator[str]:
        return iter(self.databases)

    def __len__(self) -> int:
        return len(self.databases)


@dataclass(frozen=True, eq=False)
class Partitioned(AttributeFunction):
    """A database of one relation for each value of the partition columns, kept as one DataFrame.

    Reading a member is a filter; the members' names are only looked up when asked for.
    """

    relation: Relation
    columns: tuple[str, ...]
    hidden: bool = False

    def __getitem__(self, value: Any) -> Relation:
        values = value if isinstance(value, tuple) else (value,)
        condition = F.lit(True)
        for column, v in zip(self.columns, values, strict=True):
            condition &= F.col(f"`{column}`").eqNullSafe(F.lit(v))
        df = self.relation.df.where(condition)
        return self.relation.with_df(df.drop(*self.columns) if self.hidden else df)

    __call__ = __getitem__

    def keys(self) -> DataFrame:
        return self.relation.df.select(*self.columns).distinct()

    def counts(self) -> DataFrame:
        return self.relation.df.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("n"))

    def __len__(self) -> int:
        return self.keys().count()


@dataclass(frozen=True, eq=False)
class Tensor(AttributeFunction):
    """A sparse array: coordinate columns c0, c1, ... and value; its dimensions are metadata, not data."""

    df: DataFrame
    dimensions: tuple[int, ...]

    @property
    def coordinates(self) -> list[str]:
        return [f"c{i}" for i in range(self.rank)]

    @property
    def rank(self) -> int:
        return len(self.dimensions)

    def _elementwise(self, other: Tensor, how: str, combine: Callable[[Column, Column], Column]) -> Tensor:
        if self.dimensions != other.dimensions:
            raise ValueError(f"dimensions differ: {self.dimensions} and {other.dimensions}")
        right = other.df.withColumnRenamed("value", "__other")
        joined = self.df.join(right, self.coordinates, how)
        return Tensor(joined.select(*self.coordinates, combine(F.coalesce("value", F.lit(0)), F.coalesce("__other", F.lit(0))).alias("value")), self.dimensions)

    def __add__(self, other: Tensor) -> Tensor:
        return self._elementwise(other, "full_outer", lambda a, b: a + b)

    def __sub__(self, other: Tensor) -> Tensor:
        return self._elementwise(other, "full_outer", lambda a, b: a - b)

    def __mul__(self, other: Tensor) -> Tensor:
        return self._elementwise(other, "inner", lambda a, b: a * b)

    def __matmul__(self, other: Tensor) -> Tensor:
        """Contraction of the last dimension with the first of ``other``; partial sums are taken before the shuffle."""
        if self.dimensions[-1] != other.dimensions[0]:
            raise ValueError(f"inner dimensions differ: {self.dimensions} and {other.dimensions}")
        left = self.df.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(self.coordinates)], F.col("value").alias("x"))
        right = other.df.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(other.coordinates)], F.col("value").alias("y"))
        outer = [f"l{i}" for i in range(self.rank - 1)] + [f"r{i}" for i in range(1, other.rank)]
        made = left.join(right, F.col(f"l{self.rank - 1}") == F.col("r0")).groupBy(*outer).agg(F.sum(F.col("x") * F.col("y")).alias("value"))
        return Tensor(made.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(outer)], "value"), (*self.dimensions[:-1], *other.dimensions[1:]))
