"""References, join predicates and constraints as metadata, and checked new versions of a database."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintViolationError
from ..model import Database, JoinPredicate, Reference, Relation
from .base import Operator, database_of
from .joins import _matching, reference_violations
from .shapes import last_by_key


class add_reference(Operator):
    """A reference from columns of ``source`` (by default the one named like it) to the key of ``target``.

    Paths follow a reference to one tuple, so a key of the target that comes twice is refused.  Existing rows of the source are
    only checked with ``validate=True``.
    """

    params = ("origin", "ref_key", "target", "columns")

    def __init__(self, source_database: Any, *, source: str, ref_key: str, target: str, columns: tuple[str, ...] | str | None = None, validate: bool = False):
        super().__init__(source_database)
        if not (source and ref_key and target):
            raise ValueError("source, ref_key and target need names")
        self.origin, self.ref_key, self.target, self.validate = source, ref_key, target, validate
        self.columns = (columns,) if isinstance(columns, str) else tuple(columns or (ref_key,))

    def compute(self) -> Database:
        database = database_of(self.input)
        for name in (self.origin, self.target):
            if name not in database.relations:
                raise ValueError(f"no relation {name!r}")
        missing = [c for c in self.columns if c not in database.relations[self.origin].df.columns]
        if missing:
            raise ValueError(f"{self.origin!r} has no columns {missing}")
        target = database.relations[self.target]
        if not target.key or target.df.groupBy(*target.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ConstraintViolationError(f"{self.target!r} has no unique key")
        added = Reference(self.origin, self.ref_key, self.columns, self.target, database.relations[self.target].key)
        if self.validate and reference_violations(database, added).limit(1).count():
            raise ConstraintViolationError(f"some {self.origin}.{self.ref_key} lead to no tuple of {self.target}")
        others = tuple(r for r in database.references if (r.source, r.ref_key, r.target) != (self.origin, self.ref_key, self.target))
        return replace(database, references=(*others, added))


class drop_reference(Operator):
    params = ("origin", "ref_key", "target")

    def __init__(self, source_database: Any, *, source: str, ref_key: str, target: str):
        super().__init__(source_database)
        if not (source and ref_key and target):
            raise ValueError("source, ref_key and target need names")
        self.origin, self.ref_key, self.target = source, ref_key, target

    def compute(self) -> Database:
        database = database_of(self.input)
        left = tuple(r for r in database.references if (r.source, r.ref_key, r.target) != (self.origin, self.ref_key, self.target))
        if len(left) == len(database.references):
            raise ValueError(f"no reference {self.origin}.{self.ref_key} to {self.target}")
        return replace(database, references=left)


class add_join_predicate(Operator):
    """A condition over tuples of the named relations, which ``join`` applies where all of them are present.

    A comparison of two relations can be given by its sides, a function of each relation's tuple: ``equal``, or ``above`` (the first is
    larger than the second).  Joins then pass over pairs that it excludes; a ``predicate`` is tried on each pair.
    """

    params = ("relations", "description")

    def __init__(self, source: Any, *relations: str, predicate: Callable[..., Any] | None = None, equal: Any = None, above: Any = None, description: str | None = None):
        super().__init__(source)
        if not relations:
            raise ValueError("at least one relation is needed")
        if sum(x is not None for x in (predicate, equal, above)) != 1:
            raise ValueError("give one of predicate, equal and above")
        if predicate is not None and not callable(predicate):
            raise TypeError("the predicate must be callable")
        sides = equal or above
        if sides is not None:
            if len(set(relations)) != 2 or len(relations) != 2 or len(sides) != 2 or not all(map(callable, sides)):
                raise TypeError("a comparison takes two relations and a callable for each")
            first, second = sides
            predicate = (lambda a, b: first(a) == second(b)) if equal else (lambda a, b: first(a) > second(b))
        self.relations, self.predicate, self.description, self.equal, self.above = relations, predicate, description, equal and tuple(equal), above and tuple(above)

    def compute(self) -> Database:
        database = database_of(self.input)
        for name in self.relations:
            if name not in database.relations:
                raise ValueError(f"no relation {name!r}")
        return replace(database, join_predicates=(*database.join_predicates, JoinPredicate(self.relations, self.predicate, self.description, self.equal, self.above)))


class drop_join_predicate(Operator):
    """Without the join predicates of a description, of a predicate, or that a matcher picks (which may pick none)."""

    params = ("description",)

    def __init__(self, source: Any, *, description: str | None = None, predicate: Any = None, matcher: Callable[[JoinPredicate], bool] | None = None):
        super().__init__(source)
        if sum(x is not None for x in (description, predicate, matcher)) != 1:
            raise ValueError("give one of description, predicate and matcher")
        self.description, self.predicate, self.matcher = description, predicate, matcher

    def compute(self) -> Database:
        database = database_of(self.input)
        if self.matcher is not None:
            goes = self.matcher
        elif self.description is not None:
            goes = lambda p: p.description == self.description
        else:
            goes = lambda p: p.predicate is self.predicate or p is self.predicate
        left = tuple(p for p in database.join_predicates if not goes(p))
        if self.matcher is None and len(left) == len(database.join_predicates):
            raise ValueError("no such join predicate")
        return replace(database, join_predicates=left)


_TYPES = {str: (T.StringType,), int: (T.LongType, T.IntegerType, T.ShortType, T.ByteType), float: (T.DoubleType, T.FloatType), bool: (T.BooleanType,)}


@dataclass(frozen=True)
class Schema:
    """Attribute names and types.  Attributes may be missing, but none may be added or have another type."""

    attributes: Mapping[str, Any]

    def violations(self, rows: DataFrame, relation: Relation) -> str | None:
        for f in rows.schema.fields:
            if f.name in relation.key:
                continue
            want = self.attributes.get(f.name)
            if want is None:
                return f"attribute {f.name!r} is not in the schema"
            if isinstance(want, T.DataType) and f.dataType != want or isinstance(want, type) and want in _TYPES and not isinstance(f.dataType, _TYPES[want]):
                return f"attribute {f.name!r} is {f.dataType.simpleString()}, not {want}"
        return None


@dataclass(frozen=True)
class MaxCount:
    """At most ``limit`` items; counts no further than that."""

    limit: int

    def violations(self, rows: DataFrame, relation: Relation) -> str | None:
        return f"more than {self.limit} items" if relation.df.limit(self.limit + 1).count() > self.limit else None


@dataclass(frozen=True)
class SameAttributes:
    """Exactly these attributes."""

    names: frozenset[str]

    def violations(self, rows: DataFrame, relation: Relation) -> str | None:
        found = set(rows.columns) - set(relation.key)
        return None if found == set(self.names) else f"attributes {sorted(found ^ set(self.names))} differ"


@dataclass(frozen=True)
class InSubset:
    """Values of an attribute come from a list."""

    attribute: str
    allowed: tuple[Any, ...]

    def violations(self, rows: DataFrame, relation: Relation) -> str | None:
        wrong = rows.where(~F.coalesce(F.col(f"`{self.attribute}`").isin(list(self.allowed)), F.lit(False))).limit(1).count()
        return f"a value of {self.attribute!r} is not allowed" if wrong else None


def _checked(database: Database, before: Database, name: str, rows: DataFrame | None, event: str) -> Database:
    """The new version, if all its constraints hold; observers hear of it then."""
    relation = database.relations[name]
    for constraint in relation.constraints:
        said = constraint.violations(rows, relation) if rows is not None else None
        if said:
            raise ConstraintViolationError(f"{name}: {said}")
    for constraint in database.constraints:
        if not constraint(database):
            raise ConstraintViolationError(f"{constraint!r} does not hold")
    for observer in database.observers:
        observer(event, name, database)
    return database


def _with_rows(database: Database, name: str, df: DataFrame) -> Database:
    old = database.relations[name]
    return database.with_relations({**database.relations, name: old.with_df(df, links=old.links)})


def _new_references_hold(database: Database, name: str, rows: DataFrame, after: DataFrame) -> None:
    """The references of new rows lead to tuples that are there; a self reference may lead to any row of ``after``, the new version."""
    for reference in database.references:
        if reference.source == name and reference.target in database.relations:
            source = rows
            for c in reference.columns:
                source = source.where(F.col(f"`{c}`").isNotNull())
            target = after if reference.target == name else database.relations[reference.target].df
            if _matching(source, target, reference.columns, reference.key, "left_anti").limit(1).count():
                raise ConstraintViolationError(f"{name}.{reference.ref_key} leads to no tuple of {reference.target}")


def _unreferenced(database: Database, name: str, gone: DataFrame, sources: Mapping[str, DataFrame] | None = None) -> None:
    """No row refers to the tuples in ``gone``; ``sources``: relations in a newer version."""
    for reference in database.references:
        if reference.target == name and reference.source in database.relations:
            source = (sources or {}).get(reference.source, database.relations[reference.source].df)
            if _matching(source, gone, reference.columns, reference.key).limit(1).count():
                raise ConstraintViolationError(f"{reference.source}.{reference.ref_key} refers to what goes from {name}")


def insert(database: Database, name: str, rows: DataFrame) -> Database:
    """A version with new rows, or with rows put in place of those of the same key.

    Only the new rows are checked against schema and references.
    """
    old = database.relations[name]
    for constraint in old.constraints:
        if isinstance(constraint, (Schema, SameAttributes)) and (said := constraint.violations(rows, old)):
            raise ConstraintViolationError(f"{name}: {said}")
    frames = old.df.withColumn("__from", F.lit(0)).unionByName(rows.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    new = _with_rows(database, name, last_by_key(frames, old.key, F.col("__from")).drop("__from").select(*old.df.columns, *[c for c in rows.columns if c not in old.df.columns]))
    _new_references_hold(database, name, rows, new.relations[name].df)
    updates = _matching(rows, old.df, old.key, old.key).limit(1).count() if database.observers else 0
    return _checked(new, database, name, rows, "UPDATE" if updates else "INSERT")


def delete(database: Database, name: str, keys: DataFrame) -> Database:
    """A version without the rows of these keys; refused while rows of other relations refer to them."""
    old = database.relations[name]
    _unreferenced(database, name, keys)
    new = _with_rows(database, name, _matching(old.df, keys, old.key, old.key, "left_anti"))
    return _checked(new, database, name, None, "DELETE")


def update(database: Database, name: str, assignments: Mapping[str, Any], predicate: Any = None) -> Database:
    """A version in which rows that meet the predicate have new values, given as functions of the value's proxy or as constants."""
    from ..functions.paths import Paths, Proxy, condition

    relation = database[name]
    paths = Paths(relation)
    holds = condition(relation, paths, predicate, "value") if predicate is not None else F.lit(True)
    made = {c: (v(Proxy(paths)) if callable(v) else F.lit(v)) for c, v in assignments.items()}
    df = paths.df.select(*[(F.when(holds, made[c]).otherwise(F.col(f"`{c}`")) if c in made else F.col(f"`{c}`")).alias(c) for c in relation.df.columns])
    changed = paths.df.where(holds).select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in relation.df.columns])
    _new_references_hold(database, name, changed, df)
    if moved := [c for c in relation.key if c in made]:
        # Rows that refer to a key that goes would lead nowhere.
        gone = _matching(relation.df.select(*relation.key), df.select(*relation.key), relation.key, relation.key, "left_anti")
        _unreferenced(database, name, gone, {name: df})
        if df.groupBy(*relation.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ConstraintViolationError(f"{name}: two tuples would have one value of {moved}")
    return _checked(_with_rows(database, name, df), database, name, changed, "UPDATE")
