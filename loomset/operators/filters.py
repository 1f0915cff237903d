"""Filters: rows of a relation, or relations of a database."""

from __future__ import annotations

from types import SimpleNamespace
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Paths, condition
from ..functions.predicates import LOOKUPS, Predicate, parse_lookup
from ..model import Database, Relation
from .base import Operator, relation_of


class filter_items(Operator):
    """Items whose predicate holds; the predicate sees ``item.key`` and ``item.value``, of a database a relation's name and the relation."""

    params = ("filter_predicate",)
    on, complement = "item", False

    def __init__(self, source: Any, filter_predicate: Any, *, as_udf: bool = False, create_lineage: bool = False):
        super().__init__(source)
        if create_lineage:
            raise NotImplementedError("lineage is read from plans")
        self.filter_predicate, self.as_udf = filter_predicate, as_udf

    def compute(self) -> Any:
        if isinstance(self.input, Database):
            parts = {"item": lambda key, value: SimpleNamespace(key=key, value=value), "value": lambda key, value: value, "key": lambda key, value: key}[self.on]
            return self.input.subset(*[n for n in self.input.relations if self.complement != bool(self.filter_predicate(parts(n, self.input[n])))])
        relation = relation_of(self.input)
        paths = Paths(relation)
        holds = condition(relation, paths, self.filter_predicate, self.on, self.as_udf)
        return keep(relation, paths, ~F.coalesce(holds, F.lit(False)) if self.complement else holds)


class filter_values(filter_items):
    """Items whose value meets a structured predicate or a function of the value."""

    on = "value"


class filter_keys(filter_items):
    """Items whose key meets a predicate; of a database, the relations whose name does."""

    on = "key"


class filter_items_scan_complement(filter_items):
    """Items whose predicate does not hold, NULL results included."""

    complement = True

    def __init__(self, source: Any, filter_predicate: Any, **options: Any):
        super().__init__(source, filter_predicate, **options)
        self.on = "value" if isinstance(filter_predicate, Predicate) else "item"


def keep(relation: Relation, paths: Paths, holds: Any) -> Relation:
    """The relation's own columns where the condition holds, after whatever joins its paths needed."""
    df = paths.df.where(holds)
    return relation.with_df(df if paths.df is relation.df else df.select(*[F.col(f"`{c}`") for c in relation.df.columns]))


def where(relation: Relation, predicate: Any = None, **lookups: Any) -> Relation:
    """A predicate (a function takes the item) and keyword lookups such as ``yob__gte=1980``, all of which must hold.

    An attribute that is NULL meets no lookup but ``isnull=True``.  References stay.
    """
    relation = relation.materialised() if relation.domain is not None else relation
    paths = Paths(relation)
    holds = F.lit(True)
    if predicate is not None:
        holds &= condition(relation, paths, predicate, "item")
    for keyword, value in lookups.items():
        path, name = parse_lookup(keyword)
        try:
            column = paths.column(path)
        except AttributeError:
            # The whole keyword may be an attribute that ends like a lookup.
            column, name = paths.column(keyword), "exact"
        if name == "contains" and isinstance(paths.df.select(column).schema[0].dataType, T.ArrayType):
            holds &= F.array_contains(column, value)
        else:
            holds &= LOOKUPS[name](column, value)
    return keep(relation, paths, holds)
