"""The star-schema tables as a database with keys and references."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import Database, Reference, Relation

#: Table: key, and (ref_key, column, target) of each reference.
_TABLES: dict[str, tuple[tuple[str, ...], list[tuple[str, str, str]]]] = {
    "region": (("r_regionkey",), []),
    "nation": (("n_nationkey",), [("region", "n_regionkey", "region")]),
    "customer": (("c_custkey",), [("nation", "c_nationkey", "nation")]),
    "supplier": (("s_suppkey",), [("nation", "s_nationkey", "nation")]),
    "part": (("p_partkey",), []),
    "orders": (("o_orderkey",), [("customer", "o_custkey", "customer")]),
    # Lines of one order and number come more than once, so lines have no key of their own.
    "lineitem": ((), [("order", "l_orderkey", "orders"), ("part", "l_partkey", "part"), ("supplier", "l_suppkey", "supplier")]),
    "events": (("event_id",), [("user", "user_id", "customer")]),
    "documents": (("doc_id",), []),
    "labels": (("doc_id",), [("document", "doc_id", "documents")]),
    "embeddings": (("vec_id",), []),
    "pages": (("page_id",), []),
    "benchmark": (("item_id",), []),
    "conversations": (("conv_id", "turn"), []),
}


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """The named tables, or all; references between those that are there."""
    chosen = names or tuple(_TABLES)
    relations = {n: Relation(spark.read.parquet(f"{sf_dir}/{n}.parquet"), _TABLES[n][0], n) for n in chosen}
    references = tuple(Reference(n, ref, (column,), target, _TABLES[target][0]) for n in chosen for ref, column, target in _TABLES[n][1] if target in relations)
    return Database(relations, references)
