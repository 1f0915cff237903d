"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Parts into which a join deals the rows of one id, so that a hub or a large component is no single task's work.
SALTS = 16


def salted_join(rows: DataFrame, labels: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``rows`` may hold any number of equal values, told apart by column ``by``, and ``labels`` one each."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(labels.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (smallest id reachable) of every id in ``edges`` (columns a, b; any direction, repeats allowed).

    Labels fall to the smallest among the neighbours' labels and then jump to their label's label until nothing changes.
    Aggregates combine partial results before they shuffle, and joins are salted, so an id with very many neighbours is spread
    over tasks like any other.  Rounds grow with the logarithm of the longest path in usual graphs.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    for _ in range(most_rounds):
        theirs = labels.select(F.col("a").alias("b"), F.col("label").alias("other"))
        least = salted_join(both, theirs, "b", by="a").groupBy("a").agg(F.min("other").alias("least"))
        lower = labels.join(least, "a", "left").select("a", F.col("label").alias("before"), F.least("label", F.coalesce("least", "label")).alias("label"))
        # Every label is an id; following its own label halves the path to the smallest.
        up = lower.select(F.col("a").alias("label"), F.col("label").alias("up"))
        jumped = durable(salted_join(lower, up, "label", by="a", how="left").select("a", "before", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = jumped.where(F.col("label") < F.col("before")).limit(1).count()
        labels = jumped.select("a", "label")
        if not changed:
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
