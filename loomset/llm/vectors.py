"""Search of a stated query set against all vectors, in cells.

Each method cuts the candidates into cells once, of bounded size whatever the values (copies of one vector are dealt by a hash of
their row), and names for each query the cells that it has to visit.  A cell and the queries that visit it are one group; it
returns its best candidates for each query, and the groups' lists meet in one ranking for each query row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell: a sixteenth of the table within these bounds.
LEAST_CELL = 2048
LARGEST_CELL = 32768
#: Queries that meet a cell in one group; candidates travel once for each such part of the queries.
QUERY_BLOCK = 65536
#: (queries, candidates, k) as data frames -> (query position, candidate position, score, verified) with about the k best of each query.
Method = Callable[[pd.DataFrame, pd.DataFrame, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]]


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and vector (doubles) of rows without null or non-finite components; all-zero ones only if ``zero``.

    Rows with a null vec_id take no part either: no result could name them.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    return rows.where(finite if zero else finite & F.exists("vector", lambda x: x != 0))


def cell_rows(n: int) -> int:
    return min(LARGEST_CELL, max(LEAST_CELL, n // 16))


def best_by_query(scores: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    of = query[order]
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
    return order[rank < k]


def meet(visits: DataFrame, candidates: DataFrame, n_queries: int, n_cells: int, k: int, method: Method, score_type: str) -> DataFrame:
    """row, query_id, found, scores and verified: the best of each visited cell for each query.

    ``visits``: row, vec_id, vector, cell and what the method needs; ``candidates``: vec_id, vector, cell and what it needs.
    """
    chunks = -(-max(1, n_queries) // QUERY_BLOCK)
    left = visits.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    # Named anew: both sides may stem from one table, and a column of the same origin on either side would be taken for one.
    right = candidates.select(*[F.col(c).alias(c) for c in candidates.columns], F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        types = (("row", "int64"), ("query_id", "int64"), ("found", "object"), ("scores", "object"), ("verified", "int64"))
        nothing = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in types})
        if not len(queries) or not len(found):
            return nothing
        # A fixed order, whatever order the rows arrived in.
        queries, found = (x.sort_values("vec_id", kind="stable").reset_index(drop=True) for x in (queries, found))
        ids, out = found["vec_id"].to_numpy(), []
        sizes = queries["vector"].map(len).to_numpy(), found["vector"].map(len).to_numpy()
        # Vectors meet only queries of their own length.
        for size in np.intersect1d(*sizes):
            q_at, c_at = np.flatnonzero(sizes[0] == size), np.flatnonzero(sizes[1] == size)
            q, c, score, verified = method(queries.iloc[q_at], found.iloc[c_at], k)
            order = best_by_query(score, ids[c_at][c], q, k)
            q, c, score = q_at[q[order]], c_at[c[order]], score[order]
            if len(q):
                heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                named = queries.iloc[q[heads]]
                out.append(pd.DataFrame({
                    "row": named["row"].to_numpy(), "query_id": named["vec_id"].to_numpy(), "found": np.split(ids[c], heads[1:]), "scores": np.split(score, heads[1:]),
                    "verified": np.append(verified, np.zeros(len(heads) - 1, np.int64)),
                }))
        return pd.concat(out) if out else nothing

    schema = f"row long, query_id long, found array<long>, scores array<{score_type}>, verified long"
    # Few bytes cost much work here, so adaptive execution must not merge cells into one task by their size.
    parts = max(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * n_cells * chunks, 8192))
    left, right = (x.repartition(parts, "cell", "chunk") for x in (left, right))
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInPandas(run, schema)


def pairs_of(lists: DataFrame) -> DataFrame:
    return lists.select("row", "query_id", F.explode(F.arrays_zip("found", "scores")).alias("x")).select("row", "query_id", F.col("x.found").alias("vec_id"), F.col("x.scores").alias("score"))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """row, query_id, vec_id, score and rank of the k best of each query row."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def thresholds(best: DataFrame, k: int) -> DataFrame:
    """row and the k-th best score so far, of rows that have k."""
    return best.where(F.col("rank") == k).select("row", F.col("score").alias("least"))


def matrix(rows: pd.DataFrame, column: str = "vector") -> np.ndarray:
    return np.stack(list(rows[column]))
