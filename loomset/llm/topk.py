"""Exact top-k by inner product: columnar branch and bound.

Candidates are cut into cells by their norms, longest first.  A query first meets one cell of the longest candidates; its k-th best
score there is certain, and only cells whose longest vector could still reach it by norm are visited after that.  Within a cell the
candidates lie in vertical layout, one array for each dimension, dimensions with the most mass first.  Scores accumulate a
block of dimensions at a time.  What the dimensions still to come can add is at most the product of the remaining norms
of query and candidate; a candidate whose bound is below the k-th best score already certain is gone, and once few are left the
survivors are compacted and only they go on.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor rows with a null vec_id; zero
vectors do.  Each component becomes floor(64 x).  Ties go to the smaller vec_id.  Repeated vec_ids are separate rows: each query row has its
own list, and a query meets none of its own id.  Sums beyond 64 bits are held at the nearest 64-bit value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .vectors import cell_rows, matrix, meet, pairs_of, ranked, thresholds, usable

STEP = 8
#: Scores that one step holds.
CELLS = 1 << 20
#: Bounds are tested once the typical remaining mass is below this share of the whole.
BOUND_AT = 0.3
#: Dense accumulation goes on until less than this share of the candidates survives.
COMPACT_AT = 0.1
#: Bands of norms, at most.
BANDS = 64


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(64 x) as doubles where sums of products stay exact, else as Python integers."""
    scaled = np.floor(vectors * 64)
    if np.abs(scaled).max(initial=0) ** 2 * max(1, scaled.shape[1]) < 2**52:
        return scaled
    return np.array([[math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in row] for row in vectors.tolist()], dtype=object)


def bounded_search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's k best candidates of the cell and all that tie with the last; may hold more, and less where ``least`` of the query is known."""
    q_all, x = quantised(matrix(queries)), quantised(matrix(candidates))
    query_ids, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    if q_all.dtype == object or x.dtype == object:
        score = np.clip(q_all.astype(object) @ x.astype(object).T, -(2**63), 2**63 - 1)
        at = np.argwhere(query_ids[:, None] != ids[None, :])
        return at[:, 0], at[:, 1], np.array([int(score[i, j]) for i, j in at], dtype=np.int64), len(at)
    known = queries["least"].astype(float).fillna(-np.inf).to_numpy()
    order = np.argsort(-(x**2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(x[:, order].T)
    dims, n = columns.shape
    cuts = [*range(0, dims, STEP), dims]
    mass = np.zeros((len(cuts), n))
    for b in range(len(cuts) - 2, -1, -1):
        mass[b] = mass[b + 1] + (columns[cuts[b] : cuts[b + 1]] ** 2).sum(axis=0)
    mass = np.sqrt(mass)
    out, finished = [], 0
    batch = max(16, CELLS // n)
    for lo in range(0, len(q_all), batch):
        q = q_all[lo : lo + batch][:, order]
        own = query_ids[lo : lo + batch, None] == ids[None, :]
        left = np.sqrt(np.concatenate([(q[:, c:] ** 2).sum(axis=1)[:, None] for c in cuts], axis=1))
        score = np.zeros((len(q), n))
        score[own] = -np.inf
        sure = known[lo : lo + batch].copy()
        pairs = None
        for b in range(len(cuts) - 1):
            part = slice(cuts[b], cuts[b + 1])
            if pairs is None:
                score += q[:, part] @ columns[part]
                if np.median(left[:, b + 1]) * np.median(mass[b + 1]) > BOUND_AT * np.median(left[:, 0]) * np.median(mass[0]):
                    continue
                if n > k and not np.isfinite(sure).all():
                    # The k best so far, completed, give a score that the k-th best cannot be below.
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    rest = np.einsum("qd,dqk->qk", q[:, cuts[b + 1] :], columns[cuts[b + 1] :][:, top])
                    sure = np.maximum(sure, (np.take_along_axis(score, top, axis=1) + rest).min(axis=1))
                # Scores are whole numbers, so half a unit covers the rounding of the bounds.
                alive = score + left[:, b + 1, None] * mass[b + 1] >= sure[:, None] - 0.5
                if np.count_nonzero(alive) < COMPACT_AT * alive.size:
                    i, j = np.nonzero(alive & ~own)
                    s = score[i, j]
                    pairs = i, j, s
            else:
                i, j, s = pairs
                s = s + (q[i, part] * columns[part][:, j].T).sum(axis=1)
                alive = s + left[i, b + 1] * mass[b + 1][j] >= sure[i] - 0.5
                pairs = i[alive], j[alive], s[alive]
        if pairs is None:
            i, j = np.nonzero((score >= sure[:, None]) & ~own)
            pairs = i, j, score[i, j]
        finished += len(pairs[0])
        out.append((pairs[0] + lo, pairs[1], pairs[2].astype(np.int64)))
    return *(np.concatenate([o[c] for o in out]) for c in range(3)), finished


def with_norm(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and norm of the quantised vector, rounded upwards; infinite where doubles do not reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                norm = [math.sqrt((np.floor(v * 64) ** 2).sum()) * (1 + 1e-9) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm, pa.float64())], [*batch.schema.names, "norm"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, norm double")


def norm_cells(vectors: DataFrame) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """``vectors`` with their cell, and (first cell, cells, largest norm) of each band of norms, longest first."""
    rows = with_norm(vectors)
    n, most, quantiles = rows.agg(F.count(F.lit(1)), F.max("norm"), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000)).first()
    size = cell_rows(n)
    bands = min(BANDS, n // size)
    if bands < 2:
        return rows.select("vec_id", "vector", F.lit(0).alias("cell")), [(0, 1, most)]
    cuts = sorted({quantiles[i * BANDS // bands - 1] for i in range(1, bands)})
    # Band 0 holds the longest; equal norms share a band.
    band = sum((F.when(F.col("norm") <= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    rows = rows.withColumn("band", band)
    table, first = [], 0
    for r in sorted(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()):
        cells = -(-r.n // size)
        table.append((r.band, first, cells, r.norm))
        first += cells
    start, cells = (F.create_map(*[F.lit(v) for t in table for v in (t[0], t[k])])[F.col("band")] for k in (1, 2))
    return rows.select("vec_id", "vector", (start + F.pmod(F.xxhash64("vec_id", "vector"), cells)).cast("int").alias("cell")), [t[1:] for t in table]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and integer score of the k best of ``vectors`` for each row of ``queries``."""
    candidates, bands = norm_cells(vectors)
    rows = durable(with_norm(queries).withColumn("row", F.monotonically_increasing_id()))
    m = rows.count()
    total = sum(cells for _, cells, _ in bands)
    home_cells = bands[0][1]
    home = F.pmod(F.xxhash64("row"), F.lit(home_cells)).cast("int")
    visits = rows.withColumns({"cell": home, "least": F.lit(None).cast("long")})
    found = pairs_of(meet(visits, candidates, m, home_cells, k, bounded_search, "long"))
    if total > 1:
        found = durable(ranked(found, k)).drop("rank")
        least = thresholds(ranked(found, k), k)
        # A band is visited unless its longest vector cannot reach the query's k-th best score so far.
        table = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(lo + cells - 1).alias("hi"), F.lit(norm).alias("norm")) for lo, cells, norm in bands])
        open_ = F.filter(table, lambda b: F.col("least").isNull() | ~(F.col("norm") * b["norm"] < F.col("least") - 0.5))
        cells = F.array_except(F.flatten(F.transform(open_, lambda b: F.sequence(b["lo"], b["hi"]))), F.array(home))
        more = rows.join(least, "row", "left").withColumn("cell", F.explode(cells))
        found = found.unionByName(pairs_of(meet(more, candidates, m, total, k, bounded_search, "long")))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), zero=True)
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
