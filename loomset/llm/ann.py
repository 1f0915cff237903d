"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes smallest Euclidean distance by one more dimension that brings all candidates to the same norm;
queries are scaled to that norm too.  Candidates are projected to ``PROJECTED`` dimensions with Gaussian (2-stable) weights, which turn a
true distance d into a projected squared distance of d^2 times a chi-square variable.  One kd-tree for the whole table indexes the
projections: its cuts come from a bounded sample, every candidate descends to its leaf, and leaves that are too large for one
task are dealt by a hash.

A query visits leaves by growing distance of their boxes, first the nearest, then eight times as many in each round.  Within a
leaf it verifies candidates on the original vectors by growing projected distance.  Before each leaf and after each step it is tested
whether a candidate as near as its present k-th would, with probability ``CERTAINTY``, have shown up at the projected distance
reached; then the query stops.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows with a null vec_id.
Scores are inner products of the original vectors in double precision, ties go to the smaller vec_id.  Repeated vec_ids are
separate rows: each query row has its own list, and a query meets none of its own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .vectors import cell_rows, matrix, meet, pairs_of, ranked, thresholds, usable

PROJECTED = 16
CERTAINTY = 0.9
#: Rows whose projections shape the tree; their number bounds what reaches the driver.
SAMPLE = 16384
MOST_LEAVES = 1024
#: Candidates that a query verifies before the first test in a leaf; the step doubles after each.
FIRST_STEP = 256
#: Projected distances that one step holds.
CELLS = 1 << 21


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """Scaled vectors have a largest squared norm of ``full``."""

    scale: float
    full: float
    weights: np.ndarray

    def _padded(self, vectors: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.weights) - 1))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def candidates(self, vectors: list[np.ndarray]) -> np.ndarray:
        x = self._padded(vectors) * self.scale
        rest = np.sqrt(np.maximum(self.full - (x**2).sum(axis=1), 0))
        return x @ self.weights[:-1] + rest[:, None] * self.weights[-1]

    def queries(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Projections, and what turns an inner product of the original vectors into one of the scaled ones."""
        q = self._padded(vectors)
        largest = np.abs(q).max(axis=1, keepdims=True)
        size = np.sqrt(((q / largest) ** 2).sum(axis=1, keepdims=True))
        unit = q / largest / size
        return unit @ self.weights[:-1] * math.sqrt(self.full), (self.scale / largest / size * math.sqrt(self.full)).ravel()


def projection_for(vectors: DataFrame) -> tuple[Projection, int]:
    """Weights for vectors of any length in the table, and the number of rows; a row for each batch is summed up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, log = 0, -math.inf
            for v in batch.column("vector").to_numpy(zero_copy_only=False):
                # The largest component apart, so that squares of the largest and smallest doubles stay in range.
                largest = np.abs(v).max()
                size, log = max(size, len(v)), max(log, math.log2(largest) + 0.5 * math.log2(((v / largest) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([size], pa.int64()), pa.array([log])], ["n", "size", "log"])

    n, size, log = vectors.select("vector").mapInArrow(run, "n long, size long, log double").agg(F.sum("n"), F.max("size"), F.max("log")).first()
    n, log = n or 0, log if n else 0.0
    exponent = math.floor(log)
    weights = np.random.default_rng(11).normal(size=((size or 0) + 1, PROJECTED))
    return Projection(2.0**-exponent if exponent > -1020 else 2.0**1020, 4.0 ** (log - exponent) * (1 + 1e-9), weights), n


class Tree:
    """A kd-tree of ``leaves`` (a power of two) by medians of the widest dimension; nodes in the order of a heap."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, leaves.bit_length() - 1)
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.full(1 << self.depth, -np.inf)
        groups = {1: np.arange(len(points))}
        for node in range(1, 1 << self.depth):
            rows = groups.pop(node)
            own = points[rows]
            if len(rows):
                axis = int(np.ptp(own, axis=0).argmax())
                self.axis[node], self.cut[node] = axis, np.median(own[:, axis])
            right = own[:, self.axis[node]] >= self.cut[node]
            groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    return sum(np.maximum(0, np.maximum(low[:, d] - points[:, d, None], points[:, d, None] - high[:, d])) ** 2 for d in range(points.shape[1]))


def verified_search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's k nearest found in a leaf, as far as they reach its k-th best score so far, all that tie with the last, and the number of candidates verified."""
    x, points, ids = matrix(candidates), matrix(candidates, "point"), candidates["vec_id"].to_numpy()
    q, at, own = matrix(queries), matrix(queries, "point"), queries["vec_id"].to_numpy()
    # What is below the k-th best score of earlier rounds is no use.
    known = queries["least"].fillna(-np.inf).to_numpy()
    factor, full, limits = queries["factor"].to_numpy(), queries["full"].to_numpy(), queries["limit"].fillna(np.inf).to_numpy()
    reach = chi_square_quantile(CERTAINTY, PROJECTED)
    square = (points**2).sum(axis=1)
    out_q, out_c, out_s, verified = [], [], [], 0
    batch = max(1, CELLS // len(x))
    for lo in range(0, len(q), batch):
        gaps = (at[lo : lo + batch] ** 2).sum(axis=1)[:, None] + square - 2 * (at[lo : lo + batch] @ points.T)
        for i, gap in enumerate(gaps, start=lo):
            limit = limits[i]
            order = np.flatnonzero((gap <= limit * reach) & (ids != own[i]))
            order = order[np.argsort(gap[order])]
            score, done, step = np.zeros(len(order)), 0, FIRST_STEP
            while done < len(order) and gap[order[done]] <= limit * reach:
                score[done : done + step] = x[order[done : done + step]] @ q[i]
                done, step = min(len(order), done + step), 2 * step
                if done >= k:
                    last = -np.partition(-score[:done], k - 1)[k - 1]
                    limit = min(limit, max(0.0, 2 * full[i] - 2 * last * factor[i]) + 1e-9 * full[i])
            verified += done
            if done:
                score = score[:done]
                last = max(known[i], -np.partition(-score, k - 1)[k - 1] if done > k else -np.inf)
                # Products of one pair may differ in the last bits with their place in a matrix; near ties are settled below.
                near = np.flatnonzero(~(score < last - 1e-9 * np.abs(score).max()))
                j = order[near]
                out_q.append(np.full(len(j), i))
                out_c.append(j)
                out_s.append((q[i] * x[j]).sum(axis=1))
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s), verified


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> tuple[DataFrame, list[DataFrame]]:
    """row, query_id, rank, vec_id and score of the k nearest found for each query row, and what each round's leaves returned."""
    projection, n = projection_for(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(projection)
    size = cell_rows(n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = shared.value.candidates(batch.column("vector").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(points), pa.list_(pa.float64()))], [*batch.schema.names, "point"])

    def project_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, factor = shared.value.queries(batch.column("vector").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(points), pa.list_(pa.float64())), pa.array(factor)], [*batch.schema.names, "point", "factor"])

    numbered = F.monotonically_increasing_id().alias("row")
    rows = vectors.select("vec_id", "vector").mapInArrow(project, "vec_id long, vector array<double>, point array<double>")
    asked = durable(queries.select("vec_id", "vector", numbered).mapInArrow(project_queries, "vec_id long, vector array<double>, row long, point array<double>, factor double"))
    m = asked.count()
    leaves = 1 << max(0, min(MOST_LEAVES, n // size).bit_length() - 1)
    sample = [r.point for r in rows.select("point", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(SAMPLE).collect()] if leaves > 1 else []
    tree = Tree(np.array(sample).reshape(-1, PROJECTED), leaves)
    placed = _in_leaves(rows, tree)
    if leaves > 1:
        extremes = [f(F.col("point")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(PROJECTED)]
        boxes = sorted(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *extremes).collect())
    else:
        boxes = [Row(leaf=0, n=n, **{f"min{d}": -math.inf for d in range(PROJECTED)}, **{f"max{d}": math.inf for d in range(PROJECTED)})]
    table = np.array([b[2:] for b in boxes], dtype=np.float64)
    low, high = table[:, :PROJECTED], table[:, PROJECTED:]
    parts = np.array([max(1, -(-b.n // size)) for b in boxes])
    starts = np.concatenate(([0], np.cumsum(parts)[:-1]))
    start_of = F.create_map(*[F.lit(int(v)) for b, s in zip(boxes, starts, strict=True) for v in (b.leaf, s)])
    parts_of = F.create_map(*[F.lit(int(v)) for b, p in zip(boxes, parts, strict=True) for v in (b.leaf, p)])
    candidates = placed.select("vec_id", "vector", "point", (start_of[F.col("leaf")] + F.pmod(F.xxhash64("vec_id", "vector"), parts_of[F.col("leaf")])).cast("int").alias("cell"))

    reach = chi_square_quantile(CERTAINTY, PROJECTED)
    best, lists, done, until = None, [], 0, 1
    while done < len(boxes):

        def visit(batches: Iterator[pa.RecordBatch], done: int = done, until: int = until) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gaps = box_gaps(np.stack(batch.column("point").to_numpy(zero_copy_only=False)), low, high) if batch.num_rows else np.zeros((0, len(low)))
                limit = batch.column("limit").fill_null(math.inf).to_numpy(zero_copy_only=False)
                order = np.argsort(gaps, axis=1, kind="stable")[:, done:until]
                wanted = np.take_along_axis(gaps, order, axis=1) <= limit[:, None] * reach
                cells = [np.concatenate([np.arange(starts[b], starts[b] + parts[b]) for b in o[w]]) if w.any() else [] for o, w in zip(order, wanted, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        if best is None:
            known = asked.withColumns({"limit": F.lit(None).cast("double"), "least": F.lit(None).cast("double")})
        else:
            distance = 2 * projection.full - 2 * F.col("least") * F.col("factor")
            known = asked.join(thresholds(best, k), "row", "left").withColumn("limit", F.greatest(distance, F.lit(0.0)) + 1e-9 * projection.full)
        known = known.select("vec_id", "vector", "row", "point", "factor", "limit", "least")
        visits = known.mapInArrow(visit, "vec_id long, vector array<double>, row long, point array<double>, factor double, limit double, least double, cells array<int>")
        visits = visits.withColumns({"cell": F.explode("cells"), "full": F.lit(projection.full)}).drop("cells")
        lists.append(meet(visits, candidates, m, int(parts.sum()), k, verified_search, "double"))
        found = pairs_of(lists[-1])
        best = ranked(found if best is None else best.drop("rank").unionByName(found), k)
        done, until = until, 8 * until
        if done < len(boxes):
            best = durable(best)
    return best, lists


def _in_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack(batch.column("point").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, PROJECTED))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf(points).astype(np.int32))], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>, point array<double>, leaf int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of ``vectors`` for each row of ``queries``."""
    return search(vectors, queries, k)[0].select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), zero=False)
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
