import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import ann, topk, vectors


def rows_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in values], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)


def random_rows(n, dims=24, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return [(i, (centres[i % 6] + r.normal(size=dims) * 0.7).astype(np.float32).tolist()) for i in range(n)]


def brute(values, k, score):
    out = {}
    for q, a in values:
        if q % 20 == 0 and a is not None:
            found = sorted(((-score(a, b), i) for i, b in values if i != q and len(a) == len(b)), key=lambda x: x)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


ODD = [(1000, None), (1020, []), (1040, [float("nan")] * 24), (1060, [float("inf")] + [0.0] * 23), (1080, [None] + [0.5] * 23), (1100, [0.0] * 24)]
COPIES = [(2000 + i, [0.25] * 24) for i in range(60)]


@pytest.mark.parametrize("cell", [64, 2048])
def test_topk_is_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "LEAST_CELL", cell)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    values = random_rows(400) + COPIES + [(1100, [0.0] * 24)]
    rows = vectors.usable(rows_of(spark, values + ODD[:-1]), zero=True)
    integer = lambda v: [math.floor(64 * x) for x in v]
    want = brute([(i, integer(v)) for i, v in values], 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert result(topk.top_k(rows, rows.where("vec_id % 20 = 0"))) == want


def test_topk_of_few_and_of_huge(spark):
    few = [(0, [1.0, -2.0]), (20, [0.5, 0.5]), (3, [0.3, 0.3]), (40, [1.0, 2.0, 3.0])]
    rows = vectors.usable(rows_of(spark, few), zero=True)
    assert result(topk.top_k(rows, rows.where("vec_id % 20 = 0"))) == {0: [(3, 64 * 19 - 128 * 19), (20, 64 * 32 - 128 * 32)], 20: [(3, 32 * 19 * 2), (0, 32 * 64 - 32 * 128)]}
    huge = vectors.usable(rows_of(spark, [(0, [3e38, 1.0]), (20, [3e38, 1.0]), (1, [1.0, 1.0])]), zero=True)
    assert result(topk.top_k(huge, huge.where("vec_id % 20 = 0")))[0] == [(1, 2**63 - 1), (20, 2**63 - 1)]
    none = rows.where("false")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(rows, none).count() == 0


@pytest.mark.parametrize("cell", [64, 2048])
def test_ann_finds_nearly_all(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "LEAST_CELL", cell)
    values = random_rows(1500) + COPIES
    rows = vectors.usable(rows_of(spark, values + ODD), zero=False)
    assert rows.count() == len(values)
    found = result(ann.nearest(rows, rows.where("vec_id % 20 = 0")))
    want = brute([(i, np.array(v, dtype=np.float64)) for i, v in values], 20, lambda a, b: float(np.dot(a, b)))
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    hits = [sum(s >= want[q][-1][1] - 1e-9 for _, s in got) / 20 for q, got in found.items()]
    assert np.mean(hits) >= 0.95
    exact = {i: np.array(v, dtype=np.float64) for i, v in values}
    for q, got in found.items():
        assert all(abs(s - float(np.dot(exact[q], exact[i]))) < 1e-9 for i, s in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_ann_of_few(spark):
    rows = vectors.usable(rows_of(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [-1e30, 5.0])]), zero=False)
    assert [i for i, _ in result(ann.nearest(rows, rows.where("vec_id = 0")))[0]] == [1, 2, 7]
    none = rows.where("false")
    assert ann.nearest(none, none).count() == 0


@pytest.mark.parametrize("find", [ann.nearest, topk.top_k])
def test_query_rows_of_one_id_have_lists_of_their_own(spark, find):
    rows = vectors.usable(rows_of(spark, [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.5, 0.4]), (None, [5.0, 5.0])]), zero=True)
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in find(rows, rows.where("vec_id = 20"), 2).collect())
    assert found == sorted([(20, 1, 1), (20, 2, 3), (20, 1, 2), (20, 2, 3)])


def test_cells_are_skipped_by_norm(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_CELL", 32)
    r = np.random.default_rng(5)
    long, short = r.normal(size=(40, 8)), r.normal(size=(400, 8)) * 0.01
    rows = vectors.usable(rows_of(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate((long, short)))]), zero=True)
    _, bands = topk.norm_cells(rows)
    assert len(bands) > 4 and bands[0][2] > 20 * bands[-1][2] and [b[0] for b in bands] == [0, *np.cumsum([b[1] for b in bands])[:-1]]


def test_leaves_are_walked_until_the_test_holds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_CELL", 64)
    r = np.random.default_rng(9)
    centres = r.normal(size=(30, 24)) * 3
    values = [(i, (centres[i % 30] + r.normal(size=24) * 0.1).astype(np.float32).tolist()) for i in range(3000)]
    rows = vectors.usable(rows_of(spark, values), zero=False)
    best, lists = ann.search(rows, rows.where("vec_id % 20 = 0"), 10)
    assert best.count() == 1500 and len(lists) > 1
    # Of clustered vectors a query verifies a small part, as later leaves fail the test.
    assert sum(found.agg(F.sum("verified")).first()[0] or 0 for found in lists) < 0.3 * 150 * 3000


def test_tree_and_chi_square():
    assert abs(ann.chi_square_cdf(13.3616, 8) - 0.9) < 1e-4 and abs(ann.chi_square_quantile(0.9, 8) - 13.3616) < 1e-3
    points = np.random.default_rng(1).normal(size=(512, 4))
    tree = ann.Tree(points, 16)
    leaf = tree.leaf(points)
    assert np.bincount(leaf, minlength=16).tolist() == [32] * 16
    boxes = [np.stack([f(points[leaf == b], axis=0) for b in range(16)]) for f in (np.min, np.max)]
    gaps = ann.box_gaps(points, *boxes)
    assert (gaps[np.arange(512), leaf] == 0).all() and all(gaps[i, leaf[j]] <= ((points[i] - points[j]) ** 2).sum() + 1e-12 for i in range(0, 512, 37) for j in range(512))
    assert set(ann.Tree(np.zeros((0, 4)), 1).leaf(np.zeros((3, 4)))) == {0} and set(ann.Tree(np.zeros((40, 4)), 4).leaf(np.zeros((5, 4)))) == {3}
