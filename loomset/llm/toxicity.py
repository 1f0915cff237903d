"""Toxicity from subword bags.

A text is cut into bags of ``BAG_WORDS`` consecutive words; a run of one and the same word fills one place of a bag.  Every word stands for its character n-grams (bytes, word
borders included), hashed to rows of an embedding table; a bag is the mean of its n-gram vectors and a linear softmax
turns that mean into clean or toxic.  Table and softmax are trained jointly in numpy, so a misspelled word that was never
seen still shares most n-gram vectors with its correct form.  A text is as toxic as its worst bag.

Very long texts are read in pieces of whole words, each with bags of its own; all of it is scored.

Defined results: a null or empty text, or one without words, scores 0.0 (clean).  Without a labelled row of each class
every text scores 0.0.  Equal texts score equally; rows are never merged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import FOLD, as_bytes, chunks, hashed_ngrams, joined, pieces, word_spans

BAG_WORDS = 5
NGRAMS = (3, 4, 5, 6)
BITS = 17
DIM = 8

#: Labelled rows that the fit uses, the first by a hash of doc_id; all of them, if fewer.
FIT_ROWS = 8000
#: Bytes that one labelled text gives to the fit, about: of longer texts, bags drawn from all over the text.
FIT_TEXT_BYTES = 32768
#: Bags of clean texts for each bag of a toxic text in the fit, about.
CLEAN_PER_TOXIC = 3


@dataclass(frozen=True)
class ToxicityModel:
    """``weight``: what an n-gram's vector adds to the toxic logit; slope and shift: from a text's worst bag to its score."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def _folded(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lower-case words; of a run of the same word only the first stays, so that no bag is one word alone."""
    folded = FOLD[raw]
    first, end = word_spans(folded)
    if len(first) < 2:
        return folded
    text = np.searchsorted(starts, first, side="right")
    size = end - first
    # Only words of equal length, first and last byte are compared, and these byte by byte.
    maybe = np.flatnonzero((size[1:] == size[:-1]) & (text[1:] == text[:-1]) & (folded[first[1:]] == folded[first[:-1]]) & (folded[end[1:] - 1] == folded[end[:-1] - 1])) + 1
    if len(maybe):
        n = size[maybe]
        heads = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(heads, n)
        differs = folded[np.repeat(first[maybe], n) + within] != folded[np.repeat(first[maybe - 1], n) + within]
        again = maybe[np.add.reduceat(differs.astype(np.int64), heads) == 0]
        change = np.zeros(len(folded) + 1, dtype=np.int8)
        change[first[again]] += 1
        change[end[again]] -= 1
        folded[np.cumsum(change[:-1], dtype=np.int8) > 0] = 32
    return folded


def _bag_starts(folded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position before the first word of each bag, and the bag's text."""
    first, _ = word_spans(folded)
    text = np.searchsorted(starts, first, side="right") - 1
    before = np.searchsorted(first, starts)
    opens = (np.arange(len(first)) - before[text]) % BAG_WORDS == 0
    return first[opens] - 1, text[opens]


def bag_logits(texts: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean n-gram weight of each bag, and the bag's text."""
    raw, starts = joined(texts)
    folded = _folded(raw, starts)
    opens, text = _bag_starts(folded, starts)
    if not len(opens):
        return np.zeros(0), text
    total = np.zeros(len(folded) - max(NGRAMS), dtype=np.float32)
    count = np.zeros(len(total), dtype=np.float32)
    for bucket, inside in hashed_ngrams(folded, NGRAMS, BITS):
        total += np.where(inside, weight[bucket], np.float32(0))
        count += inside
    return np.add.reduceat(total, opens) / np.maximum(np.add.reduceat(count, opens), 1), text


def worst_bag(texts: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Largest bag logit of each text; -inf without words."""
    out = np.full(len(texts), -np.inf)
    cut, owner = pieces(texts)
    for lo, hi in chunks(cut):
        logits, piece = bag_logits(cut[lo:hi], weight)
        np.maximum.at(out, owner[piece + lo], logits)
    return out


def sampled_text(text: bytes, limit: int = FIT_TEXT_BYTES) -> bytes:
    """The text, or of a longer one bags drawn from all of it with equal chance, about ``limit`` bytes."""
    if len(text) <= limit:
        return text
    rng, out = np.random.default_rng(zlib.crc32(text)), []
    for piece in pieces([text])[0]:
        raw, _ = joined([piece])
        first, end = word_spans(FOLD[raw])
        opens = np.arange(0, len(first), BAG_WORDS)
        closes = np.minimum(opens + BAG_WORDS, len(first)) - 1
        chosen = np.flatnonzero(rng.random(len(opens)) < limit / len(text))
        out += [raw[first[opens[b]] : end[closes[b]]].tobytes() for b in chosen]
    return b" ".join(out)


def _bags(texts: list[bytes], share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of bags one after the other, each bag's end among them, and each bag's text; a text gives about its share of its bags."""
    buckets, ends, owners, done = [], [], [], 0
    for lo, hi in chunks(texts, 1 << 18):
        raw, starts = joined(texts[lo:hi])
        folded = _folded(raw, starts)
        opens, text = _bag_starts(folded, starts)
        chosen = rng.random(len(opens)) < share[text + lo]
        if not chosen.any():
            continue
        pairs = list(hashed_ngrams(folded, NGRAMS, BITS))
        kept = np.stack([inside for _, inside in pairs], axis=1)
        kept[: opens[0]] = False
        kept[opens[0] :] &= np.repeat(chosen, np.diff(np.append(opens, len(kept))))[:, None]
        buckets.append(np.stack([bucket for bucket, _ in pairs], axis=1)[kept])
        ends.append(np.cumsum(np.add.reduceat(kept.sum(axis=1), opens)[chosen]) + done)
        done = ends[-1][-1]
        owners.append(text[chosen] + lo)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(ends), np.concatenate(owners)


def train(texts: list[bytes], toxic: np.ndarray, rounds: int = 3, epochs: int = 1, batch: int = 256, rate: float = 0.3) -> ToxicityModel | None:
    """Fit on labelled texts.

    The first round takes every bag of a toxic text as toxic.  Later rounds keep of these only what the model so far calls
    toxic, and each text's worst bag, since a long toxic text is mostly clean.  The last step maps a text's worst bag to a
    probability with a one-dimensional logistic fit.
    """
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(17)
    length = np.array([len(t) for t in texts], dtype=np.float64)
    bucket, end, owner = _bags(texts, np.where(toxic, 1.0, CLEAN_PER_TOXIC * length[toxic].sum() / max(1.0, length[~toxic].sum())), rng)
    begin = np.concatenate(([0], end[:-1]))
    label = toxic[owner].astype(np.int64)
    bad, good = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(bad) or not len(good):
        return None
    used = np.concatenate((bad, good))
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    speed_table, speed_soft, speed_bias = np.full(table.shape, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    want, size = label.copy(), end - begin
    seen, place = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS, dtype=np.int64)
    for step in range(rounds):
        if step:
            weight, logit = table @ (soft[:, 1] - soft[:, 0]), np.full(len(bad), -9.0)
            for lo in range(0, len(bad), 4096):
                rows = bad[lo : lo + 4096]
                full = np.flatnonzero(size[rows] > 0)
                n = size[rows[full]]
                heads = np.cumsum(n) - n
                ids = bucket.take(np.repeat(begin[rows[full]] - heads, n) + np.arange(n.sum()))
                if len(full):
                    logit[lo + full] = np.add.reduceat(weight.take(ids), heads) / n
            logit += bias[1] - bias[0]
            want[bad] = logit > 0
            order = np.lexsort((logit, owner[bad]))
            last = np.append(owner[bad][order][1:] != owner[bad][order][:-1], True)
            want[bad[order[last]]] = 1
        for _ in range(epochs):
            order = rng.permutation(used[size[used] > 0])
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                n = size[rows]
                heads = np.cumsum(n) - n
                ids = bucket.take(np.repeat(begin[rows] - heads, n) + np.arange(n.sum()))
                mean = np.add.reduceat(table.take(ids, axis=0), heads, axis=0) / n[:, None]
                score = mean @ soft + bias
                score = np.exp(score - score.max(axis=1, keepdims=True))
                score /= score.sum(axis=1, keepdims=True)
                score[np.arange(len(rows)), want[rows]] -= 1
                score /= len(rows)
                to_table = score @ soft.T / n[:, None]
                to_soft, to_bias = mean.T @ score, score.sum(axis=0)
                # The different n-grams of the batch, in order, and which of them each n-gram is.
                seen[ids] = True
                touched = np.flatnonzero(seen)
                seen[touched] = False
                place[touched] = np.arange(len(touched))
                which = place.take(ids)
                grad = np.stack([np.bincount(which, weights=np.repeat(to_table[:, d], n), minlength=len(touched)) for d in range(DIM)], axis=1).astype(np.float32)
                speed = speed_table.take(touched, axis=0) + grad**2
                speed_table[touched] = speed
                table[touched] -= rate * grad / np.sqrt(speed)
                speed_soft += to_soft**2
                soft -= (rate * to_soft / np.sqrt(speed_soft)).astype(np.float32)
                speed_bias += to_bias**2
                bias -= (rate * to_bias / np.sqrt(speed_bias)).astype(np.float32)
    weight = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    shift = float(bias[1] - bias[0])
    worst = worst_bag(texts, weight) + shift
    seen = np.isfinite(worst)
    slope, offset = _logistic(worst[seen], toxic[seen])
    return ToxicityModel(weight, shift, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit, lightly regularised (Newton steps)."""
    centre, scale = x.mean(), max(x.std(), 1e-6)
    z = (x - centre) / scale
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * z).sum() + 0.05 * a, (p - y).sum() + 0.01 * b])
        hess = np.array([[(w * z * z).sum() + 0.05, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-8:
            break
    return float(a / scale), float(b - a * centre / scale)


def probabilities(model: ToxicityModel | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    worst = worst_bag(texts, model.weight) + model.bias
    return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(model.slope * np.where(np.isfinite(worst), worst, 0) + model.shift, -40, 40))), 0.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel | None:
    """Fit on labelled rows outside the held-out fold.

    The first ``fit_rows`` of them by a hash of doc_id, which is what bounds the broadcast and, with ``FIT_TEXT_BYTES`` for each, what
    reaches the driver.  Labels of one document that disagree are left out.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most"))
        .where(F.col("toxic") == F.col("__most")).select("doc_id", "toxic")
    )
    chosen = known.select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string")).alias("place")).orderBy("place", "doc_id").limit(fit_rows).drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sampled_text(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(texts, pa.binary())], ["doc_id", "toxic", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    found = sorted({(r.doc_id, r.toxic, bytes(r.text)) for r in rows.mapInArrow(run, "doc_id long, toxic int, text binary").collect()})
    return train([r[2] for r in found], np.array([r[1] == 1 for r in found], dtype=bool))


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = probabilities(shared.value, as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return score(docs, fit(docs, labels)).select("doc_id", held, "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not toxic, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    columns = docs.columns
    where = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(model.value, as_bytes(batch.column(where))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
