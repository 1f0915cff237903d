"""Language identification by multilingual mixture inference.

A text is cut into segments of ``SEGMENT_WORDS`` words.  Byte n-gram counts learned per language give each segment a
log-likelihood under every language.  Expectation-maximisation then estimates the shares of the languages in the text;
the set of languages is the one with the best penalised likelihood (log-likelihood minus half a log of the number of
segments for each free share) among the nested sets of the largest shares.  The prediction is the largest share.

Defined results: a null text, or one without a letter, is ``und`` with score 0.0.  A model without any language gives
``und`` for every text.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import FOLD, as_bytes, chunks, hashed_ngrams, joined, pieces, word_spans

SEGMENT_WORDS = 8
NGRAMS = (2, 3, 4)
BITS = 14
EM_STEPS = 8

#: Labelled rows of each language that the fit uses, the first by a hash of doc_id; all of them, if fewer.  A rare language keeps all of its rows.
FIT_ROWS = 5000
#: Parts of each language from which these are chosen.
PARTS = 16
#: A segment's log-likelihood is scaled by this, since overlapping n-grams repeat each other's evidence.
TEMPER = 0.3
#: Name of the part of a text that no learned language explains; sorts after all others.
UNKNOWN = "\U0010ffff"
#: Added to every n-gram count.
SMOOTHING = 0.5


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in sorted order; ``logp``: bucket by language for each n-gram size."""

    languages: list[str]
    logp: np.ndarray


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the hashed n-grams, a row of buckets for each size."""
    out = np.zeros((len(NGRAMS), 1 << BITS), dtype=np.int64)
    cut, _ = pieces(texts)
    for lo, hi in chunks(cut):
        raw, _ = joined(cut[lo:hi])
        for k, (bucket, inside) in enumerate(hashed_ngrams(_letters(raw), NGRAMS, BITS)):
            out[k] += np.bincount(bucket[inside], minlength=1 << BITS)
    return out


def _letters(raw: np.ndarray) -> np.ndarray:
    """Folded bytes without digits."""
    folded = FOLD[raw]
    return np.where((folded >= 48) & (folded <= 57), np.uint8(32), folded)


def segments(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of each segment under each language, and the segment's text."""
    raw, starts = joined(texts)
    folded = _letters(raw)
    first, _ = word_spans(folded)
    text = np.searchsorted(starts, first, side="right") - 1
    before = np.searchsorted(first, starts)
    opens = (np.arange(len(first)) - before[text]) % SEGMENT_WORDS == 0
    at, text = first[opens] - 1, text[opens]
    if not len(at):
        return np.zeros((0, len(model.languages))), text
    total = np.zeros((len(folded) - max(NGRAMS), len(model.languages)), dtype=np.float32)
    for k, (bucket, inside) in enumerate(hashed_ngrams(folded, NGRAMS, BITS)):
        bucket[~inside] = 1 << BITS
        total += model.logp[k][bucket]
    return np.add.reduceat(total, at, axis=0).astype(np.float64) * TEMPER, text


def text_segments(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts of any length, a piece of about 1 MB at a time."""
    cut, owner = pieces(texts)
    found = [(ll, owner[piece + lo]) for lo, hi in chunks(cut) for ll, piece in [segments(cut[lo:hi], model)]]
    return np.concatenate([np.zeros((0, len(model.languages))), *(ll for ll, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(text for _, text in found)])


def _em(like: np.ndarray, text: np.ndarray, heads: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of every text, with the languages that ``allowed`` marks for it; like: relative to each segment's best."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    count = np.diff(np.append(heads, len(text)))[:, None]
    for _ in range(EM_STEPS):
        part = like * share[text]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, heads, axis=0) / count
    return share, np.add.reduceat(np.log((like * share[text]).sum(axis=1)), heads)


def mixtures(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (rows sum to 1, or are 0 without a word) and number of languages selected for each text."""
    n_lang = len(model.languages)
    shares, chosen = np.zeros((len(texts), n_lang)), np.zeros(len(texts), dtype=np.int64)
    if not n_lang:
        return shares, chosen
    for lo, hi in chunks(texts):
        ll, text = text_segments(texts[lo:hi], model)
        if not len(text):
            continue
        present, heads, owner = np.unique(text, return_index=True, return_inverse=True)
        ll = ll - ll.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(ll, -60.0)) + 1e-300
        full, _ = _em(like, owner, heads, np.ones((len(present), n_lang)))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        size = np.diff(np.append(heads, len(text)))
        best, best_value, number = np.zeros((len(present), n_lang)), np.full(len(present), -np.inf), np.zeros(len(present), dtype=np.int64)
        # Every size is tried for every text, so a result does not depend on the texts beside it.
        for k in range(1, n_lang + 1):
            share, value = _em(like, owner, heads, (rank < k).astype(float))
            value = value - 0.5 * (k - 1) * np.log(size + 1)
            better = value > best_value + 1e-9
            best[better], best_value[better], number[better] = share[better], value[better], k
        shares[lo + present], chosen[lo + present] = best, number
    return shares, chosen


def train(counts: dict[str, np.ndarray]) -> LanguageModel:
    """Model from the n-gram counts of each language."""
    names = sorted(counts)
    logp = np.zeros((len(NGRAMS), (1 << BITS) + 1, len(names)), dtype=np.float32)
    for j, name in enumerate(names):
        smooth = counts[name] + SMOOTHING
        logp[:, :-1, j] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return LanguageModel(names, logp)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from ``fit_rows`` rows of each language outside the held-out fold, the first by a hash of doc_id.

    Tasks count, Spark sums; languages times buckets rows reach the driver, whatever the number of documents.  ``fit_rows`` ids
    for each language are broadcast.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", "lang")
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    # A language may have most rows: the first rows of each part of it come first, so at most ``PARTS`` times ``fit_rows`` meet in a task.
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    for within in (["lang", "part"], ["lang"]):
        known = known.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("place") <= fit_rows)
    chosen = known.select("doc_id", "lang")
    chosen = docs.where("text IS NOT NULL").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = np.array(as_bytes(batch.column("text")), dtype=object), np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(langs):
                seen[name] = seen.get(name, 0) + ngram_counts(list(texts[langs == name]))
        for name, found in seen.items():
            kind, bucket = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(kind), pa.string()), pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(found[kind, bucket])], ["lang", "kind", "bucket", "n"]
            )

    rows = chosen.select("text", "lang").mapInArrow(run, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    kind, bucket, n = (rows.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    for name in set(langs):
        of = langs == name
        counts[name] = np.zeros((len(NGRAMS), 1 << BITS), dtype=np.int64)
        counts[name][kind[of], bucket[of]] = n[of]
    return train(counts)


def predict(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share and the number of languages selected; the caller decides which texts have no letter."""
    shares, number = mixtures(texts, model)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), number
    top = shares.argmax(axis=1)
    return [model.languages[i] if n else "und" for i, n in zip(top, number, strict=True)], shares.max(axis=1), number


def _has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and n_languages for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, share, number = predict(shared.value, as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(name, pa.string()), pa.array(share), pa.array(number.astype(np.int32))], ["doc_id", "lang_pred", "score", "n_languages"]
            )

    lettered = F.when(_has_letter(), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_languages int")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "n_languages")


def with_unknown(model: LanguageModel) -> LanguageModel:
    """One more language, the last, to which all n-grams are equally likely; it takes the segments that no learned language explains."""
    even = np.full((len(NGRAMS), (1 << BITS) + 1, 1), -BITS * np.log(2), dtype=np.float32)
    even[:, -1] = 0
    return LanguageModel([*model.languages, UNKNOWN], np.concatenate((model.logp, even), axis=2))


def keep_identified(docs: DataFrame, least_share: float = 0.5, accepted: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of which an accepted language (any learned one, if None) has the largest share and ``least_share`` at least, all columns unchanged.

    Texts without a letter go, and those of which no learned language explains enough (``with_unknown``).
    """
    model = docs.sparkSession.sparkContext.broadcast(with_unknown(fit(docs)))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, share, _ = predict(model.value, as_bytes(batch.column(where)))
            known = np.array([n not in ("und", UNKNOWN) and (accepted is None or n in accepted) for n in name], dtype=bool)
            yield batch.filter(pa.array(known & (share >= least_share)))

    return docs.where(_has_letter()).mapInArrow(run, docs.schema)
