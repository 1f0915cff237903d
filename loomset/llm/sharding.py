"""Reproducible shuffling into shards by a Feistel permutation of row numbers.

Rows get global numbers 0 to n-1 in the order of (doc_id, text checksum, size).  A keyed Feistel network permutes the
smallest even-bit domain that holds n; numbers that leave [0, n) go round again (cycle walking), which keeps it a
bijection of [0, n).  Row number p after the permutation lies in shard ``p % shards`` at slot ``p // shards``: shard sizes
differ by at most one (law ``rows``), slots have no gaps, and both can be computed, and inverted, for any row number alone.

Defined results: a null text has size 16 and the checksum of the empty text.  Null doc_ids come first.  Rows equal in
doc_id and text are interchangeable.  Equal texts are independent of each other and spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable

ROUNDS = 6
#: Rows that one task sorts, about.
TASK_ROWS = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool = False) -> np.ndarray:
    half, mask = np.uint64(bits // 2), np.uint64((1 << bits // 2) - 1)
    left, right = x >> half, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_round(left, key) & mask), left
        else:
            left, right = right, left ^ (_round(right, key) & mask)
    return (left << half) | right


def permute(numbers: np.ndarray, n: int, seed: int = 7, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n-1 at ``numbers``, or its inverse."""
    bits = max(2, int(n - 1).bit_length() if n > 1 else 1)
    bits += bits % 2
    keys = _keys(seed)
    out = _network(numbers.astype(np.uint64), bits, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], bits, keys, back)
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with global numbers from 0 in the given order, and their count.

    A range partition and a sort, kept in the shared folder so that counts and numbers come from the same rows; one count
    for each partition goes through the driver.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    kept = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int").alias("__part")
    counts = dict(kept.groupBy(part).count().collect())
    offsets, total = [], 0
    for k in sorted(counts):
        offsets.append((k, total))
        total += counts[k]
    kept = kept.select("*", part).join(F.broadcast(spark.createDataFrame(offsets, "__part int, __offset long")), "__part")
    return kept.withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__offset"), total


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; only these narrow columns are shuffled."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    )
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(zero_copy_only=False), n, seed)
            columns = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(shards: int = 40, seed: int = 7) -> str:
    """The same numbering and permutation for DuckDB: checksums byte by byte, cycle walking as a recursion."""
    modulus = "18446744073709551616::UHUGEINT"
    network = "SELECT k, n, half, x >> half AS l, x & ((1::UBIGINT << half) - 1) AS r, step FROM walk, domain WHERE step = 0 OR x >= n"
    for key in _keys(seed):
        a = f"SELECT *, ((r::UHUGEINT + {key}) * {int(_MIX)}::UHUGEINT % {modulus})::UBIGINT AS a FROM ({network})"
        b = f"SELECT *, (xor(a, a >> 29)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % {modulus})::UBIGINT AS b FROM ({a})"
        network = f"SELECT k, n, half, r AS l, xor(l, xor(b, b >> 32) & ((1::UBIGINT << half) - 1)) AS r, step FROM ({b})"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS c FROM (SELECT range AS b FROM range(256)))
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), summed AS (
  SELECT doc_id, len(b) + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM bytes, crc_table
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS k FROM summed
), domain AS (
  SELECT count(*)::UBIGINT AS n, greatest(2, CASE WHEN count(*) > 1 THEN length(ltrim(bin(count(*) - 1), '0')) ELSE 1 END) AS width, ((width + width % 2) // 2)::UBIGINT AS half FROM documents
), walk(k, x, step) AS (
  SELECT k, k::UBIGINT, 0 FROM numbered
  UNION ALL SELECT k, (l << half) | r, step + 1 FROM ({network})
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (k), domain WHERE step > 0 AND x < n
"""
