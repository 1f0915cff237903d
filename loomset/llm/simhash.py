"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set where over half of a text's shingle hashes set it.  Texts whose fingerprints differ in at most
``RADIUS`` bits are linked, and linked texts form components.

Equal fingerprints meet first, so only different ones are compared.  Fingerprints that differ in at most 4 of 64 bits agree on
at least one of 5 segments, two of 6, and so on (pigeonhole), which deals them into groups without losing a link; more segments
serve more fingerprints.  Each fingerprint has a pivot table, its Hamming distances to ``PIVOTS`` reference fingerprints, computed
once and kept as a column.  By the triangle inequality two fingerprints that differ in a coordinate by more than the radius are
no link, so every pair of a group is first tested by its largest coordinate difference, whatever the group's size; only what passes
is verified on the bits.  A group returns a spanning forest of its links, never all pairs.  Groups that are too large for one task are
cut into tiles, and pairs of tiles are compared in tasks of their own.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other.  A
text of fewer than four words is one shingle.  Repeated rows are in one component; rows of one doc_id with different texts are
told apart by their fingerprints.  A row with a null doc_id keeps its fingerprint and gets the smallest doc_id of its component, null if
that has none.

``keep_one_similar`` links by similarity instead: texts whose sets of shingles have a Jaccard similarity of at
least ``least``.  At 0.8 fingerprints of 64 bits differ in about ten, too many for segments.  Candidates are texts that agree in
all minima of a band (MinHash); their sets are compared exactly before anything is linked, large groups in tiles and with a few
members first, so that copies of one text cost no more than their number.

``keep_one_near`` keeps the same by SimHash: these texts have fingerprints of ``WIDE`` bits over their sets of shingles and meet where
they agree on a block of a few bits.  The pairs of a block are tested by a table of distances to reference fingerprints and then
on the bits; what passes forms groups, in which the sets are compared exactly as above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._text import as_bytes
from .components import components, salted_join
from .durable import durable

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Reference fingerprints of the pivot tables.
PIVOTS = 32
#: Fingerprints of a group that one task compares with each other; larger groups are cut into tiles of this size.
TILE = 1024
#: Members of a large group of sets with which all others are compared first.
LEADERS = 8
#: Pairs that one step holds.
PAIRS = 1 << 20
#: Bands, and minima in each, by which similar sets meet: 0.998 of the pairs at a similarity of 0.8 share a band, more above.
BANDS, BAND = 12, 4
_MASKS, _FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * BAND, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the fingerprints by which similar sets meet; at a similarity of 0.8 these differ in 39 bits on average, with a deviation of 6.
WIDE = 256
#: Most bits in which fingerprints of candidates differ; those of unrelated texts differ in 128, with a deviation of 8.
WIDE_RADIUS = 64
#: Members of a bucket that are its reference fingerprints.
WIDE_PIVOTS = 4
#: Share of pairs at the least similarity that agree on a block of bits; more so above it.
MEET = 0.999
#: Fingerprints that agree on a block by chance, about, and how many are taken for copies.
BY_CHANCE, MOST = 256, 8192
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the lower-cased text, repeats included."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = map(slice, starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist())
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_masks(parts: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits on which two fingerprints may agree: every choice of ``parts - radius`` of ``parts`` segments.

    ``radius`` different bits spoil at most as many segments, so all others agree, and with them one of these choices.
    """
    cuts = [64 * i // parts for i in range(parts + 1)]
    segments = [((1 << b - a) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(segments, parts - radius)]


def segments_for(n: int) -> int:
    """Fewest segments with which groups of unrelated fingerprints stay well below a tile."""
    return next((p for p in range(RADIUS + 1, 9) if n >> 64 * (p - RADIUS) // p <= TILE // 4), 9)


def pivot_prints() -> np.ndarray:
    """The reference fingerprints: ``PIVOTS`` random ones, the same for every corpus, so that tables of different runs can be compared."""
    return np.random.default_rng(29).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, a byte each."""
    return np.bitwise_count(fps[:, None] ^ pivot_prints()[None, :]).astype(np.uint8)


def with_table(fps: DataFrame) -> DataFrame:
    """``fps`` with the pivot table of each fingerprint as a column; computed once, it travels with the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pivot_table(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*batch.schema.names, "distances"])

    return fps.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fps.schema) + ", distances binary")


class Forest:
    """Disjoint sets of positions; the smallest position leads."""

    def __init__(self, n: int):
        self.lead = np.arange(n)

    def find(self, i: int) -> int:
        lead = self.lead
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.lead[max(i, j)] = min(i, j)
        return True


def links(fps: np.ndarray, table: np.ndarray, group: np.ndarray, tile: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the links within each group, and how many pairs the table saw, let pass, and were links.

    Rows are sorted by group and first coordinate of the table, so that only a window of them can lie within the radius; the
    largest coordinate difference discards most of the window, and what is left is verified on the bits.  Where ``across`` is
    set, only pairs of different tiles count.
    """
    order = np.lexsort((table[:, 0], group)) if len(fps) else np.zeros(0, np.int64)
    fps, table, group, tile, across = fps[order], table[order].astype(np.int16), group[order], tile[order], across[order]
    place = group.astype(np.int64) * 256 + table[:, 0]
    after = np.searchsorted(place, place + RADIUS, side="right") - 1 - np.arange(len(fps))
    forest, counts = Forest(len(fps)), np.zeros(3, np.int64)
    out_i, out_j = [], []
    ends = np.cumsum(after)
    lo = 0
    while lo < len(fps):
        # As many rows as give about PAIRS pairs.
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        open_ = ~across[i] | (tile[i] != tile[j])
        i, j = i[open_], j[open_]
        counts[0] += len(i)
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= RADIUS
            i, j = i[near], j[near]
        counts[1] += len(i)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
        i, j = i[near], j[near]
        counts[2] += len(i)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.union(a, b):
                out_i.append(a)
                out_j.append(b)
        lo = hi
    return order[np.array(out_i, np.int64)], order[np.array(out_j, np.int64)], counts


def compared(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Links a, b among the cells of one bucket, and the counts of ``links``."""
    fp = rows["fp"].to_numpy().view(np.uint64)
    table = np.frombuffer(b"".join(rows["distances"]), np.uint8).reshape(len(rows), PIVOTS)
    cell = rows.groupby(["part", "value", "lo", "hi"], sort=False).ngroup().to_numpy()
    i, j, counts = links(fp, table, cell, rows["tile"].to_numpy(), (rows["lo"] != rows["hi"]).to_numpy())
    return pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)}), counts


def fingerprint_cells(fps: DataFrame, parts: int | None = None) -> DataFrame:
    """fp, distances, tile, part, value, lo, hi and bucket: each fingerprint in the cells (pairs of tiles of a group) where it is compared.

    The number of segments follows the number of fingerprints (``segments_for``).  Group sizes are counted first.  Each group is
    dealt into tiles by a hash, and each pair of tiles is one task's work, so a group that holds a third of all fingerprints
    is spread like any other.
    """
    masks = segment_masks(parts or segments_for(fps.count()))
    keys = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for k, m in enumerate(masks)]
    dealt = fps.select("fp", "distances", F.explode(F.array(*keys)).alias("key")).select("fp", "distances", "key.part", "key.value")
    sizes = dealt.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    # A group of one has no pair; one group may hold a third of all fingerprints.
    placed = salted_join(dealt, sizes, ["part", "value"], by="fp")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("lo"), F.greatest(t, F.col("tile")).alias("hi")))
    cells = placed.select("fp", "distances", "part", "value", "tiles", tile).select("fp", "distances", "part", "value", "tile", F.explode(pairs).alias("cell"))
    # Small groups travel together: a task's group is a bucket of many values of one segment.
    buckets = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.select("fp", "distances", "tile", "part", "value", F.col("cell.lo").alias("lo"), F.col("cell.hi").alias("hi"), F.pmod(F.xxhash64("part", "value", "cell.lo", "cell.hi"), F.lit(4 * buckets)).alias("bucket"))


def fingerprint_links(fps: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs a, b of linked fingerprints whose components are those of all links; ``fps``: columns fp (distinct) and distances."""
    return fingerprint_cells(fps, parts).groupBy("bucket").applyInPandas(lambda rows: compared(rows)[0], "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = durable(fingerprints(docs))
    leaders = durable(with_table(rows.groupBy("fp").agg(F.min("doc_id").alias("leader"))))
    groups = components(fingerprint_links(leaders)).select(F.col("id").alias("fp"), "component")
    named = leaders.drop("distances").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("leader").alias("component_id"))
    named = salted_join(named, least, "component", by="fp").select("fp", "component_id")
    # A third of all rows may share one fingerprint.
    return salted_join(rows, named, "fp", by="doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique __row; kept in the shared folder, as numbers could differ when rows are read again."""
    return durable(docs.withColumn("__row", F.monotonically_increasing_id()))


def _first_of_each(docs: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The first row of each component; ``rows``: __row, doc_id and key of every row, ``edges``: linked keys a, b.

    First is the smallest doc_id, null after all others, and of equal ones the smallest __row.
    """
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "__row")
    firsts = rows.groupBy("key").agg(F.min(place).alias("first"))
    named = firsts.join(components(edges).select(F.col("id").alias("key"), "component"), "key", "left")
    kept = named.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("first").alias("first")).select("first.__row")
    return docs.join(kept, "__row", "left_semi").drop("__row")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of fingerprints, all columns unchanged: the smallest doc_id, null after all others; one row of that doc_id."""
    docs, columns = _numbered(docs), docs.columns
    prints = fingerprints(docs.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), F.col("fp").alias("key"))
    rows = durable(docs.select("__row", "doc_id").join(prints, "__row"))
    return _first_of_each(docs, rows, fingerprint_links(with_table(rows.select(F.col("key").alias("fp")).distinct()))).select(columns)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of a set of shingles; equal with the band's minima."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 8192):
        least = np.minimum(least, ((hashes[None, lo : lo + 8192] ^ _MASKS) * _FACTORS).min(axis=1))
    return np.array([xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, BAND)], dtype=np.uint64).view(np.int64)


def similar_pairs(sets: list[np.ndarray], least: float, group: np.ndarray | None = None, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the pairs of sets with a Jaccard similarity of ``least``.

    ``group``: sets of one number are known to be connected.  ``probe``: of each pair, one at least must be one of these positions.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, names, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # What only one set has is shared with none.
    common = often[names] > 1
    names, owner = names[common], owner[common]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    lead, out = np.arange(len(sets)) if group is None else group.copy(), []
    mark = np.zeros(len(often), dtype=bool)
    for i in (range(len(sets) - 1) if probe is None else probe.tolist()):
        open_ = (lead != lead[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]) - 1e-9)
        if probe is None:
            open_[: i + 1] = False
        if not open_.any():
            continue
        mine = names[bounds[i] : bounds[i + 1]]
        mark[mine] = True
        shared = np.bincount(owner, weights=mark[names], minlength=len(sets))
        mark[mine] = False
        for j in np.flatnonzero(open_ & (shared >= least * (sizes + sizes[i] - shared) - 1e-9)).tolist():
            if lead[j] != lead[i]:
                out.append((i, j))
                lead[lead == lead[j]] = lead[i]
    return out


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The bits of the fingerprint of a set of shingles: each set where over half of the mixed hashes set it."""
    count = np.zeros(WIDE, np.int64)
    for lo in range(0, len(hashes), 8192):
        x = hashes[lo : lo + 8192, None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.int64)
    return (count * 2 > len(hashes)).astype(np.uint8)


def blocks_for(n: int, least: float) -> np.ndarray:
    """Positions of the bits of each block on which candidates agree, for ``n`` fingerprints.

    By the angle between two sets of that similarity a bit differs with a known chance, and so few blocks give ``MEET``.
    """
    width = min(24, max(8, int(np.ceil(np.log2(max(n, 1) / BY_CHANCE)))))
    same = (1 - np.arccos(2 * least / (1 + least)) / np.pi) ** width
    rng = np.random.default_rng(13)
    return np.array([rng.choice(WIDE, width, replace=False) for _ in range(int(np.ceil(np.log(1 - MEET) / np.log(1 - same))))])


def block_values(bits: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A row of block values for each row of bits."""
    return bits[:, blocks].astype(np.int64) @ (np.int64(1) << np.arange(blocks.shape[1], dtype=np.int64))


def near_prints(prints: np.ndarray, cell: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stars (first position, other position) of the fingerprints of each cell that are connected by pairs differing in at most ``WIDE_RADIUS`` bits, and the counts of ``links``.

    Every pair of a cell is tested by the table of distances to reference fingerprints first.  These are members of the bucket: at this
    radius the distances to random fingerprints differ too little to discard a pair.
    """
    order = np.argsort(cell, kind="stable")
    prints, cell = prints[order], cell[order]
    pivots = prints[np.linspace(0, len(prints) - 1, min(WIDE_PIVOTS, len(prints))).astype(np.int64)] if len(prints) else prints
    table = np.bitwise_count(prints[:, None] ^ pivots[None]).sum(axis=2, dtype=np.int16)
    after = np.searchsorted(cell, cell, side="right") - 1 - np.arange(len(cell))
    forest, counts, ends, lo = Forest(len(cell)), np.zeros(3, np.int64), np.cumsum(after), 0
    while lo < len(cell):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        counts[0] += len(i)
        for p in range(table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= WIDE_RADIUS
            i, j = i[near], j[near]
        counts[1] += len(i)
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= WIDE_RADIUS
        i, j = i[near], j[near]
        counts[2] += len(i)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            forest.union(x, y)
        lo = hi
    return [(order[forest.find(x)], order[x]) for x in np.flatnonzero(forest.lead != np.arange(len(cell))).tolist()], counts


def candidates(prints: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of keys whose components hold all pairs of fingerprints that agree on a block and differ in few bits; columns key and print.

    A block value that more than ``MOST`` share is mostly that of copies, which the comparison of their sets connects at a cost in proportion to
    their number; its members are all candidates, linked to one of them, without a test.

    A group of near copies meets in most blocks.  Each block links its members to the smallest key there, which is the same in many blocks; then each
    member keeps the link to the smallest of these, and these are linked to each other instead (``_fewer``).
    """
    blocks = blocks_for(prints.count(), least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n = part.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(n, -1), axis=1)
                again = pa.array(np.repeat(np.arange(n), len(blocks)))
                number = pa.array(np.tile(np.arange(len(blocks), dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([part.column("key").take(again), part.column("print").take(again), number, pa.array(block_values(bits, blocks).ravel())], ["key", "print", "block", "value"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        key = rows["key"].to_numpy()
        cell = rows.groupby(["block", "value"], sort=False).ngroup().to_numpy()
        found, _ = near_prints(np.frombuffer(b"".join(rows["print"]), np.uint64).reshape(len(rows), -1), cell)
        return pd.DataFrame([(key[i], key[j]) for i, j in found], columns=["a", "b"], dtype=np.int64)

    dealt = prints.select("key", "print").mapInArrow(deal, "key long, print binary, block int, value long")
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"))
    large = durable(sizes.where(F.col("n") > MOST).drop("n"))
    several = large.count()
    small = dealt
    if several:
        # Few: each holds over MOST of the rows.
        large = F.broadcast(large) if several <= 100_000 else large
        small = dealt.join(large.drop("a"), ["block", "value"], "left_anti")
    buckets = max(4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), several)
    found = small.groupBy(F.pmod(F.xxhash64("block", "value"), F.lit(buckets)).alias("bucket")).applyInPandas(compare, "a long, b long")
    return _fewer(found.unionByName(dealt.join(large, ["block", "value"]).select("a", F.col("key").alias("b"))) if several else found)


def _fewer(stars: DataFrame) -> DataFrame:
    """Edges a, b with the components of ``stars`` (a: smallest key of a block's star, b: another key of it): about one for each key.

    A key has one star in each block at most, so what is collected for it is bounded by the number of blocks.
    """
    centres = stars.where("a <> b").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("centres"))
    between = centres.select(F.col("centres")[0].alias("a"), F.explode(F.slice("centres", 2, F.size("centres"))).alias("b")).distinct()
    return durable(centres.select(F.col("centres")[0].alias("a"), "b").unionByName(between))


def _print_rows(docs: DataFrame, width: int) -> DataFrame:
    """__row, key (a hash of the set of shingles; equal sets have equal keys) and print (null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keys, prints = [], []
                for text in as_bytes(part.column("text")):
                    found = shingle_set(text, width)
                    keys.append(xxh64_intdigest(found.tobytes(), SEED))
                    prints.append(np.packbits(wide_print(found)).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(prints, pa.binary())], ["__row", "key", "print"])

    return docs.select("__row", "text").mapInArrow(run, "__row long, key long, print binary")


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """__row, key (a hash of the set of shingles; equal sets have equal keys) and bands of every row; none for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keys, bands = [], []
                for text in as_bytes(part.column("text")):
                    found = shingle_set(text, width)
                    keys.append(xxh64_intdigest(found.tobytes(), SEED))
                    bands.append(band_keys(found) if len(found) else [])
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["__row", "key", "bands"])

    return docs.select("__row", "text").mapInArrow(run, "__row long, key long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """key and shingles (sorted hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [shingle_set(t, width).tobytes() for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.binary())], ["key", "shingles"])

    return docs.select("key", "text").mapInArrow(run, "key long, shingles binary")


def _band_groups(rows: DataFrame) -> DataFrame:
    """key, band, value, tiles and tile of the members of each group of keys that share a band; groups of the same members once."""
    dealt = rows.select("key", F.posexplode("bands").alias("band", "value")).distinct()
    groups = dealt.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members")).where("n > 1")
    once = groups.groupBy("n", "members").agg(F.min(F.struct("band", "value")).alias("group"))
    once = durable(once.select("group.band", "group.value", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    # One group may hold a third of all keys.
    placed = salted_join(dealt, once, ["band", "value"], by="key")
    return durable(placed.withColumn("tile", F.pmod(F.xxhash64("key", F.lit(3)), F.col("tiles")).cast("int")))


def _compared_sets(cells: DataFrame, sets: DataFrame, buckets: int, least: float) -> DataFrame:
    """Linked keys a, b; ``cells``: key, band, value, lo, hi, component (null: none known) and probe of the members of each cell."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, cell in rows.groupby(["band", "value", "lo", "hi"], sort=False):
            cell = cell.sort_values(["key", "probe"], ascending=[True, False]).drop_duplicates("key")
            key, probe = cell["key"].to_numpy(), cell["probe"].to_numpy()
            if len(key) > 1:
                known = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
                found = similar_pairs([np.frombuffer(x, np.uint64) for x in cell["shingles"]], least, known, None if probe.all() else np.flatnonzero(probe))
                out += [(key[i], key[j]) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    dealt = cells.withColumn("bucket", F.pmod(F.xxhash64("band", "value", "lo", "hi"), F.lit(buckets)))
    return dealt.join(sets, "key").groupBy("bucket").applyInPandas(compare, "a long, b long")


def similar_links(docs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Keys a, b of pairs of similar sets whose components are those of all similar pairs that share a band.

    Groups over ``TILE`` are cut into tiles.  First each tile is compared in itself and with the ``LEADERS`` of its group, which
    connects a group of copies however large it is.  Then whatever a group holds outside its largest component is compared with all members
    of the group in other components; pairs that are connected already are left out.
    """
    placed = _band_groups(rows)
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TILE)
    chosen = rows.groupBy("key").agg(F.min("__row").alias("__row")).join(placed.select("key").distinct(), "key", "left_semi")
    sets = _sets(docs.select("__row", "text").join(chosen, "__row"), width)
    large, cell = placed.where("tiles > 1"), ["key", "band", "value", "lo", "hi", "component", "probe"]
    leaders = large.groupBy("band", "value", "tiles", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(LEADERS))).agg(F.min("key").alias("key"))
    leaders = leaders.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = placed.select("key", "band", "value", "tile").unionByName(leaders.select("key", "band", "value", "tile"))
    first = _compared_sets(members.select("key", "band", "value", F.col("tile").alias("lo"), F.col("tile").alias("hi"), F.col("key").alias("component"), F.lit(True).alias("probe")), sets, buckets, least)
    if large.isEmpty():
        return first
    first = durable(first)
    known = components(first).select(F.col("id").alias("key"), "component")
    named = large.join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = named.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("band", "value").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    several = several.withColumn("rests", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")).drop("all", "most")
    named = durable(salted_join(named, several, ["band", "value"], by="key"))
    # A cell is a tile of the rest and a tile of all members.
    rest = named.where("component <> largest").withColumns({"lo": F.pmod(F.xxhash64("key", F.lit(7)), F.col("rests")).cast("int"), "hi": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "probe": F.lit(True)})
    every = named.withColumns({"lo": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "hi": F.col("tile"), "probe": F.lit(False)})
    return first.unionByName(_compared_sets(rest.select(cell).unionByName(every.select(cell)), sets, buckets, least))


def keep_one_similar(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of similar texts, all columns unchanged: the smallest doc_id, null after all others; one row of that doc_id.

    Texts are similar whose sets of runs of ``width`` words have a Jaccard similarity of ``least``, or that have no word.
    """
    docs, columns = _numbered(docs), docs.columns
    rows = durable(_set_rows(docs, width))
    edges = similar_links(docs, rows, width, least)
    return _first_of_each(docs, docs.select("__row", "doc_id").join(rows.select("__row", "key"), "__row"), edges).select(columns)


def keep_one_near(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """What ``keep_one_similar`` keeps, with candidates found by SimHash fingerprints of the same sets."""
    docs, columns = _numbered(docs), docs.columns
    rows = durable(_print_rows(docs, width))
    prints = durable(rows.where("print IS NOT NULL").groupBy("key").agg(F.first("print").alias("print")))
    groups = components(candidates(prints, least)).select(F.col("id").alias("key"), F.array("component").alias("bands"))
    # Only keys with a candidate are in a group.
    edges = similar_links(docs, durable(rows.drop("print").join(groups, "key")), width, least)
    return _first_of_each(docs, docs.select("__row", "doc_id").join(rows.select("__row", "key"), "__row"), edges).select(columns)
