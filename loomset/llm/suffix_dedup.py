"""Repeated passages from common-prefix interval trees over enhanced suffix arrays.

A passage repeats if a string of at least ``MIN_BYTES`` bytes occurs in two documents.  Suffixes are sorted where they can meet:
each window of ``MIN_BYTES`` bytes belongs to its minimizer, the k-mer in it with the smallest hash, so equal windows have the
same minimizer wherever they stand.  Consecutive windows of one minimizer form a stretch of text.

1. ``_announce``: documents lie in blocks; each block reports the minimizers it has to buckets by their hash, four bytes each.
2. ``_shared``: a bucket answers two bits for each: whether another document has it too, and whether it is crowded, with more than
   ``MOST_STRINGS`` different stretches.
3. ``_send``: blocks send the different stretches of shared minimizers to the buckets, with their smallest and largest doc_id.
4. ``_maximal_repeats``: a bucket sorts the suffixes of its stretches, computes common-prefix lengths of neighbours and scans
   them with a stack, which visits every node of the common-prefix interval tree.  A node whose suffixes are all preceded by
   the same byte is contained in a longer repeat and dropped; the others are maximal repeats within their stretches, returned with
   all occurrences and the smallest doc_id among them.
5. ``_apply``: blocks map the repeats back to places in their documents.

A copy's stretches are equal, so a block sends them once however many copies it holds: a group that has a third of all rows
costs a bucket one string for each block.  A passage in ever differing surroundings gives the minimizers near its ends one stretch
for each document; of such crowded minimizers each window is sent alone, to the bucket of its own hash, so they are spread over
all buckets.  Equal windows still meet, so the same bytes are found; repeats there are not joined beyond one window.
Text is shuffled once; all steps share that exchange.  Within a task the work is on arrays of stretches, in passes that fit the
processor's cache.

Defined results: a null text is empty and nothing of it is removed, nor of a text under ``MIN_BYTES`` bytes.  Rows of equal
doc_id do not remove each other's text.  A null doc_id counts as smaller than every other.  All texts are handled as bytes, NUL included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 50
KMER = 20
WINDOW = MIN_BYTES - KMER + 1
#: Bytes of a stretch, at most.
LONGEST = WINDOW + MIN_BYTES - 1
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Bytes of a pass, which so stays in the processor's cache, its places taking 16 bits; and bytes where a text is cut into passes.
_PLACES = 1 << 16
PASS_BYTES = _PLACES - MIN_BYTES + 1
#: Times ``BLOCK_BYTES`` of text whose stretches, about three times its size, a task keeps between steps.
KEEP_BLOCKS = 2
#: Bytes of text that one task of a large table handles, block by block.
TASK_BYTES = 64 << 20
#: Different stretches of one minimizer that one bucket takes; the windows of more are dealt by their own hashes.
MOST_STRINGS = 4096
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODE = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)


def _hashes(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, from hashes of doubling widths, the first of them codes of single bytes; as wide as these."""
    bits = 8 * code.itemsize
    power = lambda n: code.dtype.type(pow(_BASE, n, 1 << bits))
    out, have, size = None, 0, 1
    n = len(code) - width + 1
    while True:
        if width & size:
            part = code[width - have - size :][:n] if out is not None else code[width - size :][:n]
            out = part.copy() if out is None else part * power(have) + out
            have += size
        if size * 2 > width:
            return out
        code = code[:-size] * power(size) + code[size:]
        size *= 2


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of numbers side by side."""
    code = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        code = (code ^ (code >> np.uint64(29)) ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ (code >> np.uint64(31))) * np.uint64(_BASE)
    return code ^ (code >> np.uint64(32))


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low


def _eight(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each position on."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


#: buffer, begin, end, text, place, hash of the minimizer and hash of the string.
_Pass = tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def stretches(texts: list[bytes]) -> Iterator[_Pass]:
    """The stretches, pass by pass: bytes begin to end of the buffer, from ``place`` of the text on, and their hashes."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - MIN_BYTES + 1, PASS_BYTES):
            piece = text[at : at + PASS_BYTES + MIN_BYTES - 1]
            if size + len(piece) > _PLACES:
                yield _stretches(pieces)
                pieces, size = [], 0
            pieces.append((i, at, piece))
            size += len(piece)
    if pieces:
        yield _stretches(pieces)


def _stretches(pieces: list[tuple[int, int, bytes]]) -> _Pass:
    buffer = b"".join(p[2] for p in pieces)
    raw = np.frombuffer(buffer, np.uint8)
    lengths = np.array([len(p[2]) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    code = _hashes(raw.astype(np.uint32) + np.uint32(1), KMER)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    # Of equal upper halves the leftmost, so a window's minimizer depends on the window alone.
    least = _least((code & np.uint32(0xFFFF0000)) | np.arange(len(code), dtype=np.uint32), WINDOW)
    # The place is in it, so it changes where the minimizer does.
    change = np.append(True, least[1:] != least[:-1])
    for s in starts[1:].tolist():
        change[s - MIN_BYTES + 1 : s] = False
    change[starts] = True
    begin = np.flatnonzero(change)
    n = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
    end = np.minimum(np.append(begin[1:], len(raw)) - 1 + MIN_BYTES, np.repeat(starts + lengths, n))
    text, place = np.repeat([p[0] for p in pieces], n), begin + np.repeat(np.array([p[1] for p in pieces]) - starts, n)
    eight = _eight(buffer)
    at = (least[begin] & np.uint32(0xFFFF)).astype(np.int64)
    # A stretch has at most ``LONGEST`` bytes, so four k-mers cover it.
    string = _mixed(_pair(code[begin], code[begin + KMER]), _pair(code[end - 2 * KMER], code[end - KMER]) + (end - begin).astype(np.uint64))
    return buffer, begin, end, text, place, _mixed(eight[at], eight[at + 8], eight[at + KMER - 8]), string


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each hash in one number; the 32 bits only decide what is looked at, so a clash costs time alone."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


class _Block:
    """Documents of one block in a fixed order."""

    def __init__(self, rows: pd.DataFrame):
        ids = rows["__id"].tolist()
        texts = [b"" if t is None else bytes(t) for t in rows["__text"]]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows, self.ids, self.texts = order, np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]
        self.kept: list | None = None

    def stretches(self) -> Iterable[_Pass]:
        """``stretches`` of the texts, kept for the next call; of a block with very long texts they are found again."""
        if self.kept is None and sum(map(len, self.texts)) <= KEEP_BLOCKS * BLOCK_BYTES:
            self.kept = list(stretches(self.texts))
        return stretches(self.texts) if self.kept is None else self.kept

    def minimizers(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different codes in order, whether two documents of the block have it, and how many different stretches it has."""
        code, doc, string = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, _, _, text, _, hashes, strings in stretches(self.texts):
            code.append(_codes(hashes, buckets))
            doc.append(self.ids[text])
            string.append(strings)
        code, doc, string = np.concatenate(code), np.concatenate(doc), np.concatenate(string)
        if not len(code):
            return code, np.zeros(0, bool), np.zeros(0, np.int64)
        order = np.argsort(code)
        code, doc = code[order], doc[order]
        fresh = np.append(True, code[1:] != code[:-1])
        head = np.flatnonzero(fresh)
        different = np.diff(np.append(head, len(code)))
        # Most codes have one stretch; only the strings of others are sorted.
        several = np.repeat(different > 1, different)
        group, string = np.cumsum(fresh[several]) - 1, string[order[several]]
        by_string = np.lexsort((string, group))
        group, string = group[by_string], string[by_string]
        other = np.append(True, (string[1:] != string[:-1]) | (group[1:] != group[:-1]))[: len(group)]
        different[different > 1] = np.bincount(group[other])
        return code[head], np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head), different

    def codes(self, buckets: int) -> np.ndarray:
        """Different codes in order."""
        code = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_codes(hashes, buckets) for *_, hashes, _ in self.stretches())]))
        return code[np.append(True, code[1:] != code[:-1])[: len(code)]]

    def shared(self, bits: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes that the buckets called shared, in order, and whether each is crowded."""
        code = self.codes(buckets)
        cut = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        keep, crowded = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
        for bucket, packed, full in zip(bits["bucket"], bits["bits"], bits["crowded"], strict=True):
            lo, hi = cut[bucket], cut[bucket + 1]
            keep[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
            crowded[lo:hi] = np.unpackbits(np.frombuffer(full, np.uint8), count=hi - lo).astype(bool)
        return code[keep], crowded[keep]

    def shared_places(self, shared: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pass by pass, (buffer, bucket, begin, end, text, place) of the stretches of shared minimizers, or of the windows of crowded ones."""
        shared, crowded = shared
        if not len(shared):
            return
        # Discards most others before the search.
        low = np.uint64(0xFFFFF)
        likely = np.zeros(1 << 20, bool)
        likely[shared & low] = True
        for buffer, begin, end, text, place, hashes, _ in self.stretches():
            code = _codes(hashes, buckets)
            at = np.flatnonzero(likely[code & low])
            found = np.minimum(np.searchsorted(shared, code[at]), len(shared) - 1)
            same = shared[found] == code[at]
            at, split = at[same], crowded[found[same]]
            bucket = (code[at] >> np.uint64(32)).astype(np.int64)
            begin, end, text, place = begin[at], end[at], text[at], place[at]
            if split.any():
                # In the order of the text, so that the first and the last document of a window come first and last.
                n = np.where(split, end - begin - MIN_BYTES + 1, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                split, bucket, text = np.repeat(split, n), np.repeat(bucket, n), np.repeat(text, n)
                begin, end, place = np.repeat(begin, n) + step, np.repeat(end, n), np.repeat(place, n) + step
                end[split] = begin[split] + MIN_BYTES
                bucket[split] = _window_buckets(buffer, begin[split], buckets)
            yield buffer, bucket, begin, end, text, place

    def shared_stretches(self, shared: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, int, int]]:
        """``shared_places`` one by one: (bucket, string, text, place)."""
        for buffer, bucket, begin, end, text, place in self.shared_places(shared, buckets):
            for b, lo, hi, t, p in zip(bucket.tolist(), begin.tolist(), end.tolist(), text.tolist(), place.tolist(), strict=True):
                yield b, buffer[lo:hi], t, p

    def shared_strings(self, shared: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different strings of ``shared_places`` by bucket, and where each bucket's begin; string, text and place of each stretch."""
        parts = [(pa.array([], pa.large_binary()), *[np.zeros(0, np.int64)] * 3)]
        for buffer, bucket, begin, end, text, place in self.shared_places(shared, buckets):
            parts.append((_cut(buffer, begin, end), bucket, text, place))
        cut, *rest = zip(*parts, strict=True)
        bucket, text, place = (np.concatenate(x) for x in rest)
        strings, number = _different(pa.concat_arrays(cut))
        # A string has one minimizer, or is one window, and so has one bucket.
        of = np.zeros(len(strings), np.int64)
        of[number] = bucket
        order, rank = np.argsort(of, kind="stable"), np.empty(len(strings), np.int64)
        rank[order] = np.arange(len(order))
        return strings.take(pa.array(order)), np.searchsorted(of[order], np.arange(buckets + 1)), rank[number], text, place


def _strings(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.LargeBinaryArray:
    """Strings that stand one after the other."""
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cut(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """Bytes begin to end of the buffer, ``LONGEST`` at most."""
    from_each = np.ndarray(len(buffer), f"V{LONGEST}", buffer + bytes(LONGEST), strides=(1,))
    rows = from_each[begin].view(np.uint8).reshape(-1, LONGEST)
    lengths = (end - begin).astype("u1")
    return _strings(lengths, rows[np.arange(LONGEST, dtype="u1") < lengths[:, None]])


def _different(strings: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The different strings, and which of them each one is."""
    found = strings.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def _bytes_of(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each string begins in them, with the end."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, "<i8")[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spread(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of each, ``n`` numbers."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _window_buckets(buffer: bytes, begin: np.ndarray, buckets: int) -> np.ndarray:
    eight = _eight(buffer)
    code = _mixed(*(eight[begin + k] for k in (*range(0, MIN_BYTES - 8, 8), MIN_BYTES - 8)))
    return ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _announce(buckets: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        code, several, different = _Block(rows).minimizers(buckets)
        cut = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        low = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
        return pd.DataFrame({
            "bucket": full.astype(np.int32), "block": np.full(len(full), key[0], np.int32),
            "codes": [low[cut[b] : cut[b + 1]].tobytes() for b in full], "several": [np.packbits(several[cut[b] : cut[b + 1]]).tobytes() for b in full],
            "more": [_more(different[cut[b] : cut[b + 1]]) for b in full],
        })

    return run


def _more(different: np.ndarray) -> bytes:
    """Place and number of all numbers over 1."""
    at = np.flatnonzero(different > 1)
    return np.stack((at, different[at]), axis=1).astype("<u4").tobytes()


def _shared(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(c, "<u4") for c in rows["codes"]]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)).astype(bool) for s, p in zip(rows["several"], parts, strict=True)]
        code, flag = np.concatenate(parts), np.concatenate(several)
        ends = np.cumsum([len(p) for p in parts])
        different = np.ones(len(code))
        for more, e, p in zip(rows["more"], ends, parts, strict=True):
            at, n = np.frombuffer(more, "<u4").reshape(-1, 2).T
            different[e - len(p) + at.astype(np.int64)] = n
        order = np.argsort(code, kind="stable")
        head = np.append(True, code[order][1:] != code[order][:-1])
        group = np.cumsum(head) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, weights=flag[order]) > 0)
        answer, crowded = np.empty(len(code), dtype=bool), np.empty(len(code), dtype=bool)
        answer[order] = many[group]
        # A sum over blocks, so at least the number of different stretches.
        crowded[order] = (np.bincount(group, weights=different[order]) > most)[group]
        packed = {c: [np.packbits(x[e - len(p) : e]).tobytes() for e, p in zip(ends, parts, strict=True)] for c, x in (("bits", answer), ("crowded", crowded))}
        return pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), **packed})

    return run


def _send(buckets: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        block = _Block(rows)
        strings, heads, number, text, _ = block.shared_strings(block.shared(bits, buckets), buckets)
        raw, starts = _bytes_of(strings)
        first, last = np.zeros(len(strings), "<i8"), np.zeros(len(strings), "<i8")
        # Texts come in the order of their ids.
        first[number[::-1]], last[number] = block.ids[text[::-1]], block.ids[text]
        lengths = np.diff(starts).astype("u1")
        full = np.flatnonzero(heads[1:] > heads[:-1])
        cuts = [slice(heads[b], heads[b + 1]) for b in full]
        return pd.DataFrame({
            "bucket": full.astype(np.int32), "block": np.full(len(full), key[0], np.int32),
            "strings": [raw[starts[c.start] : starts[c.stop]].tobytes() for c in cuts], "lengths": [lengths[c].tobytes() for c in cuts],
            "first": [first[c].tobytes() for c in cuts], "last": [last[c].tobytes() for c in cuts],
        })

    return run


def interval_tree(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every node of the tree of common-prefix intervals of at least ``least``, children first.

    ``common[i]`` is the common prefix of sorted suffixes i-1 and i.
    """
    nodes, stack = [], []
    for i, value in enumerate([*common.tolist()[1:], 0], start=1):
        first = i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            nodes.append((length, first, i - 1))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return nodes


def repeats(strings: pa.LargeBinaryArray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, offset, length, smallest id) of all occurrences of the maximal repeats among different strings.

    A string that several documents hold is a repeat as a whole.
    """
    raw, starts = _bytes_of(strings)
    starts, lengths = starts[:-1], np.diff(starts)
    whole = np.flatnonzero(first < last)
    found = [(np.arange(len(whole)), whole, np.zeros(len(whole), np.int64), lengths[whole], first[whole])]
    raw = np.append(raw, np.zeros(LONGEST + 1, np.uint8))
    windows = lengths - MIN_BYTES + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    place = starts[owner] + offset
    code = np.concatenate([_hashes(_BYTE_CODE[raw[at : at + _PLACES + MIN_BYTES - 1]], MIN_BYTES) for at in range(0, len(raw) - MIN_BYTES + 1, _PLACES)])[place]
    # Only windows that may be equal to another are sorted, and of these only sets that may be preceded by different bytes.
    order = np.argsort(code)
    code = code[order]
    same = code[1:] == code[:-1]
    several = np.append(same, False)[: len(code)] | np.append(False, same)[: len(code)]
    order, code = order[several], code[several]
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    size = np.diff(np.append(head, len(order)))
    before = np.where(offset[order] > 0, raw[place[order] - 1].astype(np.int64), 256)
    low, high = np.minimum.reduceat(before, head), np.maximum.reduceat(before, head)
    diverse = np.repeat((low != high) | (high == 256), size)
    kept, before = order[diverse], before[diverse]
    if len(kept):
        owner, offset, place = owner[kept], offset[kept], place[kept]
        words = -(-LONGEST // 8)
        suffix = raw[np.minimum(place[:, None] + np.arange(words * 8), len(raw) - 1)]
        room = lengths[owner] - offset
        suffix[np.arange(words * 8)[None, :] >= room[:, None]] = 0
        keys = suffix.view(">u8").astype(np.uint64)
        order = np.lexsort((room, *(keys[:, w] for w in range(words - 1, -1, -1))))
        owner, offset, before, room, suffix = owner[order], offset[order], before[order], room[order], suffix[order]
        differs = suffix[1:] != suffix[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), LONGEST)
        common = np.append(0, np.minimum(np.minimum(room[1:], room[:-1]), common))
        changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
        borders = np.cumsum(before == 256)
        nodes = np.array(interval_tree(common, MIN_BYTES), dtype=np.int64).reshape(-1, 3)
        length, lo, hi = nodes.T
        # Different bytes before it, or the border of a stretch, beyond which another bucket looks.
        diverse = (changes[hi] > changes[lo]) | (borders[hi] - borders[lo] + (before[lo] == 256) > 0)
        length, lo, hi = length[diverse], lo[diverse], hi[diverse]
        size = hi - lo + 1
        heads = np.cumsum(size) - size
        member = np.arange(size.sum()) - np.repeat(heads, size) + np.repeat(lo, size)
        if len(member):
            smallest = np.minimum.reduceat(first[owner[member]], heads)
            found.append((np.repeat(np.arange(len(lo)), size) + len(whole), owner[member], offset[member], np.repeat(length, size), np.repeat(smallest, size)))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def _maximal_repeats(every: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """``every``: also return occurrences that remove nothing."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block").reset_index(drop=True)
        lengths = np.frombuffer(b"".join(rows["lengths"]), "u1")
        strings, ids = _different(_strings(lengths, b"".join(rows["strings"])))
        first, last = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), _NO_ID)
        np.minimum.at(first, ids, np.frombuffer(b"".join(rows["first"]), "<i8"))
        np.maximum.at(last, ids, np.frombuffer(b"".join(rows["last"]), "<i8"))
        group, string, offset, length, smallest = repeats(strings, first, last)
        if not every:
            useful = smallest < last[string]
            group, string, offset, length, smallest = (x[useful] for x in (group, string, offset, length, smallest))
        order = np.argsort(string, kind="stable")
        n = np.bincount(string, minlength=len(strings))
        begin, n = (np.cumsum(n) - n)[ids], n[ids]
        at = order[_spread(n, begin)]
        # Strings of each block, and where its answers end.
        ends = np.cumsum([len(s) for s in rows["lengths"]])
        sizes = np.diff(ends, prepend=0)
        told = np.append(0, np.cumsum(n))[np.append(0, ends)]
        answer = {
            "string": np.repeat(np.arange(len(ids)) - np.repeat(ends - sizes, sizes), n).astype("<u4"), "offset": offset[at].astype("u1"), "length": length[at].astype("u1"), "smallest": smallest[at].astype("<i8"),
            "repeat": (group[at] + (int(key[0]) << 40)).astype("<i8") if every else np.zeros(0, "<i8"),
        }
        out = [(block, key[0], *(x[lo:hi].tobytes() for x in answer.values())) for block, lo, hi in zip(rows["block"], told[:-1], told[1:], strict=True) if lo < hi]
        return pd.DataFrame(out, columns=["block", "bucket", *answer])

    return run


def _found(block: _Block, bits: pd.DataFrame, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, smallest id, repeat) of every place of a repeat."""
    strings, heads, number, text, place = block.shared_strings(block.shared(bits, buckets), buckets)
    string, offset, length, smallest, repeat = (np.frombuffer(b"".join(answers[c]), t) for c, t in (("string", "<u4"), ("offset", "u1"), ("length", "u1"), ("smallest", "<i8"), ("repeat", "<i8")))
    string = string + np.repeat(heads[answers["bucket"].to_numpy(np.int64)], [len(o) for o in answers["offset"]])
    order = np.argsort(string, kind="stable")
    n = np.bincount(string, minlength=len(strings))
    begin, n = (np.cumsum(n) - n)[number], n[number]
    at = order[_spread(n, begin)]
    return np.repeat(text, n), np.repeat(place, n) + offset[at], length[at].astype(np.int64), smallest[at], repeat[at] if len(repeat) else np.zeros(len(at), np.int64)


def _runs(text: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of bytes that are covered, in order; ``sizes`` of the texts."""
    if not len(text):
        return text, start, start
    base = np.cumsum(sizes + 1) - (sizes + 1)
    begin = base[text] + start
    order = np.argsort(begin, kind="stable")
    text, begin, end = text[order], begin[order], np.maximum.accumulate((begin + length)[order])
    head = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    base = base[text[head]]
    return text[head], begin[head] - base, end[np.append(head[1:], len(end)) - 1] - base


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _apply(buckets: int, columns: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, told = _Block(rows.select(["__id", "__text"]).to_pandas()), answers.to_pandas()
        is_bits = told["bits"].notna()
        text, start, length, smallest, _ = _found(block, told[is_bits], told[~is_bits], buckets)
        removed = smallest < block.ids[text]
        text, start, end = _runs(text[removed], start[removed], length[removed], np.array([len(t) for t in block.texts], np.int64))
        kept: list[bytes] = [b""] * rows.num_rows
        cut = np.searchsorted(text, np.arange(rows.num_rows + 1)).tolist()
        begins, ends = start.tolist(), end.tolist()
        for i, whole in enumerate(block.texts):
            lo, hi = cut[i], cut[i + 1]
            kept[block.rows[i]] = b"".join(whole[a:b] for a, b in zip([0, *ends[lo:hi]], [*begins[lo:hi], len(whole)], strict=True)) if lo < hi else whole
        row = np.array(block.rows, np.int64)[text]
        order = np.argsort(row, kind="stable")
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows.num_rows)))
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(start[order]), pa.array((end - start)[order])], fields=list(_SPANS.value_type)))
        kept = pa.array(kept, pa.binary())
        try:
            text = kept.cast(pa.string())
        except pa.ArrowInvalid:
            # A cut may fall inside a character; in the text, bytes that no longer form one go.
            text = pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())
        return rows.select(columns).append_column("spans", spans).append_column("kept", kept).append_column("kept_text", text)

    return run


def _blocks(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int, int]:
    """__id, __text, __block and __c0, __c1 ... for ``columns`` of every row, the number of buckets, and the least number of tasks."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-size // BLOCK_BYTES))
    buckets = max(parts, blocks // 4)
    # Rows without an id are spread by their text.
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks)).cast("int").alias("__block")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id"), F.col("text").cast("binary").alias("__text"), block]
    return docs.select(*own, *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)]), buckets, -(-size // TASK_BYTES)


def _dealer(spark: SparkSession, tasks: int) -> Callable[[DataFrame, str], DataFrame]:
    """Deals rows by a key into as many tasks as the table needs, where the session's shuffle partitions would be too few."""
    enough = tasks <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lambda df, key: df if enough else df.repartition(tasks, key)


def _exchanged(docs: DataFrame, columns: list[str], every: bool, most: int) -> tuple[DataFrame, DataFrame, int]:
    rows, buckets, tasks = _blocks(docs, columns)
    deal = _dealer(docs.sparkSession, tasks)
    rows = deal(rows, "__block")
    by_block = rows.groupBy("__block")
    told = by_block.applyInPandas(_announce(buckets), "bucket int, block int, codes binary, several binary, more binary")
    bits = deal(told, "bucket").groupBy("bucket").applyInPandas(_shared(most), "block int, bucket int, bits binary, crowded binary")
    sent = by_block.cogroup(deal(bits, "block").groupBy("block")).applyInPandas(_send(buckets), "bucket int, block int, strings binary, lengths binary, first binary, last binary")
    found = deal(sent, "bucket").groupBy("bucket").applyInPandas(_maximal_repeats(every), "block int, bucket int, string binary, offset binary, length binary, smallest binary, repeat binary")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("string", "offset", "length", "smallest", "repeat")]
    answers = bits.select("block", "bucket", "bits", "crowded", *nothing).unionByName(found.withColumns({c: F.lit(None).cast("binary") for c in ("bits", "crowded")}))
    return rows, deal(answers, "block"), buckets


def _doc_id() -> F.Column:
    return F.when(F.col("__id") != _NO_ID, F.col("__id")).alias("doc_id")


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, most: int = MOST_STRINGS) -> DataFrame:
    """doc_id, text (bytes), spans (array of start and length), kept (bytes), kept_text and __c0, __c1 ... for ``columns`` of every row."""
    columns = columns or []
    rows, answers, buckets = _exchanged(docs, columns, every=False, most=most)
    names = ["__id", "__text", *[f"__c{i}" for i in range(len(columns))]]
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(_apply(buckets, names), f"{schema}, spans array<struct<start: long, length: long>>, kept binary, kept_text string")
    return found.select(_doc_id(), F.col("__text").alias("text"), "spans", "kept", "kept_text", *names[2:])


def maximal_repeats(docs: DataFrame, most: int = MOST_STRINGS) -> DataFrame:
    """repeat, length, doc_id and start of all occurrences of each maximal repeat within a stretch, in every document that has it."""
    rows, answers, buckets = _exchanged(docs, [], every=True, most=most)

    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block, is_bits = _Block(rows), answers["bits"].notna()
        text, start, length, _, repeat = _found(block, answers[is_bits], answers[~is_bits], buckets)
        return pd.DataFrame({"repeat": repeat, "length": length, "__id": block.ids[text], "start": start})

    found = rows.groupBy("__block").cogroup(answers.groupBy("block")).applyInPandas(run, "repeat long, length long, __id long, start long")
    return found.select("repeat", "length", _doc_id(), "start")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Every window of MIN_BYTES bytes with the smallest doc_id that has it; texts as hexadecimal digits, in pieces so that a window is found fast.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {_NO_ID}) AS id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), pieces AS (
  SELECT r, id, off, substr(digits, 2 * off + 1, {2 * (512 + MIN_BYTES - 1)}) AS piece FROM (SELECT *, unnest(range(0, len(digits) // 2, 512)) AS off FROM texts)
), windows AS (
  SELECT r, id, off + i AS start, substr(piece, 2 * i + 1, {2 * MIN_BYTES}) AS w FROM (SELECT *, unnest(range(0, len(piece) // 2 - {MIN_BYTES - 1})) AS i FROM pieces)
), firsts AS (
  SELECT w, min(id) AS first FROM windows GROUP BY w HAVING min(id) < max(id)
), covered AS (
  SELECT r, start, start > coalesce(lag(start) OVER (PARTITION BY r ORDER BY start), -{MIN_BYTES} - 1) + {MIN_BYTES} AS fresh FROM windows JOIN firsts USING (w) WHERE first < id
), runs AS (
  SELECT r, run, min(start) AS lo, max(start) + {MIN_BYTES} AS hi FROM (SELECT *, sum(fresh::BIGINT) OVER (PARTITION BY r ORDER BY start) AS run FROM covered) GROUP BY r, run
), cuts AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(digits, 2 * his[i] + 1, 2 * (los[i] - his[i])), '' ORDER BY i) AS digits
  FROM (SELECT r, digits, list_prepend(0, his) AS his, list_append(los, len(digits) // 2) AS los, unnest(range(1, len(his) + 2)) AS i FROM texts JOIN cuts USING (r)) GROUP BY r
)
SELECT doc_id, CAST(len(t.digits) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.digits, t.digits))) AS kept_sha256
FROM texts t LEFT JOIN cuts USING (r) LEFT JOIN kept k USING (r)
"""


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the passages that an earlier document has; columns and types stay, n_chars is counted anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, others)
    cut = F.size("spans") > 0
    found = found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text").cast("string")))
    out = []
    for c in docs.columns:
        value = F.col(c) if c in ("doc_id", "text") else F.col(f"__c{others.index(c)}")
        if c == "n_chars":
            value = F.when(cut, F.length("text")).otherwise(value)
        out.append(value.cast(docs.schema[c].dataType).alias(c))
    return found.select(*out)
