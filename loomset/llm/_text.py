"""Byte-level helpers shared by the text operators (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; longer texts are cut into pieces.
CHUNK_BYTES = 2 << 20
#: Bytes of a piece of a long text, at most.
PIECE_BYTES = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, letters and every byte of a multi-byte character.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True

#: Lower case, with one space for each byte outside words.
FOLD = np.where(IS_WORD, LOWER, 32).astype(np.uint8)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def pieces(texts: list[bytes], limit: int | None = None) -> tuple[list[bytes], np.ndarray]:
    """Texts of at most ``limit`` bytes (``PIECE_BYTES``) as they are, longer ones in pieces of whole words, and the text of each piece.

    Where a text is cut depends on that text alone.  A word longer than a piece is cut inside.
    """
    limit = limit or PIECE_BYTES
    out, owner = [], []
    for i, text in enumerate(texts):
        lo = 0
        while len(text) - lo > limit:
            hi = lo + limit
            gaps = np.flatnonzero(~IS_WORD[np.frombuffer(text, np.uint8, limit, lo)])
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
            out.append(text[lo:hi])
            owner.append(i)
            lo = hi
        out.append(text[lo:] if lo else text)
        owner.append(i)
    return out, np.array(owner, dtype=np.int64)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``limit`` bytes each."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes], pad: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space before each and ``pad`` spaces at the end; starts has each text's first byte."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" " * pad, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return raw, starts


def word_spans(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that are not spaces; ``folded`` begins and ends with spaces."""
    solid = folded != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    return edge[0::2], edge[1::2]


def hashed_ngrams(folded: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n bytes from each position on, and whether they lie within one word and its two borders."""
    n_out = len(folded) - max(sizes)
    solid = folded != 32
    code = folded[:n_out].astype(np.uint32)
    inside = np.ones(n_out, dtype=bool)
    for n in range(2, max(sizes) + 1):
        code *= np.uint32(0x01000193)
        code ^= folded[n - 1 : n - 1 + n_out]
        if n > 2:
            inside &= solid[n - 2 : n - 2 + n_out]
        if n in sizes:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - bits)).astype(np.int32), inside.copy()
