"""Byte-pair encoding by dynamic programming over prefixes, and its decoding.

A pre-token is a string of symbols, one a byte, the last one marked as the end of the word.  An automaton over the whole
vocabulary reports each token that ends at each place.  Of these exactly one is the last token of the prefix's encoding:
the one whose pair with the last token of the shorter prefix is stable, that is, where no merge would ever join symbols
across the border before both sides are complete.  Back-pointers then give the ids.  The result equals applying the merges
in order of rank, without simulating them on the text.

Defined results: a null or empty text has no token and decodes to the empty text.  Equal texts give equal rows; rows are
never merged.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Pre-tokens whose encodings a Python worker remembers; as many of those before them stay until it is full again.
REMEMBERED = 200_000
#: Longer pre-tokens are not remembered, which bounds the bytes as well.
LONGEST_REMEMBERED = 64
_END = "</w>"
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same as ``_SPLIT`` for ordinary texts without other spaces than the blank, and faster.
_SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^ \w]|_)+")


def _odd_characters() -> str:
    """Numerals that are not decimal digits, separators that are spaces to Python alone, and what Python's Unicode does not know yet."""
    odd = [c for c in range(0x110000) if 28 <= c <= 31 or unicodedata.category(chr(c)) in ("Nl", "No", "Cn")]
    ranges, start = [], 0
    for i in range(1, len(odd) + 1):
        if i == len(odd) or odd[i] != odd[i - 1] + 1:
            ranges.append(f"{re.escape(chr(odd[start]))}-{re.escape(chr(odd[i - 1]))}")
            start = i
    return "[" + "".join(ranges) + "]"


_ODD = re.compile(_odd_characters())
_ODD_LATIN = [c for c in range(256) if _ODD.match(chr(c))]


def ordinary(text: str) -> bool:
    """Whether all characters are of a kind that Python's ``re`` and the tokenizers library certainly see alike."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.search(text)
    return not any(c in raw for c in _ODD_LATIN)


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixEncoder:
    """Encoder for vocabularies with ``</w>`` at word ends; symbol b is byte b, symbol 256 + b the same byte at the end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.rank: dict[tuple[int, int], int] = {}
        # The border symbols of each token while it is built: (token, rank of the merge that absorbs it).
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        for c, b in byte_of.items():
            for text in (c, c + _END):
                if text in vocab:
                    self.right[vocab[text]] = self.left[vocab[text]] = [(vocab[text], float("inf"))]
        for rank, pair in enumerate(merges):
            one, two = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[one], vocab[two]] = rank
        for (one, two), rank in self.rank.items():
            # A token that its own border would break up earlier never comes up.
            if one not in self.right or two not in self.right or not self._stable(one, two, rank):
                continue
            made = vocab[self.name[one] + self.name[two]]
            self.right[made] = [*self.right[two][:-1], (two, rank), (made, float("inf"))]
            self.left[made] = [*self.left[one][:-1], (one, rank), (made, float("inf"))]
        self.automaton = ahocorasick.Automaton()
        for token in self.right:
            name = self.name[token]
            ends = name.endswith(_END) and len(name) > len(_END)
            codes = [byte_of[c] for c in (name[: -len(_END)] if ends else name)]
            if ends:
                codes[-1] += 256
            self.automaton.add_word("".join(map(chr, codes)), (len(codes), token))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        # For texts that are not ordinary: the library's own normaliser and splitter.
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(_SPLIT), behavior="removed", invert=True).pre_tokenize_str
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _stable(self, one: int, two: int, until: float = float("inf")) -> bool:
        """Whether no merge crosses the border between the two tokens, before both are complete or before rank ``until``."""
        right, left = self.right[one], self.left[two]
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = right[i], left[j]
            a_end, b_end = min(a_end, until), min(b_end, until)
            rank = self.rank.get((a, b))
            # Of equal ranks, the leftmost merge goes first: before one inside ``two``, after one inside ``one``.
            if rank is not None and rank < a_end and (rank <= b_end if b_end < until else rank < b_end):
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if i < len(right) - 1 and (a_end <= b_end or j == len(left) - 1):
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last, size = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                if last[before] < 0:
                    continue
                key = (last[before], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._stable(*key)
                if not fits:
                    continue
            last[end], size[end] = token, length
        out, at = [], len(raw)
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _remember(self, word: str) -> tuple[bytes, str]:
        if len(self.words) >= REMEMBERED:
            self.older, self.words = self.words, {}
        if len(self.pairs) >= 4 * REMEMBERED:
            self.pairs.clear()
        found = self.older.get(word)
        if found is None:
            ids = self.encode_word(word)
            packed = pack(f"<{len(ids)}I", *ids)
            found = (packed, self.decode(packed))
        if len(word) <= LONGEST_REMEMBERED:
            self.words[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text: the tokens with a space between."""
        ids, names = [], []
        known = self.words.get
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                ids.append(int(self.special[part]).to_bytes(4, "little"))
                names.append(part)
                continue
            if ordinary(part):
                part = _SPACE.sub(" ", part if part.isascii() else unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                words = _SPLIT_PLAIN.findall(part)
            else:
                words = [w for w, _ in self.split(self.normalise(part))]
            found = [known(w) or self._remember(w) for w in words]
            if found:
                of_ids, of_names = zip(*found, strict=True)
                ids += of_ids
                names += of_names
        return b"".join(ids), " ".join(names)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included."""
        return " ".join([self.name[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@cache
def encoder(path: str) -> PrefixEncoder:
    """One for each Python worker and vocabulary file."""
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and decoded of each row of ``docs``; the vocabulary file must be on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [model.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; ids and texts stay in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for i in range(batch.num_rows):
                ids, text = model.encode(batch.column("text")[i].as_py() or "")
                count.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
