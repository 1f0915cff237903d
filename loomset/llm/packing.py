"""Packing of tokenized examples by the dot-product heuristic for vector bins.

A sequence has three limits: tokens, segments and loss-bearing tokens.  An open sequence takes, of the pieces that fit, the
one whose demand has the largest dot product with the room left in all three, each as a share of its limit; so a sequence
short of loss tokens takes prompt-heavy pieces and one short of segments takes long ones.  When no piece fits whole, the
longest front that does is cut off and the rest stays.  A sequence that a limit ends before it is full is cut back to a power
of two, and so is what is left at the end of a task; such sequences need no padding.

Documents have no marked prompts, so a fixed rule stands in for them: the first sixteenth of a document's tokens
(``PROMPT_PART``) is its prompt and bears no loss, and a sequence holds at most ``MAX_LOSS`` tokens that do.

Every task packs its own rows, so nothing is shuffled and no token leaves the task that made it; a rerun of a lost task
repeats the same numbers.

Defined results: a null or empty text is the single end token.  doc_id may be null or repeated; each row is packed.  Equal
documents give equal pieces up to their place.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LONGEST_REMEMBERED, REMEMBERED, byte_symbols, ordinary

END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 256
MAX_LOSS = 1984
#: One in so many tokens of a document, its first ones, is prompt.
PROMPT_PART = 16
#: Pieces that wait in a task before it packs them.
POOL = 3000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ordinary texts, and faster.
_SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary file whose merges are in the order of their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text in special:
            ranks.pop(text.encode(), None)
        self.model = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {text: np.uint32(i).tobytes() for text, i in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.words: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)

    def _remember(self, word: str) -> bytes:
        found = np.array(self.model.encode_ordinary(word), dtype="<u4").tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.words) >= 2 * REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens' strings included as such."""
        out = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            if ordinary(part):
                known = self.words.get
                out += [known(w) or self._remember(w) for w in _SPLIT_PLAIN.findall(part)]
            else:
                out.append(np.array(self.library.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return np.frombuffer(b"".join(out), dtype="<u4")


@cache
def tokenizer(path: str) -> ByteTokenizer:
    """One for each Python worker and vocabulary file."""
    return ByteTokenizer(path)


class Packer:
    """Pieces of examples placed into sequences.  An example is ``size`` tokens of which the last ``loss`` bear loss.

    ``placed`` gets (example, start, length, sequence, offset) for each piece.
    """

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.waiting: list[tuple[int, int, int, int]] = []  # example, start, tokens left, loss tokens of the whole example
        self.sequence = 0
        self.placed: list[tuple[int, int, int, int, int]] = []

    def add(self, example: int, size: int, loss: int) -> None:
        self.waiting.append((example, 0, size, loss))

    def pack(self, final: bool = False) -> None:
        """Fill sequences from what waits; unless ``final``, less than one sequence's tokens may stay waiting."""
        if not self.waiting:
            return
        table = np.array(self.waiting, dtype=np.int64)
        example, start, tokens, whole = (table[:, k].copy() for k in range(4))
        left, full = int(tokens.sum()), int(self.limits[0])
        while left >= full or final and left:
            left -= self._fill(min(full, 1 << left.bit_length() - 1) if final else full, example, start, tokens, whole)
        alive = np.flatnonzero(tokens)
        self.waiting = list(zip(*(x[alive].tolist() for x in (example, start, tokens, whole)), strict=True))

    def _fill(self, target: int, example: np.ndarray, start: np.ndarray, tokens: np.ndarray, whole: np.ndarray) -> int:
        """One sequence of ``target`` tokens, or of the largest power of two that its limits allow; returns how many it took."""
        _, segments, loss_room = self.limits
        room, weight = target, 1 / self.limits**2
        # Loss tokens are an example's last ones, and what waits of it always reaches to its end.
        loss = np.minimum(tokens, whole)
        free, open_, taken = tokens - loss, tokens > 0, []
        while room and segments:
            fits = open_ & (tokens <= room) & (loss <= loss_room)
            gain = np.where(fits, tokens * (room * weight[0]) + segments * weight[1] + loss * (loss_room * weight[2]), -1.0)
            i = int(gain.argmax())
            take = int(tokens[i])
            if gain[i] < 0:
                # None fits whole: the longest front that does, of equal ones the front of the longest piece.
                front = np.where(open_, np.minimum(np.minimum(tokens, room), free + int(loss_room)), 0)
                i = int((front * 4096.0 + np.minimum(tokens, 4095) * (front > 0)).argmax())
                take = int(front[i])
                if take <= 0:
                    break
            taken.append((i, take))
            open_[i] = False
            room, segments, loss_room = room - take, segments - 1, loss_room - max(0, take - int(free[i]))
        size = target - room
        if room:
            # A limit ended it: it is cut back to a power of two, which needs no padding.
            size = 1 << size.bit_length() - 1
        offset = 0
        for i, take in taken:
            take = min(take, size - offset)
            if take <= 0:
                break
            self.placed.append((int(example[i]), int(start[i]), take, self.sequence, offset))
            start[i] += take
            tokens[i] -= take
            offset += take
        self.sequence += 1
        return size


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """Pieces of all rows of ``docs``, each document's ids followed by the end token.

    The vocabulary file must be on every executor.  sequence_id holds the task's number in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = tokenizer(path), Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        seen = 0

        def done() -> pa.RecordBatch:
            rows = packer.placed
            crc = [zlib.crc32(held[e][1][s : s + n].tobytes()) for e, s, n, _, _ in rows]
            columns = [
                pa.array([held[e][0] for e, *_ in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(crc, pa.int64()),
                pa.array([len(held[e][1]) for e, *_ in rows], pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            packer.placed = []
            waiting = {w[0] for w in packer.waiting}
            for e in [e for e in held if e not in waiting]:
                del held[e]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                found = np.append(model.encode(batch.column("text")[i].as_py() or ""), np.uint32(END_ID)).astype("<u4")
                held[seen] = (ids[i], found)
                packer.add(seen, len(found), len(found) - len(found) // PROMPT_PART)
                seen += 1
                if len(packer.waiting) >= POOL or len(packer.placed) >= 4 * POOL:
                    packer.pack()
                    yield done()
        packer.pack(final=True)
        if packer.placed:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
