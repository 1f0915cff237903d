"""License scan by an exact set-similarity join of text blocks with templates.

A text's words are cut into blocks of ``BLOCK_WORDS`` words, one every half block, and a template, which may be a whole license, into
parts of at most half a block; so a part that stands in a text lies whole in one of the text's blocks, whatever its line breaks.  A
block meets a part if it has at least ``CONTAINMENT`` of the part's different words.  Words of templates are ordered by their
frequency in the whole corpus, rarest first, and blocks and parts are compared in this order:

* prefix filter: a block that misses all of a part's rarest words cannot reach the required overlap any more;
* length filter: a block with fewer different words of templates than the required overlap cannot meet the part;
* positional filter: with the first shared word at position i of the part and j of the block, at most one and the lesser number of
  words behind either can be shared.

What passes is verified on the words themselves.  The filters lose nothing, so the join is exact.

Base labels come from phrases whose words stand one after the other.

Defined results: a null or empty text, or one without words, has no label, score 0.0 and null places.  The score is the
largest containment among a text's matches, 1.0 with a base label, 0.0 without a match.  Label lists without a label are
empty texts.  Repeated rows are scanned each for itself.  Very long texts are read in pieces; words and blocks run across them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import FOLD, PIECE_BYTES, as_bytes, chunks, joined, pieces, word_spans

BLOCK_WORDS = 64
STRIDE = BLOCK_WORDS // 2
CONTAINMENT = 0.9
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and labels of the base scan.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License statements and texts in their usual wording.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
     without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
     the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
     Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
     PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
     notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
     FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
     AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version
     3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
     retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
     endorse or promote products derived from this software without specific prior written permission."""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
]


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # of bytes: A to Z only


_PHRASES = [(words_of(p.encode()), label) for p, label in BASE_PHRASES.items()]
_TOKENS = sorted({w for p, _ in _PHRASES for w in p} | {w for _, t in TEMPLATES for w in words_of(t.encode())})


def _parts(text: str) -> list[list[bytes]]:
    """The words of a template in parts of about equal length, at most half a block."""
    words = words_of(text.encode())
    n = -(-len(words) // STRIDE)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


_SETS = [(label, sorted(set(part))) for label, t in TEMPLATES for part in _parts(t)]
_CODE = np.random.default_rng(23).integers(1, 1 << 63, 256).astype(np.uint64)
_STEP = 0x9E3779B97F4A7C15


def word_hashes(folded: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = end - first
    longest = int(size.max())
    power = np.full(longest, _STEP, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = within + np.repeat(first, size)
    heads = np.cumsum(size) - size
    return np.add.reduceat(_CODE[folded[at]] * power[within], heads)


def _hash_of(word: bytes) -> int:
    folded = np.frombuffer(b" " + word + b" ", np.uint8)
    return int(word_hashes(folded, np.array([1]), np.array([1 + len(word)]))[0])


_HASHES = np.array([_hash_of(t) for t in _TOKENS], dtype=np.uint64)
_BY_HASH = np.argsort(_HASHES)


_LONG = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{65,}")


def _scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; begin, end, and template-token number (or -1) of each word; first word of each text, and one past the last of all.

    Hashing needs some thirty times the bytes that it looks at, so it goes by pieces of texts.  In texts of several pieces, words
    longer than any token are shortened first, so that no cut falls inside one.
    """
    cut, owner = pieces([_LONG.sub(b"x" * 65, t) if len(t) > PIECE_BYTES else t for t in texts])
    found, offset = [], 0
    for lo, hi in chunks(cut):
        raw, starts = joined(cut[lo:hi])
        folded = FOLD[raw]
        first, end = word_spans(folded)
        hashes = word_hashes(folded, first, end)
        at = np.minimum(np.searchsorted(_HASHES[_BY_HASH], hashes), len(_TOKENS) - 1)
        token = np.where(_HASHES[_BY_HASH][at] == hashes, _BY_HASH[at], -1)
        found.append((folded, first + offset, end + offset, token, owner[lo + np.searchsorted(starts, first, side="right") - 1]))
        offset += len(folded)
    if not found:
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(len(texts) + 1, np.int64)
    folded, first, end, token, text = (np.concatenate(f) for f in zip(*found, strict=True))
    return folded, first, end, token, np.searchsorted(text, np.arange(len(texts) + 1))


def token_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Occurrences in all texts of each word that a template has; a few dozen rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_TOKENS), dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in chunks(texts):
                token = _scan(texts[lo:hi])[3]
                total += np.bincount(token[token >= 0], minlength=len(_TOKENS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(_TOKENS), dtype=np.int32)), pa.array(total)], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {_TOKENS[r.token]: r.n for r in rows}


class Templates:
    """Parts of templates in the global order of words, with their prefixes."""

    def __init__(self, frequency: dict[bytes, int], containment: float = CONTAINMENT):
        order = sorted(range(len(_TOKENS)), key=lambda i: (frequency.get(_TOKENS[i], 0), _TOKENS[i]))
        #: Place of each token in the global order; -1 stands behind all for words that are no token.
        self.rank = np.append(np.argsort(order), -1)
        place = {t: int(self.rank[i]) for i, t in enumerate(_TOKENS)}
        self.containment = containment
        self.labels = [label for label, _ in _SETS]
        self.words = [words for _, words in _SETS]
        self.ranks = [sorted(place[w] for w in words) for words in self.words]
        self.need = [math.ceil(containment * len(words) - 1e-9) for words in self.words]
        # For each rank: the parts in whose prefix it stands, and where.
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.ranks):
            for i, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                self.prefix.setdefault(r, []).append((t, i))
        self.is_prefix = np.isin(self.rank, list(self.prefix))


def block_count(words: int) -> int:
    return max(1, -(-(words - STRIDE) // STRIDE))


def matches(texts: list[bytes], templates: Templates, counts: dict[str, int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """(text, block, part, shared words, containment) of every block and part that meet; ``counts`` gets what each filter let go."""
    out, counts = [], {} if counts is None else counts
    said = lambda name: counts.__setitem__(name, counts.get(name, 0) + 1)
    folded, first, end, token, bound = _scan(texts)
    at = np.flatnonzero(templates.is_prefix[token])
    owner = np.searchsorted(bound, at, side="right") - 1
    own = (at - bound[owner]) // STRIDE
    blocks = np.unique(np.concatenate((np.stack((owner, own - 1), axis=1), np.stack((owner, own), axis=1))), axis=0)
    for text, block in blocks.tolist():
        lo, hi = int(bound[text]), int(bound[text + 1])
        if not 0 <= block < block_count(hi - lo):
            continue
        span = slice(lo + block * STRIDE, min(hi, lo + block * STRIDE + BLOCK_WORDS))
        ranks = np.unique(templates.rank[token[span]])
        ranks = ranks[ranks >= 0].tolist()
        there, words, seen = set(ranks), None, set()
        for j, r in enumerate(ranks):
            for t, i in templates.prefix.get(r, ()):
                if t in seen:
                    continue
                # The first word that block and part share, as every rarer word of the part is in its prefix too.
                seen.add(t)
                need, size = templates.need[t], len(templates.ranks[t])
                if len(ranks) < need:
                    said("length")
                elif min(size - i, len(ranks) - j) < need:
                    said("position")
                elif len(there.intersection(templates.ranks[t])) < need:
                    said("verified")
                else:
                    if words is None:
                        words = {folded[a:b].tobytes() for a, b in zip(first[span].tolist(), end[span].tolist(), strict=True)}
                    count = sum(word in words for word in templates.words[t])
                    if count >= need:
                        said("met")
                        out.append((text, block, t, count, count / size))
    return out


def base_places(texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """Number of words of each text, and its (first word, label) of every place where a phrase stands."""
    folded, first, end, token, bound = _scan(texts)
    found: list[list[tuple[int, str]]] = [[] for _ in texts]
    for words, label in _PHRASES:
        numbers = [_TOKENS.index(w) for w in words]
        n = len(token) - len(words) + 1
        if n <= 0:
            continue
        hit = np.ones(n, dtype=bool)
        for j, number in enumerate(numbers):
            hit &= token[j : j + n] == number
        for w in np.flatnonzero(hit).tolist():
            text = int(np.searchsorted(bound, w, side="right")) - 1
            same = all(folded[first[w + j] : end[w + j]].tobytes() == word for j, word in enumerate(words))
            if same and w + len(words) <= bound[text + 1]:
                found[text].append((w - int(bound[text]), label))
    return np.diff(bound), found


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: words, base places, labels and score."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(token_frequencies(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in chunks(texts):
                counts, places = base_places(texts[lo:hi])
                labels = [{label for _, label in p} for p in places]
                base = [",".join(sorted(x)) for x in labels]
                score = [1.0 if p else 0.0 for p in places]
                for text, _, t, _, share in matches(texts[lo:hi], templates):
                    labels[text].add(templates.labels[t])
                    score[text] = max(score[text], share)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array(counts), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p)[0] if p else None for p in places], pa.int64()),
                        pa.array([max(p)[0] if p else None for p in places], pa.int64()), pa.array(base, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """The same join without any filter, for DuckDB."""
    listed = lambda words: "[" + ", ".join("'" + w.decode() + "'" for w in words) + "]"
    phrases = ", ".join(f"({listed(p)}, '{label}')" for p, label in _PHRASES)
    sets = ", ".join(f"({listed(w)}, '{label}')" for label, w in _SETS)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), phrases(p, label) AS (VALUES {phrases}), sets(s, label) AS (VALUES {sets}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words) - len(p) + 1), lambda i: words[i + 1 : i + len(p)] = p)) AS place FROM w, phrases
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, list_distinct(words[k * {STRIDE} + 1 : k * {STRIDE} + {BLOCK_WORDS}]) AS block
  FROM (SELECT doc_id, words, unnest(range(greatest(1, CAST(ceil((len(words) - {STRIDE}) / {STRIDE}.0) AS BIGINT)))) AS k FROM w)
), met AS (
  SELECT doc_id, label, len(list_intersect(s, block)) / CAST(len(s) AS DOUBLE) AS share FROM blocks, sets
), both_labels AS (
  SELECT doc_id, label, share FROM met WHERE share >= {CONTAINMENT - 1e-9} UNION ALL SELECT doc_id, label, 1.0 FROM places
), named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM both_labels GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
"""
