import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomset.llm import bpe, packing, sharding
from tests.llm.cases import empty, odd_documents, odd_texts, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["aaa aaaa aaaaaaaaaaaa", "it's I'LL don't 'tis _a_ __", "x² ½ Ⅷ ٣", "Hello <|endoftext|> world<|startoftext|>x<|endoftext|>", "ΑΣ ΣΑΣ", "é É İI ſ", "a\x1cb\x1dc  d e", "日本語 テスト", "😀👩‍👩‍👧", "ha" * 300, "  two  spaces \n\n lines\t\ttabs "]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def pieces():
    return Tokenizer.from_file(BYTE)


def test_bpe_is_the_librarys(words):
    model = bpe.encoder(WORD)
    r = random.Random(1)
    texts = [t or "" for t in odd_texts()] + HARD + [prose(i, 50) for i in range(20)] + [" ".join("".join(r.choice("abceilnorst") for _ in range(r.randint(1, 14))) for _ in range(400))]
    for text in texts:
        want = words.encode(text, add_special_tokens=False).ids
        ids, decoded = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == words.decode(want, skip_special_tokens=False) == model.decode(ids), text[:40]


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=40))
def test_bpe_on_any_text(text):
    words = Tokenizer.from_file(WORD) if not hasattr(test_bpe_on_any_text, "t") else test_bpe_on_any_text.t
    test_bpe_on_any_text.t = words
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert np.frombuffer(bpe.encoder(WORD).encode(text)[0], "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_bpe_tables(spark, words):
    docs = odd_documents(spark)
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, WORD).collect()}
    assert len(rows) == docs.count() - 1 and rows[0].ids == b"" and rows[0].decoded == ""
    assert np.frombuffer(rows[12].ids, "<u4").tolist() == words.encode(odd_texts()[12], add_special_tokens=False).ids
    assert bpe.encode_digests(docs, WORD).count() == docs.count() and bpe.encode_digests(empty(docs), WORD).count() == 0


def test_byte_tokenizer_is_the_librarys(pieces):
    model = packing.tokenizer(BYTE)
    for text in [t or "" for t in odd_texts()] + HARD:
        assert model.encode(text).tolist() == pieces.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=40))
def test_byte_tokenizer_on_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    t = test_byte_tokenizer_on_any_text.__dict__.setdefault("t", Tokenizer.from_file(BYTE))
    assert packing.tokenizer(BYTE).encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check_packing(rows, ids_of, limit=2048, segments=256):
    """Each id in exactly one piece, sequences without gaps and within limits."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, parts in by_doc.items():
        ids, at = ids_of[doc], 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    waste = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limit and len(parts) <= segments
        waste += 0 if at & (at - 1) == 0 else limit - at
    return waste


def test_packing_of_documents(spark, pieces):
    docs = odd_documents(spark).where("doc_id IS NOT NULL AND NOT (doc_id = 2 AND n_chars = 1 AND block = 2 AND source = 'src0' AND lang = 'en' AND score = 0.5 AND fp = 'b' AND spans[0] = 2)")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, prose(i, 5 + 37 * i % 900)) for i in range(60)], "doc_id long, text string")).repartition(3)
    docs = docs.dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack_documents(docs, BYTE).collect()
    assert check_packing(rows, {i: [*pieces.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}) == 0 and {r.doc_id for r in rows} == set(texts)
    assert packing.pack_documents(empty(docs), BYTE).count() == 0


def slow_choice(pieces, target, limits):
    """(piece, tokens taken) of one sequence by plain loops; a piece is (tokens, loss tokens at its end)."""
    room, out, used = [target, limits[1], limits[2]], [], set()
    while room[0] and room[1]:
        best = None
        for i, (tokens, loss) in enumerate(pieces):
            if i not in used and tokens and tokens <= room[0] and loss <= room[2]:
                value = sum(d / limit * r / limit for d, r, limit in zip((tokens, 1, loss), room, limits, strict=True))
                if best is None or value > best[0] + 1e-12:
                    best = value, i, tokens
        if best is None:
            fronts = [(0 if i in used else max(0, min(tokens, room[0], tokens - loss + room[2])), tokens, -i) for i, (tokens, loss) in enumerate(pieces)]
            take, _, i = max(fronts)
            if not take:
                break
            best = 0, -i, take
        _, i, take = best
        used.add(i)
        out.append((i, take))
        room = [room[0] - take, room[1] - 1, room[2] - max(0, take - (pieces[i][0] - pieces[i][1]))]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 4)), min_size=1, max_size=25))
def test_choice_is_that_of_plain_loops(examples):
    pieces = [(n, n - n * k // 4) for n, k in examples]
    packer = packing.Packer(64, 6, 40)
    for i, (n, loss) in enumerate(pieces):
        packer.add(i, n, loss)
    total = sum(n for n, _ in pieces)
    target = min(64, 1 << total.bit_length() - 1)
    packer.pack(final=True)
    want, size = slow_choice(pieces, target, (64, 6, 40)), 0
    size = sum(t for _, t in want)
    size = size if size == target else 1 << size.bit_length() - 1
    cut, at = [], 0
    for i, take in want:
        if at < size:
            cut.append((i, min(take, size - at)))
            at += take
    assert [(e, n) for e, _, n, sequence, _ in packer.placed if sequence == 0] == cut


def test_short_documents_need_no_padding(spark):
    docs = spark.createDataFrame([(i, "a b c d"[: 1 + 2 * (i % 4)] if i % 9 else prose(i, 700)) for i in range(6000)], "doc_id long, text string").repartition(2)
    sizes = {}
    for r in packing.pack_documents(docs, BYTE).collect():
        sizes.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(s) & (sum(s) - 1) == 0 and len(s) <= packing.MAX_SEGMENTS for s in sizes.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 120), st.floats(0, 1)), min_size=1, max_size=80), st.sampled_from([8, 16, 32, 64]), st.integers(1, 6), st.integers(4, 64))
def test_packer_keeps_its_limits(examples, tokens, segments, loss):
    packer = packing.Packer(tokens, segments, loss)
    bearing = {i: (n, round(n * share)) for i, (n, share) in enumerate(examples)}
    for i, (n, k) in bearing.items():
        packer.add(i, n, k)
        if i % 10 == 9:
            packer.pack()
    packer.pack(final=True)
    seen, by = {i: set() for i in bearing}, {}
    for e, start, length, sequence, offset in packer.placed:
        assert not seen[e] & set(range(start, start + length))
        seen[e] |= set(range(start, start + length))
        by.setdefault(sequence, []).append((offset, length, sum(p >= bearing[e][0] - bearing[e][1] for p in range(start, start + length))))
    assert all(seen[i] == set(range(n)) for i, (n, _) in bearing.items())
    for parts in by.values():
        assert sum(p[1] for p in parts) <= tokens and len(parts) <= segments and sum(p[2] for p in parts) <= loss


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, seed):
    there = sharding.permute(np.arange(n), n, seed)
    assert sorted(there.tolist()) == list(range(n)) and (sharding.permute(there, n, seed, back=True) == np.arange(n)).all()


def test_sharding(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs, 7).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(7))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r.doc_id not in (None, 2):
            raw = (text[r.doc_id] or "").encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    again = sharding.shard_documents(docs.repartition(2), 7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(empty(docs)).count() == 0
    numbers = sharding.numbered(docs.select("doc_id", "text"), ["doc_id", "text"])[0].select("row_number", "doc_id").orderBy("row_number").collect()
    assert [r.row_number for r in numbers] == list(range(len(numbers))) and numbers[0].doc_id is None
