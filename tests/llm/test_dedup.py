import hashlib
import random
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomset.llm import simhash, suffix_dedup
from loomset.llm.components import components
from tests.llm.cases import empty, odd_documents, prose


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    lead = {i: i for i in ids}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for x, a in enumerate(ids):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 4:
                p, q = sorted((find(a), find(ids[y])))
                lead[q] = p
    return [find(i) for i in ids]


def near_corpus():
    r = random.Random(4)
    texts = [prose(i, 80) for i in range(20)]
    for i in range(60):
        words = texts[i % 7].split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "edit" + str(i)
        texts.append(" ".join(words))
    return texts + [None, "", "  ", "Some Words", "some\twords", "UPPER Case ß É"] + [texts[0]] * 5


@pytest.mark.parametrize("tile, parts", [(None, None), (4, 5), (1024, 6), (8, 7)])
def test_simhash_against_brute_force(spark, monkeypatch, tile, parts):
    if tile:
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "segments_for", lambda n: parts)
    texts = near_corpus()
    docs = spark.createDataFrame([(i * 3 + 1, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, a int").repartition(3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids, prints = [i * 3 + 1 for i in range(len(texts))], [slow_fingerprint(t) for t in texts]
    assert found == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, slow_components(ids, prints), strict=True)}
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {c for _, c in found.values()}


def test_segments():
    assert [len(simhash.segment_masks(p)) for p in (5, 6, 7)] == [5, 15, 35]
    assert simhash.segments_for(10**5) == 5 and simhash.segments_for(10**7) == 6 and simhash.segments_for(10**10) > 6


def test_links_of_random_and_close_prints():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40).astype(np.uint64)
    near = np.array([b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, r.integers(1, 6), replace=False))) for b in np.repeat(base, 6)], dtype=np.uint64)
    fps = np.unique(np.concatenate((base, near)))
    group, tile = np.arange(len(fps)) % 2, np.arange(len(fps)) % 3
    table = simhash.pivot_table(fps)

    def groups(pairs):
        forest = simhash.Forest(len(fps))
        for i, j in pairs:
            forest.union(int(i), int(j))
        return [forest.find(i) for i in range(len(fps))]

    linked = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1) & (group[:, None] == group[None, :])
    for across in (np.zeros(len(fps), bool), np.ones(len(fps), bool)):
        want = linked & (~across[:, None] | (tile[:, None] != tile[None, :]))
        i, j, (seen, passed, found) = simhash.links(fps, table, group, tile, across)
        assert groups(zip(i, j, strict=True)) == groups(np.argwhere(want)) and found == want.sum()
        # The table discards most pairs before any is verified.
        assert found <= passed < 0.2 * seen
    assert simhash.links(fps[:0], table[:0], group[:0], tile[:0], across[:0])[2].tolist() == [0, 0, 0]


def test_every_pair_goes_through_the_pivot_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = simhash.with_table(simhash.fingerprints(docs).select("fp").distinct())
    counts = np.zeros(3, np.int64)
    for _, rows in simhash.fingerprint_cells(tables).toPandas().groupby("bucket"):
        counts += simhash.compared(rows)[1]
    seen, passed, found = counts.tolist()
    assert seen > 100 and found <= passed < seen


def test_simhash_on_odd_tables(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = spark.createDataFrame([(5, prose("a", 40)), (5, prose("b", 40)), (4, prose("a", 40)), (None, prose("c", 40))], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(texts).collect()) == [(-1, -1), (4, 4), (5, 4), (5, 5)]
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0} and {r.doc_id for r in zero} >= {0, 1, 2, 3}
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.keep_one(empty(docs)).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts_of_similar(rows):
    """Ids of the first row of each component of pairs with a similarity of 0.8 in runs of five words."""
    sets = [shingles(t) for _, t in rows]
    lead = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9:
                lead = [lead[y] if v == lead[x] else v for v in lead]
    groups = {}
    for v, (i, _) in zip(lead, rows, strict=True):
        groups.setdefault(v, []).append(i)
    return sorted((min(g, key=lambda i: (i is None, i)) for g in groups.values()), key=lambda i: (i is None, i))


@pytest.mark.parametrize(("tile", "leaders"), [(2, 1), (3, 8), (1024, 8)])
def test_near_copies_by_similarity(spark, monkeypatch, tile, leaders):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    r, texts = random.Random(6), []
    for i in range(12):
        base = prose(f"n{i}", 150)
        texts.append(base)
        for edits in (1, 2, 3, 4, 9):
            words = base.split()
            for k in r.sample(range(10, 140), edits):
                words[k] = f"edit{i}x{k}"
            texts.append(" ".join(words))
    # One word in most places gives equal fingerprints to texts that share little else.
    texts += ["spam " * 200 + prose("p", 60), "spam " * 200 + prose("q", 60), None, "", "three words here", "Three words here"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(i for i, _ in simhash.keep_one_similar(docs).collect()) == firsts_of_similar(rows)


def test_a_large_group_of_near_copies_costs_its_number(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    base, texts = prose("h", 200).split(), []
    for i in range(300):
        words = list(base)
        words[i % 200] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[:120], *prose(f"o{i}", 40).split()]) for i in range(5)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed, dealt = [], []
    groups, compared = simhash._band_groups, simhash._compared_sets
    monkeypatch.setattr(simhash, "_band_groups", lambda r: placed.append(groups(r)) or placed[-1])
    monkeypatch.setattr(simhash, "_compared_sets", lambda cells, *a: dealt.append(cells) or compared(cells, *a))
    assert sorted(i for i, _ in simhash.keep_one_similar(docs).collect()) == firsts_of_similar(rows)
    n = placed[0].count()
    # All pairs of tiles would take each member 38 times.
    assert n > 1000 and len(dealt) == 2 and dealt[0].count() <= 2 * n + 1000 and dealt[1].count() <= 4 * n


def test_recall_of_bands():
    r = random.Random(2)
    met, pairs = 0, 0
    for i in range(200):
        words = prose(f"r{i}", 300).split()
        other = list(words)
        for k in range(r.randrange(25), 300, 43):
            other[k] = "edited"
        a, b = (simhash.shingle_set(" ".join(w).encode(), 5) for w in (words, other))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.78 * (len(a) + len(b) - shared):
            pairs += 1
            met += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert pairs > 100 and met >= 0.98 * pairs


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_one_similar])
def test_kept_rows_without_id_and_repeated_rows(spark, keep):
    docs = odd_documents(spark)
    twice = docs.where("doc_id = 13 OR doc_id IS NULL")
    kept = keep(docs.unionByName(twice))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.schema == docs.schema and len(ids) == len(set(ids)) and {None, 0, 13} <= set(ids) and not {1, 2, 3} & set(ids)
    clean = spark.createDataFrame([(None, prose("u", 60)), (None, prose("v", 60)), (4, prose("w", 60)), (4, prose("w", 60)), (None, prose("w", 60))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in keep(clean).collect()) == sorted([(0, prose("u", 60)), (0, prose("v", 60)), (4, prose("w", 60))])


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 80)]
    edges = spark.createDataFrame([*path, *hub, (7, 7), (3, 2), (200, 150)], "a long, b long")
    found = {r.id: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 180)}, 150: 100, 200: 100}
    assert components(edges.where("false")).count() == 0


def slow_repeats(rows):
    """(bytes, removed, runs, digest) of each row, from all windows."""
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], i), i)
    out = []
    for i, t in rows:
        gone = [False] * (len(t) + 1)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, len(r.text or b""), sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("task", [2000, 1 << 26])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, task):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task)
    r = random.Random(8)
    base = [prose(i, 70) for i in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            at = r.randrange(len(b) - 60)
            parts.append(b[at : at + r.randint(20, 200)] + ("é" if r.random() < 0.3 else "") + prose(r.random(), r.randint(0, 5)))
        rows.append((r.randrange(50), " ".join(parts)))
    rows += [(70 + i, base[0]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(suffix_dedup.remove_repeats(docs)) == slow_repeats([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("most", [1, 5])
def test_suffix_dedup_with_crowded_minimizers(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 700)
    line = prose(1, 14)
    rows = [(i % 50, prose(f"a{i}", 6) + line + prose(f"b{i}", 6)) for i in range(80)] + [(70 + i, prose(2, 40)) for i in range(5)] + [(None, line * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = slow_repeats([(-(1 << 63) if i is None else i, t.encode()) for i, t in rows])
    assert digests(suffix_dedup.remove_repeats(docs, most=most)) == want
    assert {(r.doc_id, r.start + k) for r in suffix_dedup.maximal_repeats(docs, most=most).collect() for k in range(r.length)} == {
        (r.doc_id, r.start + k) for r in suffix_dedup.maximal_repeats(docs).collect() for k in range(r.length)
    }


def test_a_passage_in_many_surroundings_is_spread_over_buckets(spark):
    line, n = prose(1, 40), 6000
    docs = spark.createDataFrame([(i, f"{i * 7919 % 100003:08d}" * 5 + line + f"{i * 104729 % 100003:08d}" * 5) for i in range(n)], "doc_id long, text string")
    sent = {}
    # The step that sends strings to buckets, without Spark: one block of all documents.
    rows = docs.selectExpr("doc_id AS __id", "CAST(text AS BINARY) AS __text").toPandas()
    bits = suffix_dedup._announce(64)((0,), rows)
    answer = suffix_dedup._shared(suffix_dedup.MOST_STRINGS)(bits)
    for r in suffix_dedup._send(64)((0,), rows, answer).itertuples():
        sent[r.bucket] = len(r.lengths)
    assert sum(sent.values()) > n and max(sent.values()) < 4 * sum(sent.values()) / 64


@pytest.mark.parametrize("times", [0, 2])
def test_a_block_finds_its_stretches_once(monkeypatch, times):
    calls, found = [], suffix_dedup._stretches
    monkeypatch.setattr(suffix_dedup, "_stretches", lambda pieces: calls.append(len(pieces)) or found(pieces))
    monkeypatch.setattr(suffix_dedup, "KEEP_BLOCKS", times)
    block = suffix_dedup._Block(pd.DataFrame({"__id": [2, 1, 3], "__text": [prose(1, 40).encode(), (prose(1, 40) + prose(2, 9)).encode(), b"short"]}))
    code = block.codes(8)
    sent = list(block.shared_stretches((code, np.zeros(len(code), bool)), 8))
    assert len(calls) == (1 if times else 2) and (np.diff(code.astype(object)) > 0).all()
    # Every window lies in one stretch.
    assert all(block.texts[t][p : p + len(s)] == s for _, s, t, p in sent)
    assert sorted((t, p + k) for _, s, t, p in sent for k in range(len(s) - 49)) == [(t, k) for t, x in enumerate(block.texts) for k in range(len(x) - 49)]


def test_stretches_are_found_in_small_passes():
    r = random.Random(5)
    texts = [prose(i, n).encode() for i, n in enumerate((30, 20000, 400, 9, 30000))] + [b"x" * 70000, bytes(150000), r.randbytes(65536 - 49), r.randbytes(65537), b"short"]
    windows, strings = set(), {}
    for buffer, begin, end, text, place, code, *_ in suffix_dedup.stretches(texts):
        assert len(buffer) <= 1 << 16
        for lo, hi, t, p, c in zip(begin.tolist(), end.tolist(), text.tolist(), place.tolist(), code.tolist(), strict=True):
            assert 50 <= hi - lo <= 80 and texts[t][p : p + hi - lo] == buffer[lo:hi]
            for k in range(hi - lo - 49):
                assert (t, p + k) not in windows and strings.setdefault(buffer[lo + k : lo + k + 50], c) == c
                windows.add((t, p + k))
    assert len(windows) == sum(max(0, len(t) - 49) for t in texts)


def test_a_block_is_worked_on_in_arrays():
    ids, texts = list(range(40)), [prose(i // 2, 3000).encode() for i in range(40)]
    rows, calls = pd.DataFrame({"__id": ids, "__text": texts}), []

    def steps():
        bits = suffix_dedup._shared(suffix_dedup.MOST_STRINGS)(suffix_dedup._announce(64)((0,), rows))
        sent = suffix_dedup._send(64)((0,), rows, bits)
        found = pd.concat([suffix_dedup._maximal_repeats(False)((b,), sent[sent["bucket"] == b]) for b in sent["bucket"]])
        answers = pa.Table.from_pandas(pd.concat([bits, found]).astype({"block": "int32", "bucket": "int32"}), preserve_index=False)
        out = suffix_dedup._apply(64, ["__id", "__text"])((0,), pa.table({"__id": ids, "__text": texts}), answers)
        return sent, out

    sent, out = steps()
    assert out["kept"].to_pylist() == [b"" if i % 2 else t for i, t in enumerate(texts)]
    assert out["spans"].to_pylist() == [[{"start": 0, "length": len(t)}] if i % 2 else [] for i, t in enumerate(texts)]
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event in ("call", "c_call") else None)
    try:
        suffix_dedup._send(64)((0,), rows, suffix_dedup._shared(suffix_dedup.MOST_STRINGS)(suffix_dedup._announce(64)((0,), rows)))
    finally:
        sys.setprofile(None)
    # No Python for each string.
    assert len(calls) < 0.5 * sent["lengths"].map(len).sum()


def test_suffix_dedup_of_texts_beyond_one_pass(spark):
    long = prose(1, 16000)
    rows = [(3, prose(2, 7) + long), (1, long), (2, "x" * 70000), (5, "y" + "x" * 66000 + prose(3, 20)), (4, prose(4, 14000) + long[-300:] + "é" * 40), (6, "e" + "é" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert digests(suffix_dedup.remove_repeats(docs)) == slow_repeats([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_on_odd_tables(spark):
    docs = odd_documents(spark)
    rows = [(-(1 << 63) if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert digests(suffix_dedup.remove_repeats(docs)) == slow_repeats(rows)
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0
    cut = suffix_dedup.keep_first_passages(docs)
    assert cut.columns == docs.columns and [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]
    before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, cut))
    assert set(before) == set(after) and after[0].text is None and after[8] == before[8] and after[9].text == "" and after[9].n_chars == 0 and after[12] == before[12]


def test_repeats_of_maximal_strings(spark):
    same, other = prose(1, 30), prose(2, 30)
    docs = spark.createDataFrame([(1, "a" + same + "b"), (2, "c" + same + "d"), (3, other), (4, "e" + other + "f" + same + "g")], "doc_id long, text string")
    places = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    covered = {i: set() for i in texts}
    for r in suffix_dedup.maximal_repeats(docs).collect():
        string = texts[r.doc_id][r.start : r.start + r.length]
        assert places.setdefault(r["repeat"], string) == string and r.length >= 50
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert {i: "".join(texts[i][k] for k in sorted(c)) for i, c in covered.items()} == {1: same, 2: same, 3: other, 4: other + same}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12))
def test_interval_tree_nodes(strings):
    suffixes = sorted({s[i:] for s in strings for i in range(len(s))})
    common = [0] * len(suffixes)
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        common[i] = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    nodes = suffix_dedup.interval_tree(np.array(common, dtype=np.int64), 2) if suffixes else []
    want = set()
    for i in range(len(suffixes)):
        for j in range(i + 1, len(suffixes)):
            least = min(common[i + 1 : j + 1])
            if least >= 2 and (i == 0 or common[i] < least) and (j + 1 == len(suffixes) or common[j + 1] < least):
                want.add((least, i, j))
    assert set(nodes) == want and len(nodes) == len(want)


@pytest.mark.parametrize("most", [3, 8192])
def test_near_copies_are_found_by_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    r, texts = random.Random(7), []
    for i in range(12):
        base = prose(f"f{i}", 150)
        texts.append(base)
        for edits in (1, 2, 3, 9):
            words = base.split()
            for k in r.sample(range(10, 140), edits):
                words[k] = f"edit{i}x{k}"
            texts.append(" ".join(words))
    texts += ["spam " * 200 + prose("p", 60), "spam " * 200 + prose("q", 60), None, "", "three words here", "Three words here"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(i for i, _ in simhash.keep_one_near(docs).collect()) == firsts_of_similar(rows)
    assert simhash.keep_one_near(empty(docs)).count() == 0


def test_a_group_of_near_copies_gives_one_link_for_each(spark):
    rng = np.random.default_rng(4)
    bits, n = np.repeat(rng.integers(0, 2, (3, simhash.WIDE)), (300, 20, 1), axis=0), 321
    bits ^= rng.random(bits.shape) < 0.03
    prints = spark.createDataFrame([(i + 1, np.packbits(b.astype(np.uint8)).tobytes()) for i, b in enumerate(bits)], "key long, print binary").repartition(3)
    edges = simhash.candidates(prints, 0.8).select("a", "b")
    assert edges.count() < 1.5 * n
    assert {r.id: r.component for r in components(edges).collect()} == {i: 1 if i <= 300 else 301 for i in range(1, n)}


def test_the_pipeline_finds_near_copies_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    def no(*_):
        raise AssertionError("candidates of another method")

    monkeypatch.setattr(simhash, "_set_rows", no)
    docs = spark.createDataFrame([(3, prose("x", 80)), (2, prose("x", 80) + " more"), (5, prose("y", 80))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [2, 5]


def test_wide_fingerprints_and_their_blocks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    flipped = base.copy()
    flipped[:, 0] ^= np.uint64((1 << 20) - 1)
    prints, cell = np.concatenate([base, flipped]), np.tile(np.arange(40) % 2, 2)
    found, counts = simhash.near_prints(prints, cell)
    assert {tuple(sorted((int(i), int(j)))) for i, j in found} == {(i, i + 40) for i in range(40)}
    assert counts[0] >= counts[1] >= counts[2] == 40
    for n in (10, 10**5, 10**7):
        blocks = simhash.blocks_for(n, 0.8)
        met, tried = 0, 400
        for _ in range(tried):
            a = rng.integers(0, 2, simhash.WIDE)
            b = a ^ (rng.random(simhash.WIDE) < 0.1514)
            met += bool((simhash.block_values(a[None], blocks) == simhash.block_values(b[None], blocks)).any())
        assert met >= 0.97 * tried
