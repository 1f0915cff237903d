import math
import resource
import zlib

import numpy as np
import pytest

from loomset.llm import _text, langid, toxicity
from tests.llm.cases import empty, labels_for, odd_documents, prose

BAD = ["gloomp", "snarfle", "vexidor"]


def toxic_corpus(n=400):
    texts, toxic = [], []
    for i in range(n):
        words = prose(i, 40 + i % 60).split()
        if i % 3 == 0:
            for k in range(3):
                words.insert((i * 7 + k * 11) % len(words), BAD[(i // 3 + k) % 3])
        texts.append(" ".join(words).encode())
        toxic.append(i % 3 == 0)
    return texts, np.array(toxic)


def test_toxicity_learns_and_knows_misspellings():
    texts, toxic = toxic_corpus()
    model = toxicity.train(texts[:300], toxic[:300])
    found = toxicity.probabilities(model, texts[300:]) >= 0.5
    assert (found == toxic[300:]).mean() > 0.95
    unseen = [prose(999, 30).encode() + b" gloompp snarflle " + prose(998, 10).encode(), prose(997, 50).encode()]
    assert list(toxicity.probabilities(model, unseen) >= 0.5) == [True, False]
    assert list(toxicity.probabilities(model, [b"", b" .. "])) == [0.0, 0.0]
    # The score of a text does not depend on what stands beside it.
    assert np.allclose(toxicity.probabilities(model, texts[300:310]), [toxicity.probabilities(model, [t])[0] for t in texts[300:310]])
    assert toxicity.train(texts[:5], np.zeros(5, bool)) is None and list(toxicity.probabilities(None, texts[:2])) == [0.0, 0.0]


def bucket_of(gram, bits):
    code = gram[0]
    for byte in gram[1:]:
        code = code * 0x01000193 % 2**32 ^ byte
    return ((code ^ code >> 15) * 0x9E3779B1 % 2**32) >> 32 - bits


def grams_of(word, sizes):
    bordered = b" " + word + b" "
    return [(n, bordered[i : i + n]) for n in sizes for i in range(len(bordered) - n + 1)]


def words_in(text):
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in text.lower()).split()


def test_scores_are_those_of_plain_loops():
    weight = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    for text in (b"One two, two TWO three four five six. Seven; eight seven", "é b ñandu".encode(), b"god dog listen silent stop pots good", b"a b", prose(5, 40).encode()):
        every = words_in(text)
        words = [w for i, w in enumerate(every) if not i or w != every[i - 1]]
        bags = [words[i : i + toxicity.BAG_WORDS] for i in range(0, len(words), toxicity.BAG_WORDS)]
        of = [[weight[bucket_of(g, toxicity.BITS)] for w in bag for _, g in grams_of(w, toxicity.NGRAMS)] for bag in bags]
        want = max(float(np.mean(x)) if x else 0.0 for x in of)
        assert abs(toxicity.worst_bag([b"other words", text], weight)[1] - want) < 1e-4


def test_only_equal_words_count_as_repeated():
    raw, starts = _text.joined([b"god dog listen silent stop pots good good Good"])
    assert toxicity._folded(raw, starts).tobytes().split() == b"god dog listen silent stop pots good".split()
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    for _, g in grams_of(b"tinsel", toxicity.NGRAMS):
        weight[bucket_of(g, toxicity.BITS)] = 9
    assert toxicity.worst_bag([b"silent tinsel"], weight)[0] > 1 and toxicity.worst_bag([b"silent enlist"], weight)[0] < 1


def test_pieces_and_long_texts(monkeypatch, model):
    texts = [b"", b"ab cd", b"x" * 25, "wörter und wörter und".encode() * 3]
    cut, owner = _text.pieces(texts, 10)
    assert [b"".join(c for c, o in zip(cut, owner, strict=True) if o == i) for i in range(4)] == texts and max(map(len, cut)) <= 10
    weight = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    long = b" ".join(prose(i, 2000).encode() for i in range(2000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(long) > 20e6 and np.isfinite(toxicity.worst_bag([long], weight)[0])
    assert langid.predict(model, [long])[0][0] in model.languages
    # A pass holds some 2 MB of text, however long the text is.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    assert 0.5 * toxicity.FIT_TEXT_BYTES < len(toxicity.sampled_text(long)) < 1.5 * toxicity.FIT_TEXT_BYTES


def test_fits_take_the_first_rows_by_hash_whatever_their_number(spark):
    texts, toxic = toxic_corpus(120)
    docs = spark.createDataFrame([(i, t.decode(), "aa" if i % 40 else "bb") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, fit_rows=20) is not None
    # The rare language is learned too.
    assert langid.fit(docs, fit_rows=5).languages == ["aa", "bb"]


def test_toxicity_on_odd_tables(spark):
    docs = odd_documents(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels_for(spark, docs))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(empty(docs), toxicity.fit(empty(docs), empty(labels_for(spark, docs)))).count() == 0
    kept = toxicity.keep_clean(docs, empty(labels_for(spark, docs)))
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_toxicity_ignores_the_held_out_fold(spark):
    texts, toxic = toxic_corpus(120)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    known = [(i, int(x)) for i, x in enumerate(toxic)]
    turned = [(i, 1 - x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, x) for i, x in known]
    scores = [[r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(k, "doc_id long, toxic int"))).orderBy("doc_id").collect()] for k in (known, turned)]
    assert scores[0] == scores[1]


SYLLABLES = {"aa": ["ka", "lo", "mi", "tar", "ven"], "bb": ["schu", "bre", "wirz", "ung", "ich"], "cc": ["oui", "eau", "tre", "ñez", "çon"]}


def speech(lang, seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang], r.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return langid.train({lang: langid.ngram_counts([speech(lang, s, 200).encode() for s in range(10)]) for lang in SYLLABLES})


def test_language_mixtures(model):
    texts = [speech("aa", 50, 80), speech("bb", 51, 80), speech("cc", 52, 9), speech("aa", 53, 240) + " " + speech("bb", 54, 80)]
    name, share, number = langid.predict(model, [t.encode() for t in texts])
    assert name == ["aa", "bb", "cc", "aa"] and list(number[:3]) == [1, 1, 1] and number[3] == 2
    assert min(share[:3]) > 0.99 and abs(share[3] - 0.75) < 0.06
    shares, _ = langid.mixtures([texts[3].encode()], model)
    assert abs(shares.sum() - 1) < 1e-9


def slow_mixture(like, n_steps):
    """Shares and log-likelihood of one text by plain loops, all languages allowed that ``like`` has."""
    langs = len(like[0])
    share = [1 / langs] * langs
    for _ in range(n_steps):
        parts = [[p * s / sum(x * y for x, y in zip(row, share, strict=True)) for p, s in zip(row, share, strict=True)] for row in like]
        share = [sum(p[j] for p in parts) / len(parts) for j in range(langs)]
    return share, sum(math.log(sum(p * s for p, s in zip(row, share, strict=True))) for row in like)


def test_mixture_is_that_of_plain_loops(model):
    for text in (speech("aa", 1, 60) + " " + speech("cc", 2, 30), speech("bb", 3, 9), speech("aa", 4, 20) + " " + speech("bb", 5, 20) + " " + speech("cc", 6, 20)):
        words = words_in(text.encode())
        rows = []
        for i in range(0, len(words), langid.SEGMENT_WORDS):
            total = [0.0] * 3
            for w in words[i : i + langid.SEGMENT_WORDS]:
                for n, g in grams_of(w, langid.NGRAMS):
                    total = [t + float(x) for t, x in zip(total, model.logp[langid.NGRAMS.index(n)][bucket_of(g, langid.BITS)], strict=True)]
            rows.append([langid.TEMPER * t for t in total])
        like = [[math.exp(max(t - max(r), -60)) for t in r] for r in rows]
        full, _ = slow_mixture(like, langid.EM_STEPS)
        order = sorted(range(3), key=lambda j: -full[j])
        best = None
        for k in (1, 2, 3):
            used = order[:k]
            share, value = slow_mixture([[r[j] for j in used] for r in like], langid.EM_STEPS)
            value -= 0.5 * (k - 1) * math.log(len(rows) + 1)
            if best is None or value > best[0] + 1e-9:
                best = value, dict(zip(used, share, strict=True)), k
        name, share, number = langid.predict(model, [text.encode()])
        assert number[0] == best[2] and name[0] == model.languages[max(best[1], key=best[1].get)] and abs(share[0] - max(best[1].values())) < 1e-3


def test_a_text_is_judged_by_itself(model):
    texts = [(speech("aa", i, 30) + " " + speech("bb", i, i % 40) + " " + speech("cc", i, 13)).encode() for i in range(40)]
    together, alone = langid.mixtures(texts, model), [langid.mixtures([t], model) for t in texts]
    assert np.allclose(together[0], np.concatenate([a[0] for a in alone])) and list(together[1]) == [a[1][0] for a in alone]


def test_unknown_languages_go(spark):
    rows = [(i, speech("aa" if i % 2 else "bb", i, 40), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, speech("cc", 3, 40), None), (101, "", None), (102, speech("aa", 7, 40), None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {*range(60), 102}
    assert {r.doc_id for r in langid.keep_identified(docs, accepted=("aa",)).collect()} == {*range(1, 60, 2), 102}


def test_language_on_odd_tables(spark):
    docs = odd_documents(spark)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    assert len(rows) == docs.count()
    of = {r.doc_id: r for r in rows if r.doc_id not in (None, 2)}
    for i in (0, 1, 3, 6, 7):
        assert (of[i].lang_pred, of[i].score) == ("und", 0.0)
    assert of[8].lang_pred == "en" and 0 < of[8].score <= 1
    assert all(r.lang_pred == "und" for r in langid.identify(docs, langid.fit(empty(docs))).collect())
    assert langid.identify(empty(docs), langid.fit(docs)).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} >= {8, 9, 12} and not {0, 1, 3, 6, 7} & {r.doc_id for r in kept.collect()}


def test_language_ignores_the_held_out_fold(spark):
    rows = [(i, speech("aa" if i % 2 else "bb", i, 30), "aa" if i % 2 else "bb") for i in range(80)]
    turned = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    found = [langid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, turned)]
    assert found[0].languages == found[1].languages == ["aa", "bb"] and (found[0].logp == found[1].logp).all()
