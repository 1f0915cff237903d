import duckdb

from loomset.llm import _text, licenses
from tests.llm.cases import empty, odd_documents, prose

STATEMENTS = [
    "Released under the MIT License.", "LICENSED\nunder the  Apache-License, version 2.0", "This work is licensed under CC BY-NC 4.0.", "under the mit\nlicense under the MIT license", "apache license version", "a cc by nc b",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this sofware and more", "the license was under mit released", "Redistribution and use in source and binary forms with or without modification are permitted provided that",
]


def corpus(spark):
    texts = [s for s in STATEMENTS] + [prose(i, 90) + " " + s + " " + prose(i + 50, 31 * i) for i, s in enumerate(STATEMENTS)] + [None, "", "ümlaut " + STATEMENTS[0]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows_of(rows):
    return sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows)


def test_same_as_the_join_without_filters(spark, tmp_path):
    docs = corpus(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cursor = c.execute(licenses.oracle_sql())
    names = [d[0] for d in cursor.description]
    want = rows_of([dict(zip(names, row, strict=True)) for row in cursor.fetchall()])
    found = rows_of([r.asDict() for r in licenses.scan(docs).collect()])
    assert found == want
    by = {r[0]: r for r in found}
    assert by[0][5:7] == ("mit", "mit") and by[1][5:7] == ("apache-2", "apache-2") and by[3][2:5] == (2, 0, 4) and by[4][2] == 0 and by[6][5:7] == ("", "mit") and by[6][7] < 1 and by[7][6] == "mit"
    assert by[18][1:] == (0, 0, None, None, "", "", 0.0) == by[19][1:]


def test_each_filter_lets_something_go():
    frequency = {t: i % 7 for i, t in enumerate(licenses._TOKENS)}
    templates, counts = licenses.Templates(frequency), {}
    whole = [" ".join(t.split()).encode() for _, t in licenses.TEMPLATES]
    texts = whole + [prose(i, 40).encode() + b" " + b" ".join(t.split()[::2]) + prose(i, 40).encode() for i, t in enumerate(whole)]
    found = licenses.matches(texts, templates, counts)
    assert min(counts[k] for k in ("length", "position", "verified", "met")) > 0
    want = set()
    for text, raw in enumerate(texts):
        words = licenses.words_of(raw)
        for block in range(licenses.block_count(len(words))):
            there = set(words[block * licenses.STRIDE : block * licenses.STRIDE + licenses.BLOCK_WORDS])
            want |= {(text, block, t) for t, part in enumerate(templates.words) if len(there.intersection(part)) >= 0.9 * len(part) - 1e-9}
    assert {f[:3] for f in found} == want and all({templates.labels[f[2]] for f in found if f[0] == i} >= {label} for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_texts_in_pieces(monkeypatch):
    texts = [(prose(1, 300) + " Released under the MIT License. " + "y" * 200 + " " + prose(2, 300)).encode(), b"", b"under the mit license " * 40]
    whole = licenses.base_places(texts)
    monkeypatch.setattr(licenses, "PIECE_BYTES", 100)
    monkeypatch.setattr(_text, "PIECE_BYTES", 100)
    cut = licenses.base_places(texts)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1] and [len(licenses.words_of(t)) for t in texts] == cut[0].tolist()


def test_on_odd_tables(spark):
    docs = odd_documents(spark)
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and {r.labels for r in rows if r.doc_id == 17} == {"mit"}
    assert licenses.scan(empty(docs)).count() == 0


def test_hashes_do_not_depend_on_neighbours():
    texts = [b"under the mit license", b"", b"x" * 3000 + b" mit", b"mit"]
    together = [t for t in licenses._scan(texts)[3]]
    assert together == [t for text in texts for t in licenses._scan([text])[3]]
