import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_dedup import firsts_of_similar, slow_repeats
from tests.llm.test_tokens import check_packing

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen[-1], DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append(out.cache())
    text = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    toxic = set(text[0]) - set(text[1])
    assert len(text[0]) > len(text[1]) and sum(labels.get(i) == 0 for i in toxic) <= 0.03 * len(text[0])
    assert len(text[2]) > 0.95 * len(text[1])
    assert sorted(text[3]) == firsts_of_similar(sorted(text[2].items()))
    cut = {i: n for i, _, n, _, _ in slow_repeats([(i, t.encode()) for i, t in text[3].items()])}
    assert set(text[4]) == set(text[3]) and all((text[4][i] == text[3][i]) == (cut[i] == 0) for i in cut)
    rows = corpus_pipeline.STAGES[4][1](spark, seen[4], DATA).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check_packing(rows, {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in text[4].items()}) == 0


def test_run_is_the_stages_in_a_row(spark):
    rows = entry.queries()["pipeline"](spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "packing"]


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_its_query(spark, n):
    names = [q for q in entry.queries() if q.startswith(f"op{n}_")]
    assert len(names) == 1
    rows = entry.queries()[names[0]](spark, DATA)
    assert rows.count() > 0
