"""The registered queries against their SQL, and the pipeline against brute force."""

import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import check, database  # noqa: E402

from quillspark.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    check(queries.QUERIES[name](spark, SF), database(SF), queries.ORACLES[name])


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken away")
def test_pipeline_against_model(spark, tmp_path):
    import public_tokenizers as P
    from test_llm_operators import jaccard_model, lines_model, packed, passages_model, tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "suffix_array_dedup", "packing"]
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text)]
    cleaned = lines_model(rows, 3)
    rows = [(k, t) for k, (t, _) in cleaned.items() if t.strip()]
    model = jaccard_model(rows, 0.8, 5)
    rows = [(k, t) for k, t in rows if model[k][1] == k]
    gone = passages_model(rows, 50)
    left = {k: [w for i, w in enumerate(t.split()) if i not in gone[k]] for k, t in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {k for k, w in left.items() if w}
    t = tokenizer("byte_bpe_50k.json")
    texts = dict(rows)
    for k in left:
        if left[k] and not gone[k]:
            own = sorted((r for r in out if r.doc_id == k), key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == packed(t.encode(texts[k], add_special_tokens=False).ids + [1])
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns, name
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
    assert P.path("byte_bpe_50k.json")
