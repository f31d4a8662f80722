"""Empty tables, repeated rows, clashing columns and very long texts, for operators and pipeline stages."""

import importlib.util

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, common, jaccard, langid, line_dedup, packing, suffix_dedup, token_counts, token_file
from quillspark.llm.chunks import library_encoder

SCHEMA = "doc_id long, text string, ids string, th long, n int, fp long, start int"
BYTES, RANKS, WORDS, PIECES = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 7, 1, 2, 3) for k, t in rows], SCHEMA)


OPERATORS = {
    "pack": lambda df: packing.pack(df, BYTES).filter("start = 0"),
    "encode": lambda df: bpe.encode(df, RANKS, P.PATTERN, decoded=True),
    "lines": lambda df: line_dedup.dedup_lines(df, run=3),
    "jaccard": lambda df: jaccard.similar_documents(df),
    "passages": lambda df: suffix_dedup.repeated_passages(df),
    "counts": lambda df: token_counts.token_counts(df, PIECES),
    "language": lambda df: langid.identify(df, langid.LanguageModel(["aa"], np.ones((1 << 16, 1), np.float32), np.zeros(1), 1.0, 16)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_repeated(spark, name):
    """An empty table gives no rows; every repeated row is answered; nulls and clashing columns do no harm."""
    apply = OPERATORS[name]
    assert apply(frame(spark, [])).count() == 0
    rows = [(1, "one two three\nfour\nfive"), (1, "one two three\nfour\nfive"), (1, "other"), (None, None), (None, "null id"), (None, "null id"), (2, ""), (3, None)]
    out = apply(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(k) for k, _ in rows)


def test_token_file_orders_equal_ids_by_their_text(spark, tmp_path):
    rows = [(5, "b c"), (5, "a"), (None, "z"), (4, "y"), (5, "a")]
    path = f"file://{tmp_path}/file"
    token_file.write_tokens(frame(spark, rows), path, WORDS)
    got = sorted(token_file.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 4, 5, 5, 5]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    hashes = [h for _, h in sorted((spark.sql(f"SELECT xxhash64('{t}')").first()[0], t) for k, t in rows if k == 5)]
    library = Tokenizer.from_file(WORDS)
    assert [bytes(r.ids) for r in got[2:]] == [np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in hashes]


@pytest.mark.parametrize("unit", ["lorem ipsum dolor, sit amet\n", "x" * 97 + "é"])
def test_texts_of_ten_megabytes(unit):
    """A very long text, with and without spaces, is tokenised whole."""
    text = unit * (10_000_000 // len(unit.encode()))
    short = unit * 400
    ranks = bpe.load_ranks(RANKS)
    encoder = bpe.text_encoder(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encoder.encode(pa.array([short]))[0].tolist() == library.encode_ordinary(short)
    ids, counts = encoder.encode(pa.array([text, "a"]))
    tokens = bpe._token_bytes(RANKS)
    assert bpe._decoded(ids, counts, tokens).to_pylist() == [text.encode(), b"a"]
    if " " in unit:
        packed, n = library_encoder(WORDS, False).encode(pa.array([text]))
        assert packed.tolist() == Tokenizer.from_file(WORDS).encode(unit, add_special_tokens=False).ids * (10_000_000 // len(unit)) and n.tolist() == [len(packed)]


def test_working_tables_are_deleted_at_the_end_of_their_block(spark):
    kept = common.stored(spark.range(3), "kept")
    with common.working_tables(spark):
        gone = common.stored(spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*gone.inputFiles()).count()


def test_hot_join_keeps_every_row(spark):
    """A key of a third of the rows is dealt to several tasks; the rows are those of a plain join."""
    large = spark.range(9000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = common.join_hot(large, small, ["k"], ["id"], how)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=repr) == sorted(map(tuple, large.join(small, "k", how).select("k", "id", "v").collect()), key=repr)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken away")
def test_pipeline_stages_at_the_edges(spark, tmp_path):
    """Every stage takes an empty table, null ids and texts, repeated rows and clashing columns, and keeps the columns."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, th long, ids string, runs int"
    clean = "The river ran past the old mill and the children played near the bridge until the evening bells rang. "
    rows = [(1, clean * 3, "en"), (None, clean.upper() * 2, "en"), (2, None, "en"), (3, "", None), (4, clean * 3, "en"), (4, clean * 3, "en"), (5, "a\nb\nc", "en"), (6, "Der Fluss lief an der alten Mühle vorbei. " * 4, "de")]
    for data in ([], rows):
        docs = spark.createDataFrame([(k, t, lang, "s", 0, 1, "x", 2) for k, t, lang in data], schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"file://{tmp_path}/{len(data)}-{name}"
            out = stage(spark, docs, "")
            assert i == 4 or out.columns == docs.columns, name
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(data)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken away")
def test_pipeline_stages_delete_nothing_that_is_read(spark, tmp_path):
    """Lazy stages can be chained, and a stage of another run in between takes nothing from this one."""
    import corpus_pipeline

    def docs(n):
        rows = [(i, f"line {i % n} of a text with words enough\nsecond line {i % n}\nthird line {i % n} here\n" + "x y z " * 20) for i in range(20)]
        return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    chained = corpus_pipeline.jaccard_join(spark, corpus_pipeline.line_deduplication(spark, docs(20), ""), "")
    other = corpus_pipeline.line_deduplication(spark, docs(7), "")
    assert chained.count() > 0 and other.count() > 0
    stages = dict(corpus_pipeline.STAGES)
    lazy = stages["suffix_array_dedup"](spark, stages["line_dedup"](spark, docs(20), ""), "")
    assert lazy.count() > 0
    first = stages["line_dedup"](spark, docs(20), "")
    first.write.parquet(f"file://{tmp_path}/first")
    written = spark.read.parquet(f"file://{tmp_path}/first")
    assert stages["jaccard_join"](spark, written, "").count() == written.count()
    with pytest.raises(Exception):  # noqa: B017  (its tables went when the next stage began)
        spark.catalog.clearCache()
        first.count()
