"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote and its decisions take effect: documents without a
recognisable language go, repeated runs of lines are cut out, one document of each group of near
duplicates stays, repeated passages are cut out, and what is left is packed.  A document of
which nothing is left goes.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard, langid, line_dedup, packing, suffix_dedup
from quillspark.llm.common import delete, new_folder, recorded, working_tables
from quillspark.llm.queries import vocabulary


def _reads(docs: DataFrame, path: str) -> bool:
    """Whether the frame reads a table under the path."""
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    return any(f"/{folder}/" in file for file in docs.inputFiles())


def _staged(function):
    """A stage for use as in STAGES: its result is written before the next one is called.

    The working tables of the stage before are then deleted when this one begins, unless ``docs`` still reads them.
    The functions themselves delete nothing, so their lazy results can be chained.
    """

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _TABLES.get()
        done = [path for path in before if not _reads(docs, path)]
        for path in done:
            delete(spark, path)
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _TABLES.set([path for path in before if path not in done] + paths)
        return out

    return staged


#: Working tables of the stages called last, by this thread or task.
_TABLES: ContextVar[list[str]] = ContextVar("tables", default=[])


def _documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars counted anew and emptied documents left out."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.filter(F.col("text").rlike(r"\S")).select(like.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, langid.train_on_documents(docs)).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.dedup_lines(docs, run=3), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard.similar_documents(docs, threshold=0.8, shingle=5, hashed=True).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_th"))
    text = docs["text"].cast("string")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(text) == F.col("_th")), "left_anti")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(docs, passage=50)
    return _documents(suffix_dedup.remove_passages(docs, found), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller batches than packing by itself: the workers of the stages before are still there
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, max_len=2048, batch_bytes=1_500_000)


STAGES = [
    ("language_id", _staged(language_id)),
    ("line_dedup", _staged(line_deduplication)),
    ("jaccard_join", _staged(jaccard_join)),
    ("suffix_array_dedup", _staged(suffix_array_dedup)),
    ("packing", _staged(pack)),
]

#: A trained classifier, MinHash and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's working tables, and what the stage before wrote, are deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with working_tables(spark):
            stage.__wrapped__(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
