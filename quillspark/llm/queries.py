"""The registered queries of this subpackage: op<N>_<name> and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, common, embedding_dedup, jaccard, langid, line_dedup, mixing, packing, periodic, suffix_dedup, token_counts, token_file


def vocabulary(name: str) -> str:
    """A public tokenizer file's path; it is the same on every machine that has the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, max_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    decimal = F.expr("replace(trim(BOTH '[]' FROM cast(ids AS string)), ', ', ' ')")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), run=3).select("doc_id", "n_lines", "n_removed", "text")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_file.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train_on_documents(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), passage=50)
    repeated = F.expr("aggregate(runs, 0L, (s, x) -> s + x.b - x.a + 1)")
    return found.select("doc_id", "n_words", repeated.alias("n_repeated"), F.expr("array_join(transform(runs, x -> concat(x.a, '-', x.b)), ',')").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, overlap=50, top=2000)


#: A share of the documents repeats some of its own words with a period that follows from its id.
_REPEATED = r"""CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0 THEN
    transform(array(named_struct('g', crc32(cast(cast(doc_id AS string) AS binary)) div 10, 'w', filter(split(cast(text AS string), '[\\x20\\x09-\\x0D]+', -1), x -> x != ''))),
        d -> CASE WHEN size(d.w) > 0 THEN array_join(transform(array(named_struct('w', d.w, 'a', cast(d.g % size(d.w) AS int), 'p', cast(1 + (size(d.w) - d.g % size(d.w)) div (3 + d.g % 8) AS int))),
            e -> array_join(transform(e.w, (x, i) -> CASE WHEN i < e.a THEN x ELSE e.w[e.a + (i - e.a) % e.p] END), ' ')), '') ELSE '' END)[0]
    ELSE cast(text AS string) END"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_REPEATED).alias("text"))
    found = periodic.periodic_runs(docs, copies=4, least=6)
    best = F.expr("aggregate(runs, cast(NULL AS struct<start: bigint, length: bigint, period: bigint>), (b, x) -> CASE WHEN b IS NULL OR x.length * b.period > b.length * x.period THEN x ELSE b END)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_file": op4_token_file,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_nearest": op7_nearest,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op3_line_dedup": line_dedup.oracle_sql(3), "op5_embedding_dedup": embedding_dedup.oracle_sql(0.98), "op6_jaccard_join": jaccard.oracle_sql(0.8, 5), "op9_suffix_dedup": suffix_dedup.oracle_sql(50), "op11_collocations": collocations.oracle_sql(), "op13_mixing": mixing.oracle_sql()}
