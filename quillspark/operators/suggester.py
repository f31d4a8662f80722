"""Spelling of whole phrases, and completion of what is being typed, from written tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import PREFIX, _bucket, buckets_of, dealt, fuzzy_terms, opened, start_of, write_deletions


def _tallies(batches: Iterable[pa.RecordBatch], most: int = 1 << 22, rows: int = 1 << 16) -> Iterable[pa.RecordBatch]:
    """(first, term, n): how often each word (first: null) and each pair of words in a row occurs in every run of lists with about ``most`` words."""

    def told(lists: list[pa.Array]) -> Iterable[pa.RecordBatch]:
        whole = pa.concat_arrays(lists)
        coded = whole.flatten().dictionary_encode()
        terms = coded.dictionary
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.bincount(code[code >= 0], minlength=len(terms))
        both = (code[:-1] >= 0) & (code[1:] >= 0)
        ends = np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
        both[ends[(ends > 0) & (ends < len(code))] - 1] = False  # a list's last word and the next one's first
        pair, m = np.unique((code[:-1] * len(terms) + code[1:])[both], return_counts=True)
        words = pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.string()), terms, pa.array(n, pa.int64())], names=["first", "term", "n"])
        pairs = [terms.take(pa.array(pair // max(len(terms), 1))), terms.take(pa.array(pair % max(len(terms), 1))), pa.array(m, pa.int64())]
        for out in (words, pa.RecordBatch.from_arrays(pairs, names=["first", "term", "n"])):
            yield from (out.slice(i, rows) for i in range(0, len(out), rows))

    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        column = batch.column(0)
        ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most - size, "right")))
            held.append(column.slice(start, stop - start))
            size, start = size + int(ends[stop - 1] - base), stop
            if size >= most or start < len(ends):
                yield from told(held)
                held, size = [], 0
    if held:
        yield from told(held)


def write_phrase_model(docs: DataFrame, terms: Column, path: str, buckets: int = 16) -> None:
    """Counts of words and of pairs of words in a row, and the words' deletions, in folders by a hash.

    Null and empty arrays count for nothing, nor does a null word, which parts its neighbours.  The texts are read once: words and pairs
    are counted where their texts are, and the counts are shuffled once, dealt to the folders they are written to.
    """
    spark = docs.sparkSession
    counted = docs.select(terms.alias("w")).filter(F.size("w") > 0).mapInArrow(_tallies, "first string, term string, n long")
    by = ["words", "bucket", "first", "term"]
    counted = counted.withColumns({"words": F.col("first").isNull(), "bucket": _bucket(buckets, start_of(F.coalesce("first", "term")))})
    summed = dealt(counted, buckets, "term").groupBy("_turn", *by).agg(F.sum("n").alias("n")).drop("_turn")
    summed.sortWithinPartitions(*by).write.partitionBy("words", "bucket").parquet(f"{path}/counts")
    words = _counts(spark, path, True)
    words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/totals")
    write_deletions(words, path, buckets)


def _counts(spark: SparkSession, path: str, words: bool) -> DataFrame:
    return opened(spark, path, "counts").filter(F.col("words") if words else ~F.col("words")).drop("words")


def spelling_edits(word: str) -> int:
    """Two edits for words of four characters or more; shorter ones are taken as they are."""
    return 2 if len(word) >= 4 else 0


def phrase_suggestions(spark: SparkSession, path: str, query: Sequence[str], size: int = 1, errors: int = 1, candidates: int = 5, real: float = 0.95, discount: float = 0.4, unseen: float = 0.5) -> DataFrame:
    """(suggestion, score): spellings of the query that are likelier than the query itself, the best ``size`` first.

    A word of four characters or more may be replaced by a more frequent one within two edits that begins alike, by the ``candidates`` nearest
    of them, and ``errors`` words at most.  A phrase's score is the sum of logarithms of each word's probability after the word before it and of its channel:
    ``real`` for a word kept, 1 - distance / length for one replaced.  A pair that never occurs backs off to ``discount`` times the word's
    own probability, a word that never occurs counts ``unseen``.  No query, and one with nothing better, give no rows.
    """
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("total").alias("total"), F.max("buckets").alias("buckets")).first()
    if not query or not totals.total:
        return spark.createDataFrame([], "suggestion string, score double")
    words = list(dict.fromkeys(query))
    folders = lambda values: F.col("bucket").isin(buckets_of({v[:PREFIX] for v in values}, totals.buckets))
    counts = _counts(spark, path, True).drop("first")
    found = fuzzy_terms(spark, path, words, totals.buckets, counts, spelling_edits)
    near = found.filter((F.col("term") != F.col("word")) & (F.substring("term", 1, 1) == F.substring("word", 1, 1))).withColumn("distance", F.levenshtein("term", "word"))
    own = counts.filter(folders(words) & F.col("term").isin(words)).select(F.col("term").alias("word"), F.col("n").alias("own"))
    near = near.join(F.broadcast(own), "word", "left").filter(F.col("n") > F.coalesce("own", F.lit(0)))  # own: the query's words
    nth = F.row_number().over(Window.partitionBy("slot").orderBy("distance", F.desc("n"), "term"))
    options: dict[str, list[tuple[str, float]]] = {w: [] for w in words}
    for r in near.withColumn("nth", nth).filter(F.col("nth") <= candidates).collect():  # candidates for each word of the query
        options[r.word].append((r.term, 1.0 - r.distance / max(len(r.term), len(r.word))))
    variants = {tuple(query): [real] * len(query)}
    for at in itertools.chain.from_iterable(itertools.combinations(range(len(query)), e) for e in range(1, errors + 1)):
        for chosen in itertools.product(*[options[query[i]] for i in at]):
            spelt, channel = list(query), [real] * len(query)
            for i, (term, likelihood) in zip(at, chosen, strict=True):
                spelt[i], channel[i] = term, likelihood
            variants.setdefault(tuple(spelt), channel)
    rows = [(i, w, v[j - 1] if j else None, c[j], " ".join(v)) for i, (v, c) in enumerate(variants.items()) for j, w in enumerate(v)]
    tried = spark.createDataFrame(rows, "id int, term string, first string, channel double, suggestion string")
    used, before = sorted({r[1] for r in rows}), sorted({r[2] for r in rows if r[2] is not None})
    # what the variants are made of: read by folder and word, then small
    single = counts.filter(folders(used) & F.col("term").isin(used)).select("term", "n")
    pairs = _counts(spark, path, False).filter(folders(before) & F.col("first").isin(before) & F.col("term").isin(used)).select("first", "term", F.col("n").alias("both"))
    prior = single.select(F.col("term").alias("first"), F.col("n").alias("n_first"))
    met = tried.join(single, "term", "left").join(pairs, ["first", "term"], "left").join(prior, "first", "left")
    alone = F.coalesce(F.col("n").cast("double"), F.lit(unseen)) / F.lit(float(totals.total))
    likely = F.when(F.col("first").isNull(), alone).otherwise(F.coalesce(F.col("both") / F.col("n_first"), discount * alone))
    scored = met.groupBy("id", "suggestion").agg(F.round(F.sum(F.log(likely) + F.log("channel")), 9).alias("score"))
    itself = F.broadcast(scored.filter("id = 0").select(F.col("score").alias("_own")))  # one row
    better = scored.join(itself).filter((F.col("id") > 0) & (F.col("score") > F.col("_own")))
    return better.select("suggestion", "score").orderBy(F.desc("score"), "suggestion").limit(size)


_NOT_WORD = r"[^\p{L}\p{N}]+"


def _plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), _NOT_WORD, " "))


def write_completions(texts: DataFrame, columns: Sequence[str], path: str, short: int = 3, k: int = 20, group_bytes: int = 1 << 20) -> None:
    """Every distinct value under each of its words' starts, in sorted files, and the first ``k`` values for each short prefix.

    Values are compared in lower case with one space between words.  Nulls and values without a letter or digit complete nothing.
    """
    spark = texts.sparkSession
    values = texts.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).filter("value IS NOT NULL").distinct()
    words = values.select("value", F.split(_plain(F.col("value")), " ").alias("w")).filter(F.col("w")[0] != "")
    starts = words.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))).alias("start")).distinct()
    starts.repartitionByRange("start", "value").sortWithinPartitions("start", "value").write.option("parquet.block.size", group_bytes).parquet(f"{path}/starts")
    starts = spark.read.parquet(f"{path}/starts")
    heads = starts.select("value", F.explode(F.sequence(F.lit(1), F.least(F.lit(short), F.length("start")))).alias("n"), "start").select(F.substring("start", F.lit(1), F.col("n")).alias("prefix"), "value").distinct()
    heads = heads.withColumn("_slice", F.pmod(F.xxhash64("value"), F.lit(64)))  # a short prefix may have very many values
    for keys in (["prefix", "_slice"], ["prefix"]):
        heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).filter(F.col("nth") <= k)
    heads.select("prefix", "value").repartitionByRange("prefix").sortWithinPartitions("prefix", "value").write.parquet(f"{path}/short")
    spark.createDataFrame([(short, k)], "short int, k int").write.parquet(f"{path}/limits")


def completions(spark: SparkSession, path: str, prefix: str, size: int = 5) -> DataFrame:
    """(suggestion): the first ``size`` values that hold the words of the prefix in a row, the last as the start of a word.

    A short prefix reads its ready list (unless more are wanted than it holds), a longer one a range of the sorted starts.
    """
    typed = " ".join(re.findall(r"[^\W_]+", prefix.lower()))
    limits = spark.read.parquet(f"{path}/limits").first()
    if not typed:
        return spark.createDataFrame([], "suggestion string")
    if len(typed) <= limits.short and size <= limits.k:
        rows = spark.read.parquet(f"{path}/short").filter(F.col("prefix") == typed)
    else:
        rows = spark.read.parquet(f"{path}/starts").filter((F.col("start") >= typed) & (F.col("start") < typed + "\U0010ffff"))
    return rows.select(F.col("value").alias("suggestion")).distinct().orderBy("suggestion").limit(size)
