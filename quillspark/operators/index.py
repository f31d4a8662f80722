"""Keyword search over a written index: positional postings, block maxima, fuzzy terms by deletions.

``write_index`` lays down Parquet tables in one folder:

- ``postings``: field, term, block, key, tf, length, positions, impact, in folders by a hash of the term and in order
  of term and block, so that a query's filters skip files and row groups.  A block is a range of ``span`` keys.
- ``blocks``: for each field, term and block the largest impact (what a posting adds to a score, but for the
  weight of the term) and the number of postings.
- ``deletions``: what is left of terms' starts (their first characters) without up to two of these; terms within two edits
  share one with the query's word.  Each start counts once, however many terms have it.
- ``terms``: the terms in folders by a hash of their start, so fuzzy words are found without a pass over all of them.
- ``totals``: one row for each field.

A search adds up the maxima of each block first, scores the most promising blocks, and then reads only those
whose bound reaches the k-th score found.  The result is that of a scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, K1, edits_allowed

#: The tables' columns, so that an index without a row can be read.
TABLES = {
    "postings": "field string, term string, block long, key long, tf int, length int, positions array<int>, impact double, bucket int",
    "blocks": "term string, field string, block long, top double, n long, bucket int",
    "deletions": "start string, left string, bucket int",
    "terms": "term string, bucket int",
    "counts": "first string, term string, n long, words boolean, bucket int",
}

#: Above so many values a filter is a join.
LISTED = 4096
#: Terms are looked up by deletions of so many of their first characters.
PREFIX = 7


def deletions(word: Column, edits: int = 2) -> Column:
    """The distinct strings left of the first characters of a word without up to ``edits`` of them."""
    found = one = F.array(F.substring(word, 1, PREFIX))
    for _ in range(edits):
        less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(PREFIX))))
        one = F.array_distinct(F.flatten(F.transform(F.filter(one, lambda x: x != ""), less)))
        found = F.array_union(found, one)
    return found


def opened(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{path}/{table}")


def _bucket(n: int, term: str | Column) -> Column:
    return F.pmod(F.crc32((F.col(term) if isinstance(term, str) else term).cast("binary")), F.lit(n)).cast("int")


def start_of(term: str | Column) -> Column:
    return F.substring(term, 1, PREFIX)


def dealt(rows: DataFrame, buckets: int, *turn: str) -> DataFrame:
    """The rows with those of a folder ("bucket") dealt by a hash of ``turn`` to as many tasks as it takes; the extra column is ``_turn``.

    Rows that are equal in bucket and turn's columns meet, so they need no other shuffle, and no sample is taken of them first.
    """
    turns = -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    return rows.withColumn("_turn", F.pmod(F.xxhash64(*turn), F.lit(turns))).repartition("bucket", "_turn")


def write_deletions(terms: DataFrame, path: str, buckets: int) -> None:
    """The deletions of the starts of the terms, each start once."""
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = terms.select(start_of("term").alias("start")).repartition(n, "start").distinct()  # few bytes, but much work: not drawn together
    left = starts.select("start", F.explode(deletions(F.col("start"))).alias("left")).withColumn("bucket", _bucket(buckets, "left"))
    dealt(left, buckets, "left").drop("_turn").sortWithinPartitions("bucket", "left").write.partitionBy("bucket").parquet(f"{path}/deletions")


def buckets_of(terms: Iterable[str], n: int) -> list[int]:
    """The folders of terms, as :func:`_bucket` gives them."""
    return sorted({zlib.crc32(t.encode()) % n for t in terms})


def _places(batches: Iterable[pa.RecordBatch], most: int = 500_000) -> Iterable[pa.RecordBatch]:
    """Each row's distinct terms with their positions, from 0; about ``most`` terms at a time.  A null term has no posting."""
    for whole in batches:
        ends = np.cumsum(whole.column("length").to_numpy().astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            batch, start = whole.slice(start, stop - start), stop
            sizes = batch.column("length").to_numpy().astype(np.int64)
            coded = batch.column("terms").flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            order = np.lexsort((code, row))
            order = order[code[order] >= 0]
            row, code = row[order], code[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
            own = pa.array(row[first])
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
            columns = [*(batch.column(c).take(own) for c in ("key", "field", "length")), coded.dictionary.take(pa.array(code[first])), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "field", "length", "term", "positions"])


def write_index(docs: DataFrame, key: str, fields: dict[str, Column], path: str, buckets: int = 16, span: int = 1024, fuzzy: bool = True, group_bytes: int = 8 << 20) -> None:
    """Write the index of ``docs`` under ``path``.  ``fields`` are columns of term arrays; ``key`` is a whole number, one row each.

    A null or empty array, and a null key, have no postings.  A very frequent term is spread over files by its blocks; row groups
    of ``group_bytes`` let a query skip most of its postings.
    """
    spark = docs.sparkSession
    lists = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("terms")) for f, c in fields.items()])).alias("f"))
    lists = lists.select("key", "f.field", "f.terms", F.size("f.terms").alias("length")).filter("length > 0")
    lists.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).withColumns({"buckets": F.lit(buckets), "span": F.lit(span)}).coalesce(1).write.parquet(f"{path}/totals")
    means = F.broadcast(spark.read.parquet(f"{path}/totals").select("field", "mean"))  # one row for each field
    # a row's terms are grouped where the row is, so each posting is sent once, without what follows from its columns
    places = lists.mapInArrow(_places, "key long, field string, length int, term string, positions array<int>").withColumn("bucket", _bucket(buckets, "term"))
    by = ["bucket", "term", "field", "key"]  # in the order of blocks too
    rows = places.repartitionByRange(*by).sortWithinPartitions(*by).join(means, "field").withColumn("tf", F.size("positions"))
    rows = rows.withColumn("impact", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    rows = rows.select("bucket", "field", "term", F.floor(F.col("key") / span).alias("block"), "key", "tf", "length", "positions", "impact")
    rows.write.option("parquet.block.size", group_bytes).partitionBy("bucket").parquet(f"{path}/postings")
    order = ["bucket", "term", "field", "block"]
    written = opened(spark, path, "postings")
    tops = written.groupBy(*order).agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"))
    tops.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/blocks")
    if fuzzy:
        terms = opened(spark, path, "blocks").select("term").distinct().withColumn("bucket", _bucket(buckets, start_of("term")))
        dealt(terms, buckets, "term").drop("_turn").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        write_deletions(opened(spark, path, "terms"), path, buckets)


def fuzzy_terms(spark: SparkSession, path: str, words: Sequence[str], buckets: int, terms: DataFrame, forgives: Callable[[str], int] = edits_allowed) -> DataFrame:
    """(slot, word) with the columns of those ``terms`` (one row a term, in folders by its start) within the edits that each word forgives
    (two at most), the word itself among them if it is a term."""
    asked = spark.createDataFrame([(i, w, forgives(w)) for i, w in enumerate(words)], "slot int, word string, edits int")
    left = asked.select("slot", "word", "edits", F.explode(deletions(F.col("word"))).alias("left"))
    few = [r[0] for r in left.select("left").distinct().collect()]  # as many as the words of a query have
    known = opened(spark, path, "deletions").filter(F.col("bucket").isin(buckets_of(few, buckets)) & F.col("left").isin(few))
    starts = known.join(F.broadcast(left), "left").select("slot", "word", "edits", "start").distinct()
    starts = starts.filter((F.length("start") == PREFIX) | (F.levenshtein("start", "word") <= F.col("edits")))  # a shorter start is the term
    some = starts.limit(LISTED + 1).collect()
    if len(some) <= LISTED:
        listed = sorted({r.start for r in some})
        starts = F.broadcast(spark.createDataFrame([tuple(r) for r in some], starts.schema))
        terms = terms.filter(F.col("bucket").isin(buckets_of(listed, buckets)) & start_of("term").isin(listed))
    met = terms.withColumn("start", start_of("term")).join(starts, "start").filter(F.levenshtein("term", "word") <= F.col("edits"))
    return met.drop("start", "edits", "bucket")


def _of_terms(rows: DataFrame, wanted: DataFrame, listed: dict[str, list[int]] | None, buckets: int) -> DataFrame:
    """The rows of the wanted terms with their slots; a short list of terms reaches the scan as a filter."""
    if listed is None:
        return rows.join(wanted, "term")
    slots = F.create_map(*[x for t, own in listed.items() for x in (F.lit(t), F.array(*map(F.lit, own)))])
    return rows.filter(F.col("bucket").isin(buckets_of(listed, buckets)) & F.col("term").isin(list(listed))).withColumn("slot", F.explode(slots[F.col("term")]))


def search_index(
    spark: SparkSession, path: str, query: Sequence[str], fields: dict[str, float], k: int, every: bool = True, fuzzy: bool = False,
    phrase: dict[str, float] | None = None, allowed: DataFrame | None = None, first: int = 8, digits: int = 9,
) -> DataFrame:
    """(key, score) of the ``k`` best rows, ties to the smaller key.

    A row's score is that of its best field: the field's weight times the sum of BM25 over the query's distinct terms, all
    of which must be there (with ``every``).  With ``fuzzy`` a term is met by any within the edits it forgives, whose counts add
    up.  ``phrase`` weights are added for fields that hold the query's terms in a row.  ``allowed`` has the keys that pass
    the filters.  Scores are rounded to ``digits`` before they are ranked.  A query without terms finds nothing.
    """
    words = list(dict.fromkeys(query))
    totals = {r.field: r for r in spark.read.parquet(f"{path}/totals").filter(F.col("field").isin(list(fields))).collect()}  # one row for each field
    none = spark.createDataFrame([], "key long, score double")
    if not words or not totals:
        return none
    buckets, span = next((r.buckets, r.span) for r in totals.values())
    wanted = fuzzy_terms(spark, path, words, buckets, opened(spark, path, "terms")).select("slot", "term") if fuzzy else spark.createDataFrame(list(enumerate(words)), "slot int, term string")
    some = wanted.limit(LISTED + 1).collect()
    listed: dict[str, list[int]] | None = {} if len(some) <= LISTED else None
    for r in some if listed is not None else ():
        listed.setdefault(r.term, []).append(r.slot)
    if listed == {}:
        return none
    several = len(some) != len({r.slot for r in some})
    of = lambda table: _of_terms(opened(spark, path, table).filter(F.col("field").isin(list(fields))), wanted, listed, buckets)
    # a word met by one term has that term's frequency, else rows that hold any of its terms are counted
    df = of("postings").groupBy("field", "slot").agg(F.count_distinct("key").alias("df")) if several else of("blocks").groupBy("field", "slot").agg(F.sum("n").alias("df"))
    weights = spark.createDataFrame([(f, float(totals[f].n), w, float((phrase or {}).get(f, 0.0))) for f, w in fields.items() if f in totals], "field string, rows double, weight double, more double")
    weights = df.join(F.broadcast(weights), "field").withColumn("idf", F.log1p((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = spark.createDataFrame(weights.select("field", "slot", "idf", "weight", "more").collect(), "field string, slot int, idf double, weight double, more double")  # fields times words

    here = of("blocks").groupBy("field", "block", "slot").agg(F.sum("top").alias("top")).join(F.broadcast(weights), ["field", "slot"])
    here = here.groupBy("field", "block", "weight", "more").agg(F.sum(F.col("idf") * F.col("top")).alias("s"), F.count(F.lit(1)).alias("m"))
    bounds = (here.filter(F.col("m") == len(words)) if every else here).groupBy("block").agg((F.max(F.col("weight") * F.col("s")) + F.sum("more")).alias("bound"))

    def scored(rows: DataFrame) -> DataFrame:
        if allowed is not None:
            rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("key")).distinct(), "key", "left_semi")
        own = F.element_at(F.array(*map(F.lit, words)), F.col("slot") + 1) == F.col("term")
        met = rows.groupBy("key", "field", "slot").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"), *([F.max(F.when(own, F.col("positions"))).alias("positions")] if phrase else []))
        means = F.create_map(*[F.lit(x) for f, r in totals.items() for x in (f, r.mean)])
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / means[F.col("field")]))
        held = F.collect_list(F.when(F.col("positions").isNotNull(), F.struct("slot", "positions"))).alias("held") if phrase else F.lit(0).alias("held")
        field = met.join(F.broadcast(weights), ["field", "slot"]).groupBy("key", "field", "weight", "more").agg(F.sum(F.col("idf") * part).alias("s"), F.count(F.lit(1)).alias("m"), held)
        if phrase:
            before = lambda i: lambda x: x - i
            starts = [F.transform(F.map_from_entries("held")[words.index(w)], before(i)) for i, w in enumerate(query)]
            run = starts[0]
            for s in starts[1:]:
                run = F.array_intersect(run, s)
            field = field.withColumn("more", F.when((F.size("held") == len(words)) & (F.size(run) > 0), F.col("more")).otherwise(0.0))
        whole = F.col("m") == len(words) if every else F.lit(True)
        best = field.groupBy("key").agg((F.max(F.when(whole, F.col("weight") * F.col("s")).otherwise(0.0)) + F.sum(F.col("more") if phrase else F.lit(0.0))).alias("score"))
        return best.filter("score > 0").select("key", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "key").limit(k)

    ahead = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
    sure = [r.score for r in scored(of("postings").filter(F.col("block").isin(ahead))).collect()]
    if len(sure) == k:
        bounds = bounds.filter(F.col("bound") >= sure[-1] - 10.0**-digits)
    left = [r.block for r in bounds.select("block").limit(LISTED + 1).collect()]
    rows = of("postings")
    rows = rows.filter(F.col("block").isin(left)) if len(left) <= LISTED else rows.join(bounds.select("block"), "block", "left_semi")
    return scored(rows)
