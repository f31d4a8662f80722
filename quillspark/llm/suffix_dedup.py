"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected places are kept: of every ``passage`` words, the one whose
first ``prefix`` words have the least hash (a minimiser).  Equal passages of at least
``passage`` words thus keep a suffix at the same word.  The suffixes of all documents are sorted
(by the hash of their first words, then by document) and each is compared with its neighbours;
one that agrees with neither is dropped.  From the others the match is extended left and right,
by every number of words that a passage around the suffix allows: places that agree over
``passage`` words are a group, and all but its first place (by doc_id, then place) are
repeats.  What is found is exactly every word that lies in a run of ``passage`` or more words met
before, in another document or the same one.

Of documents with equal texts only the first takes part; the others repeat it whole.  A task
compares its own windows first and sends one of each kind on, so that a passage in very many
documents is no large group anywhere.  Windows are compared by 64 bits: of n windows about
n * n / 2 ** 65 are wrongly held equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chars_grouped, documents, forget, join_hot, stored
from .line_dedup import repeated_runs

NO_ID = -(1 << 63)


def suffixes(docs: DataFrame, passage: int, prefix: int) -> DataFrame:
    """One row for each document: doc_id, th, size, n_words, and the distinct hashes of its kept suffixes with the places of each."""

    def run(batches):
        forget()
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            counts, hashes, places, sizes, offsets = [], [], [], [], [0]
            for text in texts:
                own = words.word_hashes(text)
                counts.append(len(own))
                offsets.append(offsets[-1])
                if len(own) >= passage:
                    starts = words.run_hashes(own, prefix)
                    at = words.least_of_window(starts, passage - prefix + 1)
                    at = at[np.append(True, at[1:] != at[:-1])]
                    at = at[np.argsort(starts[at], kind="stable")]
                    h = starts[at]
                    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    hashes.append(h[head])
                    places.append(at)
                    sizes.append(np.diff(np.append(head, len(h))))
                    offsets[-1] += len(head)
            bound = pa.array(offsets, pa.int32())
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            where = np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)
            inner = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(where))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), batch.column("size"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(bound, pa.array(flat)), pa.ListArray.from_arrays(bound, lists)],
                names=["doc_id", "th", "size", "n_words", "hashes", "places"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, size int, n_words long, hashes array<long>, places array<array<int>>")


def agreeing(kept: DataFrame) -> DataFrame:
    """The rows of (suffix, doc_id, th, places) that agree with a neighbour in the sorted order, or recur in their document.

    Parts are cut by suffix and document, so a suffix of very many documents lies in several of them; the
    ends of a part may agree with a neighbour in the next one and stay.
    """

    def run(batches):
        held = None  # the last row of what came before, and whether it has been sent on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h = batch.column("suffix").to_numpy()
            same = h[1:] == h[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep |= pc.greater(pc.list_value_length(batch.column("places")), 1).to_numpy(zero_copy_only=False)
            if held is None:
                keep[0] = True
            elif held[0] == h[0]:
                keep[0] = True
                if not held[1]:
                    yield held[2]
            yield batch.filter(pa.array(keep))
            held = (h[-1], bool(keep[-1]), batch.slice(n - 1, 1))
        if held is not None and not held[1]:
            yield held[2]

    ordered = kept.repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id", "th")
    return ordered.mapInArrow(run, "suffix long, doc_id long, th long, places array<int>")


def windows(texts: DataFrame, passage: int, prefix: int) -> DataFrame:
    """The windows around the shared suffixes: key, doc_id, th, start, last, sure.

    ``sure`` windows have an equal one before them in the same batch and come as runs from start
    to last; of the others a batch holds one of each key.
    """

    def run(batches):
        forget()
        for batch, text in chars_grouped(batches, "text", 4_000_000):
            keys, ids, hashes, starts = [], [], [], []
            for t, doc_id, th, shared in zip(text, batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("places").to_pylist(), strict=True):
                own = words.word_hashes(t)
                at = words.least_of_window(words.run_hashes(own, prefix), passage - prefix + 1)
                wanted = np.zeros(len(own) + 1, bool)
                wanted[shared] = True
                start = np.flatnonzero(wanted[at])
                keys.append(words.run_hashes(own, passage)[start])
                ids.append(np.full(len(start), NO_ID if doc_id is None else doc_id))
                hashes.append(np.full(len(start), th))
                starts.append(start)
            key, doc_id, th, start = (np.concatenate(x) for x in (keys, ids, hashes, starts))
            order = np.lexsort((start, th, doc_id, key))
            key, doc_id, th, start = key[order], doc_id[order], th[order], start[order]
            fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            sure = (doc_id != doc_id[first]) | (th != th[first]) | (start != start[first])
            last = start
            if sure.any():  # a run of sure windows is one row; its key is of no use but to spread it
                d, t, s = doc_id[sure], th[sure], start[sure]
                order = np.lexsort((s, t, d))
                d, t, s = d[order], t[order], s[order]
                head = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1))
                tail = np.append(head[1:], True)
                rest = ~sure
                key = np.concatenate((key[rest], words.mixed(s[head].astype(np.uint64) + d[head].view(np.uint64))))
                doc_id, th = np.concatenate((doc_id[rest], d[head])), np.concatenate((th[rest], t[head]))
                start, last = np.concatenate((start[rest], s[head])), np.concatenate((start[rest], s[tail]))
                sure = np.arange(len(key)) >= int(rest.sum())
            for i in range(0, len(key), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64)), pa.array(doc_id[j]), pa.array(th[j]), pa.array(start[j].astype(np.int32)), pa.array(last[j].astype(np.int32)), pa.array(sure[j])], names=["key", "doc_id", "th", "start", "last", "sure"])

    return texts.select("doc_id", "th", "text", "places").mapInArrow(run, "key long, doc_id long, th long, start int, last int, sure boolean")


def repeated_passages(docs: DataFrame, passage: int = 50, prefix: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (text hash), n_words, runs array<struct<a, b>>: word intervals that repeat earlier ones, both ends in.

    One row for each input row.  A null text has no words; a text of fewer than ``passage`` words
    has no repeats.  A null doc_id comes before all others; rows of one doc_id and equal text
    count as one document, rows of one doc_id and other texts are told apart by the text.
    An empty table gives no rows.
    """
    plain = documents(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    rows = stored(suffixes(plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), passage, prefix), "suffixes")
    sized = rows.select("doc_id", "th", "size", "n_words")
    classes = sized.filter(F.col("n_words") >= passage).groupBy("th", "size").agg(F.min("doc_id").alias("first"))
    # the first of each class, found by its id too, so that copies are not gathered
    firsts = rows.join(classes.withColumnRenamed("first", "doc_id"), ["doc_id", "th", "size"], "left_semi").dropDuplicates(["doc_id", "th"])
    kept = firsts.select("doc_id", "th", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(F.col("s.hashes").alias("suffix"), "doc_id", "th", F.col("s.places").alias("places"))
    near = agreeing(kept).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("places")).alias("places"))  # one document's
    texts = plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(near, ["doc_id", "th"])
    found = stored(windows(texts, passage, prefix), "windows")
    place = F.struct("doc_id", "th", "start")
    unsure = found.filter("NOT sure").select("key", "doc_id", "th", "start", "last")  # one of a key from each batch
    firsts_of = unsure.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key", "first")
    later = join_hot(unsure, firsts_of, ["key"], ["doc_id", "start"]).filter(place > F.col("first")).select("doc_id", "th", "start", "last")
    later = later.unionByName(found.filter("sure").select("doc_id", "th", "start", "last"))
    runs = repeated_runs(later, passage)
    whole = join_hot(sized, classes, ["th", "size"], ["doc_id"], "left").join(runs, ["doc_id", "th"], "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first"))
    all_words = F.array(F.struct(F.lit(0).alias("a"), (F.col("n_words") - 1).cast("int").alias("b")))
    none = F.expr("cast(array() AS array<struct<a: int, b: int>>)")
    return whole.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "th", "n_words", F.when(copy, all_words).otherwise(F.coalesce("runs", none)).alias("runs"))


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the found words cut out of ``text_col``; what stands between kept words stays."""
    cut = found.filter(F.size("runs") > 0).select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), F.col("runs").alias("_runs")).dropDuplicates(["_doc_id", "_th"])
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.join(cut, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_th")), "left")

    @F.pandas_udf("string")
    def without(texts, runs):
        def one(t, r):
            if r is None or t is None:
                return t
            data = t.encode("utf-8", "surrogatepass")
            starts, ends = words.word_bounds(np.frombuffer(data, np.uint8))
            out, at = [], 0
            for x in r:
                out.append(data[at : starts[x["a"]]])
                at = int(starts[x["b"] + 1]) if x["b"] + 1 < len(starts) else int(ends[-1])
            return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

        return texts.combine(runs, one)

    return joined.withColumn(text_col, F.when(F.col("_runs").isNull(), text).otherwise(without(text, "_runs"))).drop("_doc_id", "_th", "_runs")


def oracle_sql(passage: int = 50) -> str:
    """DuckDB SQL for doc_id, n_words, n_repeated, spans over documents with unique ids."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, k, list_slice(ws, k + 1, k + {passage}) AS key FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {passage - 1})) AS k FROM w WHERE len(ws) >= {passage})),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY md5(array_to_string(key, ' ')) ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1),
islands AS (SELECT doc_id, min(k) AS a, max(k) + {passage - 1} AS b FROM (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT doc_id, k, CASE WHEN k > lag(k, 1, -{passage + 1}) OVER (PARTITION BY doc_id ORDER BY k) + {passage} THEN 1 ELSE 0 END AS fresh FROM later)) GROUP BY doc_id, g)
SELECT w.doc_id, coalesce(len(w.ws), 0)::BIGINT AS n_words, coalesce(i.n, 0)::BIGINT AS n_repeated, coalesce(i.s, '') AS spans
FROM w LEFT JOIN (SELECT doc_id, sum(b - a + 1) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS s FROM islands GROUP BY doc_id) i USING (doc_id)
"""
