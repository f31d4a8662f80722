"""Ingestion: upserts, insert-ignore, entity resolution, rules, patches.

Tables are files, so an upsert is the merged table that replaces the old one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_key, turns
from .storage import stored


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old_if_null: Sequence[str] = (), order: Sequence[Column | str] | None = None) -> DataFrame:
    """The table after new rows overwrite old ones of the same key; listed columns keep the old value where the new is null.

    Of new rows with one key the first by ``order`` counts.
    """
    fresh = first_per_key(new, key, order) if order else new.dropDuplicates(list(key))
    a, b = old.alias("a"), fresh.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    there = F.col(f"b.{key[0]}").isNotNull()
    columns = []
    for c in old.columns:
        if c in key:
            columns.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c in keep_old_if_null:
            columns.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        else:
            columns.append(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, on, "full").select(*columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The new rows whose key is not there, one for a key."""
    return first_per_key(new, key, order).join(old.select(*key), list(key), "left_anti")


def latest(log: DataFrame, key: Sequence[str], time: str, tie: str) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_r")
    return log.groupBy(*key).agg(row).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_dense_ids(df: DataFrame, order: str, name: str, start: int = 1, part_bytes: int = 64 << 20) -> DataFrame:
    """Consecutive ids by a unique key, counted by key range so that no task sees all rows.

    Rows are sent and sorted once, in parts of about ``part_bytes`` as they lie in memory (compressed, wide rows tell little of it),
    and numbered as they are written; what is broadcast is a row for each part.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.select(F.sum(sum(wide, F.lit(16 * len(df.columns)))).alias("bytes")).first().bytes or 0  # one row
    parts = min(int(size // part_bytes) + df.sparkSession.sparkContext.defaultParallelism, 100_000)
    numbered = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    numbered = stored(numbered, "parts").withColumn("_p", F.shiftright("_m", 33))
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + place + start).drop("_p", "_m", "_base")


def numbered_ids(df: DataFrame, base: Column, order: Sequence[str], name: str = "external_id") -> DataFrame:
    """A base id for each row; repeats get -2, -3 and so on.  A null base gives a null id."""
    turn = turns(df.withColumn("_b", base), F.col("_b"), order, "_turn")
    return turn.withColumn(name, F.when(F.col("_turn") == 1, F.col("_b")).when(F.col("_b").isNotNull(), F.concat_ws("-", "_b", "_turn"))).drop("_b", "_turn")


def roll_up(parents: DataFrame, parts: DataFrame, key: str, chars: str) -> DataFrame:
    """Parents with has_content and content_char_count from their parts."""
    sums = parts.groupBy(key).agg(F.sum(chars).alias("content_char_count"))
    return parents.join(sums, key, "left").withColumns({"has_content": F.col("content_char_count").isNotNull(), "content_char_count": F.coalesce("content_char_count", F.lit(0))})


def resolve(new: DataFrame, old: DataFrame, keys: Sequence[tuple[str, str]], old_id: str) -> DataFrame:
    """``new`` with match_id: by the first (new column, old column) pair that finds an entity, else null.

    Where several old rows have one key the smallest id counts; null and empty keys match nothing.
    """
    out = new
    for i, (mine, theirs) in enumerate(keys):
        ids = old.filter(F.col(theirs).isNotNull() & (F.col(theirs) != "")).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(old_id).alias(f"_m{i}"))
        out = out.join(ids, F.col(mine) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out.withColumn("match_id", F.coalesce(*[F.col(f"_m{i}") for i in range(len(keys))])).drop(*[f"_m{i}" for i in range(len(keys))])


def unique_matches(new: DataFrame, old: DataFrame, name: str, old_name: str, old_id: str) -> DataFrame:
    """Matches by a name that only one old row has; ambiguous names match nothing."""
    single = old.groupBy(F.col(old_name).alias(name)).agg(F.count(F.lit(1)).alias("_n"), F.min(old_id).alias("match_id")).filter("_n = 1").drop("_n")
    return new.join(single, name)


def richest(candidates: DataFrame, group: str, exact: Column, birth: Column, death: Column, note: Column, aliases: Column, key: str) -> DataFrame:
    """One candidate of each group: exact names first, then the most told of, then the smallest key."""
    told = birth.isNotNull().cast("int") + death.isNotNull().cast("int") + F.least(F.coalesce(F.length(note), F.lit(0)), F.lit(200)) + F.coalesce(aliases, F.lit(0))
    return first_per_key(candidates, [group], [exact.desc(), told.desc(), key])


def longest_contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, priority: str, grams: int = 2) -> DataFrame:
    """For each text the name it holds of the best (smallest) priority, then the longest.

    Names are looked up by their first ``grams`` characters among the text's own, so only
    likely pairs are joined; shorter names are matched by a gram of their own length.
    """
    size = F.least(F.length(name), F.lit(grams))
    keyed = names.select(F.col(name).alias("_name"), F.col(priority).alias("_priority"), F.substring(name, F.lit(1), size).alias("_gram")).filter(F.length("_name") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    cut = lambda n: lambda i: F.substring(F.col(text), i, F.lit(n))
    own = F.array_distinct(F.flatten(F.array(*[F.transform(starts, cut(n)) for n in range(1, grams + 1)])))
    pairs = texts.select(key, text, F.explode(own).alias("_gram")).join(keyed, "_gram").filter(F.contains(text, F.col("_name")))
    best = first_per_key(pairs, [key], ["_priority", F.desc(F.length("_name")), "_name"])
    return best.select(key, F.col("_name").alias("matched"), F.col("_priority").alias("priority"))


def range_matches(items: DataFrame, ranges: DataFrame, prefix: str, width: int = 100) -> DataFrame:
    """Items (id, prefix, start, end) to the first range (range_id, prefix, r_start, r_end) that overlaps; equal bounds first.

    Both sides are cut into buckets of ``width``, so the join is by equality.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    i = items.withColumn("_b", cut("start", "end"))
    r = ranges.withColumn("_b", cut("r_start", "r_end"))
    met = i.join(r, [prefix, "_b"]).filter((F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start"))).drop("_b").distinct()
    exact = (F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end"))
    return first_per_key(met, ["id"], [exact.desc(), "r_start", "r_end", "range_id"])


def _rectangles(batches: Iterable[pa.RecordBatch], run: int = 256, rise: int = 8, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(x, k, half): key lists of which all pairs are linked (with ``half``, those with x < k), from each row's blocks ``_x`` and ``_k`` of keys by translator.

    ``run`` neighbouring keys meet all x of one translator, ``rise`` at a time: equal runs on end, which a file holds in little.
    """
    held, n = [], 0
    for batch in batches:
        for i, j, *sides in zip(*(batch.column(c) for c in ("_i", "_j", "_x", "_k")), strict=True):
            (xs, of_x), (ks, of_k) = ((s.values.field("k").flatten(), s.values.field("k").value_lengths().to_numpy()) for s in sides)
            names = pa.concat_arrays([s.values.field("w") for s in sides]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order = pc.sort_indices(ks).to_numpy().astype(np.int64)
            theirs = np.repeat(names[len(of_x) :], of_k)[order]
            for end, size, name in zip(np.cumsum(of_x), of_x, names, strict=False):
                if i.equals(j):  # one block: each two translators meet once, and the missing one itself
                    linked = [(order[theirs > name], False)] + ([(order[theirs == name], True)] if name < 0 else [])
                else:
                    linked = [(order if name < 0 else order[theirs != name], False)]
                for met, half in linked:
                    for lo in range(0, len(met), run):
                        for at in range(end - size, end, rise):
                            held.append((xs, np.arange(at, min(at + rise, end)), ks, met[lo : lo + run], half))
                            n += len(held[-1][1]) + len(held[-1][3])
                            if n >= most:
                                yield _lists(held)
                                held, n = [], 0
    if held:
        yield _lists(held)


def _lists(held: list[tuple]) -> pa.RecordBatch:
    def lists(at: int) -> pa.Array:
        taken = []
        for _, own in itertools.groupby(held, lambda h: id(h[at])):  # one block after another
            values, *places = zip(*((h[at], h[at + 1]) for h in own), strict=True)
            taken.append(values[0].take(pa.array(np.concatenate(*places))))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(h[at + 1]) for h in held)]), pa.int32()), pa.concat_arrays(taken))

    return pa.RecordBatch.from_arrays([lists(0), lists(2), pa.array([h[4] for h in held])], names=["x", "k", "half"])


def same_title_pairs(texts: DataFrame, key: str, title: str, translator: str, confidence: float = 0.9, block: int = 2048, cells: int = 1024, few: int = 64) -> DataFrame:
    """(a, b, confidence), a < b: one title, translators that differ or are missing (an empty one is missing).

    The texts of a title are dealt to blocks by a hash of the key, and each two blocks meet in one group, so that no task holds a title of
    very many texts.  A block is sent as one row, its keys by translator.  Blocks grow with the texts, from ``block`` to 2¹⁸, so that some
    ``cells`` groups are made and a text is sent a few times, however many texts there are.  A title of ``few`` texts at most is joined as it is.
    The pairs are as many as they are, and are made and given on by runs; :func:`same_title_classes` counts them without making any.
    """
    who = F.nullif(F.col(translator), F.lit(""))
    rows = texts.filter(F.col(key).isNotNull() & F.col(title).isNotNull()).select(F.col(key).alias("k"), F.col(title).alias("t"), who.alias("w"))
    sizes = rows.groupBy("t").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    pairs = F.col("_rows").cast("double") * F.col("_rows") / 2
    cost = sizes.agg(F.sum(F.when(F.col("_rows") <= few, pairs)).alias("few"), F.sum(F.when(F.col("_rows") > few, pairs)).alias("many")).first()  # one row
    many = cost.many or 1
    wide = min(max(block, math.sqrt(many / cells)), 1 << 18)
    known = rows.join(sizes, "t")

    # counts of tasks that are given are not coalesced: their rows are few, their pairs are not
    tasks = int(max(1, min((cost.few or 1) / 500_000, 8192)))
    rare = known.filter(F.col("_rows") <= few).repartition(tasks, "t")
    differ = F.col("a.w").isNull() | F.col("b.w").isNull() | (F.col("a.w") != F.col("b.w"))
    plain = rare.alias("a").join(rare.alias("b").hint("merge"), (F.col("a.t") == F.col("b.t")) & (F.col("a.k") < F.col("b.k")) & differ).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))

    dealt = known.filter(F.col("_rows") > few).withColumn("_n", F.ceil(F.col("_rows") / wide).cast("int")).withColumn("_b", F.pmod(F.xxhash64("k"), F.col("_n")).cast("int"))
    keys = dealt.groupBy("t", "_n", "_b", "w").agg(F.sort_array(F.collect_list("k")).alias("k"))
    blocks = keys.groupBy("t", "_n", "_b").agg(F.collect_list(F.struct("w", "k")).alias("of"))
    left = blocks.select("t", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"), F.col("of").alias("_x"))
    right = blocks.select("t", F.explode(F.sequence(F.lit(0), "_b")).alias("_i"), F.col("_b").alias("_j"), F.col("of").alias("_k"))
    group, tasks = ["t", "_i", "_j"], int(max(1, min(many / block**2, 2 * max(cells, many / wide**2))))
    met = left.repartition(tasks, *group).join(right.repartition(tasks, *group).hint("merge"), group).select("_i", "_j", "_x", "_k")
    kind = rows.schema["k"].dataType.simpleString()
    lists = met.mapInArrow(_rectangles, f"x array<{kind}>, k array<{kind}>, half boolean")
    all_of = lists.select("k", "half", F.explode("x").alias("x")).select("x", "half", F.explode("k").alias("k"))
    linked = all_of.filter((F.col("x") < F.col("k")) | (~F.col("half") & (F.col("x") > F.col("k"))))
    return plain.union(linked.select(F.least("x", "k").alias("a"), F.greatest("x", "k").alias("b"))).withColumn("confidence", F.lit(confidence))


def cross_members(groups: DataFrame, left: str, right: str, note: str) -> DataFrame:
    """(a, b, notes): pairs of the two member arrays of each row, smaller id first, notes of equal pairs joined."""
    pairs = groups.select(F.explode(left).alias("l"), F.col(right), F.col(note)).select("l", F.explode(right).alias("r"), note)
    norm = pairs.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), note)
    return norm.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set(note)), "; ").alias("notes"))


def same_title_classes(texts: DataFrame, key: str, title: str, translator: str) -> DataFrame:
    """(key, class_key, n_texts, n_links): each text with its title's smallest key, how many have the title, and to how many of them
    :func:`same_title_pairs` links it.  Counts are taken by title and translator first, so a title of very many texts makes no pairs.

    Rows without a title have no class.
    """
    who = F.nullif(F.col(translator), F.lit(""))
    rows = texts.filter(F.col(title).isNotNull()).select(F.col(key).alias("key"), F.col(title).alias("_t"), who.alias("_w"))
    parts = rows.groupBy("_t", "_w").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_k"))
    whole = parts.groupBy("_t").agg(F.sum("_n").alias("n_texts"), F.min("_k").alias("class_key"))
    known = parts.join(whole, "_t").withColumn("n_links", F.when(F.col("_w").isNull(), F.col("n_texts") - 1).otherwise(F.col("n_texts") - F.col("_n"))).drop("_n", "_k")
    found = rows.alias("r").join(known.alias("k"), (F.col("r._t") == F.col("k._t")) & F.col("r._w").eqNullSafe(F.col("k._w")))
    return found.select("key", "class_key", "n_texts", "n_links")


def resolve_texts(texts: DataFrame, chunks: DataFrame, key: str, chunk_key: str, equal: dict[str, object] | None = None, patterns: dict[str, str] | None = None, most: int = 2000) -> DataFrame:
    """Texts that have a chunk and meet all conditions, by key, ``most`` at most: columns equal to a value, columns that hold a pattern (% and _ as in LIKE, any case)."""
    rows = texts
    for column, value in (equal or {}).items():
        rows = rows.filter(F.col(column) == F.lit(value))
    for column, pattern in (patterns or {}).items():
        rows = rows.filter(F.col(column).ilike(pattern))
    return rows.join(chunks.select(F.col(chunk_key).alias(key)).distinct(), key, "left_semi").orderBy(key).limit(most)


def manifest_rows(manifests: DataFrame, texts: DataFrame, number: str, old: DataFrame, source: str) -> DataFrame:
    """(text, source, manifest) for texts found by a catalog number, but for pairs of text and source that are there; of several manifests of a text the smallest."""
    found = manifests.filter(F.length(number) > 0).join(texts.select(F.col("id").alias("text"), number), number).groupBy("text").agg(F.min("manifest").alias("manifest"))
    return found.withColumn("source", F.lit(source)).join(old.select("text", "source"), ["text", "source"], "left_anti").select("text", "source", "manifest")


def two_signals(df: DataFrame, text: Column, positive: str, negative: str) -> DataFrame:
    """verdict: keep with a positive word, delete with only a negative one, else keep; null text is kept."""
    plus, minus = F.coalesce(text.rlike(positive), F.lit(False)), F.coalesce(text.rlike(negative), F.lit(False))
    return df.withColumn("verdict", F.when(plus, "keep").when(minus, "delete").otherwise("keep"))


def rule_deletes(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]], protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and (rule, n) of what the first matching rule deletes; rows in ``protected`` stay."""
    rule = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])
    marked = rows.withColumn("_rule", rule).join(protected.select(key).distinct().withColumn("_safe", F.lit(True)), key, "left")
    gone = F.col("_rule").isNotNull() & F.col("_safe").isNull()
    return marked.filter(~gone).drop("_rule", "_safe"), marked.filter(gone).groupBy(F.col("_rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the patch's non-null values."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(p, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    rest = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("_a"))
    b = new.select(key, F.struct(*rest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def domain_code(rows: DataFrame, url: str, key: str) -> DataFrame:
    """A unique code from the url's host; repeats get -2, -3 and so on."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", ""), r"[^a-z0-9]+", "-")
    return numbered_ids(rows, F.coalesce(host, F.lit("source")), [key], "code")


def flow(state: Column, action: Column) -> Column:
    """The annotation workflow's next state, null if the action is not allowed."""
    return (
        F.when((state == "draft") & (action == "submit"), "pending")
        .when((state == "pending") & (action == "approve"), "approved")
        .when((state == "pending") & (action == "reject"), "rejected")
        .when((state == "pending") & (action == "revise"), "draft")
    )
