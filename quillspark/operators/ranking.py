"""Per-group ranking, deduplication, paging and neighbourhoods.

Orders always end in a key that makes them total, so that results do not depend on arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the optimiser cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def newest_page_in_order(df: DataFrame, time: str, key: str, size: int) -> DataFrame:
    """The newest rows, returned from old to new."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(size).orderBy(time, key)


def capped_groups(df: DataFrame, group: str, order: Sequence[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group beside the group's whole size, ``total``."""
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return first_per_key(df, [group], order, cap).join(totals, group)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """previous and next value within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def adjacent(df: DataFrame, value: str, current) -> DataFrame:
    """One row: the values before and after ``current`` in the distinct values; without it, null and the first."""
    c = F.lit(current)
    found = df.agg(F.max(F.when(F.col(value) < c, F.col(value))).alias("previous"), F.min(F.when(F.col(value) > c, F.col(value))).alias("next"), F.count_if(F.col(value) == c).alias("here"), F.min(value).alias("first"))
    return found.select(F.when(F.col("here") > 0, F.col("previous")).alias("previous"), F.when(F.col("here") > 0, F.col("next")).otherwise(F.col("first")).alias("next"))


def around(df: DataFrame, keys: Sequence[str], index: str, centers: DataFrame, radius: int) -> DataFrame:
    """Rows within ``radius`` (0 to 5) of the centers (keys and ``index``), with is_center, has_more_before and has_more_after."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must lie between 0 and 5")
    last = df.groupBy(*keys).agg(F.max(index).alias("_last"))
    c = centers.select(*keys, F.col(index).alias("_center")).withColumn("_at", F.explode(F.sequence(F.greatest(F.col("_center") - radius, F.lit(0)), F.col("_center") + radius)))
    joined = df.join(c.withColumnRenamed("_at", index), [*keys, index]).join(last, list(keys))
    return joined.withColumns({"is_center": F.col(index) == F.col("_center"), "has_more_before": F.col("_center") - radius > 0, "has_more_after": F.col("_last") > F.col("_center") + radius}).drop("_center", "_last")


def round_robin(df: DataFrame, group: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """``n`` rows taken in turn from the groups."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= n).orderBy("_turn", group).limit(n).drop("_turn")


def sampled_round_robin(df: DataFrame, group: str, key: str, seed: str, sample: int = 24, n: int = 8) -> DataFrame:
    """``n`` rows taken in turn from the groups of a seeded sample; within a group in the order drawn."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return round_robin(df.withColumn("_drawn", drawn).orderBy("_drawn", key).limit(sample), group, ["_drawn", key], n).drop("_drawn")


def pick_per_group(df: DataFrame, group: str, key: str, excluded: Sequence, seed: int = 0) -> DataFrame:
    """One row of each group, by a seeded hash; an excluded row only where the group has no other."""
    out = F.col(key).isin(list(excluded)) if excluded else F.lit(False)
    return first_per_key(df, [group], [out, F.xxhash64(key, F.lit(seed)), key])


def recent_list(df: DataFrame, owner: str, item: str, time: str, cap: int) -> DataFrame:
    """Each owner's items by last use, newest first, at most ``cap``."""
    last = df.groupBy(owner, item).agg(F.max(time).alias(time))
    return first_per_key(last, [owner], [F.desc(time), item], cap)


def collapse(hits: DataFrame, group: str, score: str, key: str, inner: int = 5) -> DataFrame:
    """One row for each group: best score and key, number of hits, and its first ``inner`` keys by score."""
    top = first_per_key(hits, [group], [F.desc(score), key], inner)
    listed = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")))).alias("l"))
    totals = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n_hits"))
    return listed.join(totals, group).select(group, (-F.col("l")[0]["s"]).alias("best_score"), F.col("l")[0]["k"].alias("best_key"), "n_hits", F.transform("l", lambda x: x["k"]).alias("keys"))


def in_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in ascending parts by key range, each with its part's number ``_p``.

    The parts are written once: a range partitioning that is planned twice draws its bounds twice.
    """
    return stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "parts")


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row in ascending ``order``, which should be a total one.

    Each part is summed first, so no task sees more than a part; what is broadcast is a row for each part.
    """
    ranged = in_parts(df.withColumn("_value", value), order)
    sums = ranged.groupBy("_p").agg(F.sum("_value").alias("_sum"))
    base = sums.select("_p", (F.sum("_sum").over(Window.orderBy("_p")) - F.col("_sum")).alias("_base"))
    own = F.sum("_value").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_own")).drop("_p", "_value", "_own", "_base")


def with_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """(batch, first, last, n_rows) of consecutive batches of ``size`` rows by ``order``."""
    numbered = running_total(df.select(order), [order], F.lit(1), "_n")
    return numbered.groupBy(F.floor((F.col("_n") - 1) / size).cast("long").alias("batch")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_rows"))


def turns(df: DataFrame, base: Column, order: Sequence[str], name: str) -> DataFrame:
    """``name``: the place of each row among those of its ``base``, from 1 by ascending ``order``.

    A base of very many rows lies in several parts; only a part's first base can have begun before
    it, so one row for each part tells how many came earlier.
    """
    ranged = in_parts(df.withColumn("_base", base), ["_base", *order])
    first = ranged.groupBy("_p").agg(F.min(F.struct("_base")).alias("_f")).select("_p", F.col("_f._base").alias("_base"))
    counts = ranged.join(F.broadcast(first.select("_base").distinct()), "_base", "left_semi").groupBy("_p", "_base").count()
    before = F.sum("count").over(Window.partitionBy("_base").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("_p", "_base", F.coalesce(before, F.lit(0)).alias("_before")).filter("_before > 0")
    own = F.row_number().over(Window.partitionBy("_p", "_base").orderBy(*order))
    out = ranged.withColumn("_own", own).join(F.broadcast(earlier), ["_p", "_base"], "left")
    return out.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_p", "_base", "_own", "_before")
