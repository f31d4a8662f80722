"""Dashboard statistics: counts, distributions, trends, activity and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overview(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row: for each name the rows of its table, or the distinct values of its column."""
    out = None
    for name, (df, column) in tables.items():
        one = df.agg((F.count_distinct(column) if column else F.count(F.lit(1))).alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out


def distribution(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """value and n, most frequent first."""
    rows = df if with_null else df.filter(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def coverage(sources: DataFrame, items: DataFrame, key: str, flag: Column) -> DataFrame:
    """For each source: n_items, n_full (items with the flag) and n_rest; sources without items stay."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(flag).alias("n_full"))
    out = sources.select(key).join(counts, key, "left").na.fill(0, ["n_items", "n_full"])
    return out.withColumn("n_rest", F.col("n_items") - F.col("n_full"))


def coverage_by(sources: DataFrame, items: DataFrame, key: str, by: str, flag: Column) -> DataFrame:
    """(key, by, n_items, n_full, orphan) for each source and each value of ``by`` that items have; items of no source are orphans."""
    counts = items.groupBy(key, by).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(flag).alias("n_full"))
    grid = sources.select(key).distinct().join(F.broadcast(items.select(by).distinct().agg(F.collect_set(by).alias("_by")))).select(key, F.explode("_by").alias(by)).withColumn("_known", F.lit(True))  # one row of languages
    out = grid.join(counts, [key, by], "full_outer")
    return out.select(key, by, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_full", F.lit(0)).alias("n_full"), F.col("_known").isNull().alias("orphan"))


def most_read(log: DataFrame, texts: DataFrame, key: str, time: str, flag: Column, days: int, n: int) -> DataFrame:
    """The ``n`` texts with most flagged events in the log's last ``days`` days, with their names and counts."""
    newest = F.broadcast(log.agg(F.max(time).alias("_newest")))  # one row
    counts = log.filter(flag).join(newest).filter(F.col(time) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return texts.join(counts, key).orderBy(F.desc("n"), key).limit(n)


def joined_counts(base: DataFrame, key: str, counts: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """``base`` with several aggregates, each taken before its join so that none multiplies another; absent ones are 0."""
    for name, (df, own_key, aggregate) in counts.items():
        one = df.groupBy(F.col(own_key).alias(key)).agg(aggregate.alias(name))
        base = base.join(one, key, "left").na.fill(0, [name])
    return base


def mode_per_group(df: DataFrame, group: str, value: str, top: int) -> DataFrame:
    """The ``top`` groups by rows: n and the most frequent value, ties to the smallest."""
    pairs = df.filter(F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    known = F.col(value).isNotNull()
    totals = pairs.groupBy(group).agg(F.sum("c").alias("n"), F.min_by(value, F.when(known, F.struct(-F.col("c"), F.col(value)))).alias("usual"))
    return totals.orderBy(F.desc("n"), group).limit(top)


def facet(df: DataFrame, column: str, size: int) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(size)


def local_day(time: Column, zone: str = "Asia/Shanghai") -> Column:
    """The calendar day in a zone of a UTC time without zone, whatever the session's own zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), time.cast("timestamp_ntz")))


def daily_grid(days: DataFrame, day: str, today: str, n: int, count: Column) -> DataFrame:
    """(day, n) for the ``n`` days that end with ``today``; days without rows have 0."""
    spark = days.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), n - 1), F.lit(today).cast("date"))).alias("day"))
    counts = days.groupBy(F.col(day).alias("day")).agg(count.alias("n"))
    return grid.join(counts, "day", "left").na.fill(0, ["n"])


def active_users(logs: Sequence[DataFrame], user: str, time: str) -> DataFrame:
    """(day, n_users) over several logs; rows without a user are left out."""
    union = None
    for log in logs:
        one = log.select(local_day(F.col(time)).alias("day"), F.col(user).alias("user")).filter(F.col("user").isNotNull())
        union = one if union is None else union.unionByName(one)
    return union.groupBy("day").agg(F.count_distinct("user").alias("n_users"))


def total_and_since(df: DataFrame, time: str, cutoff: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(time) >= F.lit(cutoff).cast("timestamp_ntz")).alias("since"))


def recent(df: DataFrame, time: str, now: str, days: int, keep_null: bool = False) -> DataFrame:
    """Rows of the last ``days`` days before ``now``; undated ones on request."""
    fresh = F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(fresh | F.col(time).isNull() if keep_null else fresh)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_and_other(df: DataFrame, column: str, top: int, other: str = "Other") -> DataFrame:
    """(value, n): the ``top`` values, and all else under one name."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "value").limit(top)
    named = counts.join(first.select("value", F.lit(True).alias("_top")), "value", "left").withColumn("value", F.when(F.col("_top"), F.col("value")).otherwise(other))
    return named.groupBy("value").agg(F.sum("n").alias("n"))


def by_member(df: DataFrame, csv: str, empty: str, key: str) -> DataFrame:
    """(member, n): rows under each member of a comma list, once a key; rows of no member under ``empty``."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(csv), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    member = F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(empty)))).alias("member")
    return df.select(key, member).groupBy("member").agg(F.count_distinct(key).alias("n"))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, n): how many rows have each top-level key."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, percent) of a classification."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 2).alias("percent"))


def clusters(points: DataFrame, lat: str, lng: str, digits: int, top: int) -> DataFrame:
    """The most frequent rounded places."""
    return points.groupBy(F.round(lat, digits).alias("lat"), F.round(lng, digits).alias("lng")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lat", "lng").limit(top)


def evaluation(scores: DataFrame, group: str, dimensions: Sequence[str], weights: dict[str, float], whole: float) -> DataFrame:
    """Means of scored dimensions (-1: not scored) for each group, and the weighted share of the best possible, in percent."""
    mean = lambda d: F.avg(F.when(F.col(d) >= 0, F.col(d)))
    out = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[mean(d).alias(d) for d in dimensions])
    overall = sum((F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in weights.items()), F.lit(0.0)) * 100 / whole
    return out.withColumn("overall_percent", F.round(overall, 4))


def activity(events: DataFrame, now: str, days: int, time: str, user: str, kind: str) -> DataFrame:
    """One row of the window's platform figures."""
    window = recent(events, time, now, days)
    firsts = events.groupBy(user).agg(F.min(time).alias("_first"))
    fresh = recent(firsts, "_first", now, days).agg(F.count(F.lit(1)).alias("new_users"))
    main = window.agg(F.count(F.lit(1)).alias("events"), F.count_distinct(user).alias("active_users"), F.count_if(F.col(kind) == "view").alias("reads"), F.count_if(F.col(kind) == "signup").alias("registrations"), F.count_if(F.col(kind) == "error").alias("errors"))
    return main.join(F.broadcast(fresh))  # one row each


def feed_summary(updates: DataFrame, feeds: DataFrame, time: str, source: str, key: str, now: str, days: int = 30, n: int = 5) -> DataFrame:
    """One row: the newest ``n`` keys of each of two lists, how many each has of the last ``days`` days, and how many sources updated then."""
    out = None
    for name, rows in (("updates", updates), ("feeds", feeds)):
        newest = rows.orderBy(F.desc(time), F.desc(key)).limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), (-F.col(key)).alias("k")))), lambda x: (-x["k"]).cast("string")), ",").alias(f"newest_{name}"))
        window = recent(rows, time, now, days)
        counts = window.agg(F.count(F.lit(1)).alias(f"n_{name}"), *([F.count_distinct(source).alias("n_sources")] if name == "updates" else []))
        both = newest.join(F.broadcast(counts))  # one row each
        out = both if out is None else out.join(F.broadcast(both))
    return out


def over_quota(df: DataFrame, owner: str, time: str, limit: int) -> DataFrame:
    """(owner, day, n, allowed) by local day."""
    used = df.groupBy(owner, local_day(F.col(time)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return used.withColumn("allowed", F.col("n") < limit)


def rate_windows(df: DataFrame, owner: str, time: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Fixed windows with more than ``limit`` requests of one owner."""
    counted = df.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"), owner).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit).select(owner, F.col("w.start").alias("window_start"), "n")


def throttled(df: DataFrame, owner: str, time: str, seconds: int, key: str) -> DataFrame:
    """(owner, time, key) of the events that pass: those with none of the owner's passed in the ``seconds`` before.

    The span runs from the event that passed, so the rows are read in order of time; a task keeps the last time
    passed and no more, however many events an owner has.  Ties go to the smaller key.
    """
    seconds_of = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.filter(F.col(owner).isNotNull() & F.col(time).isNotNull()).select(owner, time, key, seconds_of.alias("_us"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches):
        last_owner, passed, span = None, 0, seconds * 1_000_000
        for batch in batches:
            us, owners = batch.column(3).to_numpy(), batch.column(0)
            ends = np.flatnonzero(pc.not_equal(owners[1:], owners[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(us) > 1 else np.zeros(0, np.int64)
            keep = np.zeros(len(us), bool)
            for start, end in zip(np.append(0, ends).tolist(), np.append(ends, len(us)).tolist(), strict=True):
                own, who = us[start:end], owners[start].as_py() if end > start else None
                at = int(np.searchsorted(own, passed + span)) if who == last_owner else 0
                last_owner = who
                while at < len(own):  # one step for each event that passes
                    keep[start + at], passed = True, int(own[at])
                    at = int(np.searchsorted(own, passed + span))
            yield batch.filter(pa.array(keep))

    return rows.repartition(owner).sortWithinPartitions(owner, "_us", key).mapInArrow(run, kept).drop("_us")
