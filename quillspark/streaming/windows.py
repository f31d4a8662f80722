"""Structured Streaming forms; each gives the rows of its batch twin on a finite input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def rate_windows(stream: DataFrame, owner: str, time: str, limit: int, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Tumbling windows with more than ``limit`` requests of one owner, once they are closed."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), owner).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit).select(owner, F.col("w.start").alias("window_start"), "n")


def distinct_by(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, late: str, zone_offset: str = "16 hours") -> DataFrame:
    """Counts of local days; a day of Asia/Shanghai begins at 16:00 UTC."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, "1 day", startTime=zone_offset).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date(F.from_utc_timestamp("w.start", "Asia/Shanghai")).alias("day"), "n")


class _Throttle(StatefulProcessor):
    """The time of the event that passed last, kept until the watermark says that its span is over."""

    def __init__(self, owner: str, time: str, seconds: int):
        self.owner, self.time, self.span = owner, time, pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        times = pd.concat([pdf[self.time] for pdf in rows]).dropna().sort_values()
        us = times.to_numpy().astype("datetime64[us]").astype(np.int64)
        span, keep = self.span // pd.Timedelta(microseconds=1), []
        before = self.passed.get()[0] if self.passed.exists() else None
        at = 0 if before is None else int(np.searchsorted(us, before + span))
        while at < len(us):
            keep.append(at)
            at = int(np.searchsorted(us, us[at] + span))
        if keep:
            last = int(us[keep[-1]])
            self.passed.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + span) // 1000)
        yield pd.DataFrame({self.owner: [key[0]] * len(keep), self.time: times.iloc[keep].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.passed.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttled(stream: DataFrame, owner: str, time: str, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """An owner's event passes if none passed in the ``seconds`` before it: the span runs from the event that passed.

    Events of a batch are taken in order of time; one that comes later than an event already passed does not pass.  Once the
    watermark (``late`` behind the newest event) is beyond the span of the last event passed, the owner's state is dropped, so
    state holds the owners of the last minutes only.  Events behind the watermark are dropped; events without a time do not pass.
    The session's state store must be RocksDB (:func:`use_state_store`).
    """
    kind = dict(stream.dtypes)
    rows = stream.select(owner, time).withWatermark(time, late).groupBy(owner)
    return rows.transformWithStateInPandas(_Throttle(owner, time, seconds), f"{owner} {kind[owner]}, {time} {kind[time]}", "append", "eventTime")


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB: on disk, so that the number of keys is not bounded by memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _versions(spark: SparkSession, path: str) -> dict[int, dict[int, int]]:
    """The committed manifests under a path: for each epoch, the epoch that wrote each bucket last."""
    fs, folder = _folder(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n for n in names if n.startswith("e") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    return {int(n[1:]): {r.bucket: r.epoch for r in spark.read.parquet(f"{path}/manifest/{n}").collect()} for n in done}  # a row for each bucket


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _of_manifest(spark: SparkSession, path: str, schema, manifest: dict[int, int], buckets=None) -> DataFrame:
    paths = [f"{path}/data/e{e}/bucket={b}" for b, e in sorted(manifest.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that :func:`upsert_sink` keeps under ``path``, as of its last committed batch."""
    versions = _versions(spark, path)
    return _of_manifest(spark, path, schema, versions[max(versions)] if versions else {})


def upsert_sink(path: str, key: list[str], time: str, tie: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key under ``path``.

    Rows lie in buckets by a hash of their key.  A batch rewrites the buckets it touches, in a folder of its own epoch, and then commits a
    manifest that names the newest folder of each bucket; all other buckets stay where they are.  A batch that is run again starts
    from the manifest before its own and gives the same table; one that fails half way leaves the last manifest as it was.  Folders
    that neither this manifest nor the one before names are deleted, so readers of the last version are not disturbed.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.etl import latest

        spark = batch.sparkSession
        older = {e: m for e, m in _versions(spark, path).items() if e < epoch}
        last = older[max(older)] if older else {}
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r.bucket for r in placed.select("bucket").distinct().collect()}  # at most ``buckets``
            if not touched:
                return
            before = _of_manifest(spark, path, batch.schema, last, touched).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            rows = latest(before.unionByName(placed), key, time, tie)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/e{epoch}")
        finally:
            placed.unpersist()
        manifest = last | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(manifest.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/e{epoch}")
        named = {(e, b) for m in (last, manifest) for b, e in m.items()}
        fs, data = _folder(spark, f"{path}/data")
        for old in [s.getPath() for s in fs.listStatus(data)]:
            e = int(old.getName()[1:])
            parts = [p.getPath() for p in fs.listStatus(old) if "=" in p.getPath().getName()]
            gone = [p for p in parts if e < epoch and (e, int(p.getName().split("=")[1])) not in named]
            for p in [old] if gone and len(gone) == len(parts) else gone:
                fs.delete(p, True)
        for e in sorted(older)[:-1]:
            fs.delete(_folder(spark, f"{path}/manifest/e{e}")[1], True)

    return write
