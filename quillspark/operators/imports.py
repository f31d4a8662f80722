"""Imports in steps that can be resumed: each step's table, counters and commit lie in one folder."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .service import run_log

Tables = dict[str, DataFrame]
MANIFEST = "step string, attempt int, counters string, finished_at string"


@dataclass
class Step:
    """A table made from the tables of the steps before it, and what is counted while it is written."""

    name: str
    make: Callable[[SparkSession, Tables], DataFrame]
    counters: dict[str, Column] = field(default_factory=dict)


def committed(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """The counters of each committed step.  A step counts once its manifest is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [str(p) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    rows = spark.read.schema(MANIFEST).parquet(*done).collect() if done else []  # one row for each step
    return {r.step: json.loads(r.counters) for r in rows}


def table(spark: SparkSession, path: str, step: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{step}")


def run(spark: SparkSession, path: str, source: str, steps: Sequence[Step], retries: int = 3, wait: float = 1.0) -> dict[str, dict[str, int]]:
    """Write the table of each step that is not committed yet, in order, and return every step's counters.

    ``rows`` is always counted; counters are observed while the rows are written, so they are of what was written and need no
    pass of their own.  A step that fails is tried ``retries`` times, ``wait`` seconds and twice as many after each failure;
    what it left is overwritten.  If it fails for good the error is raised and logged, and the next call starts from it.
    A log row is appended for each call.
    """
    known = committed(spark, path)
    tables = {s.name: table(spark, path, s.name) for s in steps if s.name in known}
    started = datetime.datetime.now(datetime.UTC).isoformat()

    def log(error: str | None) -> None:
        total = {f"{step}.{k}": v for step, counted in known.items() for k, v in counted.items()}
        run_log(spark, source, started, datetime.datetime.now(datetime.UTC).isoformat(), total, error).write.mode("append").parquet(f"{path}/log")

    for step in steps:
        if step.name in known:
            continue
        for attempt in range(1, retries + 1):
            seen = Observation()
            try:
                rows = step.make(spark, tables).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in step.counters.items()])
                rows.write.mode("overwrite").parquet(f"{path}/data/{step.name}")
                break
            except Exception as error:
                if attempt == retries:
                    log(f"{step.name}: {error}"[:2000])
                    raise
                time.sleep(wait * 2 ** (attempt - 1))
        counters = {n: int(v or 0) for n, v in seen.get.items()}
        finished = datetime.datetime.now(datetime.UTC).isoformat()
        spark.createDataFrame([(step.name, attempt, json.dumps(counters, sort_keys=True), finished)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{step.name}")
        known[step.name], tables[step.name] = counters, table(spark, path, step.name)
    log(None)
    return known
