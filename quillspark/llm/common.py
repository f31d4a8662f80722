"""Helpers shared by the text operators: batching, checkpoints and document keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextlib.contextmanager
def recorded():
    """The paths of the working tables that are written inside this block."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield paths
    finally:
        _OPEN.reset(token)


@contextlib.contextmanager
def working_tables(spark: SparkSession):
    """Working tables that are written inside this block are deleted at its end, and no others.

    For results that are written out before the block ends.
    """
    with recorded() as paths:
        yield
    for path in paths:
        delete(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, told to the innermost :func:`recorded` block."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and what follows sees one fixed
    set of rows however often it is evaluated.  The table stays for the lazy results that read it,
    unless the caller opened :func:`working_tables`.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` frame once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, os.path.dirname(files[0]))


def join_hot(large: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", buckets: int = 4096, share: int = 8, least: int = 256) -> DataFrame:
    """``large`` joined with ``small``, whose keys are few but may each have very many rows in ``large``.

    Keys are counted by hash bucket, in a job of its own: so the driver plans each count once, however
    often the result is read.  A bucket with more than ``share`` times its part of the rows is
    dealt to as many tasks as that takes, by a hash of the columns ``spread``, and its rows of ``small``
    are sent to each of them.  There are fewer than ``buckets / share`` such buckets; without one the join is a plain one.
    """
    bucket = lambda df: F.pmod(F.xxhash64(*[df[k] for k in keys]), F.lit(buckets)).cast("int")
    counts = large.select(bucket(large).alias("_b")).groupBy("_b").count()
    fair = F.greatest(F.sum("count").over(Window.partitionBy()) * (share / buckets), F.lit(float(least)))
    hot = counts.select("_b", F.ceil(F.col("count") / fair).cast("int").alias("_turns")).filter("_turns > 1").collect()
    if not hot:
        return large.join(small, keys, how)
    dealt = F.broadcast(large.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({r._b}, {r._turns})' for r in hot)} AS t(_b, _turns)"))
    turns = F.coalesce("_turns", F.lit(1))
    a = large.withColumn("_b", bucket(large)).join(dealt, "_b", "left").withColumn("_turn", F.pmod(F.xxhash64(*spread), turns).cast("int")).drop("_b", "_turns")
    b = small.withColumn("_b", bucket(small)).join(dealt, "_b", "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), turns - 1))).drop("_b", "_turns")
    return a.join(b, [*keys, "_turn"], how).drop("_turn")


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """A large object that a Python worker keeps from task to task, until a task asks for another one.

    Workers are reused by later stages, so what an earlier operator cached must not stay beside it.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what this worker keeps, and of the memory it no longer uses."""
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def sized(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``size`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, done + size)) + 1, len(ends))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def chars_grouped(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same runs with their texts, a null text as an empty one.

    Only one run's texts are Python strings at a time.
    """
    for batch in sized(batches, text, size):
        yield batch, [x or "" for x in batch.column(text).to_pylist()]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators need, under fixed names: doc_id long and text string.

    Selecting first keeps other columns, whatever their names, out of the way.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
