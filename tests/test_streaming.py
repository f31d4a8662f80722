"""State that expires and sinks that rewrite what they touch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import etl, stats
from quillspark.streaming import windows

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_throttle_state_expires(spark, tmp_path):
    """Over many batches the stream passes what the batch twin passes, and owners long gone leave the state."""
    windows.use_state_store(spark)
    rng = random.Random(3)
    batches = []
    for b in range(6):
        rows = [(f"u{b}_{i}", at(b * 3000 + rng.randint(0, 900))) for i in range(15) for _ in range(rng.randint(1, 4))]
        rows += [("steady", at(b * 3000 + s)) for s in range(0, 900, 50)] + [("steady", None), (None, at(b * 3000))]
        batches.append(rows)
    source = str(tmp_path / "in")
    schema = "u string, t timestamp"
    for b in range(len(batches)):
        (tmp_path / "in" / str(b)).mkdir(parents=True)
    stream = spark.readStream.schema(schema).parquet(source + "/*")
    q = windows.throttled(stream, "u", "t", 300, late="1 second").writeStream.format("memory").queryName("throttle_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    rows_of_state = []
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{b}")
        q.processAllAvailable()
        rows_of_state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    everything = spark.createDataFrame([(i, *r) for i, r in enumerate(r for rows in batches for r in rows)], "i int, " + schema)
    want = sorted((r.u, r.t) for r in stats.throttled(everything, "u", "t", 300, "i").collect())
    got = sorted((r.u, r.t) for r in spark.table("throttle_state").filter("u IS NOT NULL").collect())
    assert got == want and len(got) > 100
    owners = 15 * len(batches)
    assert max(rows_of_state) < owners  # each owner would have two rows: a value and a timer


@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_on_arrays(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("abc"), rng.randint(0, 5000)) for _ in range(400)})
    df = spark.createDataFrame([(u, at(s), i) for i, (u, s) in enumerate(rows)], "u string, t timestamp, i int").repartition(3)
    want, passed = [], {}
    for i, (u, s) in enumerate(rows):
        if s - passed.get(u, -10**9) >= 300:
            passed[u] = s
            want.append(i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert sorted(r.i for r in stats.throttled(df, "u", "t", 300, "i").collect()) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet")}


def test_upserts_rewrite_touched_buckets(spark, tmp_path):
    schema = "k long, v string, t timestamp"
    path = tmp_path / "table"
    write = windows.upsert_sink(f"file://{path}", ["k"], "t", "v", buckets=8)
    make = lambda rows: spark.createDataFrame(rows, schema)
    everything = [(k, f"a{k}", at(k)) for k in range(100)]
    write(make(everything), 0)
    first = files(path / "data" / "e0")
    table = lambda: sorted(map(tuple, windows.upserted(spark, f"file://{path}", schema).collect()), key=str)
    expected = lambda rows: sorted(map(tuple, etl.latest(make(rows), ["k"], "t", "v").collect()), key=str)
    assert table() == expected(everything)
    second = [(5, "new", at(500)), (5, "old", at(1)), (200, "fresh", at(0)), (None, "no key", at(3))]
    write(make(second), 1)
    everything += second
    assert table() == expected(everything)
    touched = {p.split("/")[0] for p in files(path / "data" / "e1")}
    assert 1 <= len(touched) <= 3 and files(path / "data" / "e0") == first  # the version before stays readable
    once = table()
    write(make(second), 1)  # run again after a failure behind the commit
    assert table() == once
    write(make([]), 2)
    assert table() == once
    third = [(5, "newest", at(900))]
    write(make(third), 3)
    write(make([(5, "last", at(950))]), 4)
    assert table() == expected(everything + third + [(5, "last", at(950))])
    assert not any(p.split("/")[0] in touched for p in files(path / "data" / "e0") if "bucket" in p) or len(files(path / "data" / "e0")) < len(first)
    (path / "manifest" / "e4" / "_SUCCESS").unlink()  # a commit that did not come to its end does not count
    assert table() == expected(everything + third)
