"""What a task holds, shuffles and writes does not grow with one group, and results stay those of the plain way."""

from pyspark.sql import functions as F

from quillspark.operators import etl


def test_a_frequent_title_is_paired_in_many_tasks(spark):
    rows = [(i, "the same", ("A", "B", "", None)[i % 4]) for i in range(600)] + [(9000, "rare", "A"), (9001, "rare", "B"), (9002, None, "A"), (9003, None, "B"), (None, "rare", "C"), (9001, "rare", "C")]
    texts = spark.createDataFrame(rows, "k long, t string, w string").coalesce(1)
    got = etl.same_title_pairs(texts, "k", "t", "w", block=50).withColumn("task", F.spark_partition_id()).collect()
    missing = lambda w: not w
    expected = sorted((a, b) for a, t, v in rows for b, u, w in rows if None not in (a, b, t) and t == u and a < b and (missing(v) or missing(w) or v != w))
    assert sorted((r.a, r.b) for r in got) == expected
    tasks = [r.task for r in got]
    assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)


def test_pairs_of_a_title_take_little_disk(spark, tmp_path):
    """What is sent does not follow the blocks that meet (some 42 rows a text), and pairs come in runs that a file holds in little."""
    texts = spark.range(4000).select((F.col("id") * 7919 % 100_003).alias("k"), F.lit("the same").alias("t"), (F.col("id") % 25).cast("string").alias("w"))
    pairs = etl.same_title_pairs(texts, "k", "t", "w", block=200)
    pairs.write.parquet(f"{tmp_path}/pairs")
    written = sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet"))
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert back.count() == back.distinct().count() == (4000 * 4000 - 25 * 160 * 160) // 2 and back.filter("a >= b").count() == 0
    assert pairs._jdf.queryExecution().toRdd().count() == back.count()
    sent = sum(p.metrics().apply("shuffleRecordsWritten").value() for p in _nodes(pairs._jdf.queryExecution().executedPlan()) if p.nodeName() == "Exchange")
    assert 0 < sent < 8000
    assert written < 0.8 * back.count()


def test_pairs_keep_repeated_keys_missing_translators_and_any_kind_of_key(spark):
    """In crowded and rare titles alike; blocks of more translators than runs, and of one."""
    missing = lambda w: not w
    who = {"a": lambda i: ("A", "B", "", None)[i % 4], "b": str, "c": lambda _: None, "d": lambda _: "A", "e": lambda i: "A" if i else None}
    rows = [(i % 90, t, w(i)) for t, w in who.items() for i in range(100)] + [(i, "f", "AB"[i % 2]) for i in range(5)]
    expected = sorted((a, b) for a, t, v in rows for b, u, w in rows if t == u and a < b and (missing(v) or missing(w) or v != w))
    for kind, name in (("long", int), ("string", lambda k: f"{k:03}")):
        texts = spark.createDataFrame([(name(k), t, w) for k, t, w in rows], f"k {kind}, t string, w string")
        for block in (16, 1000):
            got = etl.same_title_pairs(texts, "k", "t", "w", block=block)
            assert sorted((int(r.a), int(r.b)) for r in got.collect()) == expected and dict(got.dtypes)["a"] == texts.dtypes[0][1]
    assert etl.same_title_pairs(texts.limit(0), "k", "t", "w").collect() == []


def test_places_of_a_frequent_name_do_not_all_meet(spark):
    """Distances at the poles, over the date line and around 2 km are those of every pair; repeated points meet once."""
    from quillspark.functions.geo import haversine_km
    from quillspark.operators import graph

    spots = [(0.0, 0.0), (0.0179, 0.0), (0.018, 0.0), (0.0127, 0.0127), (0.0128, 0.0128), (89.99, 0.0), (89.991, 170.0), (45.0, 180.0), (45.0, -179.99), (45.0, -179.97), (-0.0, 360.0), (float("nan"), 1.0), (5.0, float("inf"))]
    kinds = "id long, name string, lat double, lng double, external_id string"
    new = spark.createDataFrame([(i, "寺 一", *p, None) for i, p in enumerate(spots)] + [(100 + i, "寺一", 10.0, 10.0, None) for i in range(300)] + [(500, "寺一", None, 1.0, None), (501, None, 10.0, 10.0, None), (502, "寺二", 1.0, 1.0, None), (503, "寺三", 10.0, 10.0, "q"), (504, "寺三", 50.0, 50.0, None)], kinds)
    old = spark.createDataFrame([(i, "寺一", *p, "q") for i, p in enumerate(spots) if i not in (1, 6, 8)] + [(100 + i, "寺一", 10.001, 10.0, None) for i in range(300)] + [(1, "寺二", None, 1.0, None), (2, None, 10.0, 10.0, None)], kinds)
    plain = F.regexp_replace("name", " ", "")
    pairs = new.select("id", plain.alias("n"), "lat", "lng").join(old.select(plain.alias("n"), F.col("lat").alias("a"), F.col("lng").alias("b")), "n")
    near = {r.id for r in pairs.filter(F.col("a").isNull() | F.col("b").isNull() | (haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")) < 2.0)).collect()}
    met = graph.nearby_known(new, old)
    assert {r.id for r in met.collect()} == {r.id for r in new.collect()} - near - {503}
    told = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" in told and "_z" in told  # joined by cells, not by the name alone


def test_the_pipeline_packs_in_small_batches(monkeypatch):
    """Its executors still hold the workers of the stages before."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    import corpus_pipeline
    from quillspark.llm import packing

    class Encoder:
        sizes: list[int] = []

        def encode(self, texts):
            lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            self.sizes.append(int(lengths.sum()))
            return np.zeros(int(lengths.sum()), np.uint32), lengths

    class Frame:
        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(packing, "documents", lambda *_: Frame())
    monkeypatch.setattr(packing, "cached_library_encoder", lambda *_: Encoder())
    docs = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 10_000] * 1000)], names=["doc_id", "text"])
    made = list(corpus_pipeline.pack(None, None, "")(iter([docs])))
    assert sum(Encoder.sizes) == 10_000_000 and max(Encoder.sizes) <= 2_000_000
    assert sum(pa.compute.sum(b.column("length")).as_py() for b in made) == 10_001_000


def test_alignment_sends_a_target_once_for_a_few_blocks(spark):
    """Rows sent do not grow with the square of a pair, ties over tiles go to the smaller key, and blocks of a long pair are merged."""
    from quillspark.operators import vector

    plain = [(1, i, [1.0, float(i % 7), float(i % 3)]) for i in range(900)]
    rows, others = (spark.createDataFrame(plain, "pair int, k long, v array<float>") for _ in range(2))
    got = {}
    for held in (4_000_000, 300):
        got[held] = sorted(map(tuple, vector.nearest_of_blocks(rows, others, "pair", "k", "v", 4, 0.1, block=50, held=held).collect()))
    alike = [[j for j in range(900) if j % 21 == i % 21][:4] for i in range(900)]
    assert got[300] == got[4_000_000] == [(1, i, j, 1.0) for i in range(900) for j in alike[i]]
    near = vector.nearest_of_blocks(rows, others, "pair", "k", "v", 4, 0.1, block=50)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan()
    cogroup = next(p for p in _nodes(plan) if "CoGroup" in p.nodeName())
    sent = [p.metrics().apply("shuffleRecordsWritten").value() for side in (0, 1) for p in _nodes(cogroup.children().apply(side)) if p.nodeName() == "Exchange"]
    assert 0 < sum(sent) <= 900 + 4 * 900 + 8 * 900  # the sides, and what their joins with the sizes may send


def _nodes(plan):
    """The plan's nodes, through what adaptive execution wraps."""
    yield plan
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    for p in inner:
        yield from _nodes(p)


def test_postings_are_grouped_within_their_row():
    """No row of a term is sent alone: whatever the size of a batch, a row's term comes once, with all its places."""
    import pyarrow as pa

    from quillspark.operators import index

    lists = [["b", "a", "b", None], ["é"], ["a"] * 5, ["b", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 8, 9]), pa.array(["t", "t", "u", "t"]), pa.array(lists, pa.list_(pa.string())), pa.array(list(map(len, lists)), pa.int32())], names=["key", "field", "terms", "length"])
    expected = [(7, "t", 4, "a", [1]), (7, "t", 4, "b", [0, 2]), (8, "t", 1, "é", [0]), (8, "u", 5, "a", [0, 1, 2, 3, 4]), (9, "t", 2, "b", [0, 1])]
    for most in (1, 3, 100):
        got = [tuple(r.values()) for b in index._places(iter([batch, batch.slice(0, 0)]), most) for r in b.to_pylist()]
        assert sorted(got) == expected


def test_wide_rows_are_numbered_in_parts_of_their_real_size(spark):
    """Rows that compress to nothing are many parts all the same, and are sorted once, not again for a window."""
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"), F.repeat(F.lit("x"), 1000).alias("wide"))
    out = etl.with_dense_ids(rows, "k", "n", part_bytes=100_000)
    assert sorted((r.k, r.n) for r in out.select("k", "n").collect()) == [(k, k + 1) for k in range(3000)]
    assert len(out.inputFiles()) > 20


def test_hot_keys_are_counted_once_and_not_planned_again(spark):
    """A plan that holds its counts four times over takes the driver's memory."""
    from quillspark.llm import common

    large = spark.range(2000).selectExpr("id", "if(id < 1500, 0, id) AS k")
    small = large.select("k").distinct()
    out = common.join_hot(large, small, ["k"], ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in plan and "Window" not in plan and "LocalRelation" in plan  # dealt by what was counted
    assert sorted(r.id for r in out.collect()) == list(range(2000))
    few = common.join_hot(large.filter("id >= 1500"), small, ["k"], ["id"])
    assert "LocalRelation" not in few._jdf.queryExecution().optimizedPlan().toString() and few.count() == 500


def test_training_holds_counts_and_gives_memory_back(spark, monkeypatch):
    """The driver's Python process lives on through the stages after it."""
    import tracemalloc

    import numpy as np

    from quillspark.llm import langid

    rng = np.random.default_rng(3)
    texts = [("ab"[i % 2], "".join(map(chr, rng.integers(0x4E00, 0x9000, 4000)))) for i in range(100)]
    table = spark.createDataFrame(texts, "lang string, text string").cache()
    table.count()
    held, back, real = [], [], langid.ftrl

    def ftrl(rows, *options):
        held.append((tracemalloc.get_traced_memory()[0] - before, sum(len(row[1]) for row in rows)))
        return real(rows, *options)

    monkeypatch.setattr(langid, "ftrl", ftrl)
    monkeypatch.setattr(langid, "give_back", lambda: back.append(True), raising=False)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    model = langid.train(table, epochs=1)
    tracemalloc.stop()
    table.unpersist()
    assert model.languages == ["a", "b"] and back
    ((size, slots),) = held
    assert size < 16 * slots  # 8 bytes for each slot of four rows in five, and what Python itself takes
