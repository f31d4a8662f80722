"""Literal cases for operators: caps, ties, nulls, loops and empty inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import etl, export, graph, rag, ranking, search, stats, vector
from quillspark.streaming import windows

REL = "id long, subject long, predicate string, object long, source string, confidence double"


def rels(spark, edges):
    return spark.createDataFrame([(i, a, "p", b, "s", 0.5) for i, (a, b) in enumerate(edges)], REL)


def people(spark, n, hidden=()):
    return spark.createDataFrame([(i, "person", f"n{i}", '{"is_hidden": true}' if i in hidden else "{}") for i in range(n)], "id long, kind string, name string, properties string")


def test_star_is_cut_in_id_order(spark):
    nodes, edges, cut = graph.subgraph(rels(spark, [(0, i) for i in range(1, 21)]), people(spark, 21, {3}), 0, depth=1, max_nodes=10)
    assert cut and [r.id for r in nodes.collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9] and edges.count() == 8


def test_subgraph_against_model(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(35)]
        nodes, _, _ = graph.subgraph(rels(spark, pairs), people(spark, 30), 0, depth=3, max_nodes=10)
        seen, layer = {0: 0}, [0]
        for d in (1, 2, 3):
            near = sorted({b for a, b in pairs if a in layer} | {a for a, b in pairs if b in layer} - set(seen))
            layer = [x for x in near if x not in seen][: 10 - len(seen)]
            seen |= dict.fromkeys(layer, d)
        assert {r.id: r.depth for r in nodes.collect()} == seen


def test_self_loop_counts_once(spark):
    assert [(r.node, r.other, r.direction) for r in graph.symmetric(rels(spark, [(1, 1)])).collect()] == [(1, 1, "outgoing")]
    with pytest.raises(ValueError):
        graph.subgraph(rels(spark, [(1, 1)]), people(spark, 2), 1, depth=5)


def test_distinct_edges_and_commentaries(spark):
    df = spark.createDataFrame([(1, 1, "p", 2, "a", 0.5), (2, 1, "p", 2, "b", 0.9), (3, 1, "p", 2, "c", 0.9)], REL)
    assert [(r.confidence, r.source) for r in graph.distinct_edges(df).collect()] == [(0.9, "b")]
    texts = spark.createDataFrame([(1, "法華經"), (2, "法華經疏"), (3, "佛說般若"), (4, "般若疏"), (5, "心經疏")], "id int, title string")
    found = graph.commentaries(texts, "id", "title", ["疏"], {"心經": "法華經"}).collect()
    assert {(r.subject, r.object, r.confidence) for r in found} == {(2, 1, 0.8), (4, 3, 0.5), (5, 1, 0.7)}


def test_propagation_lineage_and_near(spark):
    e = spark.createDataFrame([(1, "person", "a", "{}"), (2, "place", "b", '{"latitude": 1, "longitude": "2"}'), (3, "person", "c", '{"latitude": 9, "longitude": 9}')], "id long, kind string, name string, properties string")
    r = spark.createDataFrame([(1, 1, "active_in", 2, "s", 0.5), (2, 3, "teacher_of", 2, "s", 1.0)], REL)
    got = {x.id: (x.lat, x.lng, x.geo_source) for x in graph.propagate(e, r, "active_in", "place").collect()}
    assert got == {1: (1.0, 2.0, "place:2"), 2: (1.0, 2.0, None), 3: (9.0, 9.0, None)}
    assert [(x.teacher_id, x.student_id) for x in graph.lineage(r, e).collect()] == [(3, 2)]
    new = spark.createDataFrame([(1, "寺 一", 30.0, 120.0, "x"), (2, "寺一", 31.0, 120.0, "y"), (3, "寺二", 0.0, 0.0, "q")], "id long, name string, lat double, lng double, external_id string")
    old = spark.createDataFrame([("寺一", 30.001, 120.0, "z"), ("寺三", 1.0, 1.0, "q")], "name string, lat double, lng double, external_id string")
    assert [x.id for x in graph.nearby_known(new, old).collect()] == [2]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, s int")
    new = spark.createDataFrame([(1, "b", None), (2, "c", 3)], "k int, v string, s int")
    once = etl.upsert(old, new, ["k"], ["s"])
    again = etl.upsert(once, new, ["k"], ["s"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, "b", 1), (2, "c", 3)]


def test_richest_and_flow(spark):
    c = spark.createDataFrame([(1, "g", False, 1, 2, "x" * 300, 3), (2, "g", True, None, None, None, None)], "id int, g string, exact boolean, b int, d int, note string, al int")
    assert etl.richest(c, "g", F.col("exact"), F.col("b"), F.col("d"), F.col("note"), F.col("al"), "id").first().id == 2
    moves = spark.createDataFrame([("draft", "submit"), ("pending", "approve"), ("pending", "reject"), ("pending", "revise"), ("draft", "approve"), ("approved", "reject")], "s string, a string")
    assert [r.n for r in moves.select(etl.flow(F.col("s"), F.col("a")).alias("n")).collect()] == ["pending", "approved", "rejected", "draft", None, None]


def test_accepts_stop_after_three(spark):
    a = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0])], "pair int, k int, v array<double>")
    b = spark.createDataFrame([(1, i, [1.0, i / 10]) for i in range(8)], "pair int, k int, v array<double>")
    got = vector.align(a, b, "pair", "k", "v", k=6, verdict=lambda x, y, s: y % 2 == 0).orderBy("b").collect()
    assert [(r.a, r.b) for r in got] == [(0, 0), (0, 2), (0, 4)]


def test_keyword_score(spark):
    row = spark.createDataFrame([(0.5, "心經 abc", "心經"), (0.5, "xyz", "心"), (0.5, "", None)], "s double, c string, t string")
    got = [r.x for r in row.select(rag.keyword_score(F.col("s"), "心經是什麼", F.col("c"), F.col("t")).alias("x")).collect()]
    assert got == pytest.approx([0.35 + 0.2 * 2 / 5 + 0.1, 0.35, 0.35])


def test_dictionary_phases(spark):
    few = spark.createDataFrame([(1, "red"), (2, "reddish"), (3, "a_red"), (4, "blue")], "id int, w string")
    assert [r.id for r in search.dictionary_search(few, "id", "w", "red").collect()] == [1, 2, 3]
    many = spark.createDataFrame([(i, f"red{i}") for i in range(6)] + [(9, "a red")], "id int, w string")
    assert 9 not in [r.id for r in search.dictionary_search(many, "id", "w", "red").collect()]
    assert search.dictionary_search(few, "id", "w", "%").count() == 0


def test_paging_and_picks(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert ranking.page(df, ["id"], 4, 3).count() == 1 and ranking.page(df, ["id"], 9, 3).count() == 0
    picked = ranking.pick_per_group(df, "g", "id", [0, 2, 4, 6, 8]).collect()
    assert len(picked) == 2
    assert ranking.adjacent(df, "id", 42).first().asDict() == {"previous": None, "next": 0}
    with pytest.raises(ValueError):
        ranking.around(df, ["g"], "id", df, 6)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k long, v string, t timestamp_ntz, u long")
    assert stats.distribution(empty, "v").count() == 0
    assert stats.daily_grid(empty.withColumn("d", stats.local_day(F.col("t"))), "d", "2024-01-03", 3, F.count(F.lit(1))).count() == 3
    assert search.bm25(empty, "k", F.split("v", " "), ["x"]).count() == 0
    assert graph.distinct_edges(spark.createDataFrame([], REL)).count() == 0


def test_json_ld(spark):
    e = spark.createDataFrame([(1, "person", "法藏", "Fazang", "", '{"a": "http://x", "b": "Q1"}'), (2, "place", "x", None, None, None)], "id int, kind string, zh string, en string, sa string, ext string")
    rows = export.json_ld(e, "urn:", [("zh", "zh"), ("en", "en"), ("sa", "sa")], "ext").orderBy("id").collect()
    assert rows[0].json == '{"@id":"urn:1","@type":"person","prefLabel":"法藏","altLabel":[{"@value":"Fazang","@language":"en"}],"sameAs":["http://x"]}'
    assert rows[1].json == '{"@id":"urn:2","@type":"place","prefLabel":"x","altLabel":[],"sameAs":[]}'


def test_streams_match_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    times = ["00:00:01", "00:00:30", "00:00:59", "00:01:10", "00:06:00", "00:30:00"]
    rows = spark.createDataFrame([(1, f"2024-01-01 {t}") for t in times], "u long, t string").select("u", F.col("t").cast("timestamp").alias("t"))
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("u long, t timestamp").parquet(src)

    windows.use_state_store(spark)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert [(r.u, str(r.window_start), r.n) for r in run(windows.rate_windows(stream, "u", "t", 2), "rate")] == [(1, "2024-01-01 00:00:00", 3)]
    assert [str(r.t)[11:] for r in run(windows.throttled(stream, "u", "t", 300), "thr")] == ["00:00:01", "00:06:00", "00:30:00"]
    q = stream.writeStream.foreachBatch(windows.upsert_sink(out, ["u"], "t", "t")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [str(r.t) for r in windows.upserted(spark, out, "u long, t timestamp").collect()] == ["2024-01-01 00:30:00"]
