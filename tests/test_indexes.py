"""Searches over written indexes against plain loops: the same rows, from fewer of them."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cells, index, search, suggester, vector


def scanned(df):
    """Rows that the file scans of an executed frame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    rows, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def search_model(docs, query, weights, k, every, fuzzy, phrase):
    words = list(dict.fromkeys(query))
    edits = {w: search.edits_allowed(w) if fuzzy else 0 for w in words}
    near = {w: {t for d in docs.values() for ts in d.values() for t in set(ts) if edit_distance(t, w) <= edits[w]} for w in words}
    out = []
    stats = {}
    for f in weights:
        sizes = [len(d[f]) for d in docs.values() if d[f]]
        stats[f] = len(sizes), sum(sizes) / max(len(sizes), 1), {w: sum(any(t in near[w] for t in d[f]) for d in docs.values()) for w in words}
    for key, d in docs.items():
        best = more = 0.0
        for f, weight in weights.items():
            n, mean, df = stats[f]
            tf = {w: sum(t in near[w] for t in d[f]) for w in words}
            if all(tf.values()) or not every:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d[f]) / mean)) for w in words if tf[w])
                best = max(best, weight * s)
            if any(d[f][i : i + len(query)] == query for i in range(len(d[f]))):
                more += phrase.get(f, 0.0)
        if best + more > 0:
            out.append((-round(best + more, 9), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("sutra", "karma", "lotus", "path", "od") for b in ("", "s", "ed", "ing", "x")] + [f"rare{i}" for i in range(300)]
    docs = {i: {"title": rng.choices(vocabulary, k=rng.randint(0, 5)), "body": rng.choices(vocabulary[:25] + vocabulary[25 : 25 + 12 * (i % 25)], k=rng.randint(0, 60))} for i in range(1500)}
    for i in range(0, 1500, 400):
        docs[i]["body"] = ["karma"] * 20 + ["path", "karma", "karma"]
    df = spark.createDataFrame([(i, d["title"], d["body"]) for i, d in docs.items()] + [(None, ["karma"], ["karma"])], "key int, title array<string>, body array<string>")
    path = str(tmp_path_factory.mktemp("index")) + "/i"
    index.write_index(df, "key", {"title": F.col("title"), "body": F.col("body")}, path, buckets=4, span=32, group_bytes=1024)
    return docs, path


QUERIES = [["karma"], ["karma", "path"], ["path", "karma", "karma"], ["sutras", "lotus"], ["rare7", "rare11"], ["od"], ["nothing"], ["karmaa", "lotusing"]]


@pytest.mark.parametrize("query", QUERIES, ids=" ".join)
@pytest.mark.parametrize(("every", "fuzzy"), [(True, False), (False, False), (True, True)])
def test_index_equals_scan(spark, corpus, query, every, fuzzy):
    docs, path = corpus
    weights, phrase = {"title": 3.0, "body": 1.0}, {"body": 2.5}
    got = [tuple(r) for r in index.search_index(spark, path, query, weights, 10, every, fuzzy, phrase).collect()]
    expected = search_model(docs, query, weights, 10, every, fuzzy, phrase)
    assert [k for k, _ in got] == [k for k, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-7)


def test_blocks_below_the_running_threshold_are_skipped(spark, corpus):
    docs, path = corpus
    found = index.search_index(spark, path, ["karma"], {"body": 1.0}, 4, first=2)
    assert {r.key for r in found.collect()} == {0, 400, 800, 1200}
    holding = sum("karma" in d["body"] for d in docs.values())
    every = spark.read.parquet(f"{path}/postings").filter("term = 'karma' AND field = 'body'").count()
    assert every == holding > 250 and 0 < scanned(found) < spark.read.parquet(f"{path}/postings").count() / 20
    assert "In(block, [" in found._jdf.queryExecution().toString()  # blocks reach the scan


def test_filters_and_missing_fields(spark, corpus):
    docs, path = corpus
    allowed = spark.range(0, 1500, 7).select(F.col("id").alias("k"))
    got = [r.key for r in index.search_index(spark, path, ["karma"], {"body": 1.0, "absent": 9.0}, 10, allowed=allowed).collect()]
    model = search_model(docs, ["karma"], {"body": 1.0}, 2000, True, False, {})
    assert got == [k for k, _ in model if k % 7 == 0][:10]
    assert index.search_index(spark, path, [], {"body": 1.0}, 5).count() == 0 and index.search_index(spark, path, ["x"], {"absent": 1.0}, 5).count() == 0


def test_deletions_find_every_word_within_two_edits(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 11))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", index.deletions(F.col("w")).alias("d"))
    pairs = {(r.a, r.b) for r in df.toDF("a", "da").crossJoin(df.toDF("b", "db")).filter(F.arrays_overlap("da", "db")).collect()}
    assert {(a, b) for a in words for b in words if edit_distance(a, b) <= 2} <= pairs


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "key long, body array<string>")
    index.write_index(none, "key", {"body": F.col("body")}, f"{tmp_path}/i")
    assert index.search_index(spark, f"{tmp_path}/i", ["a"], {"body": 1.0}, 5, fuzzy=True).count() == 0


def test_phrase_suggestions(spark, tmp_path):
    lines = ["the heart sutra"] * 30 + ["the hearth burns"] * 3 + ["lotus sutra"] * 10 + ["heart of the lotus"] * 8 + [None, ""]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(F.filter(F.split("x", " "), lambda w: w != "").alias("w"))
    suggester.write_phrase_model(df, F.col("w"), f"{tmp_path}/m", buckets=2)
    best = lambda q, **o: [r.suggestion for r in suggester.phrase_suggestions(spark, f"{tmp_path}/m", q.split(), **o).collect()]
    assert best("the haert sutra") == ["the heart sutra"]
    assert best("the hearth sutra") == ["the heart sutra"]  # a real word, but not here
    assert best("the heaven sutrra") == ["the heaven sutra"] and best("teh sutra") == []
    assert best("hearth burns") == [] and best("the heart sutra") == [] and best("") == []
    assert best("lotsu haert", errors=2) == ["lotus heart"] and "lotus heart" not in best("lotsu haert", size=9)


def test_phrase_model_reads_texts_once(spark, tmp_path):
    """Each list is made once; counts hold across runs of lists; words that begin alike share their deletions."""
    rng = random.Random(3)
    lists = [[rng.choice(["common" + c for c in "abcdefgh"] + ["commona" + "x" * i for i in range(9)] + ["of", "é"]) for _ in range(rng.randint(1, 9))] for _ in range(300)] + [["of", None, "é"], [None], [], None]
    made = spark.sparkContext.accumulator(0)

    def seen(w):
        made.add(1)
        return w

    df = spark.createDataFrame([(w,) for w in lists], "w array<string>")
    suggester.write_phrase_model(df, F.udf(seen, "array<string>")("w"), f"{tmp_path}/m", buckets=4)
    assert made.value <= 2 * len(lists)  # the filter and the list itself
    words = collections.Counter(x for w in lists for x in w or [] if x)
    pairs = collections.Counter(p for w in lists for p in zip(w or [], (w or [])[1:]) if all(p))
    rows = spark.read.parquet(f"{tmp_path}/m/counts").collect()
    assert collections.Counter({r.term: r.n for r in rows if r.first is None}) == words and collections.Counter({(r.first, r.term): r.n for r in rows if r.first is not None}) == pairs
    assert len(rows) == len(words) + len(pairs) and spark.read.parquet(f"{tmp_path}/m/totals").first().total == sum(words.values())
    left = spark.read.parquet(f"{tmp_path}/m/deletions").groupBy("start", "left").count()
    assert left.filter("count > 1").count() == 0 and {r.start for r in left.collect()} == {w[:7] for w in words}
    batch = pa.RecordBatch.from_pydict({"w": pa.array([w or [] for w in lists], pa.list_(pa.string()))})
    runs = list(suggester._tallies(iter([batch.slice(0, 100), batch.slice(100)]), most=20, rows=7))
    got = collections.Counter()
    for r in (r for b in runs for r in b.to_pylist()):
        got[r["first"], r["term"]] += r["n"]
    assert got == collections.Counter({(None, w): n for w, n in words.items()} | dict(pairs)) and max(len(b) for b in runs) <= 7


def test_completions_read_a_range(spark, tmp_path):
    values = [f"{a} {b} {i}" for a in ("Lotus", "heart", "great") for b in ("Sutra", "of path", "the-Way") for i in range(60)] + ["...", "", "élan vital"]
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, None)], "a string, b string").repartition(4)
    suggester.write_completions(df, ["a", "b"], f"{tmp_path}/c", short=2, k=5, group_bytes=1024)
    for typed in ["h", "su", "sutra 1", "the way", "THE  WAY 2", "of", "path 5", "é", "élan v", "zz", "x"]:
        pattern = " ".join(typed.lower().split())
        plain = lambda v: " " + " ".join("".join(c if c.isalnum() else " " for c in v.lower()).split())
        expected = sorted(v for v in [*values, "x"] if " " + pattern in plain(v))[:5]
        assert [r.suggestion for r in suggester.completions(spark, f"{tmp_path}/c", typed).collect()] == expected, typed
    assert len(suggester.completions(spark, f"{tmp_path}/c", "h", 50).collect()) == 50 and suggester.completions(spark, f"{tmp_path}/c", " .").count() == 0
    one = suggester.completions(spark, f"{tmp_path}/c", "élan vital")
    one.collect()
    assert scanned(one) < len(values)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 16))
    rows = np.repeat(heads, 60, axis=0) + 0.35 * rng.normal(size=(2400, 16))
    return rows


def cosines(rows, q):
    return rows @ q / np.linalg.norm(rows, axis=1) / np.linalg.norm(q)


def test_cells(spark, points, tmp_path):
    """Exact searches equal the scan and read few vectors; few probes give a recall of 0.9 and more."""
    odd = [(-1, None, 0), (-2, [0.0] * 16, 0), (-3, [1.0], 0), (-4, [float("nan")] * 16, 0), (-5, [], 0)]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)] + odd, "id long, v array<double>, g int")
    cells.write_cells(df, "id", "v", f"{tmp_path}/v", cells=40, sample=1000)
    found = cells.Cells(spark, f"{tmp_path}/v", "id", "v")
    assert found.rows.count() == len(points) + len(odd)
    met = wanted = 0
    for i in range(0, 2400, 240):
        score = cosines(points, points[i])
        exact = [r.id for r in found.top_k(points[i].tolist(), 10).collect()]
        assert exact == sorted(range(2400), key=lambda j: (-score[j], j))[:10]
        some = found.top_k(points[i].tolist(), 10, probes=3)
        met += len(set(exact) & {r.id for r in some.collect()})
        wanted += 10
        few = found.top_k(points[i].tolist(), 10, where=F.col("g") == 1, least=0.5)
        assert [r.id for r in few.collect()] == [j for j in sorted(range(2400), key=lambda j: (-score[j], j)) if j % 3 == 1 and score[j] >= 0.5][:10]
        assert scanned(some) < 2400 / 4 and scanned(few) < 2400 / 2
    assert met / wanted >= 0.9
    assert found.top_k([0.0] * 16, 5).count() == 0


def test_cells_of_nothing(spark, tmp_path):
    for i, rows in enumerate(([], [(1, None)], [(1, [0.0, 0.0])])):
        cells.write_cells(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", f"{tmp_path}/{i}")
        assert cells.Cells(spark, f"{tmp_path}/{i}", "id", "v").top_k([1.0, 0.0], 3).count() == 0


def test_alignment_in_blocks(spark, points):
    """A pair that is larger than a block, a small one, and vectors that are near nothing."""
    a = [("p", i, points[i].tolist()) for i in range(0, 500)] + [("q", 1, points[3].tolist()), ("none", 2, points[4].tolist()), ("p", 9000, [0.0] * 16), ("p", 9001, None), ("p", 9002, [1.0])]
    b = [("p", i, points[i].tolist()) for i in range(400, 1000)] + [("q", i, points[i].tolist()) for i in (3, 5)] + [("p", 9003, [float("inf")] * 16), ("p", 400, points[401].tolist())]
    make = lambda rows: spark.createDataFrame(rows, "pair string, k long, v array<double>")
    got = collections.defaultdict(list)
    for r in vector.nearest_of_blocks(make(a), make(b), "pair", "k", "v", 5, 0.3, block=90).collect():
        got[r.pair, r.a].append((-r.score, r.b))
    for pair, key, v in a:
        good = lambda x: x is not None and len(x) == 16 and all(map(math.isfinite, x)) and any(x)
        near = [(-round(float(cosines(np.array([w]), np.array(v))[0]), 9), k) for p, k, w in b if p == pair and good(v) and good(w)]
        expected = sorted(x for x in near if -x[0] >= 0.3)[:5]
        assert [k for _, k in sorted(got[pair, key])] == [k for _, k in expected]
