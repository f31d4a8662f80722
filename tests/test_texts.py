"""Longest-match rewriting, passages, deep menus and resumable imports."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rewriting
from quillspark.operators import imports, search
from quillspark.sources import catalogs


def replaced(text, mapping):
    """Leftmost, then longest, one place after another."""
    out, i = "", 0
    while i < len(text):
        found = max((k for k in mapping if text.startswith(k, i)), key=len, default=None)
        out, i = (out + mapping[found], i + len(found)) if found else (out + text[i], i + 1)
    return out


def test_longest_match(spark):
    rng = random.Random(6)
    mapping = {"".join(rng.choices("abc法华", k=rng.randint(1, 5))): f"<{i}>" for i in range(60)} | {"금강경": "金剛經", "금강": "金剛", "": "never"}
    texts = ["".join(rng.choices("abcd法华 ", k=rng.randint(0, 60))) for _ in range(200)] + ["금강경과 금강", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.x for r in df.select("i", rewriting.replace_longest(F.col("t"), mapping).alias("x")).collect()}
    plain = {k: v for k, v in mapping.items() if k}
    assert all(got[i] == (None if t is None else replaced(t, plain)) for i, t in enumerate(texts))
    one = spark.createDataFrame([("佛说阿弥陀经",)], "t string")
    assert one.select(rewriting.replace_longest(F.col("t")).alias("x")).first().x == "".join(rewriting.CHARACTERS.get(c, c) for c in "佛说阿弥陀经") != "佛说阿弥陀经"
    assert one.select(rewriting.replace_longest(F.col("t"), {}).alias("x")).first().x == "佛说阿弥陀经"
    names = {"法华": "法華", "法华经": "法華經"}
    row = spark.createDataFrame([("法华经",), ("法華經",)], "t string").select(rewriting.spellings(F.col("t"), names).alias("s")).collect()
    assert [r.s for r in row] == [["法华经", "法華經"], ["法華經", "法华经"]]


def test_mapping_tables(spark):
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("", "x"), (None, "y"), ("b", None), ("c", "3")], "k string, v string")
    assert rewriting.mapping_of(rows, "k", "v") == {"a": "1", "c": "3"}
    with pytest.raises(ValueError, match="more than 1"):
        rewriting.mapping_of(rows, "k", "v", most=1)


def test_fragments(spark):
    filler = "Nothing of note is said in this one. " * 5
    text = filler + "The lotus grows here. " + filler + "A lotus and a heart, a lotus. " + filler + "Heart to heart. " + filler + "Hearts are no match."
    rows = [(1, text), (2, "no match"), (3, ""), (4, None), (5, "lotus")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r for r in search.content_fragments(df, "k", "t", ["lotus", "heart"], size=40, n=2).collect()}
    assert set(got) == {1, 5} and got[5].fragments == ["<em>lotus</em>"] and got[1].n_passages == 3
    joined = " ".join(got[1].fragments)
    assert "A <em>lotus</em> and a <em>heart</em>, a <em>lotus</em>." in joined and "<em>Heart</em> to <em>heart</em>" in joined and "Hearts are" not in joined
    assert [len(re.sub("</?em>", "", x)) <= 40 + 40 for x in got[1].fragments] == [True, True]


def test_menus_of_any_depth(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "end"), ("n7", "side"), ("x", None), (None, "y"), ("a", "b")]
    menu = spark.createDataFrame(edges, "p string, c string")
    got = sorted(tuple(r) for r in catalogs.menu_leaves(menu, "p", "c", ["n0", "a", "alone", "a"]).collect())
    assert got == [("a", "end"), ("alone", "alone"), ("n0", "n30"), ("n0", "side")]


def test_import_resumes_from_the_first_step_not_committed(spark, tmp_path):
    path, calls, broken = f"file://{tmp_path}/import", [], {"value": True}

    def texts(spark, tables):
        calls.append("texts")
        return spark.range(100).withColumn("title", F.concat(F.lit("t"), "id"))

    def lines(spark, tables):
        calls.append("lines")
        if broken["value"]:
            fail = F.when(F.col("id") > 90, F.raise_error(F.lit("power cut")).cast("string")).otherwise(F.col("title"))
            return tables["texts"].withColumn("title", fail)
        return tables["texts"].filter("id % 2 = 0")

    steps = [imports.Step("texts", texts, {"long_titles": F.count_if(F.length("title") > 2)}), imports.Step("lines", lines)]
    with pytest.raises(Exception, match="power cut"):
        imports.run(spark, path, "demo", steps, retries=2, wait=0.01)
    assert calls == ["texts", "lines", "lines"] and set(imports.committed(spark, path)) == {"texts"}
    broken["value"] = False
    counters = imports.run(spark, path, "demo", steps)
    assert calls == ["texts", "lines", "lines", "lines"]
    assert counters == {"texts": {"rows": 100, "long_titles": 90}, "lines": {"rows": 50}} == imports.committed(spark, path)
    assert imports.table(spark, path, "lines").count() == 50
    assert imports.run(spark, path, "demo", steps) == counters and len(calls) == 4
    log = spark.read.parquet(f"{path}/log").orderBy("started_at").collect()
    assert [r.status for r in log] == ["failed", "success", "success"] and "power cut" in log[0].error_log
    (tmp_path / "import" / "manifest" / "lines" / "_SUCCESS").unlink()  # a commit that did not come to its end
    assert imports.run(spark, path, "demo", steps) == counters and len(calls) == 5
