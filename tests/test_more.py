"""Literal cases for operators that no driver table represents."""

from pyspark.sql import functions as F

from quillspark.functions import names
from quillspark.functions import text as T
from quillspark.operators import etl, graph, ranking, search, service, stats
from quillspark.sources import catalogs, dictionaries, tei


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths_headers_and_pages(spark):
    assert tuple(one(spark, tei.work_of_path(F.lit("/a/T/T08/T08n0251_001.xml")))) == ("T", "08", "251_001.xml".split("_")[0])
    assert tuple(one(spark, catalogs.header(F.lit("<title>心經</title><author>唐 玄奘譯</author><extent>1卷</extent>")))) == ("心經", "唐 玄奘譯", 1)
    page = one(spark, catalogs.sutta_page(F.lit("<h1>MN <b>10</b></h1><p>One.</p><p> </p><p>Two <i>x</i></p>")))
    assert tuple(page) == ("MN 10", "One.\nTwo x")


def test_authority_and_xml_dictionary(spark, tmp_path):
    people = tmp_path / "p.xml"
    people.write_text('<list><person xml:id="A1"><persName>甲</persName><relation name="teacher" active="#A2"/></person><person xml:id="A2"><persName>乙</persName></person></list>')
    rows = catalogs.persons(spark, str(people)).orderBy("id").collect()
    assert [(r.id, r.name, r.relation, r.other) for r in rows] == [("A1", "甲", "teacher", "A2"), ("A2", "乙", None, None)]
    entries = tmp_path / "d.xml"
    entries.write_text("<d><entry><form>dharma</form><sense>law</sense></entry><entry><form>x</form></entry></d>")
    got = dictionaries.xml_entries(spark, str(entries), "entry", "form", "sense").collect()
    assert [(r.headword, r.definition) for r in got] == [("dharma", "law")]


def test_csv_with_extra_columns(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('a,"<i>x, y</i>",,n\n,none\nb,\n')
    rows = dictionaries.delimited(spark, str(path), ",", extra=True).collect()
    assert [(r.headword, r.definition, r.entry_data) for r in rows] == [("a", "x, y", '{"col_3":"n"}')]


def test_reading_layout(spark):
    lines = ["般若經卷第一", "玄奘譯", "序品第一", "如是我聞", "一時佛在", "", "色即是空　空即是色", "終"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, at int, line string")
    got = service.merged_prose(df, "doc", "at", "line").orderBy("block").collect()
    assert [(r.kind, r.text) for r in got] == [("juan", "般若經卷第一"), ("byline", "玄奘譯"), ("section", "序品第一"), ("prose", "如是我聞一時佛在"), ("verse", "色即是空　空即是色"), ("prose", "終")]


def test_sentence_edges(spark):
    long = "斷了。" + "這是一個相當長的句子用來測試前後邊界的處理方法"
    assert one(spark, T.snap_head(F.lit(long))) == long[3:] and one(spark, T.snap_head(F.lit("短。短"))) == "短。短"
    assert one(spark, T.snap_tail(F.lit(long[3:] + "。尾"))) == long[3:] + "。" and one(spark, T.snap_tail(F.lit("a。b"))) == "a。b"
    assert one(spark, T.sanitize_highlight(F.lit("<b><em>x</em><script>"))) == "<em>x</em>"
    assert one(spark, T.shortened(F.lit("x" * 10), 8)) == "xxxxx..." and one(spark, T.fold_diacritics(F.lit("Saṃyutta Nikāya"))) == "samyutta nikaya"
    assert one(spark, names.reading(F.lit("(fa) law"))) == "fa" and one(spark, names.reading(F.lit("law"))) is None
    assert one(spark, search.fragments(F.lit("a" * 100 + "KEY" + "b" * 100), "key", 11)) == ["aaaa<em>KEY</em>bbbb"]


def test_models_and_runs(spark):
    df = spark.createDataFrame([(1, "a long enough text"), (2, "short")], "id int, t string")
    rows = service.embedded(df, "t", service.hashed_encoder(8)).collect()
    assert [r.id for r in rows] == [1] and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5
    seen = []

    def fails():
        raise ValueError

    steps = [(1, "c", lambda: seen.append("c")), (0, "a", lambda: seen.append("a")), (0, "b", lambda: seen.append("b"))]
    assert service.run_in_order(steps, done=["b"]) == ["a", "c"] == seen
    assert service.run_in_order([(0, "x", fails), (0, "y", lambda: None), (1, "z", lambda: None)]) == ["y"]
    assert service.run_log(spark, "s", "t0", "t1", {"n": 1}, "boom").first().status == "failed"


def test_two_hop_places_and_sites(spark):
    rel = spark.createDataFrame([(1, 1, "translated", 5, "s", 0.5), (2, 5, "translated_at", 9, "s", 0.9), (3, 1, "translated", 6, "s", 0.8), (4, 6, "translated_at", 8, "s", 0.9)], "id long, subject long, predicate string, object long, source string, confidence double")
    assert [(r.node, r.place) for r in graph.via(rel, "translated", "translated_at").collect()] == [(1, 8)]
    c = spark.createDataFrame([(1, "於大慈恩寺翻經院譯。"), (2, "於小寺譯"), (3, None)], "id int, t string")
    assert [(r.id, r.site) for r in graph.sites(c, "id", F.col("t"), ["大慈恩寺"]).collect()] == [(1, "大慈恩寺")]


def test_year_slice_and_bounds(spark):
    df = spark.createDataFrame([(1, None, None), (2, 600, None), (3, 500, 700)], "id int, a int, b int")
    assert [r.id for r in df.filter(graph.in_year_slice(F.col("a"), F.col("b"), 650)).collect()] == [1, 3]
    assert [r.id for r in df.filter(graph.years_overlap(F.col("a"), F.col("b"), 701, None)).collect()] == [1, 2]
    assert [r.line for r in service.timeline_rows(df.filter("a IS NOT NULL"), "a", "id", 2).orderBy("a").collect()] == [0, 1]


def test_recent_keeps_undated_on_request(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-30 00:00:00'), (2, timestamp_ntz'2023-01-01 00:00:00'), (3, NULL) AS t(id, at)")
    assert sorted(r.id for r in stats.recent(df, "at", "2024-01-31 00:00:00", 7).collect()) == [1]
    assert sorted(r.id for r in stats.recent(df, "at", "2024-01-31 00:00:00", 7, keep_null=True).collect()) == [1, 3]


def test_local_day_turns_at_sixteen_utc(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 15:59:59'), (timestamp_ntz'2024-01-01 16:00:00') AS t(at)")
    assert [str(r.d) for r in df.select(stats.local_day(F.col("at")).alias("d")).collect()] == ["2024-01-01", "2024-01-02"]


def test_parallel_reading_and_collapse(spark):
    c = spark.createDataFrame([(1, 1, "pi", "p"), (1, 1, "lzh", "l"), (2, 1, "bo", "b")], "t int, j int, lang string, content string")
    r = service.parallel_reading(c, "t", "j", "lang", 1, 2, 1, "pi").first()
    assert (r.left, r.right) == ("p", "b")
    hits = spark.createDataFrame([("w", i, float(i % 3)) for i in range(7)], "w string, k int, s double")
    got = ranking.collapse(hits, "w", "s", "k", 2).first()
    assert (got.best_key, got.best_score, got.n_hits, got["keys"]) == (2, 2.0, 7, [2, 5])


def test_fuzzy_catalog_search(spark):
    df = spark.createDataFrame([(1, "Heart Sutra", "心經"), (2, "Hearts of gold", "x"), (3, "Diamond", None), (4, "harp", "般若波羅蜜多心經")], "id int, en string, zh string")
    hits = lambda q, **k: {r.id: r.score for r in search.catalog_search(df, "id", q, {"en": 2.0, "zh": 3.0}, {"zh": 15.0, "en": 8.0}, {}, **k).collect()}
    assert set(hits("heart sutra")) == {1} and hits("heart sutra")[1] > 8 and hits("haert sutrb") == {} and set(hits("hart")) == {1, 4}
    expanded = hits("心經", expansion="般若波羅蜜多心經")
    assert set(expanded) == {1, 4} and expanded[1] > 15 and expanded[4] > 45 and len(hits(" ")) == 4
    texts = spark.createDataFrame([(1, "heart sutra"), (2, "lotus sutra"), (3, "hart"), (4, None)], "id int, title string")
    find = lambda q: {r.id: r.score for r in search.catalog_search(texts, "id", q, {"title": 3.0}, {"title": 10.0}, {}).collect()}
    assert find("haert sutra") == {}  # a swap is two edits, forgiven only from six letters on
    assert set(find("hearts")) == {1, 3} and set(find("sutr")) == {1, 2} and find("lotus sutra")[2] > 10
    assert find("") == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0} and find("zzz") == {}


def test_dense_ids_of_a_wide_table(spark):
    """What is counted and what is numbered are the same parts, whatever columns each needs."""
    wide = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.repeat(F.col("id").cast("string"), 128).alias("wide")).dropDuplicates(["k"])
    out = etl.with_dense_ids(wide, "k", "n")
    row = out.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b"), F.sum(F.length("wide")).alias("w")).first()
    assert (row.c, row.d, row.a, row.b) == (400_000, 400_000, 1, 400_000) and row.w > 128 * 400_000
    assert out.filter("n <= 1000").agg(F.max("k")).first()[0] < out.filter("n > 1000").agg(F.min("k")).first()[0]


def test_turns_of_a_hot_base(spark):
    """A base of a third of all rows lies in several parts and is still numbered without gaps."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 500)).alias("b")).unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS STRING) AS b"))
    got = etl.numbered_ids(rows, F.col("b"), ["id"]).collect()
    assert len(got) == 30_001 and [r.external_id for r in got if r.b is None] == [None]
    by_base = {}
    for r in sorted((r for r in got if r.b), key=lambda r: r.id):
        by_base[r.b] = by_base.get(r.b, 0) + 1
        assert r.external_id == (r.b if by_base[r.b] == 1 else f"{r.b}-{by_base[r.b]}")


def test_written_postings(spark, tmp_path):
    """A query over the written index gives the scores of a scan and reads its terms' folders only."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    search.write_postings(docs, "doc_id", T.words(F.col("text")), f"file://{tmp_path}/index")
    found = search.bm25_of_postings(spark, f"file://{tmp_path}/index", "doc_id", ["the", "was", "nowhere"])
    scanned = search.bm25(docs, "doc_id", T.words(F.col("text")), ["the", "was", "nowhere"])
    pack = lambda df: {r.doc_id: (round(r.score, 9), r.n_terms) for r in df.collect()}
    assert pack(found) == pack(scanned)
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()


def test_throttle_twins(spark):
    """A span runs from the event that passed, not from a fixed clock."""
    rows = [(1, 0), (1, 299), (1, 300), (1, 599), (1, 900), (2, 5), (2, 5), (None, 7)]
    df = spark.createDataFrame([(u, s, i) for i, (u, s) in enumerate(rows)], "u int, s long, i int").withColumn("t", F.timestamp_seconds("s"))
    assert sorted(r.i for r in stats.throttled(df, "u", "t", 300, "i").collect()) == [0, 2, 4, 5]


def test_commentary_cascade(spark):
    titles = ["心經疏", "心經", "佛華嚴經疏", "大方廣佛華嚴經", "觀無量壽疏", "觀無量壽經", "蓮華疏", "妙法蓮華", "孤本疏", "大孤本論", "雙疏", "雙一", "雙二"]
    texts = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {titles[r.subject]: (titles[r.object], r.confidence) for r in graph.commentaries(texts, "id", "title", ["疏"], {}).collect()}
    assert got == {"心經疏": ("心經", 0.8), "佛華嚴經疏": ("大方廣佛華嚴經", 0.6), "觀無量壽疏": ("觀無量壽經", 0.6), "蓮華疏": ("妙法蓮華", 0.6), "孤本疏": ("大孤本論", 0.5)}


def test_translators_without_dynasty(spark):
    rows = spark.createDataFrame([("唐 玄奘",), ("後秦鳩摩羅什",), ("玄奘",), ("",)], "t string")
    assert [r.n for r in rows.select(names.without_dynasty(F.col("t")).alias("n")).collect()] == ["玄奘", "鳩摩羅什", "玄奘", ""]
