from pyspark.sql import functions as F

from quillspark.functions import geo, names
from quillspark.functions import text as T
from quillspark.sources import dictionaries, markup, tei

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://www.cbeta.org/ns/1.0"><text><body>
<milestone n="1" unit="juan"/><cb:juan n="001" fun="open">卷第一</cb:juan><byline>玄奘譯</byline>
<p>觀自在<note>x</note>菩薩</p><p>行<g ref="#CB1"/>深<app>y</app>時<g ref="#CB9"></g></p>
<milestone n="2" unit="juan"/><lg><l>色即是空</l><l>空即是色</l></lg></body></text></TEI>"""


def test_tei_chapters(spark):
    df = spark.createDataFrame([("a", TEI), ("bad", "<x"), ("null", None)], "id string, xml string")
    rows = tei.chapters(df, "id", "xml", {"CB1": "甚"}).orderBy("juan_num").collect()
    assert [(r.id, r.juan_num, r.content, r.char_count) for r in rows] == [
        ("a", 1, "卷第一\n玄奘譯\n\n觀自在菩薩\n\n行甚深時□", 16),
        ("a", 2, "色即是空\n空即是色", 8),
    ]


def test_rare_glyphs(spark):
    df = spark.createDataFrame([("1", "甲", None, None, None), ("2", "", "乙", "丙", "x"), ("3", None, "", "丙", "x"), ("4", None, None, None, "[a*b]"), ("5", None, None, None, None)], "id string, uni_char string, norm_uni_char string, norm_big5_char string, composition string")
    assert {r.id: r.glyph for r in tei.rare_glyphs(df).collect()} == {"1": "甲", "2": "乙", "3": "丙", "4": "[a*b]"}


def test_translation(spark):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><titleStmt><title xml:lang="en">Rice & Seedling</title><title xml:lang="bo">sa lu</title></titleStmt><publicationStmt><idno type="Toh">Toh 210</idno></publicationStmt><text><body><div type="summary"><p>S.</p></div><div type="translation"><p>One.</p><p>Two.</p></div></body></text></TEI>'
    r = spark.createDataFrame([(xml,)], "x string").select(tei.translation(F.col("x")).alias("t")).first().t
    assert (r.title_en, r.title_bo, r.title_sa, r.toh_number, r.translation, r.summary) == ("Rice & Seedling", "sa lu", "", "Toh 210", "One.\n\nTwo.", "S.")


def test_romanised_text(spark):
    html = "<!DOCTYPE html><html><head><title> Nāgārjuna: Verses </title></head><body>meta<hr>boiler<hr/>one<BR>two <b>x</b><p>three</body></html>"
    plain = "# Title: Vajra\n# Author: unknown\n// note\n\nbody {c} one\n// gone\n<i>two</i>"
    rows = spark.createDataFrame([(1, html), (2, plain), (3, "")], "id int, t string").select("id", markup.romanised_text(F.col("t")).alias("x")).orderBy("id").collect()
    assert (rows[0].x.title, rows[0].x.author, rows[0].x.content) == ("Nāgārjuna: Verses", "Nāgārjuna", "one\ntwo x\nthree")
    assert (rows[1].x.title, rows[1].x.author, rows[1].x.content) == ("Vajra", "unknown", "body  one\ntwo")
    assert rows[2].x.content == "" and rows[2].x.char_count == 0
    more = ["Verfasser: A\nQuelle: B: 1\n\n===\nrest", "# only\n// header", "# T\n---\none\n\ntwo <b>x</b>", None, "<html><title>No rule</title><body>all\n\n\n\nof  it</body></html>"]
    got = spark.createDataFrame(list(enumerate(more)), "id int, t string").select("id", markup.romanised_text(F.col("t")).alias("x")).orderBy("id").collect()
    assert [tuple(r.x) for r in got] == [
        ("Verfasser: A", "A", "Verfasser: A\nQuelle: B: 1\n\n===\nrest", 35, "B: 1"),
        ("only", "", "", 0, ""),
        ("two <b>x</b>", "", "one\n\ntwo x", 10, ""),
        ("", "", "", 0, ""),
        ("No rule", "", "all\n\nof it", 10, ""),
    ]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link> http://x/1 </link><description><![CDATA[<p>Hi</p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed><entry><title>C</title><link rel="self" href="http://s"/><link rel="alternate" href="http://x/2"/><author><name>N</name></author><updated>2024-02-03T04:05:06Z</updated></entry></feed>'
    rows = markup.feed_entries(spark.createDataFrame([("r", rss), ("a", atom)], "s string, x string"), "s", "x").orderBy("title").collect()
    assert [(r.title, r.url, r.summary, r.author, str(r.published_at)) for r in rows] == [("A & B", "http://x/1", "Hi", None, "2024-01-01 10:00:00"), ("C", "http://x/2", None, "N", "2024-02-03 04:05:06")]


def test_jsonp_outline_and_ranges(spark):
    j = spark.createDataFrame([('cb({"data2": {"b": 1}, "data1": {"a": 1}, "n": 2} trailing)',), ("junk",)], "t string").select(markup.jsonp_entries(F.col("t")).alias("e")).collect()
    assert j[0].e == ['{"a":1}', '{"b":1}'] and j[1].e == []
    org = ["* Cat", "** Work one", ":PROPERTIES:", ":ID: K1", ":EXTENT: III", ":END:", "** Work two", "* Other"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(org)], "doc string, at int, line string")
    out = markup.outline(lines, "doc", "at", "line").orderBy("at").collect()
    assert [(r.category, r.title, r.properties) for r in out] == [("Cat", "Work one", {"ID": "K1", "EXTENT": "III"}), ("Cat", "Work two", {})]
    ids = spark.createDataFrame([("SC-an1.51-60",), ("SC-an1.56",), ("SC-dhp71",), ("SC-x",)], "w string").select(markup.sutta_range(F.col("w")).alias("r")).collect()
    assert [tuple(x.r) for x in ids] == [("SC-an1.", 51, 60), ("SC-an1.", 56, 56), ("SC-dhp", 71, 71), ("SC-x", None, None)]
    e = spark.createDataFrame([("12卷",), ("iii",), ("?",)], "x string").select(markup.extent(F.col("x")).alias("n")).collect()
    assert [r.n for r in e] == [12, 3, 1]


def test_dictionaries(spark, tmp_path):
    tsv = tmp_path / "d.tsv"
    tsv.write_text("# head\n法\t<b>law</b>\tfa\n\n空\t\n色\tform\n")
    rows = dictionaries.delimited(spark, str(tsv), reading=2).orderBy("headword").collect()
    assert [(r.headword, r.reading, r.definition) for r in rows] == [("法", "fa", "law"), ("色", None, "form")]
    j = spark.createDataFrame([('[{"word": "a", "gloss": "x", "id": "7", "pos": "n"}, {"word": "b"}]',), ('{"k": "v", "e": ""}',)], "j string")
    rows = dictionaries.json_objects(j, "j").orderBy("headword").collect()
    assert [(r.headword, r.definition, r.external_id, r.entry_data) for r in rows] == [("a", "x", "7", '{"pos":"n"}'), ("k", "v", None, None)]
    twice = dictionaries.keyed(spark.createDataFrame([("a", None, "1", None, None), ("a", None, "2", None, None)], "headword string, reading string, definition string, external_id string, entry_data string"), "d")
    assert sorted(r.external_id for r in twice.collect()) == ["d-a", "d-a-2"]
    raw = spark.createDataFrame([("法".encode("utf-8"),), ("漢字".encode("gb18030"),), (b"\xef\xbb\xbfx",), (None,)], "b binary")
    assert [r.t for r in raw.select(dictionaries.decoded(F.col("b")).alias("t")).collect()] == ["法", "漢字", "x", None]
    star = spark.createDataFrame([(b"ab\0" + (0).to_bytes(4, "big") + (3).to_bytes(4, "big"), b"def")], "i binary, c binary")
    assert [(r.headword, r.definition) for r in dictionaries.stardict(star, "i", "c").collect()] == [("ab", "def")]


def test_names_and_text(spark):
    one = spark.range(1)
    col = lambda x: one.select(x.alias("x")).first().x
    assert tuple(col(names.dynasty_years(F.lit("姚秦")))) == (304, 439) and col(names.dynasty_years(F.lit("?"))) is None
    assert tuple(col(names.split_byline(F.lit("後秦 鳩摩羅什譯")))) == ("十六國", "鳩摩羅什")
    assert col(names.collection(F.lit("ZW01n0001"))) == "藏外佛教文獻" and col(names.collection(F.lit("T0251"))) == "大正藏"
    assert col(names.work_number(F.lit("T08n0251"))) == "T251" and col(names.bare_translator(F.lit("唐 玄奘"))) == "玄奘"
    assert col(T.cjk_bigrams(F.lit("心经论 ABC 空"))) == ["心經", "經論", "abc", "空"]
    assert col(T.chunks(F.lit(""))) == [] and [len(x) for x in col(T.chunks(F.lit("x" * 950)))] == [500, 500, 50]
    assert col(T.highlight(F.lit("Ab ab"), "ab")) == "<em>Ab</em> <em>ab</em>"
    assert col(T.variants(F.lit("心经"))) == ["心经", "心經"]
    gcj = col(geo.to_gcj(F.lit(39.9), F.lit(116.4)))
    assert abs(gcj.lat - 39.9014) < 1e-3 and abs(gcj.lng - 116.4062) < 1e-3
    back = col(geo.to_wgs(F.lit(gcj.lat), F.lit(gcj.lng)))
    assert abs(back.lat - 39.9) < 1e-4 and abs(back.lng - 116.4) < 1e-4
