"""HTML, plain text, feeds, JSONP and outline files, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T


# The header fields of plain e-texts, in English and German.
HEADER_FIELDS = {"title": ["title", "titel"], "author": ["author", "verfasser"], "source_info": ["source", "quelle"]}


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def _web_page(content: Column) -> Column:
    """An e-text kept as a web page: what stands before the second rule (or the only one) is the archive's preamble."""
    title = _stripped(F.regexp_extract(content, r"(?is)<title\b[^>]*>(.*?)</title\b", 1))
    author = F.when(title.contains(":"), F.rtrim(F.substring_index(title, ":", 1))).otherwise("")
    inside = F.regexp_replace(content, r"(?is)\A.*?<body\b[^>]*>|</body\b.*\z", "")
    sections = F.split(inside, r"(?i)<hr\b[^>]*>")
    text = F.array_join(F.slice(sections, F.least(F.size(sections), F.lit(3)), F.size(sections)), "\n")
    for pattern, by in ((r"(?i)<(?:br|p)\b[^>]*>", "\n"), (r"<[^<>]+>", ""), (r"[ \t]+", " "), (r"\n\n\n+", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return F.struct(title.alias("title"), author.alias("author"), _stripped(text).alias("content"), F.lit("").alias("source_info"))


def _headed_text(content: Column) -> Column:
    """A plain e-text: comment lines and blank ones come first, `name: value` fields stand in the first 50 lines."""
    lines = F.split(content, "\n")
    head = F.transform(F.slice(lines, 1, 50), lambda line: F.ltrim(F.trim(line), F.lit("# \t")))
    halves = F.filter(F.transform(head, lambda line: F.split(line, "[:：]", 2)), lambda pair: F.size(pair) == 2)
    fields = F.transform(halves, lambda pair: F.struct(F.lower(F.trim(pair[0])).alias("name"), F.trim(pair[1]).alias("value")))

    def last_of(field: str) -> Column:
        of_it = F.filter(fields, lambda x: x["name"].isin(HEADER_FIELDS[field]) & (x["value"] != ""))
        return F.try_element_at(of_it, F.lit(-1))["value"]

    opening = F.try_element_at(F.filter(head, lambda line: ~line.startswith("//") & (F.length(line) > 3)), F.lit(1))
    prefatory = F.transform(lines, lambda line: F.coalesce(line.rlike(r"^\s*(#|//|$)"), F.lit(True)))
    begin = F.array_position(prefatory, F.lit(False)).cast("int")  # 0: nothing but a header
    begin = begin + F.try_element_at(lines, F.nullif(begin, F.lit(0))).rlike(r"^\s*(---|===)").cast("int")
    body = F.filter(F.slice(lines, begin, F.size(lines)), lambda line: ~F.ltrim(line).startswith("//"))
    body = F.coalesce(F.array_join(body, "\n"), F.lit(""))
    title = F.coalesce(last_of("title"), F.substring(opening, 1, 200), F.lit(""))
    others = [F.coalesce(last_of(x), F.lit("")).alias(x) for x in ("author", "source_info")]
    return F.struct(title.alias("title"), others[0], _stripped(F.regexp_replace(body, r"\{[^{}]*\}|<[^<>]*>", "")).alias("content"), others[1])


def romanised_text(content: Column) -> Column:
    """struct<title, author, content, char_count, source_info> of an e-text, a web page or plain."""
    page = F.left(content, F.lit(500)).rlike(r"(?i)<(html\b|!doctype\s+html)")
    x = F.when(page, _web_page(content)).otherwise(_headed_text(content))
    return F.struct(x["title"].alias("title"), x["author"].alias("author"), x["content"].alias("content"), F.length(x["content"]).alias("char_count"), x["source_info"].alias("source_info"))


def feed_entries(feeds: DataFrame, source: str, xml: str) -> DataFrame:
    """(source, title, url, summary, author, published_at) of RSS items and Atom entries; untitled or unlinked ones go.

    Titles are cut at 500 characters, summaries at 2000 and authors at 200, with an ellipsis.
    """
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), F.lit(1))
    rows = feeds.select(source, F.explode(items).alias("e"))
    cdata = F.regexp_replace("e", r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    rows = rows.withColumn("e", cdata)

    def tag(name: str) -> Column:
        inner = F.regexp_extract("e", f"(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)
        for _ in range(2):
            for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
                inner = F.replace(inner, F.lit(a), F.lit(b))
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", ""), r"\s+", " ")), F.lit(""))

    alternate = F.nullif(F.regexp_extract("e", r"(?is)<link(?=[^>]*rel=[\"']alternate[\"'])[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    any_href = F.nullif(F.regexp_extract("e", r"(?is)<link[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    url = F.coalesce(tag("link"), alternate, any_href)
    author = F.coalesce(tag("dc:creator"), tag("name"), tag("author"))
    date = F.coalesce(*[names.parsed_date(tag(x)) for x in ("pubDate", "published", "updated")])
    summary = F.coalesce(tag("description"), tag("summary"), tag("content:encoded"), tag("content"))
    out = rows.select(source, T.shortened(tag("title"), 500).alias("title"), F.trim(url).alias("url"), T.shortened(summary, 2000).alias("summary"), T.shortened(author, 200).alias("author"), date.alias("published_at"))
    return out.filter(F.col("title").isNotNull() & F.col("url").isNotNull())


def jsonp_entries(text: Column) -> Column:
    """array<string>: the JSON of data1, data2 ... in a JSONP answer, in key order; what follows the last brace is dropped."""
    inner = F.regexp_extract(text, r"(?s)^[^(]*\((.+)\)\s*$", 1)
    body = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "map<string,string>")
    entries = F.filter(F.map_entries(parsed), lambda e: e["key"].startswith("data") & e["value"].startswith("{"))
    return F.coalesce(F.transform(F.array_sort(entries), lambda e: e["value"]), F.array().cast("array<string>"))


def outline(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """Entries of an org-mode catalog: (doc, at, category, title, property map) for each second-level heading."""
    w = Window.partitionBy(doc).orderBy(at)
    rows = lines.withColumns({"level": F.length(F.regexp_extract(line, r"^(\*+) ", 1)), "head": F.trim(F.regexp_extract(line, r"^\*+ (.*)$", 1))})
    rows = rows.withColumns({"category": F.last(F.when(F.col("level") == 1, F.col("head")), True).over(w), "entry": F.last(F.when(F.col("level") == 2, F.col(at)).when(F.col("level") == 1, F.lit(-1)), True).over(w)}).filter("entry >= 0")
    key, value = F.regexp_extract(line, r"^\s*:([A-Za-z_]+):\s*(.*)$", 1), F.trim(F.regexp_extract(line, r"^\s*:([A-Za-z_]+):\s*(.*)$", 2))
    pair = F.when((key != "") & ~F.upper(key).isin("PROPERTIES", "END"), F.struct(F.upper(key).alias("key"), value.alias("value")))
    grouped = rows.groupBy(doc, F.col("entry").alias(at)).agg(F.max("category").alias("category"), F.max(F.when(F.col("level") == 2, F.col("head"))).alias("title"), F.collect_list(pair).alias("p"))
    return grouped.select(doc, at, "category", "title", F.map_from_entries(F.array_distinct("p")).alias("properties"))


# Roman numerals.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10, "XI": 11, "XII": 12}


def extent(text: Column) -> Column:
    """The number of an extent such as '12卷' or 'III'; 1 if there is none."""
    roman = F.create_map(*[F.lit(x) for p in ROMAN.items() for x in p])
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int"), roman[F.upper(F.trim(text))], F.lit(1))


def sutta_range(work_id: Column) -> Column:
    """struct<prefix, start, end> of ids such as SC-an1.51-60 or SC-dhp71; numbers are null without one."""
    dotted, bare = r"^(SC-[a-z]+\d*\.)(\d+)(?:-(\d+))?$", r"^(SC-[a-z]+)(\d+)(?:-(\d+))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(work_id, dotted, i), F.lit("")), F.nullif(F.regexp_extract(work_id, bare, i), F.lit("")))
    start = part(2).cast("int")
    return F.struct(F.coalesce(part(1), work_id).alias("prefix"), start.alias("start"), F.coalesce(part(3).cast("int"), start).alias("end"))
