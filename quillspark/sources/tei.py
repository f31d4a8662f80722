"""TEI documents to rows.

Files are read by Spark's binaryFile source and parsed one document at a time; what a document
says is a list of typed pieces, and everything after that is DataFrame work.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements left out (what follows them stays) and elements that hold text.
LEFT_OUT = {"note", "app", "rdg", "ref", "tt", "mulu"}
HOLDERS = {"p", "l", "head", "byline", "juan"}
PIECES = "array<struct<kind: string, n: string, text: string>>"


def rare_glyphs(table: DataFrame) -> DataFrame:
    """(id, glyph) of a table id, uni_char, norm_uni_char, norm_big5_char, composition: the first usable form.

    A private-use character is not usable as uni_char.
    """
    private = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    usable = F.when(~filled("uni_char").rlike(private), filled("uni_char"))
    return table.select("id", F.coalesce(usable, filled("norm_uni_char"), filled("norm_big5_char"), filled("composition")).alias("glyph")).filter("glyph IS NOT NULL")


def _pieces(xml: str | bytes | None, glyphs: dict[str, str]) -> list[dict]:
    """The body's milestones and texts in document order; none if it can't be read."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    body = next((e for e in root.iter() if name(e) == "body"), None)
    out: list[dict] = []

    def text_of(e) -> str:
        parts = [e.text or ""]
        for child in e:
            if name(child) == "g":
                ref, own = child.get("ref", "").lstrip("#"), child.text or ""
                private = any(0xE000 <= ord(c) <= 0xF8FF or ord(c) >= 0xF0000 for c in own)
                parts.append(glyphs.get(ref) or (own if own and not private else "□"))
            elif name(child) not in LEFT_OUT:
                parts.append(text_of(child))
            parts.append(child.tail or "")
        return "".join(parts)

    waiting = list(body)[::-1] if body is not None else []
    while waiting:
        e = waiting.pop()
        kind = name(e)
        if kind == "milestone" and e.get("unit") == "juan":
            out.append({"kind": "milestone", "n": e.get("n", ""), "text": ""})
        elif kind == "juan":
            if e.get("fun") == "open":
                out.append({"kind": "juan", "n": e.get("n", ""), "text": text_of(e).strip()})
        elif kind in HOLDERS:
            out.append({"kind": kind, "n": "", "text": text_of(e).strip()})
        elif kind not in LEFT_OUT:
            waiting += list(e)[::-1]
    return out


def chapters(files: DataFrame, key: str, content: str, glyphs: dict[str, str] | None = None) -> DataFrame:
    """(key, juan_num, content, char_count) of canon files: a chapter begins at a milestone or an opening heading.

    A paragraph after other text is set off by a blank line; char_count leaves out spaces and line
    feeds.  ``glyphs`` is the table of rare characters, a few thousand rows.
    """
    known = dict(glyphs or {})

    @F.pandas_udf(PIECES)
    def pieces(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: _pieces(x, known))

    order = "pieces_at"
    rows = files.select(key, F.posexplode(pieces(F.col(content))).alias(order, "piece")).select(key, order, "piece.*")
    from pyspark.sql import Window

    doc = Window.partitionBy(key).orderBy(order)
    number = F.nullif(F.regexp_replace("n", "[^0-9]", ""), F.lit("")).cast("int")
    marks = rows.withColumn("mark", F.when(F.col("kind").isin("milestone", "juan"), number)).withColumn("bare", (F.col("kind") == "milestone") & F.col("mark").isNull())
    # a milestone without a number goes one on; a heading without one changes nothing
    last = F.coalesce(F.last("mark", True).over(doc), F.lit(1))
    groups = marks.withColumn("_base", last).withColumn("_given", F.count("mark").over(doc))
    more = F.sum(F.col("bare").cast("int")).over(Window.partitionBy(key, "_given").orderBy(order))
    placed = groups.withColumn("juan_num", F.col("_base") + F.coalesce(more, F.lit(0)))
    texts = placed.filter(F.col("text") != "")
    chapter = Window.partitionBy(key, "juan_num").orderBy(order)
    spaced = texts.withColumn("line", F.when((F.col("kind") == "p") & (F.row_number().over(chapter) > 1), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    joined = spaced.groupBy(key, "juan_num").agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("l"))  # one chapter
    content_ = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return joined.select(key, "juan_num", content_.alias("content")).withColumn("char_count", F.length(F.regexp_replace("content", "[ \n]", "")))


def translation(xml: Column) -> Column:
    """struct of titles, number, translation and summary of a translation's TEI; stray ampersands are escaped first."""
    clean = F.regexp_replace(F.regexp_replace(xml, r"&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    clean = F.regexp_replace(clean, r"xml:lang=", "lang=")
    one = lambda path: F.trim(F.xpath_string(clean, F.lit(path)))
    many = lambda path, sep: F.array_join(F.filter(F.transform(F.xpath(clean, F.lit(path)), lambda x: F.trim(x)), lambda x: x != ""), sep)
    return F.struct(
        one("//titleStmt/title[@lang='en']").alias("title_en"),
        one("//titleStmt/title[@lang='bo']").alias("title_bo"),
        one("//titleStmt/title[@lang='Sa-Ltn' or @lang='sa']").alias("title_sa"),
        one("//publicationStmt/idno[contains(@type, 'Toh') or contains(., 'toh')]").alias("toh_number"),
        many("//body//div[@type='translation']//p/text()", "\n\n").alias("translation"),
        many("//body//div[@type='summary']//p/text()", "\n").alias("summary"),
    )


def work_of_path(path: Column) -> Column:
    """struct<collection, volume, number> of a file name such as T08n0251_001.xml."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    part = lambda i: F.nullif(F.regexp_extract(base, r"^([A-Z]+)(\d+)n([A-Za-z]?\d+[a-zA-Z]?)", i), F.lit(""))
    return F.struct(part(1).alias("collection"), part(2).alias("volume"), F.regexp_replace(part(3), "^0+", "").alias("number"))


def escaped(text: str) -> str:
    return re.sub(r"&(?!\w+;|#)", "&amp;", text)
