"""The reading layout of a canon text: lines to heads, chapters, bylines, sections, verses, breaks and prose.

Whether verses are expected is a state that runs through a text, from line to line.  A line either sets it or leaves it as
it is, so the lines' transitions compose to the last one that sets it: an associative aggregate, here a window over the
lines of one text, instead of a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns that tell kinds of lines, and the lengths they allow (in UTF-16 units).
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CHAPTER, CHAPTER_BARS = r"卷第?[一二三四五六七八九十百千\d]+", "[，。]"
BYLINE, BYLINE_BARS = "[譯译述撰注疏記造]$", "[，。；]"
NUMBERED, SECTION, SECTION_BARS = r"^[（(][一二三四五六七八九十\d]+[）)]", r"[品分經]第[一二三四五六七八九十百\d]+", "[，。]"
HEAD, HEAD_BARS = "[經论論律品序疏記集傳]", "[，。；：！？、]"
TO_VERSE, TO_PROSE = "頌曰[：:]?|偈曰[：:]?", "^(論曰|述曰|疏曰|解曰|釋曰)"
VERSE_END, MARKS, HALVES, FINAL = "[，。；]$", "[，。、；：！？]", "[，。、；]", "[。！？」』]$"


def units(x: Column) -> Column:
    """The length in UTF-16 units."""
    return F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def verse_like(line: Column) -> Column:
    """A line of one or two clauses as verses have: gapped, two halves of like length, or one short clause."""
    size, marks = units(line), F.regexp_count(line, F.lit(MARKS))
    parts = F.split(line, HALVES)
    a, b = units(F.get(parts, F.lit(0))), units(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    halves = (marks == 2) & (a > 0) & (b > 0)
    gapped = line.rlike(_SPACE + "{2,}")
    return size.between(4, 22) & line.rlike(VERSE_END) & (marks <= 2) & F.when(gapped, True).when(halves, 2 * F.least(a, b) >= F.greatest(a, b)).otherwise((marks == 1) & (size <= 12))


def layout(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """(doc, segment, kind, text): the segments of each text in order, numbered from 0.

    ``at`` numbers the lines of a text without gaps.  Prose lines are joined until something else comes; a blank line breaks
    them only after the end of a sentence; a line that opens verses ends the prose it belongs to, one that opens a comment begins its own.
    Null lines are blank.  Windows cover one text.
    """
    order = Window.partitionBy(doc).orderBy(at)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    trimmed = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")
    rows = lines.select(doc, at, trimmed.alias("_t"))
    full = F.when(F.col("_t") != "", F.col("_t"))
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_t") != "", F.col(at))).over(Window.partitionBy(doc)), "_last": F.last(full, ignorenulls=True).over(before), "_size": units(F.col("_t")), "_verse": verse_like(F.col("_t"))})
    x, size = F.col("_t"), F.col("_size")
    form = (
        F.when(x == "", F.when(F.coalesce(F.col("_last"), F.lit("")).rlike(FINAL), "break").otherwise("blank"))
        .when(x.rlike(CHAPTER) & (size <= 25) & ~x.rlike(CHAPTER_BARS), "juan")
        .when(x.rlike(BYLINE) & (size <= 25) & ~x.rlike(BYLINE_BARS), "byline")
        .when(x.rlike(NUMBERED) | (x.rlike(SECTION) & (size <= 20) & ~x.rlike(SECTION_BARS)), "section")
        .when((F.col(at) - F.col("_first") <= 2) & size.between(2, 15) & x.rlike(HEAD) & ~x.rlike(HEAD_BARS), "head")
        .when(x.rlike(TO_PROSE), "to_prose")
        .when(x.rlike(TO_VERSE), "to_verse")
        .when(F.col("_verse"), "clause")
        .otherwise("plain")
    )
    rows = rows.withColumn("_form", form)
    sets = F.when(F.col("_form") == "to_verse", True).when(F.col("_form").isin("to_prose", "plain"), False)
    rows = rows.withColumn("_mode", F.coalesce(F.last(sets, ignorenulls=True).over(before), F.lit(True)))
    kind = F.when((F.col("_form") == "clause") & F.col("_mode"), "verse").when(F.col("_form").isin("to_prose", "to_verse", "clause", "plain"), "prose").otherwise(F.col("_form"))
    rows = rows.withColumn("kind", kind).filter("kind <> 'blank'")
    alone = F.col("kind") != "prose"
    opens = alone | (F.col("_form") == "to_prose") | F.coalesce(F.lag(alone | (F.col("_form") == "to_verse")).over(order), F.lit(True))
    rows = rows.withColumn("segment", F.sum(opens.cast("int")).over(order) - 1)
    whole = rows.groupBy(doc, "segment", "kind").agg(F.sort_array(F.collect_list(F.struct(at, "_t"))).alias("l"))
    return whole.select(doc, F.col("segment").cast("int").alias("segment"), "kind", F.array_join(F.transform("l", lambda y: y["_t"]), "").alias("text"))
