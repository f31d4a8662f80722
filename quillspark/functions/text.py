"""Text columns: cleaning, folding, chunking, escaping, highlighting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def html_to_text(html: Column) -> Column:
    """Markup to text: scripts and styles go whole, breaks and paragraphs become line feeds, tags go, spaces collapse."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?i)<br[^>]*>|<p[^>]*>|</p>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(character))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def escape_xml(x: Column) -> Column:
    """& < > " ' as entities."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(character), F.lit(entity))
    return x


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """array<string> of fixed-size pieces, each starting ``size - overlap`` after the last; none of an empty text.

    An overlap of the size or more counts as 0.  A last piece wholly inside its predecessor stays.
    """
    step = size - (overlap if overlap < size else 0)
    pieces = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case runs of Latin letters."""
    return F.array_remove(F.split(F.lower(text), "[^a-zà-ÿ]+"), "")  # three times as fast as regexp_extract_all


def cjk_bigrams(text: Column) -> Column:
    """Terms of a CJK analyser: folded to traditional and lower case, each run of ideographs as overlapping pairs
    (a lone one as itself), other words whole."""
    folded = F.lower(to_traditional(text))
    runs = F.regexp_extract_all(folded, F.lit(r"([\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]+|[\p{L}\p{N}&&[^\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]]+)"), F.lit(1))
    ideographs = lambda r: r.rlike(r"^[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]")
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(ideographs(r) & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))


def to_traditional(x: Column) -> Column:
    return F.translate(x, fixed.SIMPLIFIED, fixed.TRADITIONAL)


def to_simplified(x: Column) -> Column:
    return F.translate(x, fixed.TRADITIONAL, fixed.SIMPLIFIED)


def variants(x: Column) -> Column:
    """The distinct spellings of a query: as it is, simplified, traditional."""
    return F.array_distinct(F.array(x, to_simplified(x), to_traditional(x)))


def fold_diacritics(x: Column) -> Column:
    """Lower case without the diacritics of romanised Sanskrit and Pali."""
    return F.translate(F.lower(x), "āīūṛṝḷḹṃṁḥṅñṭḍṇśṣäëïöüàâéèêç", "aiurrllmmhnntdnssaeiouaaeeec")


def like_escaped(x: str) -> str:
    """A literal for LIKE with escape character backslash."""
    return re.sub(r"([\\%_])", r"\\\1", x)


def highlight(text: Column, term: str) -> Column:
    """Every occurrence of a term, whatever its case, between <em> and </em>."""
    return F.regexp_replace(text, "(?i)" + re.escape(term), "<em>$0</em>")


def sanitize_highlight(text: Column) -> Column:
    """Drop all tags but <em> and </em>."""
    return F.regexp_replace(text, r"<(?!/?em>)[^>]*>", "")


def snippet(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three an ellipsis if cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) * 2 / 3)).cast("long")


def shared_characters(a: Column, b: Column) -> Column:
    """The number of distinct characters that both hold."""
    split = lambda x: F.array_remove(F.array_distinct(F.split(x, "")), "")
    return F.size(F.array_intersect(split(a), split(b)))


def drop_lines(text: Column, pattern: str) -> Column:
    """The lines that do not match the pattern."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def strip_overlap(chunk: Column, previous: Column, overlap: int = 50) -> Column:
    """A chunk without its first characters if they repeat the end of the previous one."""
    repeats = (F.length(previous) >= overlap) & chunk.startswith(F.right(previous, F.lit(overlap)))
    return F.when(F.coalesce(repeats, F.lit(False)), F.substring(chunk, F.lit(overlap + 1), F.length(chunk))).otherwise(chunk)


def snap_head(text: Column, least: int = 20) -> Column:
    """From after the first sentence end, if more than ``least`` characters remain."""
    rest = F.regexp_replace(text, r"(?s)^[^。！？；.!?]*[。！？；.!?]\s*", "")
    return F.when((F.length(rest) > least) & (rest != text), rest).otherwise(text)


def snap_tail(text: Column, least: int = 20) -> Column:
    """Up to the last sentence end, if more than ``least`` characters remain."""
    head = F.regexp_extract(text, r"(?s)^(.*[。！？；.!?])", 1)
    return F.when(F.length(head) > least, head).otherwise(text)
