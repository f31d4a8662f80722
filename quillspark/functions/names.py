"""Names, bylines, identifiers, dates and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def known_dynasty(name: Column) -> Column:
    """A dynasty's usual name; aliases are resolved, unknown names stay."""
    return F.coalesce(_map(fixed.DYNASTY_ALIASES)[name], name)


def dynasty_years(name: Column) -> Column:
    """struct<start, end>, null for an unknown dynasty."""
    years = F.create_map(*[x for _, zh, _, a, b in fixed.DYNASTIES for x in (F.lit(zh), F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))])
    return years[known_dynasty(name)]


def split_byline(byline: Column) -> Column:
    """struct<dynasty, translator>: the longest dynasty prefix is taken off, and a last 譯."""
    prefixes = "|".join(sorted(fixed.BYLINE_DYNASTIES, key=len, reverse=True))
    line = F.trim(byline)
    prefix = F.nullif(F.regexp_extract(line, f"^({prefixes})", 1), F.lit(""))
    rest = F.trim(F.regexp_replace(F.regexp_replace(line, f"^({prefixes})", ""), "譯$", ""))
    return F.struct(_map(fixed.BYLINE_DYNASTIES)[prefix].alias("dynasty"), F.nullif(rest, F.lit("")).alias("translator"))


def bare_translator(name: Column) -> Column:
    """A translator's name without the dynasty: its last part if it has several."""
    prefixes = "|".join(sorted(fixed.BYLINE_DYNASTIES, key=len, reverse=True))
    x = F.trim(F.regexp_replace(F.trim(name), f"^({prefixes})[ 　]+", ""))
    return F.element_at(F.split(x, "[ 　]+"), -1)


def collection(work_id: Column) -> Column:
    """The collection of a work id, by its longest known prefix."""
    prefixes = "|".join(sorted(fixed.COLLECTIONS, key=len, reverse=True))
    return _map(fixed.COLLECTIONS)[F.nullif(F.regexp_extract(work_id, f"^({prefixes})", 1), F.lit(""))]


def plain_name(name: Column) -> Column:
    """Trimmed, with no space of either width."""
    return F.regexp_replace(F.trim(name), "[ 　]", "")


def reading(definition: Column) -> Column:
    """The text of a leading pair of parentheses, or null."""
    return F.nullif(F.regexp_extract(definition, r"^\s*[(（]([^)）]*)[)）]", 1), F.lit(""))


def script_of(name: Column) -> Column:
    """hangul, kana, han, latin or other, by the first of these that occurs."""
    return (
        F.when(name.rlike(r"[\x{AC00}-\x{D7AF}]"), "hangul")
        .when(name.rlike(r"[\x{3040}-\x{30FF}]"), "kana")
        .when(name.rlike(r"[\x{4E00}-\x{9FFF}]"), "han")
        .when(name.rlike(r"[A-Za-z]"), "latin")
        .otherwise("other")
    )


def is_chinese_name(name: Column) -> Column:
    """Ideographs or kana, and no Hangul."""
    return name.rlike(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]") & ~name.rlike(r"[\x{AC00}-\x{D7AF}]")


def listed(csv: Column) -> Column:
    """The trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def mapped_list(csv: Column, codes: dict[str, str]) -> Column:
    """A comma list with each part mapped (unknown ones stay), repeats dropped, order kept."""
    return F.array_join(F.array_distinct(F.transform(listed(csv), lambda x: F.coalesce(_map(codes)[x], x))), ",")


def work_number(work_id: Column) -> Column:
    """Prefix and number without leading zeros: T08n0251 and T0251 to T251."""
    prefix = F.regexp_extract(work_id, r"^([A-Z]+)", 1)
    number = F.regexp_extract(F.regexp_replace(work_id, r"^[A-Z]+\d*n", "n"), r"^[A-Zn]+0*(\d+)", 1)
    return F.when(number != "", F.concat(prefix, number))


def toh_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)toh[_-]?(\d+)", 1), F.lit(""))


def parsed_date(x: Column) -> Column:
    """A timestamp of an RFC 2822 or ISO date, else null."""
    plain = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    forms = ["d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX"]
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in forms], F.try_to_timestamp(x))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def without_dynasty(translator: Column) -> Column:
    """A translator's name without one dynasty at its front."""
    return F.trim(F.regexp_replace(translator, "^(" + "|".join(fixed.TRANSLATOR_DYNASTIES) + r")\s*", ""))
