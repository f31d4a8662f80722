"""Exports: CSV rows, graph JSON and JSON-LD, feeds, citations."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml


def metadata_rows(texts: DataFrame, columns: Sequence[str], defaults: dict[str, str], filters: dict[str, str | None], key: str) -> DataFrame:
    """String columns for a CSV file: nulls as their default or empty, by key."""
    for c, v in filters.items():
        if v is not None:
            texts = texts.filter(F.col(c) == v)
    return texts.orderBy(key).select(*[F.coalesce(F.col(c).cast("string"), F.lit(defaults.get(c, ""))).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("emptyValue", "").csv(path)


def graph(entities: DataFrame, relations: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities of a kind, and the relations with both ends among them."""
    if kind is None:
        return entities, relations
    kept = entities.filter(F.col("kind") == kind)
    inside = relations.join(kept.select(F.col("id").alias("subject")), "subject", "left_semi").join(kept.select(F.col("id").alias("object")), "object", "left_semi")
    return kept, inside


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def json_ld(entities: DataFrame, base: str, names: Sequence[tuple[str, str]], external: str) -> DataFrame:
    """(id, json): preferred label, other labels by language, and http identities from a JSON map."""
    labels = F.filter(F.array(*[F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct(F.col(c).alias("@value"), F.lit(lang).alias("@language"))) for c, lang in names[1:]]), lambda x: x.isNotNull())
    same = F.filter(F.map_values(F.from_json(F.coalesce(F.col(external), F.lit("{}")), "map<string,string>")), lambda x: x.startswith("http"))
    body = F.struct(F.concat(F.lit(base), F.col("id")).alias("@id"), F.col("kind").alias("@type"), F.col(names[0][0]).alias("prefLabel"), labels.alias("altLabel"), same.alias("sameAs"))
    return entities.select("id", F.to_json(body).alias("json"))


def feed_items(texts: DataFrame, key: str, title: str, time: str, parts: Sequence[str], n: int = 50) -> DataFrame:
    """The newest texts as feed items: escaped title and a description of the known parts, else the title."""
    known = F.concat_ws(" · ", *[F.nullif(F.col(p), F.lit("")) for p in parts])
    text = F.when(known != "", known).otherwise(F.col(title))
    return texts.orderBy(F.desc_nulls_last(time), F.desc(key)).limit(n).select(key, escape_xml(F.col(title)).alias("title"), escape_xml(text).alias("description"))


def citation(style: Column, title: Column, translator: Column, dynasty: Column, number: Column, collection: str, platform: str) -> Column:
    """A citation in chicago, apa, mla, harvard or the plain style; a missing translator is 佚名, a missing dynasty empty.

    ``collection`` and ``platform`` name the publication and the host.
    """
    values = {"who": F.coalesce(F.nullif(translator, F.lit("")), F.lit("佚名")), "when": F.coalesce(dynasty, F.lit("")), "title": title, "id": F.coalesce(number, F.lit(""))}

    def filled(form: str) -> Column:
        pieces = [F.lit(t) if k is None else values[k] for t, k in _pieces(form.replace("{c}", collection).replace("{p}", platform))]
        return F.concat(*pieces)

    # The citation forms.
    forms = {
        "chicago": "《{title}》，{when}{who}译。{c}，编号 {id}。{p}。",
        "apa": "{who} (译). ({when}). 《{title}》 ({id}). {c}. {p}.",
        "mla": "{who}, 译. 《{title}》. {c}, {id}. {p}.",
        "harvard": "{who} (译) ({when}) 《{title}》. {id}. {c}. {p}.",
    }
    out = None
    for name, form in forms.items():
        out = F.when(style == name, filled(form)) if out is None else out.when(style == name, filled(form))
    return out.otherwise(filled("《{title}》，{when}{who}译，{c} {id}。"))


def _pieces(form: str):
    """(text, None) and ('', field) parts of a form with {field} places."""
    for text, field, _, _ in Formatter().parse(form):
        if text:
            yield text, None
        if field:
            yield "", field


def bibtex(key: Column, title: Column, translator: Column, year: Column) -> Column:
    name = F.regexp_replace(key, "[^A-Za-z0-9]", "_")
    return F.concat(F.lit("@misc{"), name, F.lit(",\n  title = {"), title, F.lit("},\n  author = {"), F.coalesce(translator, F.lit("佚名")), F.lit("},\n  year = {"), F.coalesce(year, F.lit("")), F.lit("}\n}"))


def ris(key: Column, title: Column, translator: Column, year: Column) -> Column:
    return F.concat(F.lit("TY  - GEN\nTI  - "), title, F.lit("\nAU  - "), F.coalesce(translator, F.lit("佚名")), F.lit("\nPY  - "), F.coalesce(year, F.lit("")), F.lit("\nID  - "), key, F.lit("\nER  - "))
