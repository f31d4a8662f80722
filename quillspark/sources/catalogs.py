"""Catalogs, authority files, menus and query-service answers to rows; the one generic ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.storage import stored


def works(rows: DataFrame, json: str) -> DataFrame:
    """(work_id, title, byline, fascicles) of catalog JSON: a list of works, or an object of id to work."""
    fields = "map<string,string>"
    listed = rows.filter(F.trim(json).startswith("[")).select(F.explode(F.from_json(json, f"array<{fields}>")).alias("m")).select(F.coalesce(F.col("m")["id"], F.col("m")["work"]).alias("work_id"), "m")
    keyed = rows.filter(F.trim(json).startswith("{")).select(F.explode(F.from_json(json, f"map<string,{fields}>")).alias("work_id", "m"))
    both = listed.unionByName(keyed).filter(F.col("work_id").isNotNull())
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("m")[n]), F.lit("")) for n in names])
    return both.select("work_id", pick("title", "name").alias("title"), pick("byline", "author").alias("byline"), pick("juan", "fascicles").try_cast("int").alias("fascicles"))


def header(xml: Column) -> Column:
    """struct<title, author, fascicles> of a TEI header, the fallback where a catalog is missing."""
    find = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(xml, p, 1), r"<[^>]+>", "")), F.lit(""))
    return F.struct(find(r"(?s)<title[^>]*>(.*?)</title>").alias("title"), find(r"(?s)<author[^>]*>(.*?)</author>").alias("author"), find(r"(\d+)\s*卷").cast("int").alias("fascicles"))


def persons(spark: SparkSession, path: str, row_tag: str = "person") -> DataFrame:
    """(id, name, relation, other): people of an authority file with their teachers and students, one row a relation."""
    schema = "`_xml:id` string, persName array<string>, relation array<struct<_name: string, _active: string>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(F.col("`_xml:id`").alias("id"), F.col("persName")[0].alias("name"), F.explode_outer("relation").alias("r")).select("id", "name", F.col("r._name").alias("relation"), F.regexp_replace("r._active", "^#", "").alias("other"))


def bindings(rows: DataFrame, json: str, names: Sequence[str]) -> DataFrame:
    """Rows of a SPARQL JSON answer: the value of each variable, null where unbound."""
    cell = "struct<value: string>"
    schema = f"struct<results: struct<bindings: array<struct<{', '.join(f'`{n}`: {cell}' for n in names)}>>>>"
    found = rows.select(F.explode(F.from_json(json, schema)["results"]["bindings"]).alias("b"))
    return found.select(*[F.col(f"b.{n}.value").alias(n) for n in names])


def places(found: DataFrame, item: str, label: str, coordinates: str) -> DataFrame:
    """(external_id, name, longitude, latitude) of place bindings whose point is valid, one for an item."""
    rows = found.select(F.regexp_extract(item, r"(Q\d+)$", 1).alias("external_id"), F.col(label).alias("name"), geo.point_of(F.col(coordinates)).alias("p")).filter("p IS NOT NULL AND external_id <> ''")
    one = rows.groupBy("external_id").agg(F.min(F.struct("name", "p.longitude", "p.latitude")).alias("r"))
    return one.select("external_id", "r.*")


def menu_leaves(menu: DataFrame, parent: str, child: str, roots: Sequence[str]) -> DataFrame:
    """(root, leaf): the nodes without children below each root, however deep; a root without children is its own leaf.

    Each round adds the children of the nodes that the round before found and no earlier round had, so cycles end.  Rounds are written,
    so a plan does not grow with the depth.  Rows without a parent or child are left out.
    """
    edges = stored(menu.select(F.col(parent).alias("p"), F.col(child).alias("c")).dropna().distinct(), "menu-edges")
    level = seen = menu.sparkSession.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, node string")
    while True:
        below = level.join(edges, F.col("node") == F.col("p")).select("root", F.col("c").cast("string").alias("node")).distinct()
        level = stored(below.join(seen, ["root", "node"], "left_anti"), "menu-level")
        if level.isEmpty():
            return seen.join(edges, F.col("node") == F.col("p"), "left_anti").select("root", F.col("node").alias("leaf"))
        seen = seen.unionByName(level)


def sutta_page(html: Column) -> Column:
    """struct<title, content> of a page: its heading, and the text of its paragraphs a line each."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    return F.struct(title.alias("title"), F.array_join(F.filter(paragraphs, lambda x: x != ""), "\n").alias("content"))


def ingest(rows: DataFrame, source: str, mapping: dict[str, Column | str], lang: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, identifiers and contents of any source, by a mapping of uid, title, translator, url and content.

    The first row of a uid counts; a row without a uid is left out; content is null where there is none.
    """
    pick = lambda n: (lambda c: F.col(c) if isinstance(c, str) else c)(mapping[n]) if n in mapping else F.lit(None).cast("string")
    flat = rows.select(*[F.nullif(F.trim(pick(n).cast("string")), F.lit("")).alias(n) for n in ("uid", "title", "translator", "url", "content")]).filter("uid IS NOT NULL")
    flat = flat.groupBy("uid").agg(F.min(F.struct("title", "translator", "url", "content")).alias("r")).select("uid", "r.*")
    text_id = F.concat_ws("-", F.lit(source), "uid")
    texts = flat.select(text_id.alias("text_id"), "title", "translator", F.lit(lang).alias("lang"), F.col("content").isNotNull().alias("has_content"), F.coalesce(F.length("content"), F.lit(0)).alias("content_char_count"))
    identifiers = flat.select(text_id.alias("text_id"), F.lit(source).alias("source"), F.col("uid").alias("source_uid"), F.col("url").alias("source_url"))
    contents = flat.filter("content IS NOT NULL").select(text_id.alias("text_id"), F.lit(1).alias("juan_num"), F.lit(lang).alias("lang"), "content")
    return texts, identifiers, contents
