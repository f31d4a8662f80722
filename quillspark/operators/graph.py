"""Property graphs: neighbours, subgraphs, edge rules, places and lineages.

Entities have id, kind, name and JSON properties; relations have id, subject, predicate, object,
source and confidence.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_key


def prop(name: str, column: str = "properties") -> Column:
    return F.get_json_object(column, f"$.{name}")


def number(name: str, column: str = "properties") -> Column:
    """A JSON number or numeric string as double; anything else is null."""
    return F.expr(f"try_cast(get_json_object({column}, '$.{name}') AS DOUBLE)")


def hidden(column: str = "properties") -> Column:
    return F.lower(F.coalesce(prop("is_hidden", column), F.lit("false"))) == "true"


def symmetric(relations: DataFrame) -> DataFrame:
    """(id, other, direction, ...) from either end; a self-loop once, outgoing."""
    rest = [c for c in relations.columns if c not in ("subject", "object")]
    out = relations.select(F.col("subject").alias("node"), F.col("object").alias("other"), F.lit("outgoing").alias("direction"), *rest)
    back = relations.filter("subject <> object").select(F.col("object").alias("node"), F.col("subject").alias("other"), F.lit("incoming").alias("direction"), *rest)
    return out.unionByName(back)


def relations_of(relations: DataFrame, entities: DataFrame, node) -> DataFrame:
    """A node's relations with the other end's name and kind, by predicate and name."""
    mine = symmetric(relations).filter(F.col("node") == F.lit(node))
    other = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("kind").alias("other_kind"))
    return mine.join(other, "other").select("other", "direction", "predicate", "other_name", "other_kind").orderBy("predicate", "other_name", "other")


def with_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities on either end of a relation: one semi join over the union of both ends."""
    ends = relations.select(F.col("subject").alias("id")).unionByName(relations.select(F.col("object").alias("id"))).distinct()
    return entities.join(ends, "id", "left_semi")


def distinct_edges(relations: DataFrame) -> DataFrame:
    """One row for a triple: the largest confidence and the source that states it (ties to the smallest relation id)."""
    first = F.struct(F.col("confidence"), (-F.col("id")).alias("i"))
    return relations.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.max_by("source", first).alias("source"))


def preferred_source(relations: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row for a triple: of the source that comes first in the list, then the smallest id."""
    turn = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    return first_per_key(relations, ["subject", "predicate", "object"], [turn, "id"])


def subgraph(relations: DataFrame, entities: DataFrame, start, depth: int = 2, max_nodes: int = 150, max_edges: int = 500, predicates: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (id, depth), edges among them, and whether nodes were cut off.

    Breadth first and undirected, 1 to 4 layers; when the cap is reached the nodes of least depth and id
    stay.  The node table is bounded by ``max_nodes``, so each layer's frontier is
    broadcast and the relations are only scanned.
    """
    if not 1 <= depth <= 4 or not 10 <= max_nodes <= 500:
        raise ValueError("depth must lie between 1 and 4, max_nodes between 10 and 500")
    spark = relations.sparkSession
    edges = relations if predicates is None else relations.filter(F.col("predicate").isin(list(predicates)))
    nodes, frontier, cut = {start: 0}, [start], False
    for d in range(1, depth + 1):
        room = max_nodes - len(nodes)
        if not frontier or room <= 0:
            cut = cut or bool(frontier)
            break
        out = edges.filter(F.col("subject").isin(frontier)).select(F.col("object").alias("id"))
        back = edges.filter(F.col("object").isin(frontier)).select(F.col("subject").alias("id"))
        fresh = [r.id for r in out.unionByName(back).distinct().filter(~F.col("id").isin(list(nodes))).orderBy("id").limit(room + 1).collect()]
        cut, frontier = cut or len(fresh) > room, fresh[:room]
        nodes |= dict.fromkeys(frontier, d)
    kept = F.broadcast(spark.createDataFrame(list(nodes.items()), "id long, depth int"))
    kept = kept.join(entities.select("id", "name", "kind", "properties"), "id").filter(~hidden()).drop("properties")
    ids = kept.select("id")
    inside = edges.join(F.broadcast(ids.withColumnRenamed("id", "subject")), "subject", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "object")), "object", "left_semi")
    inner = distinct_edges(inside).orderBy("subject", "predicate", "object").limit(max_edges)
    return kept.orderBy("depth", "id"), inner, cut


def years_overlap(start: Column, end: Column, first: int | None, last: int | None) -> Column:
    """Whether [start, end], open where null, meets the years asked for."""
    out = F.lit(True)
    if first is not None:
        out = out & (F.coalesce(end, F.lit(9999)) >= first)
    if last is not None:
        out = out & (F.coalesce(start, F.lit(-9999)) <= last)
    return out


def in_year_slice(start: Column, end: Column, year: int) -> Column:
    """The client's rule: shown if undated, else if the year lies between the known ends."""
    low, high = F.coalesce(start, end), F.coalesce(end, start)
    return low.isNull() | F.lit(year).between(low, high)


def places(entities: DataFrame, kinds: Sequence[str] | None = None, first: int | None = None, last: int | None = None, bounds: tuple[float, float, float, float] | None = None, limit: int = 5000) -> DataFrame:
    """Entities to show on a map, by id, with ``total`` of all that qualify.

    Persons count only inside latitudes 18 to 54 and longitudes 73 to 135 and with a vouched-for
    source of their coordinates.
    """
    rows = entities.withColumns({"lat": number("latitude"), "lng": number("longitude"), "year_start": number("year_start"), "year_end": number("year_end"), "geo_source": prop("geo_source")})
    sourced = F.col("geo_source").rlike("^(wikidata|city_match|province_match)")
    person = F.col("lat").between(18, 54) & F.col("lng").between(73, 135) & F.coalesce(sourced, F.lit(False))
    keep = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~hidden() & (F.coalesce(prop("is_buddhist"), F.lit("true")) != "false") & prop("sub_entity").isNull() & ((F.col("kind") != "person") | person)
    rows = rows.filter(keep & years_overlap(F.col("year_start"), F.col("year_end"), first, last))
    if kinds:
        rows = rows.filter(F.col("kind").isin(list(kinds)))
    if bounds:
        south, west, north, east = bounds
        rows = rows.filter(F.col("lat").between(south, north) & F.col("lng").between(west, east))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return rows.join(total).orderBy("id").limit(limit).select("id", "kind", "name", "lat", "lng", "year_start", "year_end", "total")


def lineage(relations: DataFrame, entities: DataFrame, school: str | None = None, limit: int = 1000) -> DataFrame:
    """Arcs teacher to student with both places and the teacher's school, by year (nulls last) and id."""
    located = entities.select("id", "name", number("latitude").alias("lat"), number("longitude").alias("lng"), number("year_start").alias("year")).filter("lat IS NOT NULL AND lng IS NOT NULL")
    end = lambda p: located.select(*[F.col(c).alias(f"{p}_{c}") for c in located.columns])
    arcs = relations.filter("predicate = 'teacher_of'").select(F.col("id").alias("arc"), F.col("subject").alias("teacher_id"), F.col("object").alias("student_id"))
    member = first_per_key(relations.filter("predicate = 'member_of'"), ["subject"], ["id"]).select(F.col("subject").alias("teacher_id"), F.col("object").alias("_school"))
    schools = entities.select(F.col("id").alias("_school"), F.col("name").alias("school"))
    rows = arcs.join(end("teacher"), "teacher_id").join(end("student"), "student_id").join(member, "teacher_id", "left").join(schools, "_school", "left")
    if school is not None:
        rows = rows.filter(F.col("school") == school)
    return rows.withColumn("year", F.coalesce("teacher_year", "student_year")).orderBy(F.asc_nulls_last("year"), "arc").limit(limit).select("arc", "teacher_id", "student_id", "school", "year")


def via(relations: DataFrame, first: str, second: str) -> DataFrame:
    """(node, place): the best place over two edges, by confidence, then place."""
    a = relations.filter(F.col("predicate") == first).select(F.col("subject").alias("node"), F.col("object").alias("middle"), F.col("confidence").alias("c1"))
    b = relations.filter(F.col("predicate") == second).select(F.col("subject").alias("middle"), F.col("object").alias("place"), F.col("confidence").alias("c2"))
    return first_per_key(a.join(b, "middle"), ["node"], [F.desc(F.least("c1", "c2")), "place"]).select("node", "place")


def propagate(entities: DataFrame, relations: DataFrame, predicate: str, source: str) -> DataFrame:
    """Coordinates from the object of a relation for subjects without any, tagged with where they come from."""
    have = entities.withColumns({"lat": number("latitude"), "lng": number("longitude")})
    known = have.filter("lat IS NOT NULL AND lng IS NOT NULL").select(F.col("id").alias("object"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    edge = relations.filter(F.col("predicate") == predicate).join(known, "object")
    best = first_per_key(edge, ["subject"], [F.desc("confidence"), "object"]).select(F.col("subject").alias("id"), "_lat", "_lng", F.col("object").alias("_from"))
    missing = F.col("lat").isNull() | F.col("lng").isNull()
    out = have.join(best, "id", "left")
    tag = F.when(missing & F.col("_lat").isNotNull(), F.concat(F.lit(f"{source}:"), F.col("_from")))
    return out.select("id", "kind", "name", F.when(missing, F.col("_lat")).otherwise(F.col("lat")).alias("lat"), F.when(missing, F.col("_lng")).otherwise(F.col("lng")).alias("lng"), tag.alias("geo_source"))


def insert_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """New triples that are not there yet, each once: the most confident."""
    key = ["subject", "predicate", "object"]
    return first_per_key(new, key, [F.desc("confidence"), "source"]).join(old.select(*key), key, "left_anti")


def citations(notes: DataFrame, key: str, text: str, works: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(subject, object, confidence) of works named in notes by id; self-citations go, a pair counts once."""
    found = notes.select(F.col(key).alias("subject"), F.explode(F.regexp_extract_all(text, F.lit(r"([A-Z]+\d+n\d+)"), F.lit(1))).alias("_c"))
    named = found.withColumn("work", F.concat(F.regexp_extract("_c", r"^([A-Z]+)", 1), F.regexp_extract("_c", r"n0*(\d+)", 1)))
    return named.join(works.select(F.col("id").alias("object"), "work"), "work").filter("subject <> object").select("subject", "object").distinct().withColumn("confidence", F.lit(confidence))


def commentaries(texts: DataFrame, key: str, title: str, suffixes: Sequence[str], abbreviations: dict[str, str]) -> DataFrame:
    """(subject, object, confidence): a commentary's title without its suffix is a work's title (.8), its abbreviation (.7),
    one with 大方廣 before, 經 after or 妙法 before, in this order (.6), or is held by the title of one other work alone (.5).

    Of works with one title the largest key counts.
    """
    pattern = f"^(.+?)({'|'.join(sorted(suffixes, key=len, reverse=True))})$"
    base = texts.select(F.col(key).alias("subject"), F.nullif(F.regexp_extract(title, pattern, 1), F.lit("")).alias("base")).filter(F.col("base").isNotNull())
    works = texts.groupBy(F.col(title).alias("name")).agg(F.max(key).alias("object"))
    full = F.create_map(*[F.lit(x) for p in abbreviations.items() for x in p]) if abbreviations else F.create_map(F.lit(""), F.lit(""))
    tries = [(F.col("base"), 0.8), (full[F.col("base")], 0.7), (F.concat(F.lit("大方廣"), "base"), 0.6), (F.concat("base", F.lit("經")), 0.6), (F.concat(F.lit("妙法"), "base"), 0.6)]
    tried = base.select("subject", F.posexplode(F.array(*[F.struct(n.alias("name"), F.lit(c).alias("confidence")) for n, c in tries])).alias("turn", "t")).select("subject", "turn", "t.name", "t.confidence")
    exact = tried.join(works, "name").filter("subject <> object")
    named = first_per_key(exact, ["subject"], ["turn"]).select("subject", "object", "confidence")
    # titles are looked up by the first two characters of the base among their own pairs
    pair = lambda c, i: F.substring(c, i, F.lit(2))
    rest = base.join(named, "subject", "left_anti").withColumn("_gram", pair(F.col("base"), F.lit(1)))
    grams = works.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.array(pair(F.col("name"), i), F.substring("name", i, F.lit(1))))))))
    held = rest.join(grams, "_gram").filter(F.contains("name", F.col("base")) & (F.col("object") != F.col("subject")))
    alone = held.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("object").alias("object")).filter("n = 1")
    return named.unionByName(alone.select("subject", "object", F.lit(0.5).alias("confidence")))


def concepts(texts: DataFrame, key: str, title: str, keywords: dict[str, Sequence[str]], confidence: float = 0.7) -> DataFrame:
    """(text, concept, confidence) where a keyword of the concept occurs in the title."""
    out = F.filter(F.array(*[F.when(F.col(title).rlike("|".join(re.escape(w) for w in words)), F.lit(c)) for c, words in keywords.items()]), lambda c: c.isNotNull())
    return texts.select(F.col(key).alias("text"), F.explode(out).alias("concept")).distinct().withColumn("confidence", F.lit(confidence))


def sites(colophons: DataFrame, key: str, text: str, known: Sequence[str]) -> DataFrame:
    """(key, site) named as the place of translation, of the known ones."""
    found = F.explode(F.regexp_extract_all(text, F.lit(r"於([\x{4E00}-\x{9FFF}]{1,8}?寺)[^。]{0,6}?譯"), F.lit(1)))
    return colophons.select(key, found.alias("site")).filter(F.col("site").isin(list(known))).distinct()


def nearby_known(new: DataFrame, old: DataFrame, km: float = 2.0) -> DataFrame:
    """New places that are not there: no old one of the same name within ``km`` or without coordinates, nor with the same external id.

    Each distinct name and point is compared once, with the old points of the same name in its own and the neighbouring cells of a grid of
    ``km`` in space, so places of a frequent name do not all meet.  A straight line is no longer than the way over the sphere, so cells lose nothing.
    """
    from ..functions.geo import EARTH_KM, haversine_km
    from ..functions.names import plain_name

    point = ["_n", "_lat", "_lng"]
    points = lambda df: df.select(plain_name(F.col("name")).alias("_n"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    n, o = new.withColumns({"_n": plain_name(F.col("name")), "_lat": F.col("lat"), "_lng": F.col("lng")}), points(old)
    lat, lng = F.radians("_lat"), F.radians("_lng")
    side = max(km, 1e-3) * (1 + 1e-6)
    axes = {"_x": F.cos(lat) * F.cos(lng), "_y": F.cos(lat) * F.sin(lng), "_z": F.sin(lat)}
    celled = lambda df: df.distinct().withColumns({c: F.floor(EARTH_KM * x / side) for c, x in axes.items()}).dropna()
    real = F.abs("_lat") < float("inf"), F.abs("_lng") < float("inf")
    asked = celled(points(new).filter(real[0] & real[1]))
    known = celled(o.filter(real[0] & real[1]))
    for c in axes:
        known = known.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    known = known.select("_n", *axes, F.col("_lat").alias("_lat2"), F.col("_lng").alias("_lng2"))
    near = asked.join(known, ["_n", *axes]).filter(haversine_km(F.col("_lat"), F.col("_lng"), F.col("_lat2"), F.col("_lng2")) < km).select(*point).distinct()
    nowhere = o.filter(F.col("_lat").isNull() | F.col("_lng").isNull()).select("_n").distinct()
    there = n.join(nowhere, "_n", "left_semi").select("id").union(n.join(near, point, "left_semi").select("id"))
    return new.join(there, "id", "left_anti").join(old.filter("external_id IS NOT NULL").select("external_id").distinct(), "external_id", "left_anti")


def degree(relations: DataFrame) -> DataFrame:
    return symmetric(relations).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("neighbours"))
