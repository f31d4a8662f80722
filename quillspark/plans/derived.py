"""Operators whose usual input is no table of the driver's: it is derived from those tables, the same way in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import etl, export, graph, reading, search, service, stats, vector
from ..sources import catalogs
from .base import Registry, derived, plain_sql

R = Registry()


class Input:
    """One SELECT over given tables, as a frame and as a subquery."""

    def __init__(self, sql: str, *tables: str):
        self.sql, self.tables = sql, tables

    def __call__(self, t, spark):
        return derived(t, spark, self.sql, *self.tables)

    def __str__(self) -> str:
        return f"({plain_sql(self.sql, *self.tables)})"


OLD = Input("SELECT c_custkey AS k, c_mktsegment AS v, c_nationkey AS s FROM {customer} WHERE c_custkey % 3 <> 0", "customer")
NEW = Input("SELECT o_custkey AS k, o_orderpriority AS v, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS INT) END AS s, o_orderkey AS r FROM {orders}", "orders")


@R.add("upsert", f"WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS q FROM {NEW}) WHERE q = 1) SELECT coalesce(f.k, o.k) AS k, CASE WHEN f.k IS NOT NULL THEN f.v ELSE o.v END AS v, coalesce(f.s, o.s) AS s FROM {OLD} o FULL JOIN f ON o.k = f.k")
def upsert(t, spark):
    return etl.upsert(OLD(t, spark), NEW(t, spark), ["k"], ["s"], ["r"])


PEOPLE = Input("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Q' || CAST(c_custkey % 40 AS STRING) WHEN c_custkey % 4 = 1 THEN '' END AS q, CASE WHEN c_custkey % 3 = 0 THEN 'd' || CAST(c_custkey % 70 AS STRING) END AS d, 'N' || CAST(c_nationkey AS STRING) || '-' || CAST(c_custkey % 9 AS STRING) AS name FROM {customer}", "customer")
KNOWN = Input("SELECT s_suppkey AS oid, 'Q' || CAST(s_suppkey AS STRING) AS oq, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || CAST(s_suppkey % 30 AS STRING) ELSE '' END AS od, 'N' || CAST(s_nationkey AS STRING) || '-' || CAST(s_suppkey % 9 AS STRING) AS oname FROM {supplier}", "supplier")


@R.add("entity_resolution", f"WITH q AS (SELECT oq, min(oid) AS m FROM {KNOWN} WHERE oq <> '' GROUP BY 1), d AS (SELECT od, min(oid) AS m FROM {KNOWN} WHERE od <> '' GROUP BY 1), n AS (SELECT oname, min(oid) AS m FROM {KNOWN} WHERE oname <> '' GROUP BY 1) SELECT id, coalesce(q.m, d.m, n.m) AS match_id FROM {PEOPLE} p LEFT JOIN q ON q.oq = p.q LEFT JOIN d ON d.od = p.d LEFT JOIN n ON n.oname = p.name")
def entity_resolution(t, spark):
    return etl.resolve(PEOPLE(t, spark), KNOWN(t, spark), [("q", "oq"), ("d", "od"), ("name", "oname")], "oid").select("id", "match_id")


@R.add("group_cross_members", "WITH g AS (SELECT l_orderkey, list_distinct(list(l_partkey % 50)) AS l, list_distinct(list(l_suppkey % 50)) AS r, 'p' || (l_orderkey % 5)::VARCHAR AS n FROM lineitem GROUP BY l_orderkey), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, n FROM (SELECT unnest(l) AS a, r, n FROM g) x, unnest(x.r) u(b)) SELECT a, b, string_agg(DISTINCT n, '; ' ORDER BY n) AS notes FROM p GROUP BY 1, 2")
def group_cross_members(t, spark):
    groups = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("l"), F.collect_set(F.col("l_suppkey") % 50).alias("r"))
    return etl.cross_members(groups.withColumn("n", F.concat(F.lit("p"), (F.col("l_orderkey") % 5).cast("string"))), "l", "r", "n")


HITS = Input("SELECT p_partkey AS id, p_name AS title, CASE p_size % 3 WHEN 0 THEN '唐 ' || p_brand WHEN 1 THEN p_brand END AS tr, p_size > 25 AS has, CASE WHEN p_partkey % 4 > 0 THEN 'T' || lpad(CAST(p_partkey AS STRING), 7, '0') END AS num FROM {part}", "part")


@R.add("merged_editions", f"SELECT id, title, tr FROM (SELECT *, row_number() OVER (PARTITION BY title, replace(coalesce(tr, ''), '唐 ', '') ORDER BY has DESC, coalesce(num, 'ZZZZ'), id) AS k FROM {HITS}) WHERE k = 1")
def merged_editions(t, spark):
    return search.merged_editions(HITS(t, spark), "title", "tr", "has", "num", "id").select("id", "title", "tr")


RELATED = Input("SELECT l_orderkey * 10 + l_linenumber AS rel_id, l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'R' THEN 'parallel' ELSE 'alt_translation' END AS relation FROM {lineitem}", "lineitem")
ASKED = Input("SELECT p_partkey FROM {part} WHERE p_size > 40", "part")


@R.add("related_translations", f"WITH m AS (SELECT a AS id, b AS other, relation, rel_id FROM {RELATED} UNION ALL SELECT b, a, relation, rel_id FROM {RELATED}) SELECT id, other, relation, p_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY id, other ORDER BY rel_id) AS k FROM m WHERE id IN (SELECT p_partkey FROM {ASKED})) JOIN part ON p_partkey = other WHERE k = 1")
def related_translations(t, spark):
    return search.translations(RELATED(t, spark), t("part"), ASKED(t, spark), "p_partkey", "p_name")


ALIGNED = Input("SELECT l_partkey AS a_text, 0 AS a_chapter, CASE WHEN l_linenumber < 7 THEN l_linenumber % 2 END AS a_chunk, l_suppkey AS b_text, 0 AS b_chapter, CAST(l_orderkey % 2 AS INT) AS b_chunk, CAST(l_discount AS DOUBLE) AS confidence FROM {lineitem}", "lineitem")


@R.add("parallel_chunks", f"""WITH s AS (SELECT a_text AS text, a_chunk AS chunk, b_text AS o_text, b_chunk AS o_chunk, confidence AS c FROM {ALIGNED} UNION ALL SELECT b_text, b_chunk, a_text, a_chunk, confidence FROM {ALIGNED}),
    n AS (SELECT *, row_number() OVER (PARTITION BY text, chunk ORDER BY c DESC, o_text, o_chunk) AS k FROM s WHERE chunk IS NOT NULL AND o_chunk IS NOT NULL), l AS (SELECT text, chunk, string_agg(o_text || ':' || o_chunk, ',' ORDER BY c DESC, o_text, o_chunk) AS parallels FROM n WHERE k <= 5 GROUP BY 1, 2)
    SELECT p_partkey AS text, h.chunk::BIGINT AS chunk, parallels FROM (SELECT p_partkey, unnest([0, 1]) AS chunk FROM part) h LEFT JOIN l ON l.text = p_partkey AND l.chunk = h.chunk""")
def parallel_chunks(t, spark):
    texts = t("part").select(F.col("p_partkey").alias("text"), F.lit(0).alias("chapter"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"), F.col("p_name").alias("content"))
    out = vector.attach_parallels(texts.drop("content"), ALIGNED(t, spark), texts)
    return out.select("text", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.transform("parallels", lambda x: F.concat_ws(":", x["o_text"], x["o_chunk"])), ",").alias("parallels"))


GEO = Input("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'temple' END AS kind, c_name AS name, CASE WHEN c_custkey % 17 > 0 THEN
    '{{"latitude": "' || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE CAST(c_nationkey * 3 - 10 AS STRING) || '.5' END || '", "longitude": ' || CAST(60 + c_custkey % 90 AS STRING)
    || ', "geo_source": "' || CASE c_custkey % 4 WHEN 0 THEN 'wikidata:P1' WHEN 1 THEN 'dynasty:tang' WHEN 2 THEN 'city_match' ELSE 'province_match:x' END || '"'
    || CASE WHEN c_custkey % 11 = 0 THEN ', "is_hidden": "true"' WHEN c_custkey % 11 = 1 THEN ', "is_buddhist": false' WHEN c_custkey % 11 = 2 THEN ', "year_start": 700, "year_end": 900' WHEN c_custkey % 11 = 3 THEN ', "year_start": 800' ELSE '' END || '}}' END AS properties FROM {customer}""", "customer")


@R.add(
    "geo_entities",
    f"""WITH f AS (SELECT id, kind, name, TRY_CAST(p->>'latitude' AS DOUBLE) AS lat, TRY_CAST(p->>'longitude' AS DOUBLE) AS lng, TRY_CAST(p->>'year_start' AS DOUBLE) AS y0, TRY_CAST(p->>'year_end' AS DOUBLE) AS y1, p->>'geo_source' AS g, coalesce(p->>'is_hidden', 'false') AS h, coalesce(p->>'is_buddhist', 'true') AS b FROM (SELECT *, properties AS p FROM {GEO})),
    k AS (SELECT * FROM f WHERE lat IS NOT NULL AND lng IS NOT NULL AND h <> 'true' AND b <> 'false' AND (kind <> 'person' OR (lat BETWEEN 18 AND 54 AND lng BETWEEN 73 AND 135 AND regexp_matches(coalesce(g, ''), '^(wikidata|city_match|province_match)'))) AND coalesce(y1, 9999) >= 600 AND coalesce(y0, -9999) <= 750)
    SELECT id, kind, lat, lng, (SELECT count(*) FROM k) AS total FROM k ORDER BY id LIMIT 5000""",
)
def geo_entities(t, spark):
    return graph.places(GEO(t, spark), first=600, last=750).select("id", "kind", "lat", "lng", "total")


POINTS = Input("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'POINT(' || CAST(c_custkey AS STRING) || ' x)' WHEN c_custkey % 11 > 0 THEN 'Point(' || CAST(c_custkey % 400 - 200 AS STRING) || '.25 ' || CAST(c_nationkey * 9 - 110 AS STRING) || ')' END AS w FROM {customer}", "customer")
WKT = r"(?i)^Point\((-?[0-9.]+) (-?[0-9.]+)\)$"


@R.add("wkt_points", f"WITH r AS (SELECT id, TRY_CAST(nullif(regexp_extract(w, '{WKT}', 1), '') AS DOUBLE) AS lng, TRY_CAST(nullif(regexp_extract(w, '{WKT}', 2), '') AS DOUBLE) AS lat FROM {POINTS}) SELECT id, lng, lat FROM r WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180")
def wkt_points(t, spark):
    p = POINTS(t, spark).select("id", geo.point_of(F.col("w")).alias("p")).filter("p IS NOT NULL")
    return p.select("id", F.col("p.longitude").alias("lng"), F.col("p.latitude").alias("lat"))


CITED = Input("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 4 > 0 THEN p_brand END AS tr, CASE WHEN p_size % 3 > 0 THEN p_type END AS dy, 'T' || CAST(p_partkey AS STRING) || '.' || CAST(p_size AS STRING) AS num FROM {part}", "part")
STYLES = ["chicago", "mla", "apa", "harvard", "bibtex", "ris", "other"]


@R.add(
    "citations",
    f"""WITH c AS (SELECT id, title, coalesce(tr, '佚名') AS who, coalesce(dy, '') AS dy, num FROM {CITED}) SELECT id, style, CASE style
    WHEN 'chicago' THEN '《' || title || '》，' || dy || who || '译。C，编号 ' || num || '。P。' WHEN 'mla' THEN who || ', 译. 《' || title || '》. C, ' || num || '. P.'
    WHEN 'apa' THEN who || ' (译). (' || dy || '). 《' || title || '》 (' || num || '). C. P.' WHEN 'harvard' THEN who || ' (译) (' || dy || ') 《' || title || '》. ' || num || '. C. P.'
    WHEN 'bibtex' THEN '@misc{{' || replace(num, '.', '_') || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  author = {{' || who || '}},' || chr(10) || '  year = {{' || dy || '}}' || chr(10) || '}}'
    WHEN 'ris' THEN concat_ws(chr(10), 'TY  - GEN', 'TI  - ' || title, 'AU  - ' || who, 'PY  - ' || dy, 'ID  - ' || num, 'ER  - ')
    ELSE '《' || title || '》，' || dy || who || '译，C ' || num || '。' END AS citation FROM c, (SELECT unnest({STYLES}) AS style)""",
)
def citations(t, spark):
    c = CITED(t, spark).withColumn("style", F.explode(F.array(*map(F.lit, STYLES))))
    machine = F.when(F.col("style") == "bibtex", export.bibtex(F.col("num"), F.col("title"), F.col("tr"), F.col("dy"))).when(F.col("style") == "ris", export.ris(F.col("num"), F.col("title"), F.col("tr"), F.col("dy")))
    return c.select("id", "style", F.coalesce(machine, export.citation(F.col("style"), F.col("title"), F.col("tr"), F.col("dy"), F.col("num"), "C", "P")).alias("citation"))


BYLINES = Input("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '後秦 ' WHEN 1 THEN '唐' WHEN 2 THEN ' 曹魏 ' WHEN 3 THEN '' END || CASE WHEN p_size < 48 THEN p_name ELSE '' END || '譯' AS line, CASE p_size % 5 WHEN 0 THEN '十六國' WHEN 1 THEN '唐' WHEN 2 THEN '三國' END AS dynasty, CASE WHEN p_size % 5 < 4 AND p_size < 48 THEN p_name END AS translator FROM {part}", "part")


@R.add("bylines", f"SELECT id, dynasty, translator FROM {BYLINES}")
def bylines(t, spark):
    b = BYLINES(t, spark).select("id", names.split_byline(F.col("line")).alias("x"))
    return b.select("id", F.col("x.dynasty").alias("dynasty"), F.col("x.translator").alias("translator"))


NAMES = Input("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN '玄奘 ' WHEN 1 THEN '원효 法' WHEN 2 THEN 'ひらがな' WHEN 3 THEN '' WHEN 4 THEN '123' ELSE '법 ' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 1, 12) END AS name FROM {documents}", "documents")


@R.add("script_classes", f"SELECT id, CASE WHEN regexp_matches(name, '[가-힯]') THEN 'hangul' WHEN regexp_matches(name, '[぀-ヿ]') THEN 'kana' WHEN regexp_matches(name, '[一-鿿]') THEN 'han' WHEN regexp_matches(name, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script FROM {NAMES}")
def script_classes(t, spark):
    return NAMES(t, spark).select("id", names.script_of(F.col("name")).alias("script"))


CODES = Input("SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN p_type || ', ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END || ',, SMALL' ELSE '' END AS langs FROM {part}", "part")


@R.add("language_codes", f"SELECT id, CASE WHEN langs = '' THEN '' ELSE (SELECT string_agg(m, ',' ORDER BY i) FROM (SELECT m, min(i) AS i FROM (SELECT CASE trim(x) WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' ELSE trim(x) END AS m, i FROM (SELECT unnest(string_split(langs, ',')) AS x, generate_subscripts(string_split(langs, ','), 1) AS i)) WHERE m <> '' GROUP BY m)) END AS codes FROM {CODES}")
def language_codes(t, spark):
    return CODES(t, spark).select("id", names.mapped_list(F.col("langs"), {"SMALL": "s", "LARGE": "l"}).alias("codes"))


NOTES = Input("SELECT l_partkey AS id, '見 T' || lpad(CAST(l_linenumber AS STRING), 2, '0') || 'n' || lpad(CAST(l_suppkey AS STRING), 4, '0') || ' 及 X01n' || CAST(l_suppkey % 7 AS STRING) || '。' AS t FROM {lineitem}", "lineitem")
WORKS = Input("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'X' || CAST(s_suppkey % 9 AS STRING) || CAST(s_suppkey AS STRING) ELSE 'T' || CAST(s_suppkey AS STRING) END AS work FROM {supplier}", "supplier")


@R.add("citation_mining", f"WITH c AS (SELECT n.id AS subject, unnest(regexp_extract_all(t, '[A-Z]+[0-9]+n[0-9]+')) AS c FROM {NOTES} n) SELECT DISTINCT subject, w.id AS object, 0.7::DOUBLE AS confidence FROM c JOIN {WORKS} w ON w.work = regexp_extract(c, '^([A-Z]+)', 1) || regexp_extract(c, 'n0*([0-9]+)', 1) WHERE subject <> w.id")
def citation_mining(t, spark):
    return graph.citations(NOTES(t, spark), "id", "t", WORKS(t, spark))


REL1 = Input("SELECT o_custkey AS text_id, CASE o_orderstatus WHEN 'F' THEN 'parallel' WHEN 'O' THEN 'commentary' ELSE 'cites' END AS relation_type, o_orderpriority AS note FROM {orders}", "orders")
REL2 = Input("SELECT l_suppkey AS text_id, CASE l_returnflag WHEN 'R' THEN 'commentary_on' WHEN 'N' THEN 'parallel' ELSE 'quotes' END AS relation_type, l_linestatus AS note FROM {lineitem}", "lineitem")


@R.add("merged_relations", f"WITH u AS (SELECT *, 0 AS t FROM {REL1} UNION ALL SELECT text_id, CASE relation_type WHEN 'commentary_on' THEN 'commentary' ELSE relation_type END, note, 1 FROM {REL2}) SELECT text_id, relation_type, note FROM (SELECT *, row_number() OVER (PARTITION BY text_id, relation_type ORDER BY t, note) AS k FROM u) WHERE k = 1")
def merged_relations(t, spark):
    return service.merged_relations(REL1(t, spark), REL2(t, spark), {"commentary_on": "commentary"})


ENDS = Input("SELECT l_partkey AS a, l_suppkey AS b FROM {lineitem}", "lineitem")


@R.add("text_versions", f"WITH o AS (SELECT p_name AS n FROM part WHERE p_partkey = 10), r AS (SELECT b AS id FROM {ENDS} WHERE a = 10 AND b <> 10 UNION SELECT a FROM {ENDS} WHERE b = 10 AND a <> 10) SELECT id::BIGINT AS id, 'relation' AS how FROM r UNION ALL SELECT p_partkey, 'title' FROM part WHERE p_name = (SELECT n FROM o) AND p_partkey <> 10 AND p_partkey NOT IN (SELECT id FROM r)")
def text_versions(t, spark):
    return service.versions(t("part"), ENDS(t, spark), "p_partkey", "p_name", 10)


SOURCES = Input("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN '敦煌 Museum' WHEN 1 THEN s_name || ' Dictionary' WHEN 2 THEN s_name WHEN 3 THEN 'Dunhuang ' || s_name END AS name, CASE s_nationkey % 4 WHEN 0 THEN 'pi,lzh' WHEN 1 THEN 'SA' WHEN 2 THEN 'lzh,bo' END AS langs FROM {supplier}", "supplier")


@R.add("research_fields", f"WITH s AS {SOURCES}, f AS (SELECT id, 'theravada' AS f FROM s WHERE list_contains(string_split(lower(langs), ','), 'pi') UNION SELECT id, 'sanskrit' FROM s WHERE list_contains(string_split(lower(langs), ','), 'sa') UNION SELECT id, 'tibetan' FROM s WHERE list_contains(string_split(lower(langs), ','), 'bo') UNION SELECT id, 'dunhuang' FROM s WHERE regexp_matches(name, '敦煌|Dunhuang') UNION SELECT id, 'art' FROM s WHERE regexp_matches(name, 'Museum') UNION SELECT id, 'dictionary' FROM s WHERE regexp_matches(name, '[Dd]ictionary')) SELECT s.id, coalesce(string_agg(f, ',' ORDER BY f), 'han') AS fields FROM s LEFT JOIN f USING (id) GROUP BY 1")
def research_fields(t, spark):
    rules = [("dunhuang", "敦煌|Dunhuang"), ("art", "Museum"), ("dictionary", "[Dd]ictionary")]
    return SOURCES(t, spark).select("id", service.research_fields(F.col("name"), F.col("langs"), rules, {"pi": "theravada", "bo": "tibetan", "sa": "sanskrit"}, "han").alias("fields"))


REGIONS = Input("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '中国' WHEN 1 THEN ' 台湾 ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE n_name END AS region FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey", "customer", "nation")


@R.add("region_names", f"SELECT coalesce(CASE trim(region) WHEN '中国' THEN '中国大陆' WHEN '台湾' THEN '中国台湾' WHEN '' THEN NULL ELSE trim(region) END, '其他') AS region, count(*) AS n FROM {REGIONS} GROUP BY 1")
def region_names(t, spark):
    return REGIONS(t, spark).groupBy(service.region(F.col("region")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


CATALOG = Input("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[{{"id": "T' || CAST(p_partkey AS STRING) || '", "title": " ' || p_name || ' ", "juan": "' || CAST(p_size AS STRING) || '"}}, {{"title": "none"}}]'
    ELSE '{{"T' || CAST(p_partkey AS STRING) || '": {{"name": "' || p_name || '", "author": "' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END || '", "juan": "?"}}}}' END AS j FROM {part}""", "part")


@R.add("catalog_json", f"""WITH c AS (SELECT p_partkey, j::JSON AS j FROM {CATALOG}), l AS (SELECT unnest(from_json(j, '["JSON"]')) AS m, NULL AS k FROM c WHERE json_type(j) = 'ARRAY' UNION ALL SELECT json_extract(j, '$.' || json_keys(j)[1]), json_keys(j)[1] FROM c WHERE json_type(j) = 'OBJECT')
    SELECT coalesce(k, m->>'id') AS work_id, nullif(trim(coalesce(m->>'title', m->>'name')), '') AS title, nullif(m->>'author', '') AS byline, TRY_CAST(m->>'juan' AS INT) AS fascicles FROM l WHERE coalesce(k, m->>'id') IS NOT NULL""")
def catalog_json(t, spark):
    return catalogs.works(CATALOG(t, spark), "j")


BOUND = Input("""SELECT s_suppkey, '{{"results": {{"bindings": [{{"item": {{"value": "http://e/Q' || CAST(s_suppkey AS STRING) || '"}}, "label": {{"value": "' || s_name || '"}}, "c": {{"value": "Point(' || CAST(s_nationkey * 10 - 50 AS STRING) || ' ' || CAST(s_suppkey % 130 - 40 AS STRING) || ')"}}}}, {{"item": {{"value": "http://e/' || CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE 'Q' END || CAST(100000 + s_suppkey AS STRING)
    || '"}}, "c": {{"value": "Point(-1 -2)"}}}}]}}}}' AS j FROM {supplier}""", "supplier")


@R.add("place_bindings", f"""WITH b AS (SELECT unnest(from_json(j::JSON->'results'->'bindings', '["JSON"]')) AS b FROM {BOUND}), r AS (SELECT regexp_extract(b->'item'->>'value', '(Q[0-9]+)$', 1) AS external_id, b->'label'->>'value' AS name, string_split(regexp_extract(b->'c'->>'value', '[(](.*)[)]', 1), ' ') AS p FROM b)
    SELECT external_id, name, p[1]::DOUBLE AS longitude, p[2]::DOUBLE AS latitude FROM r WHERE external_id <> '' AND p[1]::DOUBLE BETWEEN -180 AND 180 AND p[2]::DOUBLE BETWEEN -90 AND 90""")
def place_bindings(t, spark):
    found = catalogs.bindings(BOUND(t, spark), "j", ["item", "label", "c"])
    return catalogs.places(found, "item", "label", "c")


ANNOTATED = Input("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'pending' ELSE 'approved' END AS s, CASE o_orderkey % 5 WHEN 0 THEN 'submit' WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'revise' END AS a FROM {orders}", "orders")


@R.add("annotation_flow", f"WITH f(s, a, state) AS (VALUES ('draft', 'submit', 'pending'), ('pending', 'approve', 'approved'), ('pending', 'reject', 'rejected'), ('pending', 'revise', 'draft')) SELECT id, state FROM {ANNOTATED} LEFT JOIN f USING (s, a)")
def annotation_flow(t, spark):
    return ANNOTATED(t, spark).select("id", etl.flow(F.col("s"), F.col("a")).alias("state"))


DYNASTIES = Input("SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN '姚秦' WHEN 1 THEN '唐' WHEN 2 THEN '唐' WHEN 3 THEN '宋' WHEN 4 THEN '北宋' WHEN 5 THEN NULL WHEN 6 THEN p_type ELSE '劉宋' END AS dynasty FROM {part}", "part")


@R.add("dynasty_distribution", f"WITH y(dynasty, s, e) AS (VALUES ('姚秦', 304, 439), ('唐', 618, 907), ('宋', 960, 1127), ('北宋', 960, 1127), ('劉宋', 420, 589)) SELECT t.dynasty AS value, count(*) AS n, min(s) AS year_start, min(e) AS year_end FROM {DYNASTIES} t LEFT JOIN y USING (dynasty) WHERE t.dynasty IS NOT NULL GROUP BY 1")
def dynasty_distribution(t, spark):
    rows = stats.distribution(DYNASTIES(t, spark), "dynasty")
    years = names.dynasty_years(F.col("value"))
    return rows.select("value", "n", years["start"].alias("year_start"), years["end"].alias("year_end"))


LISTED = Input("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN p_type || ', ' || p_brand || ',,' || p_type WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' , ' ELSE p_brand || ' ,' || p_name END AS langs FROM {part}", "part")


@R.add("csv_facet_explode", f"WITH t AS {LISTED}, m AS (SELECT id, trim(unnest(string_split(coalesce(langs, ''), ','))) AS m FROM t), p AS (SELECT * FROM m WHERE m <> '') SELECT member, count(DISTINCT id) AS n FROM (SELECT id, m AS member FROM p UNION ALL SELECT id, '其他' FROM t WHERE id NOT IN (SELECT id FROM p)) GROUP BY 1")
def csv_facet_explode(t, spark):
    return stats.by_member(LISTED(t, spark), "langs", "其他", "id")


SCORES = Input("SELECT c_mktsegment AS category, CAST(c_custkey % 5 - 1 AS INT) AS r, CAST(c_custkey % 3 - 1 AS INT) AS c, c_nationkey % 4 AS a, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS h FROM {customer}", "customer")


@R.add(
    "evaluation_report",
    f"""WITH m AS (SELECT category, count(*) AS n, avg(CASE WHEN r >= 0 THEN r END) AS r, avg(CASE WHEN c >= 0 THEN c END) AS c, avg(CASE WHEN a >= 0 THEN a END) AS a, avg(CASE WHEN h >= 0 THEN h END) AS h FROM {SCORES} GROUP BY 1)
    SELECT *, round((coalesce(r, 0) + coalesce(c, 0) + coalesce(a, 0) + 3 * coalesce(h, 0)) * 100 / 12, 4) AS overall_percent FROM m""",
)
def evaluation_report(t, spark):
    return stats.evaluation(SCORES(t, spark), "category", ["r", "c", "a", "h"], {"r": 1.0, "c": 1.0, "a": 1.0, "h": 3.0}, 12.0)


#: Texts cut at clauses, with some words put in place of the marks that a canon's lines have.
LAID = Input("SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, ', ', '，' || chr(10)), '. ', '。' || chr(10)), chr(10) || 'The', chr(10) || '論曰'), ' of', '頌曰'), ' qui ', '譯' || chr(10)), 'La ', '（一）'), ' und ', chr(10) || '經第二' || chr(10)) AS text FROM {documents}", "documents")
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _form(x: str) -> str:
    bars = lambda marks: f"NOT regexp_matches({x}, '{marks}')"
    return f"""CASE WHEN {x} = '' THEN CASE WHEN regexp_matches(coalesce(before, ''), '{reading.FINAL}') THEN 'break' ELSE 'blank' END WHEN regexp_matches({x}, '{reading.CHAPTER}') AND size <= 25 AND {bars(reading.CHAPTER_BARS)} THEN 'juan'
    WHEN regexp_matches({x}, '{reading.BYLINE}') AND size <= 25 AND {bars(reading.BYLINE_BARS)} THEN 'byline' WHEN regexp_matches({x}, '{reading.NUMBERED}') OR (regexp_matches({x}, '{reading.SECTION}') AND size <= 20 AND {bars(reading.SECTION_BARS)}) THEN 'section'
    WHEN i - first <= 2 AND size BETWEEN 2 AND 15 AND regexp_matches({x}, '{reading.HEAD}') AND {bars(reading.HEAD_BARS)} THEN 'head' WHEN regexp_matches({x}, '{reading.TO_PROSE}') THEN 'to_prose' WHEN regexp_matches({x}, '{reading.TO_VERSE}') THEN 'to_verse'
    WHEN size BETWEEN 4 AND 22 AND regexp_matches({x}, '{reading.VERSE_END}') AND marks <= 2 AND CASE WHEN regexp_matches({x}, '{SPACES}{{2,}}') THEN true WHEN marks = 2 AND length(h[1]) > 0 AND length(h[2]) > 0 THEN 2 * least(length(h[1]), length(h[2])) >= greatest(length(h[1]), length(h[2])) ELSE marks = 1 AND size <= 12 END THEN 'clause' ELSE 'plain' END"""


@R.add(
    "reading_layout",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {LAID}),
    t AS (SELECT doc_id, i, x, length(x) AS size, len(regexp_extract_all(x, '{reading.MARKS}')) AS marks, string_split_regex(x, '{reading.HALVES}') AS h, min(CASE WHEN x <> '' THEN i END) OVER (PARTITION BY doc_id) AS first, last_value(nullif(x, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT doc_id, i, regexp_replace(line, '^{SPACES}+|{SPACES}+$', '', 'g') AS x FROM l)),
    f AS (SELECT *, {_form("x")} AS form FROM t),
    m AS (SELECT *, coalesce(last_value(CASE form WHEN 'to_verse' THEN true WHEN 'to_prose' THEN false WHEN 'plain' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS verses FROM f),
    k AS (SELECT *, CASE WHEN form = 'clause' AND verses THEN 'verse' WHEN form IN ('to_prose', 'to_verse', 'clause', 'plain') THEN 'prose' ELSE form END AS kind FROM m),
    o AS (SELECT *, kind <> 'prose' OR form = 'to_prose' OR coalesce(lag(kind <> 'prose' OR form = 'to_verse') OVER (PARTITION BY doc_id ORDER BY i), true) AS opens FROM k WHERE kind <> 'blank'),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS segment FROM o)
    SELECT doc_id, segment::INT AS segment, kind, string_agg(x, '' ORDER BY i) AS text FROM s GROUP BY doc_id, segment, kind""",
)
def reading_layout(t, spark):
    lines = LAID(t, spark).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return reading.layout(lines, "doc_id", "at", "line")
