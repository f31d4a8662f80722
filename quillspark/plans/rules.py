"""Graph paths, name rules and reader rules over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..operators import etl, graph, rag, ranking, search, service, stats, vector
from ..sources import tei
from .base import Registry
from .derived import Input

R = Registry()

PLACES = Input("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'school' ELSE 'person' END AS kind, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN '{{\"latitude\": ' || CAST(c_nationkey AS STRING) || ', \"longitude\": ' || CAST(100 + c_custkey % 30 AS STRING) || CASE WHEN c_custkey % 5 > 0 THEN ', \"year_start\": ' || CAST(300 + c_custkey % 700 AS STRING) ELSE '' END || '}}' END AS properties FROM {customer}", "customer")
ARCS = Input("SELECT o_orderkey AS id, o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'teacher_of' WHEN 1 THEN 'member_of' ELSE 'active_at' END AS predicate, (o_custkey * 31 + o_orderkey) % 1500 AS object, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM {orders}", "orders")
LOCATED = f"(SELECT id, name, kind, TRY_CAST(properties->>'latitude' AS DOUBLE) AS lat, TRY_CAST(properties->>'longitude' AS DOUBLE) AS lng, TRY_CAST(properties->>'year_start' AS DOUBLE) AS year FROM {PLACES})"


@R.add(
    "lineage_arcs",
    f"""WITH e AS {LOCATED}, l AS (SELECT * FROM e WHERE lat IS NOT NULL AND lng IS NOT NULL), m AS (SELECT subject, object, row_number() OVER (PARTITION BY subject ORDER BY id) AS k FROM {ARCS} WHERE predicate = 'member_of')
    SELECT a.id AS arc, a.subject AS teacher_id, a.object AS student_id, s.name AS school, coalesce(t.year, u.year) AS year FROM {ARCS} a JOIN l t ON t.id = a.subject JOIN l u ON u.id = a.object LEFT JOIN m ON m.subject = a.subject AND m.k = 1 LEFT JOIN e s ON s.id = m.object
    WHERE a.predicate = 'teacher_of' ORDER BY year NULLS LAST, arc LIMIT 1000""",
)
def lineage_arcs(t, spark):
    return graph.lineage(ARCS(t, spark), PLACES(t, spark)).withColumn("year", F.col("year").cast("double"))


@R.add("two_edge_places", f"WITH r AS {ARCS} SELECT node, place FROM (SELECT a.subject AS node, b.object AS place, row_number() OVER (PARTITION BY a.subject ORDER BY least(a.confidence, b.confidence) DESC, b.object) AS k FROM r a JOIN r b ON b.subject = a.object WHERE a.predicate = 'teacher_of' AND b.predicate = 'active_at') WHERE k = 1")
def two_edge_places(t, spark):
    return graph.via(ARCS(t, spark), "teacher_of", "active_at")


@R.add(
    "propagated_places",
    f"""WITH e AS {LOCATED}, b AS (SELECT a.subject, l.lat, l.lng, a.object, row_number() OVER (PARTITION BY a.subject ORDER BY confidence DESC, a.object) AS k FROM {ARCS} a JOIN e l ON l.id = a.object WHERE predicate = 'active_at' AND l.lat IS NOT NULL AND l.lng IS NOT NULL)
    SELECT e.id, kind, name, coalesce(e.lat, b.lat) AS lat, coalesce(e.lng, b.lng) AS lng, CASE WHEN (e.lat IS NULL OR e.lng IS NULL) AND b.lat IS NOT NULL THEN 'active_at:' || b.object END AS geo_source FROM e LEFT JOIN b ON b.subject = e.id AND b.k = 1""",
)
def propagated_places(t, spark):
    return graph.propagate(PLACES(t, spark), ARCS(t, spark), "active_at", "active_at").select("id", "kind", "name", "lat", "lng", "geo_source")


NEW = Input("SELECT c_custkey AS id, ' N ' || CAST(c_nationkey AS STRING) || '寺 ' AS name, CAST(c_custkey % 60 AS DOUBLE) / 100 AS lat, CAST(c_nationkey AS DOUBLE) AS lng, CASE WHEN c_custkey % 7 = 0 THEN 'Q' || CAST(c_custkey % 300 AS STRING) END AS external_id FROM {customer}", "customer")
OLD = Input("SELECT s_suppkey AS id, 'N' || CAST(s_nationkey AS STRING) || '寺' AS name, CASE WHEN s_suppkey % 31 > 0 THEN CAST(s_suppkey % 60 AS DOUBLE) / 100 END AS lat, CAST(s_nationkey AS DOUBLE) AS lng, CASE WHEN s_suppkey % 2 = 0 THEN 'Q' || CAST(s_suppkey AS STRING) END AS external_id FROM {supplier}", "supplier")


@R.add(
    "new_places",
    f"""WITH n AS (SELECT *, replace(trim(name), ' ', '') AS p FROM {NEW}), o AS (SELECT *, replace(trim(name), ' ', '') AS p FROM {OLD}),
    near AS (SELECT n.id FROM n JOIN o USING (p) WHERE o.lat IS NULL OR o.lng IS NULL OR 2 * 6371 * asin(sqrt(pow(sin(radians(o.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lng - n.lng) / 2), 2))) < 2)
    SELECT id, name, lat, lng, external_id FROM n WHERE id NOT IN (SELECT id FROM near) AND (external_id IS NULL OR external_id NOT IN (SELECT external_id FROM o WHERE external_id IS NOT NULL))""",
)
def new_places(t, spark):
    return graph.nearby_known(NEW(t, spark), OLD(t, spark)).select("id", "name", "lat", "lng", "external_id")


CANDIDATES = Input("SELECT o_orderkey AS id, o_custkey AS who, o_orderkey % 5 = 0 AS exact, CASE WHEN o_orderkey % 2 = 0 THEN 500 END AS birth, CASE WHEN o_orderkey % 3 = 0 THEN 600 END AS death, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS note, CAST(o_orderkey % 4 AS INT) AS aliases FROM {orders}", "orders")


@R.add("richest_candidates", f"SELECT who, id FROM (SELECT who, id, row_number() OVER (PARTITION BY who ORDER BY exact DESC, (birth IS NOT NULL)::INT + (death IS NOT NULL)::INT + least(coalesce(length(note), 0), 200) + aliases DESC, id) AS k FROM {CANDIDATES}) WHERE k = 1")
def richest_candidates(t, spark):
    return etl.richest(CANDIDATES(t, spark), "who", F.col("exact"), F.col("birth"), F.col("death"), F.col("note"), F.col("aliases"), "id").select("who", "id")


CHAPTERS = Input("SELECT source AS work, doc_id % 7 AS juan, lang, min(text) AS content FROM {documents} GROUP BY source, doc_id % 7, lang", "documents")


@R.add("chapter_pair", f"WITH c AS (SELECT work, content, row_number() OVER (PARTITION BY work ORDER BY lang = 'fr' DESC, lang) AS k FROM {CHAPTERS} WHERE juan = 3) SELECT (SELECT content FROM c WHERE work = 'src1' AND k = 1) AS \"left\", (SELECT content FROM c WHERE work = 'src2' AND k = 1) AS \"right\"")
def chapter_pair(t, spark):
    return service.parallel_reading(CHAPTERS(t, spark), "work", "juan", "lang", "src1", "src2", 3, "fr")


@R.add("model_rerank", "SELECT doc_id, round(0.4 * (n_chars % 100) / 100 + 0.6 * CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10 ELSE 0 END, 6) AS score FROM documents")
def model_rerank(t, spark):
    judged = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10)
    return t("documents").select("doc_id", F.round(rag.model_score((F.col("n_chars") % 100) / 100, judged), 6).alias("score"))


TITLES = Input("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN p_name || '疏' WHEN 1 THEN '大方廣' || p_name WHEN 2 THEN p_name || '經' WHEN 3 THEN p_name || p_brand || '疏' WHEN 4 THEN p_brand || '疏' ELSE p_name || p_brand || '論' END AS title FROM {part}", "part")


@R.add(
    "commentary_links",
    f"""WITH x AS {TITLES}, b AS (SELECT id AS subject, regexp_extract(title, '^(.+?)(義疏|疏)$', 1) AS base FROM x WHERE regexp_matches(title, '^(.+?)(義疏|疏)$')), w AS (SELECT title AS name, max(id) AS object FROM x GROUP BY 1),
    t AS (SELECT subject, 0 AS turn, base AS name, 0.8 AS c FROM b UNION ALL SELECT subject, 2, '大方廣' || base, 0.6 FROM b UNION ALL SELECT subject, 3, base || '經', 0.6 FROM b UNION ALL SELECT subject, 4, '妙法' || base, 0.6 FROM b),
    n AS (SELECT subject, object, c, row_number() OVER (PARTITION BY subject ORDER BY turn) AS k FROM t JOIN w USING (name) WHERE subject <> object),
    h AS (SELECT b.subject, min(w.object) AS object FROM b JOIN w ON contains(w.name, b.base) AND w.object <> b.subject WHERE b.subject NOT IN (SELECT subject FROM n) GROUP BY b.subject HAVING count(*) = 1)
    SELECT subject, object, c::DOUBLE AS confidence FROM n WHERE k = 1 UNION ALL SELECT subject, object, 0.5 FROM h""",
)
def commentary_links(t, spark):
    return graph.commentaries(TITLES(t, spark), "id", "title", ["疏", "義疏"], {})


COLOPHONS = Input("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '唐玄奘於大慈恩寺奉詔譯' WHEN 1 THEN '沙門於白馬寺譯。又於大興善寺譯' WHEN 2 THEN '於長安譯' WHEN 3 THEN '於某寺。譯' ELSE p_name END AS note FROM {part}", "part")


@R.add("translation_sites", f"SELECT DISTINCT id, site FROM (SELECT id, unnest(regexp_extract_all(note, '於([\\x{{4E00}}-\\x{{9FFF}}]{{1,8}}?寺)[^。]{{0,6}}?譯', 1)) AS site FROM {COLOPHONS}) WHERE site IN ('大慈恩寺', '大興善寺')")
def translation_sites(t, spark):
    return graph.sites(COLOPHONS(t, spark), "id", "note", ["大慈恩寺", "大興善寺"])


NAMED = Input("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN '後秦　鳩摩羅什' WHEN 1 THEN ' 唐 玄 奘 ' WHEN 2 THEN '원효' WHEN 3 THEN 'ひらがな' WHEN 4 THEN p_name ELSE '' END AS who, CASE p_size % 4 WHEN 0 THEN 'T' || lpad(CAST(p_size AS STRING), 2, '0') || 'n' || lpad(CAST(p_partkey AS STRING), 6, '0') WHEN 1 THEN 'X0' || CAST(p_partkey AS STRING) WHEN 2 THEN 'ZW' || CAST(p_size AS STRING) ELSE 'toh' || CAST(p_partkey AS STRING) || '.xml' END AS work, CASE WHEN p_size % 3 = 0 THEN ' (' || p_type || ') ' || p_name WHEN p_size % 3 = 1 THEN '（' || p_brand || '）x' ELSE p_name END AS definition FROM {part}", "part")


@R.add(
    "name_rules",
    f"""SELECT id, string_split_regex(trim(regexp_replace(trim(who), '^(後秦|唐)[ 　]+', '')), '[ 　]+')[-1] AS bare, regexp_replace(trim(who), '[ 　]', '', 'g') AS plain, regexp_matches(who, '[一-鿿぀-ヿ]') AND NOT regexp_matches(who, '[가-힯]') AS chinese,
    CASE WHEN work[1:2] = 'ZW' THEN '藏外佛教文獻' WHEN work[1] = 'T' THEN '大正藏' WHEN work[1] = 'X' THEN '卍新纂續藏經' END AS collection,
    CASE WHEN work[1] IN ('T', 'X') AND regexp_extract(regexp_replace(work, '^[A-Z]+[0-9]*n', 'n'), '^[A-Zn]+0*([0-9]+)', 1) <> '' THEN work[1] || regexp_extract(regexp_replace(work, '^[A-Z]+[0-9]*n', 'n'), '^[A-Zn]+0*([0-9]+)', 1) WHEN work[1:2] = 'ZW' THEN 'ZW' || regexp_extract(work, '^ZW0*([0-9]+)', 1) END AS number,
    nullif(regexp_extract(work, 'toh([0-9]+)', 1), '') AS toh, nullif(regexp_extract(definition, '^\\s*[(（]([^)）]*)[)）]', 1), '') AS reading, md5(who || '|' || work) AS cache_key FROM {NAMED}""",
)
def name_rules(t, spark):
    c = F.col
    return NAMED(t, spark).select(
        "id", names.bare_translator(c("who")).alias("bare"), names.plain_name(c("who")).alias("plain"), names.is_chinese_name(c("who")).alias("chinese"), names.collection(c("work")).alias("collection"),
        names.work_number(c("work")).alias("number"), names.toh_number(c("work")).alias("toh"), names.reading(c("definition")).alias("reading"), names.cache_key(c("who"), c("work")).alias("cache_key"),
    )


ENDS = "。！？；.!?"


@R.add("snapped_chunks", f"WITH c AS (SELECT doc_id, substr(text, 11, 500) AS x FROM documents), r AS (SELECT doc_id, x, regexp_replace(x, '(?s)^[^{ENDS}]*[{ENDS}]\\s*', '') AS rest, regexp_extract(x, '(?s)^(.*[{ENDS}])', 1) AS head FROM c) SELECT doc_id, CASE WHEN length(rest) > 20 AND rest <> x THEN rest ELSE x END AS from_sentence, CASE WHEN length(head) > 20 THEN head ELSE x END AS to_sentence FROM r")
def snapped_chunks(t, spark):
    x = F.substring("text", 11, 500)
    return t("documents").select("doc_id", T.snap_head(x).alias("from_sentence"), T.snap_tail(x).alias("to_sentence"))


@R.add("year_slices", "WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 5 > 0 THEN min(year(o_orderdate)) END AS a, CASE WHEN o_custkey % 3 > 0 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY 1) SELECT o_custkey, coalesce(1995 BETWEEN coalesce(a, b) AND coalesce(b, a), true) AS shown FROM s")
def year_slices(t, spark):
    spans = t("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("_a"), F.max(F.year("o_orderdate")).alias("_b"))
    spans = spans.select("o_custkey", F.when(F.col("o_custkey") % 5 > 0, F.col("_a")).alias("a"), F.when(F.col("o_custkey") % 3 > 0, F.col("_b")).alias("b"))
    return spans.select("o_custkey", graph.in_year_slice(F.col("a"), F.col("b"), 1995).alias("shown"))


@R.add("timeline_lines", "SELECT o_orderkey, ((row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) - 1) % 12)::INT AS line FROM orders WHERE o_orderdate IS NOT NULL")
def timeline_lines(t, spark):
    rows = t("orders").filter("o_orderdate IS NOT NULL").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return service.timeline_rows(rows, "y", "o_orderkey", 12).select("o_orderkey", "line")


@R.add("patched_rows", "SELECT c_custkey, CASE WHEN s_name IS NOT NULL THEN s_name ELSE c_name END AS c_name, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def patched_rows(t, spark):
    patch = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("c_acctbal"))
    return etl.patched(t("customer").select("c_custkey", "c_name", "c_acctbal"), patch, "c_custkey", ["c_name", "c_acctbal"])


GLYPHS = Input("SELECT 'CB' || CAST(p_partkey AS STRING) AS id, CASE p_size % 4 WHEN 0 THEN chr(57344 + p_size) WHEN 1 THEN '法' WHEN 2 THEN '' END AS uni_char, CASE WHEN p_size % 3 = 0 THEN p_brand END AS norm_uni_char, CASE WHEN p_size % 5 = 0 THEN '佛' ELSE '' END AS norm_big5_char, CASE WHEN p_size % 2 = 0 THEN '[' || p_name || ']' END AS composition FROM {part}", "part")


@R.add("rare_glyphs", f"SELECT * FROM (SELECT id, coalesce(CASE WHEN uni_char = '法' THEN '法' END, nullif(norm_uni_char, ''), nullif(norm_big5_char, ''), nullif(composition, '')) AS glyph FROM {GLYPHS}) WHERE glyph IS NOT NULL".replace("chr(57344 + p_size)", "chr((57344 + p_size)::INT)"))
def rare_glyphs(t, spark):
    rows = GLYPHS(t, spark).withColumn("uni_char", F.when(F.col("uni_char").isin("法", "") | F.col("uni_char").isNull(), F.col("uni_char")).otherwise(F.lit("\ue005")))
    return tei.rare_glyphs(rows)


PEOPLE = Input("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Z' || CAST(c_custkey % 77 AS STRING) ELSE '' END AS zh, 'E' || CAST(c_custkey % 150 AS STRING) AS en, CASE WHEN c_custkey % 3 > 0 THEN 'S' || CAST(c_nationkey AS STRING) END AS sa FROM {customer}", "customer")
KNOWN = Input("SELECT s_suppkey AS oid, 'Z' || CAST(s_suppkey AS STRING) AS ozh, CASE WHEN s_suppkey % 2 = 0 THEN 'E' || CAST(s_suppkey AS STRING) END AS oen, 'S' || CAST(s_nationkey AS STRING) AS osa FROM {supplier}", "supplier")


@R.add("name_cascade", f"WITH z AS (SELECT ozh, min(oid) AS m FROM {KNOWN} GROUP BY 1), e AS (SELECT oen, min(oid) AS m FROM {KNOWN} GROUP BY 1), s AS (SELECT osa, min(oid) AS m FROM {KNOWN} GROUP BY 1) SELECT id, coalesce(z.m, e.m, s.m) AS match_id FROM {PEOPLE} LEFT JOIN z ON ozh = zh LEFT JOIN e ON oen = en LEFT JOIN s ON osa = sa")
def name_cascade(t, spark):
    return etl.resolve(PEOPLE(t, spark), KNOWN(t, spark), [("zh", "ozh"), ("en", "oen"), ("sa", "osa")], "oid").select("id", "match_id")


@R.add("entity_page", f"WITH e AS (SELECT id, name FROM {PLACES} WHERE id IN (SELECT subject FROM {ARCS} UNION SELECT object FROM {ARCS})) SELECT id, name, (SELECT count(*) FROM e) AS total FROM e ORDER BY name, id LIMIT 50 OFFSET 50")
def entity_page(t, spark):
    found = graph.with_relations(PLACES(t, spark), ARCS(t, spark)).select("id", "name")
    return search.totalled(found, ["name", "id"], 2, 50)


@R.add("language_coverage", "WITH l AS (SELECT s_suppkey, lang FROM supplier, (SELECT DISTINCT lang FROM documents)), d AS (SELECT doc_id % 150 AS k, lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS f FROM documents GROUP BY 1, 2) SELECT coalesce(s_suppkey, k) AS source, coalesce(l.lang, d.lang) AS lang, coalesce(n, 0)::BIGINT AS n_items, coalesce(f, 0)::BIGINT AS n_full, s_suppkey IS NULL AS orphan FROM l FULL JOIN d ON k = s_suppkey AND d.lang = l.lang")
def language_coverage(t, spark):
    items = t("documents").withColumn("source", F.col("doc_id") % 150)
    return stats.coverage_by(t("supplier").select(F.col("s_suppkey").alias("source")), items, "source", "lang", F.col("n_chars") > 1000)


@R.add("most_read", "SELECT p_partkey, p_name, count(*) AS n FROM events JOIN part ON p_partkey = user_id % 400 WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1, 2 ORDER BY n DESC, p_partkey LIMIT 10")
def most_read(t, spark):
    log = t("events").withColumn("p_partkey", F.col("user_id") % 400)
    return stats.most_read(log, t("part").select("p_partkey", "p_name"), "p_partkey", "ts", F.col("event_type") == "view", 30, 10)


@R.add("same_title_classes", "SELECT a.p_partkey AS key, min(b.p_partkey) AS class_key, count(*) AS n_texts, count(*) FILTER (a.p_partkey <> b.p_partkey AND (nullif(a.w, '') IS NULL OR nullif(b.w, '') IS NULL OR a.w <> b.w)) AS n_links FROM (SELECT *, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '' END AS w FROM part) a JOIN (SELECT *, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '' END AS w FROM part) b ON a.p_name = b.p_name GROUP BY 1")
def same_title_classes(t, spark):
    rows = t("part").withColumn("w", F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(""))
    return etl.same_title_classes(rows, "p_partkey", "p_name", "w")


@R.add("resolved_texts", "SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_name ILIKE '%O_ B%' AND p_partkey IN (SELECT l_partkey FROM lineitem) ORDER BY p_partkey LIMIT 2000")
def resolved_texts(t, spark):
    return etl.resolve_texts(t("part"), t("lineitem"), "p_partkey", "l_partkey", {"p_type": "SMALL"}, {"p_name": "%O_ B%"}).select("p_partkey")


@R.add("manifest_rows", "WITH m AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'n' || (l_partkey % 300) END AS number, 'url/' || l_orderkey AS manifest FROM lineitem), x AS (SELECT s_suppkey AS text, 'n' || s_suppkey AS number FROM supplier) SELECT text, 'iiif' AS source, min(manifest) AS manifest FROM m JOIN x USING (number) WHERE number <> '' AND text % 5 <> 0 GROUP BY text")
def manifest_rows(t, spark):
    manifests = t("lineitem").select(F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("l_partkey") % 300).cast("string"))).alias("number"), F.concat(F.lit("url/"), F.col("l_orderkey").cast("string")).alias("manifest"))
    texts = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("number"))
    old = t("supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("text"), F.lit("iiif").alias("source"))
    return etl.manifest_rows(manifests, texts, "number", old, "iiif")


SHOWN = Input("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'school' WHEN 2 THEN 'dynasty' WHEN 3 THEN 'place' ELSE 'text' END AS kind, p_name AS name, CASE WHEN p_size % 7 = 0 THEN '{{\"is_hidden\": true}}' ELSE '{{}}' END AS properties FROM {part}", "part")


@R.add("entity_search", f"WITH h AS (SELECT id, kind, CASE WHEN lower(name) IN ('hot', 'hot rod') THEN 0 WHEN starts_with(lower(name), 'hot') OR starts_with(lower(name), 'hot rod') THEN 1 ELSE 2 END AS relevance FROM {SHOWN} WHERE (contains(lower(name), 'hot') OR contains(lower(name), 'hot rod')) AND properties NOT LIKE '%true%' AND id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 UNION SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7)) SELECT id, kind, relevance, (SELECT count(*) FROM h) AS total FROM h ORDER BY relevance, CASE kind WHEN 'person' THEN 0 WHEN 'school' THEN 1 WHEN 'dynasty' THEN 2 ELSE 3 END, id LIMIT 20 OFFSET 20")
def entity_search(t, spark):
    ends = t("lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"))
    found = search.search_entities(SHOWN(t, spark), ends, ["hot", "hot rod"], related=True, number=2)
    return found.select("id", "kind", "relevance", "total")


@R.add("sampled_questions", "WITH s AS (SELECT conv_id * 1000 + turn AS id, role, md5('week 3|' || (conv_id * 1000 + turn)) AS d FROM conversations WHERE text IS NOT NULL), n AS (SELECT * FROM s ORDER BY d, id LIMIT 24) SELECT id, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY d, id) AS k FROM n) ORDER BY k, role LIMIT 8")
def sampled_questions(t, spark):
    rows = t("conversations").filter("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return ranking.sampled_round_robin(rows, "role", "id", "week 3")


@R.add("scoped_chunks", "SELECT vec_id, 'scope' AS how FROM embeddings WHERE vec_id // 5 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT vec_id, 'empty' FROM embeddings")
def scoped_chunks(t, spark):
    chunks = t("embeddings").select("vec_id", F.expr("vec_id div 5").alias("text"))
    scope = t("supplier").filter("s_acctbal < 0").select("s_suppkey")
    part = lambda s, how: vector.in_scope(chunks, "text", s).select("vec_id", F.lit(how).alias("how"))
    return part(scope, "scope").unionByName(part(scope.limit(0), "empty"))


@R.add("federated_search", "WITH h AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 'local' AS origin FROM nation UNION ALL SELECT s_suppkey, s_name, 'remote' FROM supplier) SELECT *, (SELECT count(*) FROM h) AS total FROM h")
def federated_search(t, spark):
    """Of three engines one fails while it is read."""
    local = lambda: t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    remote = lambda: t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    broken = lambda: t("region").select(F.raise_error(F.lit("no answer")).cast("long").alias("id"), F.col("r_name").alias("name"))
    return service.federated_search({"local": local, "broken": broken, "remote": remote})[0]


@R.add("feed_summary", "WITH e AS (SELECT event_id AS id, ts, user_id FROM events WHERE event_type = 'view'), f AS (SELECT event_id AS id, ts FROM events WHERE event_type <> 'view') SELECT (SELECT string_agg(id, ',' ORDER BY ts DESC, id DESC) FROM (SELECT * FROM e ORDER BY ts DESC, id DESC LIMIT 5)) AS newest_updates, (SELECT count(*) FROM e WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) AS n_updates, (SELECT count(DISTINCT user_id) FROM e WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) AS n_sources, (SELECT string_agg(id, ',' ORDER BY ts DESC, id DESC) FROM (SELECT * FROM f ORDER BY ts DESC, id DESC LIMIT 5)) AS newest_feeds, (SELECT count(*) FROM f WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) AS n_feeds")
def feed_summary(t, spark):
    events = t("events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    return stats.feed_summary(events.filter("event_type = 'view'"), events.filter("event_type <> 'view'"), "ts", "user_id", "id", "2024-01-31 00:00:00")
