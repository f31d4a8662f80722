"""Queries of the service's other pages and of ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl, service
from ..sources import catalogs
from .base import Registry

R = Registry()


@R.add("chapter_languages", "SELECT turn, CASE WHEN bool_or(role = 'user') THEN 'user' ELSE min(role) END AS role FROM conversations GROUP BY turn")
def chapter_languages(t, spark):
    return service.chapters_in(t("conversations"), "turn", "role", "user")


@R.add("order_timeline", "SELECT (floor(year(o_orderdate) / 2) * 2)::BIGINT AS from_year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def order_timeline(t, spark):
    return service.timeline(t("orders"), F.year("o_orderdate"), 2)


@R.add("role_blocks", "WITH m AS (SELECT conv_id, turn, role = 'user' AS is_user, text, lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE text IS NOT NULL), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> is_user THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM m) SELECT conv_id, block::BIGINT AS block, is_user, string_agg(text, '' ORDER BY turn) AS text FROM g GROUP BY 1, 2, 3")
def role_blocks(t, spark):
    rows = t("conversations").filter("text IS NOT NULL").withColumn("is_user", F.col("role") == "user")
    return service.blocks(rows, "conv_id", "turn", "is_user", "text")


@R.add("split_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || p_brand), 'red1') OR (contains(lower(p_name || p_brand), 'r') AND contains(lower(p_name || p_brand), 'ed1')) OR (contains(lower(p_name || p_brand), 're') AND contains(lower(p_name || p_brand), 'd1')) OR (contains(lower(p_name || p_brand), 'red') AND contains(lower(p_name || p_brand), '1')) ORDER BY 1 LIMIT 30")
def split_search(t, spark):
    return service.split_search(t("part"), ["p_name", "p_brand"], "red1", "p_partkey").select("p_partkey")


@R.add("listed_order", "SELECT lang, n, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 999 ELSE 98 END AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def listed_order(t, spark):
    counts = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", service.listed_order(F.col("lang"), ["en", "fr"], 98, "es").cast("int")).orderBy("place")


@R.add("federated", "SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL AS balance, 'local' AS origin FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'remote' FROM supplier")
def federated(t, spark):
    a = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return service.federated({"local": a, "remote": b})


@R.add("source_descriptions", "SELECT s_suppkey, concat_ws(chr(10), CASE WHEN s_name <> '' THEN 'name: ' || s_name END, 'nation: ' || n_name) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def source_descriptions(t, spark):
    rows = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select("s_suppkey", service.source_text([("name", F.col("s_name")), ("nation", F.col("n_name"))]).alias("text"))


@R.add("cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def cascade_delete(t, spark):
    gone = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    _, lines = service.deleted(t("orders"), gone, ["o_orderkey"], t("lineitem"), "l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@R.add("view_counters", "SELECT c_custkey, c_nationkey::BIGINT + coalesce(n, 0) AS view_count FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) ON user_id = c_custkey")
def view_counters(t, spark):
    base = t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("view_count"))
    log = t("events").filter("event_type = 'view'").select(F.col("user_id").alias("c_custkey"))
    return service.views(base, log, "c_custkey")


@R.add("index_rows", "SELECT p_partkey, coalesce(s_name, 'main') AS source_code, p_size > 25 AS has_content, 'lzh' AS lang FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def index_rows(t, spark):
    texts = t("part").select("p_partkey", F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") > 25, True).alias("has_content"), F.lit(None).cast("string").alias("lang"))
    sources = t("supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_code"))
    return service.index_rows(texts, sources, "main").drop("source_id")


@R.add("menu_leaves", "SELECT 'R' || r_regionkey AS root, 'C' || c_custkey AS leaf FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_regionkey < 2 UNION SELECT 'R' || r_regionkey, 'N' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 2 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def menu_leaves(t, spark):
    a = t("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("p"), F.concat(F.lit("N"), "n_nationkey").alias("c"))
    b = t("customer").select(F.concat(F.lit("N"), "c_nationkey").alias("p"), F.concat(F.lit("C"), "c_custkey").alias("c"))
    return catalogs.menu_leaves(a.unionByName(b), "p", "c", ["R0", "R1"])


@R.add("generic_ingest", "SELECT 'parts-' || p_partkey AS text_id, p_name AS title, NULL AS translator, 'en' AS lang, p_type <> '' AS has_content, length(p_type)::INT AS content_char_count FROM part")
def generic_ingest(t, spark):
    texts, _, _ = catalogs.ingest(t("part"), "parts", {"uid": "p_partkey", "title": "p_name", "content": "p_type"}, "en")
    return texts


@R.add("domain_codes", "WITH h AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', ''), '[^a-z0-9]+', '-', 'g'), ''), 'source') AS b FROM pages) SELECT page_id, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS code FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id) AS k FROM h)")
def domain_codes(t, spark):
    return etl.domain_code(t("pages").select("page_id", "url"), "url", "page_id").select("page_id", "code")


@R.add("dated_timeline", "WITH d(name, a, b) AS (VALUES ('唐', 618, 907), ('隋', 581, 618), ('遼', 916, 1125)), n AS (SELECT c_custkey, c_nationkey, CASE c_nationkey % 5 WHEN 0 THEN '唐' WHEN 1 THEN '隋' WHEN 2 THEN '遼' ELSE c_mktsegment END AS dynasty FROM customer WHERE c_nationkey IN (0, 1, 2, 3, 4, 5, 6, 7)) SELECT c_custkey, c_nationkey, dynasty, a::INT AS first_year, b::INT AS last_year, (SELECT count(*) FROM n) AS total FROM n LEFT JOIN d ON d.name = n.dynasty ORDER BY first_year NULLS LAST, c_custkey LIMIT 20 OFFSET 20")
def dated_timeline(t, spark):
    era = F.col("c_nationkey") % 5
    dynasty = F.when(era == 0, "唐").when(era == 1, "隋").when(era == 2, "遼").otherwise(F.col("c_mktsegment"))
    rows = t("customer").select("c_custkey", "c_nationkey", dynasty.alias("dynasty"))
    return service.dated_timeline(rows, "c_custkey", "dynasty", {"c_nationkey": list(range(8)), "dynasty": None}, 2, 20)


@R.add(
    "canonical_parallels",
    """WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS source, CASE WHEN l_linestatus = 'O' THEN 'parallel' ELSE 'mention' END AS relation_type, CASE WHEN l_orderkey % 3 = 0 THEN 'n' || l_linenumber END AS note FROM lineitem),
    e AS (SELECT CASE WHEN a = 3 THEN b ELSE a END AS related_id, relation_type, note FROM r WHERE source = 'R' AND (a = 3 OR b = 3)),
    x AS (SELECT e.related_id, p.p_brand AS code, coalesce(p.p_type, p.p_name, '') AS title, CASE WHEN p.p_size % 2 = 0 THEN 'pi' ELSE 'lzh' END AS lang, e.relation_type, e.note, d.text FROM e JOIN part p ON p.p_partkey = e.related_id LEFT JOIN documents d ON d.doc_id = e.related_id)
    SELECT related_id, code, title, lang, relation_type, note, CASE WHEN lang = 'pi' THEN nullif(left(text, 240), '') END AS own_preview, CASE WHEN lang = 'pi' THEN nullif(substr(text, 11, 240), '') END AS english_preview, (SELECT count(*) FROM x) AS total FROM x""",
)
def canonical_parallels(t, spark):
    kind = F.when(F.col("l_linestatus") == "O", "parallel").otherwise("mention")
    relations = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("source"), kind.alias("relation_type"), F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))).alias("note"))
    none = F.lit(None).cast("string")
    texts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code"), none.alias("title_pi"), F.col("p_type").alias("title_sa"), none.alias("title_en"), F.col("p_name").alias("title_zh"), F.when(F.col("p_size") % 2 == 0, "pi").otherwise("lzh").alias("lang"))
    contents = t("documents").select(F.col("doc_id").alias("text_id"), F.lit(1).alias("chapter"), F.lit("pi").alias("lang"), F.col("text").alias("content"))
    pieces = F.explode(F.array(F.struct(F.lit(1).alias("chunk"), F.col("text").alias("chunk_text")), F.struct(F.lit(0).alias("chunk"), F.expr("substring(text, 11)").alias("chunk_text"))))
    chunks = t("documents").select(F.col("doc_id").alias("text_id"), F.lit(1).alias("chapter"), pieces.alias("p")).select("text_id", "chapter", "p.*")
    out = service.canonical_parallels(relations, texts, contents, chunks, 3, "R")
    return out.select("related_id", "code", "title", "lang", "relation_type", "note", "own_preview", "english_preview", "total")
