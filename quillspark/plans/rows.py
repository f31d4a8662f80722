"""Ranking, paging, joins and ingestion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl, ranking, rag
from .base import Registry, values

R = Registry()


@R.add("latest_event_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event_per_user(t, spark):
    return etl.latest(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@R.add("offset_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def offset_page(t, spark):
    return ranking.page(t("customer").select("c_custkey", "c_acctbal"), [F.desc_nulls_last("c_acctbal"), "c_custkey"], 3, 20)


@R.add("newest_page_in_order", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30) ORDER BY ts, event_id")
def newest_page_in_order(t, spark):
    return ranking.newest_page_in_order(t("events").select("event_id", "ts"), "ts", "event_id", 30).select("event_id")


@R.add("capped_groups", "SELECT p_brand, p_partkey, total FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE k <= 3")
def capped_groups(t, spark):
    return ranking.capped_groups(t("part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "total")


@R.add("prev_next", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next(t, spark):
    return ranking.neighbours(t("conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn")


@R.add("adjacent_chapter", "SELECT max(p_size) FILTER (p_size < 10) AS previous, min(p_size) FILTER (p_size > 10) AS next FROM part")
def adjacent_chapter(t, spark):
    return ranking.adjacent(t("part"), "p_size", 10)


@R.add("chunk_context", "WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) SELECT c.conv_id, c.turn, c.turn = 2 AS is_center, false AS has_more_before, m.m > 4 AS has_more_after FROM conversations c JOIN m USING (conv_id) WHERE c.turn BETWEEN 0 AND 4 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 2)")
def chunk_context(t, spark):
    c = t("conversations").select("conv_id", "turn")
    return ranking.around(c, ["conv_id"], "turn", c.filter("turn = 2"), 2)


@R.add("round_robin", "SELECT s_suppkey FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) ORDER BY k, s_nationkey LIMIT 8")
def round_robin(t, spark):
    return ranking.round_robin(t("supplier"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"], 8).select("s_suppkey")


@R.add("recent_history", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k <= 2")
def recent_history(t, spark):
    return ranking.recent_list(t("events"), "user_id", "event_type", "ts", 2).select("user_id", "event_type")


@R.add("export_batches", "SELECT (floor((k - 1) / 400))::BIGINT AS batch, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS n_rows FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) GROUP BY 1")
def export_batches(t, spark):
    return ranking.with_batches(t("part"), "p_partkey", 400)


@R.add("insert_ignore", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def insert_ignore(t, spark):
    old = t("orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return etl.insert_ignore(old, t("customer").select("c_custkey"), ["c_custkey"], ["c_custkey"])


@R.add("dense_ids_wide", "SELECT o_orderkey, repeat(o_orderpriority, 100) AS wide, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def dense_ids_wide(t, spark):
    """A wide column beside the key: what is counted and what is numbered must be the same parts."""
    rows = t("orders").select("o_orderkey", F.repeat("o_orderpriority", 100).alias("wide"))
    return etl.with_dense_ids(rows, "o_orderkey", "id")


@R.add("dense_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def dense_ids(t, spark):
    return etl.with_dense_ids(t("orders").select("o_orderkey"), "o_orderkey", "id")


@R.add("numbered_ids", "SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS external_id FROM (SELECT p_partkey, 'd-' || p_name AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def numbered_ids(t, spark):
    return etl.numbered_ids(t("part").select("p_partkey", "p_name"), F.concat(F.lit("d-"), "p_name"), ["p_partkey"]).select("p_partkey", "external_id")


@R.add("content_rollup", "SELECT o_orderkey, n IS NOT NULL AS has_content, coalesce(n, 0)::BIGINT AS content_char_count FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def content_rollup(t, spark):
    parts = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return etl.roll_up(t("orders").select("o_orderkey"), parts, "o_orderkey", "l_linenumber")


@R.add("unique_title_match", "WITH n AS (SELECT p_partkey, p_brand || p_size || left(p_name, 3) AS name FROM part) SELECT n.p_partkey, m.match_id FROM n JOIN (SELECT name, min(p_partkey) AS match_id FROM n GROUP BY 1 HAVING count(*) = 1) m USING (name)")
def unique_title_match(t, spark):
    p = t("part").select("p_partkey", F.concat("p_brand", F.col("p_size").cast("string"), F.substring("p_name", 1, 3)).alias("name"))
    return etl.unique_matches(p, p, "name", "name", "p_partkey").select("p_partkey", "match_id")


@R.add("contained_name", "SELECT doc_id, matched, priority FROM (SELECT i.item_id AS doc_id, w.n AS matched, w.p AS priority, row_number() OVER (PARTITION BY i.item_id ORDER BY w.p, length(w.n) DESC, w.n) AS k FROM benchmark i JOIN (VALUES ('the', 2), ('tion', 1), ('er', 2), ('ing', 1), ('zzz', 1)) w(n, p) ON contains(i.text, w.n)) WHERE k = 1")
def contained_name(t, spark):
    words = values(spark, "('the', 2), ('tion', 1), ('er', 2), ('ing', 1), ('zzz', 1)", "n, p")
    return etl.longest_contained(t("benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text", words, "n", "p")


@R.add("range_overlap_join", "SELECT id, range_id FROM (SELECT p.p_partkey AS id, r.range_id, row_number() OVER (PARTITION BY p.p_partkey ORDER BY (p.p_size = r.a AND p.p_size + 3 = r.b) DESC, r.a, r.b, r.range_id) AS k FROM part p JOIN (VALUES (1, 1, 10), (2, 5, 8), (3, 20, 23), (4, 30, 60)) r(range_id, a, b) ON p.p_size <= r.b AND p.p_size + 3 >= r.a) WHERE k = 1")
def range_overlap_join(t, spark):
    ranges = values(spark, "(1, 1, 10), (2, 5, 8), (3, 20, 23), (4, 30, 60)", "range_id, r_start, r_end").withColumn("prefix", F.lit("an"))
    items = t("part").select(F.col("p_partkey").alias("id"), F.lit("an").alias("prefix"), F.col("p_size").alias("start"), (F.col("p_size") + 3).alias("end"))
    return etl.range_matches(items, ranges, "prefix", 10).select("id", "range_id")


@R.add("same_title_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b, 0.9::DOUBLE AS confidence FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand")
def same_title_pairs(t, spark):
    return etl.same_title_pairs(t("part"), "p_partkey", "p_name", "p_brand")


@R.add("two_signal_classifier", "SELECT c_custkey, CASE WHEN c_mktsegment SIMILAR TO '.*(AUTO|BUILD).*' THEN 'keep' WHEN c_mktsegment SIMILAR TO '.*(MACH|FURN).*' THEN 'delete' ELSE 'keep' END AS verdict FROM customer")
def two_signal_classifier(t, spark):
    return etl.two_signals(t("customer"), F.col("c_mktsegment"), "AUTO|BUILD", "MACH|FURN").select("c_custkey", "verdict")


@R.add("rule_deletes", "WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'building' END AS rule FROM customer) SELECT rule, count(*) AS n FROM m WHERE rule IS NOT NULL AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') GROUP BY 1")
def rule_deletes(t, spark):
    rules = [("debt", F.col("c_acctbal") < 0), ("building", F.col("c_mktsegment") == "BUILDING")]
    return etl.rule_deletes(t("customer"), "c_custkey", rules, t("orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))[1]


@R.add("table_differences", "SELECT * FROM (SELECT coalesce(a.s_suppkey, b.k) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s_nationkey IS DISTINCT FROM b.n THEN 'changed' END AS change FROM supplier a FULL JOIN (SELECT s_suppkey + 5 AS k, s_nationkey AS n FROM supplier) b ON a.s_suppkey = b.k) WHERE change IS NOT NULL")
def table_differences(t, spark):
    old = t("supplier").select("s_suppkey", "s_nationkey")
    return etl.differences(old, old.withColumn("s_suppkey", F.col("s_suppkey") + 5), "s_suppkey")


@R.add("year_overlap", "SELECT o_custkey, min(year(o_orderdate))::INT AS y0, max(year(o_orderdate))::INT AS y1 FROM orders GROUP BY 1 HAVING max(year(o_orderdate)) >= 1996 AND min(year(o_orderdate)) <= 1997")
def year_overlap(t, spark):
    from ..operators.graph import years_overlap

    spans = t("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    return spans.filter(years_overlap(F.col("y0"), F.col("y1"), 1996, 1997))


@R.add("token_budget", "SELECT conv_id, turn, tokens FROM (SELECT conv_id, turn, greatest(1, floor(length(text) * 2 / 3))::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, sum(greatest(1, floor(length(text) * 2 / 3))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE n <= 10 AND s <= 300")
def token_budget(t, spark):
    return rag.within_token_budget(t("conversations"), "conv_id", "turn", "text", 300, 10).select("conv_id", "turn", "tokens")


@R.add("chunk_text", "SELECT doc_id, (i // 450)::INT AS chunk, substr(text, i + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS i FROM documents WHERE length(text) > 0)")
def chunk_text(t, spark):
    return t("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "piece"))


@R.add("chunk_overlap_stitch", "WITH c AS (SELECT doc_id, (i // 450)::INT AS chunk, substr(text, i + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS i FROM documents WHERE length(text) > 0)), p AS (SELECT *, lag(piece) OVER (PARTITION BY doc_id ORDER BY chunk) AS q FROM c) SELECT doc_id, chunk, CASE WHEN q IS NOT NULL AND length(q) >= 50 AND starts_with(piece, right(q, 50)) THEN substr(piece, 51) ELSE piece END AS piece FROM p")
def chunk_overlap_stitch(t, spark):
    from pyspark.sql import Window

    c = t("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "piece"))
    before = F.lag("piece").over(Window.partitionBy("doc_id").orderBy("chunk"))
    return c.withColumn("_p", before).select("doc_id", "chunk", T.strip_overlap(F.col("piece"), F.col("_p")).alias("piece"))


@R.add(
    "html_to_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<br[^>]*>|<p[^>]*>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM pages""",
)
def html_to_text(t, spark):
    return t("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@R.add("ordered_concat", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE text <> '' GROUP BY 1")
def ordered_concat(t, spark):
    rows = t("conversations").filter("text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"), F.sum(F.length("text")).alias("n_chars"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("content"), "n_chars")


@R.add("id_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8)")
def id_lookup(t, spark):
    ids = spark.createDataFrame([("3, 5,,8 ",)], "csv string").select(F.explode(F.slice(F.filter(F.transform(F.split("csv", ","), lambda x: F.trim(x)), lambda x: x != ""), 1, 500)).alias("_id")).select(F.col("_id").cast("long").alias("doc_id"))
    return t("documents").select("doc_id", "lang").join(ids, "doc_id", "left_semi")
