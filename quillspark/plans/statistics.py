"""Statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .base import Registry

R = Registry()
NOW = "2024-01-31 00:00:00"


@R.add(
    "source_coverage",
    """SELECT s.source, coalesce(count(d.doc_id), 0)::BIGINT AS n_items, coalesce(sum(CASE WHEN q.good THEN 1 ELSE 0 END), 0)::BIGINT AS n_full,
    (count(d.doc_id) - coalesce(sum(CASE WHEN q.good THEN 1 ELSE 0 END), 0))::BIGINT AS n_rest
    FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d USING (source) LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id) q USING (doc_id) GROUP BY s.source ORDER BY n_items DESC, s.source""",
)
def source_coverage(t, spark):
    docs = t("documents").select("doc_id", "source")
    good = t("labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    items = docs.join(good, "doc_id", "left")
    return stats.coverage(docs.select("source").distinct(), items, "source", F.coalesce(F.col("good"), F.lit(False))).orderBy(F.desc("n_items"), "source")


@R.add("overview", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(DISTINCT lang) FROM documents) AS n_languages, (SELECT count(*) FROM nation) AS n_entities, (SELECT count(*) FROM lineitem) AS n_relations, (SELECT count(DISTINCT p_name) FROM part) AS n_entries")
def overview(t, spark):
    return stats.overview({"n_documents": (t("documents"), None), "n_sources": (t("documents"), "source"), "n_languages": (t("documents"), "lang"), "n_entities": (t("nation"), None), "n_relations": (t("lineitem"), None), "n_entries": (t("part"), "p_name")})


@R.add("language_distribution", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def language_distribution(t, spark):
    return stats.distribution(t("documents"), "lang", with_null=True)


@R.add("category_distribution", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def category_distribution(t, spark):
    return stats.distribution(t("part"), "p_type")


@R.add(
    "mode_per_group",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) AS k, sum(c) OVER (PARTITION BY o_custkey) AS n FROM c WHERE o_orderpriority IS NOT NULL)
    SELECT o_custkey, n::BIGINT AS n, o_orderpriority AS usual FROM r WHERE k = 1 ORDER BY n DESC, o_custkey LIMIT 20""",
)
def mode_per_group(t, spark):
    return stats.mode_per_group(t("orders"), "o_custkey", "o_orderpriority", 20)


@R.add(
    "source_stats_preagg",
    """SELECT s.s_suppkey, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(p.n, 0)::BIGINT AS n_parts, round(coalesce(q.v, 0), 2) AS quantity FROM supplier s
    LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON l.k = s.s_suppkey
    LEFT JOIN (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p ON p.k = s.s_suppkey
    LEFT JOIN (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1) q ON q.k = s.s_suppkey""",
)
def source_stats_preagg(t, spark):
    lines = t("lineitem")
    out = stats.joined_counts(t("supplier").select("s_suppkey"), "s_suppkey", {"n_lines": (lines, "l_suppkey", F.count(F.lit(1))), "n_parts": (lines, "l_suppkey", F.count_distinct("l_partkey")), "quantity": (lines, "l_suppkey", F.sum("l_quantity"))})
    return out.withColumn("quantity", F.round("quantity", 2))


@R.add(
    "daily_counts_local_tz",
    """WITH g AS (SELECT unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
    c AS (SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT g.day, coalesce(c.n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (day)""",
)
def daily_counts_local_tz(t, spark):
    signups = t("events").filter("event_type = 'signup'").withColumn("local", stats.local_day(F.col("ts")))
    return stats.daily_grid(signups, "local", "2024-01-31", 30, F.count(F.lit(1)))


@R.add("daily_active_users", "SELECT day, count(DISTINCT u) AS n_users FROM (SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, user_id AS u FROM events WHERE event_type = 'view' UNION ALL SELECT (ts + INTERVAL 8 HOUR)::DATE, user_id FROM events WHERE event_type = 'purchase') WHERE u IS NOT NULL GROUP BY 1")
def daily_active_users(t, spark):
    e = t("events")
    return stats.active_users([e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")], "user_id", "ts")


@R.add("count_with_cutoff", "SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 16:00:00') AS since FROM events")
def count_with_cutoff(t, spark):
    return stats.total_and_since(t("events"), "ts", "2024-01-30 16:00:00")


@R.add("recent_updates", f"SELECT event_id, ts::VARCHAR AS at FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAYS")
def recent_updates(t, spark):
    rows = stats.recent(t("events").filter("event_type = 'error'"), "ts", NOW, 3)
    return rows.select("event_id", F.col("ts").cast("string").alias("at"))


@R.add("facets_topn", "(SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, value LIMIT 3) UNION ALL (SELECT 'source', source, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, source LIMIT 10)")
def facets_topn(t, spark):
    d = t("documents")
    facet = lambda c, n: stats.facet(d, c, n).select(F.lit(c).alias("facet"), "value", "n")
    return facet("lang", 3).unionByName(facet("source", 10))


@R.add(
    "platform_activity",
    f"""WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)
    SELECT (SELECT count(*) FROM w) AS events, (SELECT count(DISTINCT user_id) FROM w) AS active_users, (SELECT count(*) FROM w WHERE event_type = 'view') AS reads, (SELECT count(*) FROM w WHERE event_type = 'signup') AS registrations,
    (SELECT count(*) FROM w WHERE event_type = 'error') AS errors, (SELECT count(*) FROM (SELECT user_id, min(ts) AS f FROM events GROUP BY 1) WHERE f >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS new_users""",
)
def platform_activity(t, spark):
    return stats.activity(t("events"), NOW, 7, "ts", "user_id", "event_type")


@R.add("duplicate_titles", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(t, spark):
    return stats.duplicates(t("part"), "p_name")


@R.add("top_and_other", "WITH c AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c) SELECT CASE WHEN k <= 10 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def top_and_other(t, spark):
    return stats.top_and_other(t("documents"), "source", 10)


@R.add("json_key_counts", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_key_counts(t, spark):
    return stats.json_keys(t("events"), "props")


@R.add("class_shares", "SELECT segment AS label, n, round(n * 100.0 / sum(n) OVER (), 2) AS percent FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS segment, count(*) AS n FROM customer GROUP BY 1)")
def class_shares(t, spark):
    label = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return stats.shares(t("customer"), label)


@R.add("rate_limit_windows", "SELECT user_id, date_trunc('hour', ts)::VARCHAR AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_windows(t, spark):
    return stats.rate_windows(t("events"), "user_id", "ts", 1, "1 hour").select("user_id", F.col("window_start").cast("string").alias("window_start"), "n")


@R.add("daily_quota", "SELECT user_id, (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS n, count(*) < 5 AS allowed FROM events GROUP BY 1, 2")
def daily_quota(t, spark):
    return stats.over_quota(t("events"), "user_id", "ts", 5)


@R.add(
    "activity_throttle",
    """WITH RECURSIVE p(user_id, ts) AS (SELECT user_id, min(ts) FROM events WHERE user_id IS NOT NULL GROUP BY 1 UNION ALL SELECT p.user_id, min(e.ts) FROM p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 300 SECOND GROUP BY p.user_id)
    SELECT p.user_id, min(e.event_id) AS event_id FROM p JOIN events e USING (user_id, ts) GROUP BY p.user_id, p.ts""",
)
def activity_throttle(t, spark):
    return stats.throttled(t("events"), "user_id", "ts", 300, "event_id").select("user_id", "event_id")


@R.add("value_clusters", "SELECT round(l_discount, 1) AS lat, round(l_tax, 1) AS lng, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, lat, lng LIMIT 15")
def value_clusters(t, spark):
    return stats.clusters(t("lineitem"), "l_discount", "l_tax", 1, 15)
