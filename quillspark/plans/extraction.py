"""Queries that take a graph out of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction
from .base import Registry
from .derived import Input

R = Registry()

FOUND = "SELECT 'person' AS kind, p_brand AS ref, p_brand AS name FROM part UNION ALL SELECT 'dynasty', p_type, p_type FROM part UNION ALL SELECT 'text', p_partkey::VARCHAR, p_name FROM part"


def found_entities(t):
    return extraction.entities(t("part"), "p_partkey", "p_name", "p_brand", "p_type", "part")


@R.add("extracted_entities", f"SELECT kind, ref, min(name) AS name, count(*) AS n_texts FROM ({FOUND}) GROUP BY kind, ref")
def extracted_entities(t, spark):
    return found_entities(t).drop("ids")


@R.add(
    "enriched_entities",
    f"""WITH found AS (SELECT kind, ref, min(name) AS name FROM ({FOUND}) GROUP BY kind, ref),
known AS (SELECT 'text' AS kind, l_partkey::VARCHAR AS ref, CASE WHEN max(l_returnflag) = 'R' THEN 'line ' || l_partkey END AS name, min(l_orderkey)::VARCHAR AS first_order FROM lineitem GROUP BY l_partkey)
SELECT coalesce(k.kind, f.kind) AS kind, coalesce(k.ref, f.ref) AS ref, coalesce(k.name, f.name) AS name,
    concat_ws(',', 'order=' || k.first_order, CASE WHEN f.kind = 'text' THEN 'part=' || f.ref END) AS ids
FROM known k FULL JOIN found f ON k.kind = f.kind AND k.ref = f.ref""",
)
def enriched_entities(t, spark):
    lines = t("lineitem").groupBy(F.col("l_partkey").cast("string").alias("ref")).agg(F.max("l_returnflag").alias("flag"), F.min("l_orderkey").cast("string").alias("first"))
    known = lines.select(F.lit("text").alias("kind"), "ref", F.when(F.col("flag") == "R", F.concat(F.lit("line "), "ref")).alias("name"), F.create_map(F.lit("order"), F.col("first")).alias("ids"))
    out = extraction.enriched(known, found_entities(t))
    pairs = F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("ids", F.array_join(pairs, ","))


@R.add("role_relations", "SELECT DISTINCT p_brand AS subject, 'translated' AS predicate, p_partkey::VARCHAR AS object, 1.0::DOUBLE AS confidence FROM part UNION ALL SELECT DISTINCT p_brand, 'active_in', p_type, 1.0 FROM part")
def role_relations(t, spark):
    return extraction.role_relations(t("part"), "p_partkey", "p_brand", "p_type")


@R.add(
    "synced_relations",
    """SELECT 'part ' || l.p_partkey AS subject, CASE l_returnflag WHEN 'A' THEN 'alt_translation' ELSE 'parallel_text' END AS predicate, 'part ' || r.p_partkey AS object,
    arg_min(coalesce(nullif(l_discount, 0), CASE l_returnflag WHEN 'A' THEN 0.9 ELSE 0.8 END), l_orderkey * 10 + l_linenumber)::DOUBLE AS confidence, CASE l_returnflag WHEN 'A' THEN 'alt' ELSE 'sync' END AS source
FROM lineitem JOIN part l ON l.p_partkey = l_partkey JOIN part r ON r.p_partkey = l_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3, 5""",
)
def synced_relations(t, spark):
    entity_of = t("part").select(F.col("p_partkey").alias("text"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"))
    table = t("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return extraction.synced_relations(table, "id", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", entity_of, {"A": ("alt_translation", 0.9, "alt"), "R": ("parallel_text", 0.8, "sync")})


KNOWN = Input("SELECT s_suppkey AS text, s_name AS name_zh, CASE WHEN s_suppkey % 2 = 0 THEN 'sa ' || s_name END AS name_sa, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'bo' END AS name_bo, CAST(NULL AS STRING) AS name_pi, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS name_en, CASE WHEN s_suppkey % 4 = 0 THEN 'T' || CAST(s_suppkey AS STRING) WHEN s_suppkey % 4 = 1 THEN 'old' END AS own, CASE WHEN s_suppkey % 6 = 0 THEN 'toh1' END AS uid FROM {supplier}", "supplier")
TITLES = Input("SELECT p_partkey AS id, p_name AS title_zh, CASE WHEN p_size % 3 > 0 THEN p_brand END AS title_sa, CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END AS title_bo, CASE WHEN p_size % 5 = 0 THEN p_brand END AS title_pi, CASE WHEN p_size % 2 = 0 THEN p_name END AS title_en, CASE WHEN p_size % 7 > 0 THEN 'T' || CAST(p_partkey AS STRING) END AS cbeta_id FROM {part}", "part")
UIDS = Input("SELECT o_orderkey AS id, o_custkey AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'toh' || CAST(o_orderkey % 400 AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN '-' || CAST(o_orderkey % 7 AS STRING) ELSE '' END END AS uid FROM {orders}", "orders")


@R.add(
    "enriched_texts",
    f"""WITH u AS (SELECT text, arg_min(uid, id) AS uid FROM {UIDS} GROUP BY text), n AS (SELECT t.*, u.uid, nullif(regexp_extract(u.uid, '([0-9]+(?:-[0-9]+)?)', 1), '') AS toh FROM {TITLES} t LEFT JOIN u ON u.text = t.id),
    j AS (SELECT coalesce(k.text, n.id) AS text, k.text IS NOT NULL AS there, CASE WHEN k.text IS NOT NULL THEN k.name_zh ELSE n.title_zh END AS name_zh, {", ".join(f"coalesce(nullif(k.name_{x}, ''), nullif(n.title_{x}, '')) AS name_{x}, coalesce(k.name_{x}, '') AS old_{x}" for x in ("sa", "bo", "pi", "en"))},
        coalesce(n.cbeta_id, k.own) AS own, k.own AS old_own, n.toh, coalesce(n.uid, k.uid) AS uid, k.uid AS old_uid FROM {KNOWN} k FULL JOIN n ON n.id = k.text)
    SELECT text, name_zh, {", ".join(f"name_{x}" for x in ("sa", "bo", "pi", "en"))}, concat_ws(',', 'cbeta_id=' || own, 'toh_number=' || toh) AS properties, coalesce('84000=' || uid, '') AS external_ids,
        CASE WHEN NOT there THEN 'created' WHEN own IS DISTINCT FROM old_own OR toh IS NOT NULL OR uid IS DISTINCT FROM old_uid OR {" OR ".join(f"coalesce(name_{x}, '') <> old_{x}" for x in ("sa", "bo", "pi", "en"))} THEN 'updated' END AS change FROM j""",
)
def enriched_texts(t, spark):
    known = KNOWN(t, spark)
    one = lambda k, c: F.when(F.col(c).isNotNull(), F.create_map(F.lit(k), F.col(c)))
    known = known.withColumns({"properties": one("cbeta_id", "own"), "external_ids": one("84000", "uid")}).drop("own", "uid")
    out = extraction.enriched_texts(known, TITLES(t, spark), UIDS(t, spark), "cbeta_id")
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumns({"name_bo": F.nullif("name_bo", F.lit("")), "properties": told("properties"), "external_ids": told("external_ids")})
