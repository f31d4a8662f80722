"""Graph, export and naming queries over the driver tables and small literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..operators import export, graph
from .base import Registry

R = Registry()


def _relations(t):
    """Nation to region and customer to nation edges over one id space."""
    a = t("nation").select(F.col("n_nationkey").cast("long").alias("subject"), F.lit("located_in").alias("predicate"), (1000 + F.col("n_regionkey")).cast("long").alias("object"))
    b = t("customer").select((10000 + F.col("c_custkey")).alias("subject"), F.lit("member_of").alias("predicate"), F.col("c_nationkey").cast("long").alias("object"))
    both = a.unionByName(b)
    return both.withColumns({"id": F.col("subject") * 10000 + F.col("object"), "source": F.lit("table"), "confidence": F.lit(1.0)})


def _entities(t):
    a = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    b = t("region").select((1000 + F.col("r_regionkey")).cast("long").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    c = t("customer").select((10000 + F.col("c_custkey")).alias("id"), F.lit("person").alias("kind"), F.col("c_name").alias("name"))
    return a.unionByName(b).unionByName(c).withColumn("properties", F.when(F.col("id") % 7 == 3, '{"is_hidden": true}').otherwise("{}"))


EDGES = "(SELECT n_nationkey AS s, 'located_in' AS p, 1000 + n_regionkey AS o FROM nation UNION ALL SELECT 10000 + c_custkey, 'member_of', c_nationkey FROM customer)"
ENTS = "(SELECT n_nationkey AS id, 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, 'region', r_name FROM region UNION ALL SELECT 10000 + c_custkey, 'person', c_name FROM customer)"


@R.add("edge_dedup", "SELECT l_suppkey AS subject, 'supplies' AS predicate, l_partkey AS object, max(l_discount) AS confidence, arg_max(l_returnflag, l_discount * 1e12 - (l_orderkey * 10 + l_linenumber)) AS source FROM lineitem GROUP BY 1, 3")
def edge_dedup(t, spark):
    rel = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("source"), F.col("l_discount").alias("confidence"))
    return graph.distinct_edges(rel)


@R.add("preferred_source", "SELECT subject, object, source FROM (SELECT l_suppkey AS subject, l_partkey AS object, l_returnflag AS source, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def preferred_source(t, spark):
    rel = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("source"))
    return graph.preferred_source(rel, ["R", "N"]).select("subject", "object", "source")


@R.add("undirected_neighbors", f"WITH e AS {EDGES}, n AS {ENTS} SELECT x.other, x.direction, x.predicate, n.name AS other_name, n.kind AS other_kind FROM (SELECT o AS other, 'outgoing' AS direction, p AS predicate FROM e WHERE s = 3 UNION ALL SELECT s, 'incoming', p FROM e WHERE o = 3 AND s <> o) x JOIN n ON n.id = x.other")
def undirected_neighbors(t, spark):
    return graph.relations_of(_relations(t), _entities(t), 3)


@R.add("node_degrees", f"WITH e AS {EDGES}, b AS (SELECT s AS node, o AS other FROM e UNION ALL SELECT o, s FROM e WHERE s <> o) SELECT node::BIGINT AS node, count(*) AS degree, count(DISTINCT other) AS neighbours FROM b GROUP BY 1")
def node_degrees(t, spark):
    return graph.degree(_relations(t))


KHOP = f"""WITH RECURSIVE e AS {EDGES}, b AS (SELECT s AS a, o AS b FROM e UNION ALL SELECT o, s FROM e), r(id, d) AS (SELECT 1001, 0 UNION SELECT b.b, r.d + 1 FROM r JOIN b ON b.a = r.id WHERE r.d < 2),
    m AS (SELECT id, min(d) AS depth FROM r GROUP BY 1), c AS (SELECT id, depth FROM m ORDER BY depth, id LIMIT 150)"""


@R.add("khop_subgraph", KHOP + " SELECT id::BIGINT AS id, depth FROM c WHERE id % 7 <> 3")
def khop_subgraph(t, spark):
    nodes, _, _ = graph.subgraph(_relations(t), _entities(t), 1001, depth=2, max_nodes=150)
    return nodes.select("id", "depth")


@R.add("khop_edges", KHOP + " , k AS (SELECT id FROM c WHERE id % 7 <> 3) SELECT s::BIGINT AS subject, p AS predicate, o::BIGINT AS object FROM e WHERE s IN (SELECT id FROM k) AND o IN (SELECT id FROM k) ORDER BY 1, 2, 3 LIMIT 500")
def khop_edges(t, spark):
    _, edges, _ = graph.subgraph(_relations(t), _entities(t), 1001, depth=2, max_nodes=150)
    return edges.select("subject", "predicate", "object")


@R.add("entity_with_relation", "SELECT c_custkey AS id, CASE WHEN lower(c_name) = 'customer#00000001' THEN 0 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 1 ELSE 2 END AS relevance FROM customer WHERE contains(lower(c_name), 'customer#00000001') AND c_custkey IN (SELECT o_custkey FROM orders) ORDER BY relevance, id LIMIT 20")
def entity_with_relation(t, spark):
    from ..operators.search import contains_any, relevance

    e = t("customer").select(F.col("c_custkey").alias("id"), "c_name")
    rel = t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_custkey").alias("object"))
    found = graph.with_relations(e.filter(contains_any(F.col("c_name"), ["customer#00000001"])), rel)
    return found.select("id", relevance(F.col("c_name"), ["customer#00000001"]).alias("relevance")).orderBy("relevance", "id").limit(20)


@R.add("haversine", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(sqrt(pow(sin(radians(b.n_regionkey - a.n_regionkey) / 2), 2) + cos(radians(a.n_regionkey)) * cos(radians(b.n_regionkey)) * pow(sin(radians(b.n_nationkey - a.n_nationkey) / 2), 2))), 4) AS km FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def haversine(t, spark):
    n = t("nation").select("n_nationkey", "n_regionkey")
    a, b = n.alias("a"), n.alias("b")
    km = geo.haversine_km(F.col("a.n_regionkey"), F.col("a.n_nationkey"), F.col("b.n_regionkey"), F.col("b.n_nationkey"))
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(km, 4).alias("km"))


@R.add("graph_export", "SELECT n_nationkey::BIGINT AS subject, (1000 + n_regionkey)::BIGINT AS object FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), -1")
def graph_export(t, spark):
    places = _entities(t).withColumn("kind", F.when(F.col("kind") == "person", "person").otherwise("place"))
    kept, inside = export.graph(places, _relations(t), "place")
    return inside.select("subject", "object").unionByName(kept.agg(F.count(F.lit(1)).alias("subject")).withColumn("object", F.lit(-1).cast("long")))


@R.add("metadata_csv", "SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, 'lzh') AS lang, coalesce(source, '') AS source FROM documents WHERE lang = 'de' ORDER BY documents.doc_id")
def metadata_csv(t, spark):
    return export.metadata_rows(t("documents"), ["doc_id", "lang", "source"], {"lang": "lzh"}, {"lang": "de", "source": None}, "doc_id")


@R.add("feed_items", "SELECT p_partkey, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS title, replace(replace(p_brand || ' · ' || p_type, '&', '&amp;'), '<', '&lt;') AS description FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC LIMIT 50")
def feed_items(t, spark):
    return export.feed_items(t("part"), "p_partkey", "p_name", "p_retailprice", ["p_brand", "p_type"])


@R.add("concept_links", "SELECT p_partkey AS text, concept, 0.7::DOUBLE AS confidence FROM part JOIN (VALUES ('warm', 'red|orange'), ('cold', 'blue|azure')) c(concept, words) ON regexp_matches(p_name, words)")
def concept_links(t, spark):
    return graph.concepts(t("part"), "p_partkey", "p_name", {"warm": ["red", "orange"], "cold": ["blue", "azure"]})


@R.add("highlight", r"SELECT item_id, regexp_replace(text, '(the)', '<em>\1</em>', 'gi') AS marked FROM benchmark")
def highlight(t, spark):
    return t("benchmark").select("item_id", T.highlight(F.col("text"), "the").alias("marked"))
