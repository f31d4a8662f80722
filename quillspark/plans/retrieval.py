"""Search, vectors and answers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rag, search, vector
from .base import Registry

R = Registry()

COS = "list_cosine_similarity(e::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


def _query(t) -> list[float]:
    """The vector of row 0: one row."""
    return t("embeddings").filter("vec_id = 0").first()["embedding"]


def _chunks(t):
    lang = F.when(F.col("label") < 5, "lzh").when(F.col("label") < 8, "pi").otherwise("bo")
    return t("embeddings").select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / 5).alias("text_id"), (F.col("vec_id") % 5).alias("chunk"), lang.alias("lang"))


@R.add("vector_topk", f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {COS} AS score FROM (SELECT vec_id, embedding AS e FROM embeddings)) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(t, spark):
    return vector.top_k(t("embeddings"), "embedding", _query(t), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@R.add(
    "semantic_best_chunk",
    f"""WITH s AS (SELECT vec_id, vec_id // 5 AS text_id, {COS} AS score FROM (SELECT vec_id, embedding AS e FROM embeddings)), n AS (SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50),
    b AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, vec_id) AS k FROM n) SELECT text_id, vec_id, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY score DESC, vec_id LIMIT 10""",
)
def semantic_best_chunk(t, spark):
    best = vector.best_chunk_per_text(_chunks(t), "embedding", _query(t), "text_id", "vec_id", 10, 0.1)
    return best.select("text_id", "vec_id", F.round("score", 6).alias("score"))


SIMILAR = """WITH m AS (SELECT list(v ORDER BY i) AS m FROM (SELECT i, avg(x) AS v FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id // 5 = 1) GROUP BY i)),
    s AS (SELECT vec_id, vec_id // 5 AS text_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT m FROM m)) AS score FROM embeddings WHERE vec_id // 5 <> 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, vec_id) AS k FROM s WHERE score >= 0.05)"""


@R.add("similar_passages", SIMILAR + " SELECT text_id, vec_id, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY score DESC, text_id LIMIT 5")
def similar_passages(t, spark):
    out = vector.similar_passages(_chunks(t), "embedding", "text_id", "vec_id", 1, F.lit(True), 5, 0.05)
    return out.select("text_id", "vec_id", F.round("score", 6).alias("score"))


@R.add("similar_passages_compat", SIMILAR + " SELECT text_id, vec_id, round(score, 6) AS score FROM (SELECT * FROM b WHERE k = 1 ORDER BY text_id LIMIT 50) ORDER BY score DESC, text_id LIMIT 5")
def similar_passages_compat(t, spark):
    out = vector.similar_passages(_chunks(t), "embedding", "text_id", "vec_id", 1, F.lit(True), 5, 0.05, compat=True)
    return out.select("text_id", "vec_id", F.round("score", 6).alias("score"))


@R.add(
    "align_pairs_topk",
    """WITH s AS (SELECT a.label AS pair, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON b.label = (a.label + 1) % 10),
    n AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY score DESC, b) AS k FROM s WHERE score >= 0.05), g AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY score DESC, b) AS j FROM n WHERE k <= 20 AND b % 3 <> 0)
    SELECT pair, a, b, round(score, 6) AS score FROM g WHERE j <= 3""",
)
def align_pairs_topk(t, spark):
    e = t("embeddings").filter("label IS NOT NULL")
    source, target = e.withColumn("pair", F.col("label")), e.withColumn("pair", F.pmod(F.col("label") + 9, F.lit(10)))
    out = vector.align(source, target, "pair", "vec_id", "embedding", 20, 0.05, 3, lambda a, b, score: b % 3 != 0, block=256)
    return out.select("pair", "a", "b", F.round("score", 6).alias("score"))


@R.add(
    "topk_per_language_merge",
    f"""WITH s AS (SELECT vec_id, CASE WHEN label < 5 THEN 'lzh' WHEN label < 8 THEN 'pi' ELSE 'bo' END AS lang, {COS} AS score FROM (SELECT vec_id, label, embedding AS e FROM embeddings)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, vec_id) AS k FROM s)
    SELECT vec_id, lang, round(score, 6) AS score FROM r WHERE k <= CASE lang WHEN 'lzh' THEN 8 ELSE 4 END""",
)
def topk_per_language_merge(t, spark):
    out = vector.merged_top_k(_chunks(t), "embedding", _query(t), "vec_id", "lang", [("lzh", 8), ("pi", 4), ("bo", 4)])
    return out.select("vec_id", "lang", F.round("score", 6).alias("score"))


@R.add("cost_guard", "SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, sum(length(text)) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM conversations) WHERE spent <= 200000")
def cost_guard(t, spark):
    return vector.within_budget(t("conversations"), ["conv_id", "turn"], F.length("text"), 200000).select("conv_id", "turn", F.col("spent").cast("long").alias("spent"))


QUESTION = "the and of retion"


@R.add(
    "keyword_rerank",
    f"""WITH d AS (SELECT d.doc_id, d.text, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim, d.source AS title FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    o AS (SELECT *, len(list_intersect(list_distinct(string_split(substr(text, 1, 500), '')), list_distinct(string_split('{QUESTION}', '')))) AS n FROM d)
    SELECT doc_id, round(0.7 * sim + 0.2 * n / {len(QUESTION)}.0, 6) AS score FROM o ORDER BY 0.7 * sim + 0.2 * n / {len(QUESTION)}.0 DESC, doc_id LIMIT 20""",
)
def keyword_rerank(t, spark):
    from ..functions import vectors as V

    d = t("documents").join(t("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumn("sim", V.cosine(F.col("embedding"), V.literal(_query(t))))
    score = rag.keyword_score(F.col("sim"), QUESTION, F.col("text"), F.col("source"))
    return d.withColumn("s", score).orderBy(F.desc("s"), "doc_id").limit(20).select("doc_id", F.round("s", 6).alias("score"))


@R.add("shared_characters", f"SELECT doc_id, len(list_intersect(list_distinct(string_split(substr(text, 1, 500), '')), list_distinct(string_split('{QUESTION}', ''))))::INT AS n FROM documents")
def shared_characters(t, spark):
    return t("documents").select("doc_id", T.shared_characters(F.lit(QUESTION), F.substring("text", 1, 500)).alias("n"))


@R.add(
    "rag_context",
    f"""WITH s AS (SELECT d.doc_id, d.source, d.lang, d.text, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS k FROM s WHERE score >= 0.35), c AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE k = 1 ORDER BY score DESC, doc_id LIMIT 5),
    p AS (SELECT c.doc_id, d.text, row_number() OVER (PARTITION BY c.doc_id ORDER BY d.doc_id) AS k FROM c JOIN documents d ON d.doc_id BETWEEN c.doc_id + 1 AND c.doc_id + 4), l AS (SELECT doc_id, string_agg(chr(10) || '  ∥ ' || left(text, 300), '' ORDER BY k) AS more FROM p WHERE k <= 3 GROUP BY doc_id)
    SELECT string_agg('[' || source || ']' || chr(10) || text || coalesce(more, ''), chr(10) || chr(10) ORDER BY r) AS context FROM c LEFT JOIN l USING (doc_id)""",
)
def rag_context(t, spark):
    from ..functions import vectors as V
    from pyspark.sql import Window

    d = t("documents").join(t("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumn("score", V.cosine(F.col("embedding"), V.literal(_query(t))))
    hits = rag.context(d, "source", "lang", "doc_id", "score")
    near = hits.select("doc_id", F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 4)).alias("other")).join(t("documents").select(F.col("doc_id").alias("other"), F.col("text").alias("o")), "other")
    parallels = near.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("other", "o")))["o"].alias("parallels"))
    hits = hits.join(parallels, "doc_id", "left")
    blocks = hits.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("r"), rag.context_block(F.col("source"), F.col("text"), F.col("parallels")).alias("block"))
    return rag.context_text(blocks, "block", "r")


@R.add(
    "bm25_search",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> '') AS ws FROM documents), l AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'the')) AS a, len(list_filter(ws, lambda x: x = 'was')) AS b FROM w WHERE len(ws) > 0),
    s AS (SELECT count(*) AS N, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l)
    SELECT doc_id, round(ln(1 + (N - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (N - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score, ((a > 0)::INT + (b > 0)::INT) AS n_terms FROM l, s WHERE a + b > 0""".replace("count(*) AS N", "count(*) AS N_").replace("(N -", "(N_ -"),
)
def bm25_search(t, spark):
    hits = search.bm25(t("documents"), "doc_id", T.words(F.col("text")), ["the", "was"])
    return hits.select("doc_id", F.round("score", 6).alias("score"), "n_terms")


@R.add("content_collapse", "WITH h AS (SELECT source, doc_id, n_chars AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n_hits FROM h) SELECT source, max(score) AS best_score, min(doc_id) FILTER (k = 1) AS best_key, min(n_hits) AS n_hits, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS keys FROM r WHERE k <= 5 GROUP BY source")
def content_collapse(t, spark):
    from ..operators.ranking import collapse

    out = collapse(t("documents").select("source", "doc_id", F.col("n_chars").alias("score")), "source", "score", "doc_id")
    return out.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@R.add(
    "content_search",
    """WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS ws FROM documents), l AS (SELECT doc_id, source, len(ws) AS n, len(list_filter(ws, lambda x: x = 'the')) AS a, len(list_filter(ws, lambda x: x = 'was')) AS b FROM w WHERE len(ws) > 0),
    s AS (SELECT count(*) AS n_, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l),
    h AS (SELECT source, doc_id, round(ln(1 + (n_ - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (n_ - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM l, s WHERE a + b > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n_hits FROM h)
    SELECT source, max(score) AS best_score, min(n_hits) AS n_hits, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS keys FROM r WHERE k <= 5 GROUP BY source""",
)
def content_search(t, spark):
    out = search.content_search(t("documents"), "source", "doc_id", T.words(F.col("text")), ["the", "was"], digits=6)
    return out.select("source", "best_score", "n_hits", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


def _field(column: str, words: list[str]) -> str:
    return f"regexp_extract_all(lower({column}), '[a-zà-ÿ]+') AS w_{column}"


def _bm25_sql(column: str, words: list[str]) -> str:
    part = "ln(1 + (n_{c} - df_{c}_{j} + 0.5) / (df_{c}_{j} + 0.5)) * tf_{c}_{j} * 2.2 / (tf_{c}_{j} + 1.2 * (0.25 + 0.75 * len(w_{c}) / m_{c}))"
    every = " AND ".join(f"tf_{column}_{j} > 0" for j in range(len(words)))
    return f"CASE WHEN {every} THEN " + " + ".join(part.format(c=column, j=j) for j in range(len(words))) + " ELSE 0 END"


BOXED = ["small", "gizmo"]
COUNTS = ", ".join(f"len(list_filter(w_{c}, lambda x: levenshtein(x, '{w}') <= {e})) AS tf_{c}_{j}" for c in ("p_name", "p_type") for j, (w, e) in enumerate(zip(BOXED, (1, 2), strict=True)))
TOTALS = ", ".join(f"count(*) FILTER (len(w_{c}) > 0) AS n_{c}, avg(nullif(len(w_{c}), 0)) AS m_{c}, " + ", ".join(f"count(*) FILTER (tf_{c}_{j} > 0) AS df_{c}_{j}" for j in range(2)) for c in ("p_name", "p_type"))


@R.add(
    "catalog_search",
    f"""WITH w AS (SELECT *, {_field("p_name", BOXED)}, {_field("p_type", BOXED)} FROM part), c AS (SELECT *, {COUNTS} FROM w), s AS (SELECT {TOTALS} FROM c),
    x AS (SELECT p_partkey, greatest(3.0 * ({_bm25_sql("p_name", BOXED)}), 1.0 * ({_bm25_sql("p_type", BOXED)})) + CASE WHEN contains(lower(p_name), 'small gizmo') THEN 15 ELSE 0 END AS score FROM c, s) SELECT p_partkey, round(score, 6) AS score FROM x WHERE score > 0""",
)
def catalog_search(t, spark):
    found = search.catalog_search(t("part"), "p_partkey", " ".join(BOXED), {"p_name": 3.0, "p_type": 1.0}, {"p_name": 15.0}, {"p_size": None, "p_brand": None})
    return found.select("p_partkey", F.round("score", 6).alias("score"))


@R.add("search_page", "WITH h AS (SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')) SELECT p_partkey, p_name, (SELECT count(*) FROM h) AS total FROM h ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20")
def search_page(t, spark):
    return search.totalled(t("part").filter(F.contains("p_name", F.lit("a"))).select("p_partkey", "p_name"), ["p_name", "p_partkey"], 2, 20)


@R.add("dictionary_browse", "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_brand = 'Brand#1') AS total FROM part WHERE p_brand = 'Brand#1' ORDER BY p_name, p_partkey LIMIT 50")
def dictionary_browse(t, spark):
    return search.browse_dictionary(t("part"), "p_brand", "Brand#1", "p_name", "p_partkey", 1).select("p_partkey", "p_name", "total")


@R.add("suggestions", "SELECT DISTINCT p_name AS suggestion FROM part WHERE regexp_matches(p_name, '(?i)(^|[^a-z0-9])small[^a-z0-9]+w') OR regexp_matches(p_type, 'no such') ORDER BY 1 LIMIT 5")
def suggestions(t, spark):
    return search.suggest(t("part"), ["p_name"], "small w")


@R.add("did_you_mean", "WITH v AS (SELECT p_type AS term, count(*) AS n FROM part GROUP BY 1) SELECT term, levenshtein(term, 'PROMA')::INT AS distance FROM v WHERE levenshtein(term, 'PROMA') BETWEEN 1 AND 2 ORDER BY distance, n DESC, term LIMIT 1")
def did_you_mean(t, spark):
    v = t("part").groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return search.did_you_mean(v, "term", "n", "PROMA").select("term", "distance")


@R.add(
    "dictionary_search",
    """WITH h AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 ELSE 2 END AS relevance FROM part WHERE contains(lower(p_name), 'red')), c AS (SELECT count(*) AS c FROM h WHERE relevance < 2)
    SELECT p_partkey, relevance, CASE WHEN relevance < 2 THEN 1 ELSE 2 END AS phase FROM h, c WHERE relevance < 2 OR c < 5 ORDER BY phase, relevance, length(p_name), p_name, p_partkey LIMIT 200""",
)
def dictionary_search(t, spark):
    return search.dictionary_search(t("part"), "p_partkey", "p_name", "red").select("p_partkey", "relevance", "phase")


@R.add("question_kinds", "SELECT conv_id, turn, CASE WHEN length(text) <= 40 AND regexp_matches(lower(text), 'the|of') THEN 'meta' WHEN regexp_matches(lower(text), 'reth|and') THEN 'lookup' WHEN regexp_matches(lower(text), 'was') THEN 'compare' WHEN regexp_matches(lower(text), 'for') THEN 'history' ELSE 'general' END AS kind FROM conversations WHERE text IS NOT NULL")
def question_kinds(t, spark):
    kind = rag.question_kind(F.col("text"), ["the", "of"], ["reth", "and"], ["was"], ["for"])
    return t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", kind.alias("kind"))
