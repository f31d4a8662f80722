"""Searches over written indexes, each equal to a scan of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewriting
from ..functions import text as T
from ..operators import cells, index, ranking, search, suggester
from ..operators.search import edits_allowed
from ..operators.storage import new_folder
from .base import Registry
from .retrieval import COS, _bm25_sql, _query

R = Registry()

WORDS = "regexp_extract_all(lower({0}), '[a-zà-ÿ]+')"


def _counts(columns: list[str], words: list[str], fuzzy: bool) -> str:
    """SQL of CTEs c (each row's counts of the words in each column) and s (totals over all rows)."""
    met = lambda w: f"levenshtein(x, '{w}') <= {edits_allowed(w)}" if fuzzy and edits_allowed(w) else f"x = '{w}'"
    each = [(c, j) for c in columns for j in range(len(words))]
    tf = ", ".join(f"len(list_filter(w_{c}, lambda x: {met(words[j])})) AS tf_{c}_{j}" for c, j in each)
    totals = ", ".join([*(f"count(*) FILTER (len(w_{c}) > 0) AS n_{c}, avg(nullif(len(w_{c}), 0)) AS m_{c}" for c in columns), *(f"count(*) FILTER (tf_{c}_{j} > 0) AS df_{c}_{j}" for c, j in each)])
    return f"c AS MATERIALIZED (SELECT *, {tf} FROM w), s AS (SELECT {totals} FROM c)"


def _in_a_row(column: str, words: list[str]) -> str:
    return f"contains(' ' || array_to_string(w_{column}, ' ') || ' ', ' {' '.join(words)} ')"


BOXED = ["small", "gizmo"]


@R.add(
    "indexed_catalog_search",
    f"""WITH w AS (SELECT *, {WORDS.format("p_name")} AS w_p_name, {WORDS.format("p_type")} AS w_p_type FROM part), {_counts(["p_name", "p_type"], BOXED, True)},
    x AS (SELECT p_partkey AS key, round(greatest(3.0 * ({_bm25_sql("p_name", BOXED)}), 1.0 * ({_bm25_sql("p_type", BOXED)})) + CASE WHEN {_in_a_row("p_name", BOXED)} THEN 15 ELSE 0 END, 9) AS score FROM c, s)
    SELECT key, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY x.score DESC, key LIMIT 50""",
)
def indexed_catalog_search(t, spark):
    path = new_folder(spark, "catalog-index")
    index.write_index(t("part"), "p_partkey", {c: T.words(F.col(c)) for c in ("p_name", "p_type")}, path)
    found = index.search_index(spark, path, BOXED, {"p_name": 3.0, "p_type": 1.0}, 50, fuzzy=True, phrase={"p_name": 15.0})
    return found.select("key", F.round("score", 6).alias("score"))


ROW = ["of", "the", "reth"]


@R.add(
    "indexed_phrase_search",
    f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w_text FROM documents), {_counts(["text"], ROW[:2], False)},
    x AS (SELECT doc_id AS key, round({_bm25_sql("text", ROW[:2])} + CASE WHEN {_in_a_row("text", ROW[:2])} THEN 2 ELSE 0 END, 9) AS score FROM c, s)
    SELECT key, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY x.score DESC, key LIMIT 100""",
)
def indexed_phrase_search(t, spark):
    path = new_folder(spark, "text-index")
    index.write_index(t("documents"), "doc_id", {"text": T.words(F.col("text"))}, path, span=64, fuzzy=False)
    found = index.search_index(spark, path, ROW[:2], {"text": 1.0}, 100, phrase={"text": 2.0})
    return found.select("key", F.round("score", 6).alias("score"))


def _any_sql(column: str, words: list[str]) -> str:
    return _bm25_sql(column, words).removeprefix("CASE WHEN " + " AND ".join(f"tf_{column}_{j} > 0" for j in range(len(words))) + " THEN ").removesuffix(" ELSE 0 END")


@R.add(
    "indexed_content_search",
    f"""WITH w AS (SELECT doc_id, lang, {WORDS.format("text")} AS w_text FROM documents), {_counts(["text"], ROW, False)},
    x AS (SELECT doc_id AS key, round({_any_sql("text", ROW)}, 9) AS score FROM c, s WHERE lang = 'en' AND len(w_text) > 0)
    SELECT key, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY x.score DESC, key LIMIT 100""",
)
def indexed_content_search(t, spark):
    path = new_folder(spark, "content-index")
    index.write_index(t("documents"), "doc_id", {"text": T.words(F.col("text"))}, path, span=64, fuzzy=False)
    found = index.search_index(spark, path, ROW, {"text": 1.0}, 100, every=False, allowed=t("documents").filter("lang = 'en'").select("doc_id"))
    return found.select("key", F.round("score", 6).alias("score"))


SPELT = ["the", "andd", "ofth", "rethh"]


@R.add(
    "phrase_suggestion",
    f"""WITH lists AS (SELECT {WORDS.format("text")} AS ws FROM documents), u AS MATERIALIZED (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM lists) GROUP BY 1), total AS (SELECT sum(n) AS n FROM u),
    p AS MATERIALIZED (SELECT z[1] AS first, z[2] AS term, count(*) AS n FROM (SELECT unnest(list_zip(ws[1 : len(ws) - 1], ws[2 :])) AS z FROM lists WHERE len(ws) > 1) GROUP BY 1, 2),
    q(pos, word, edits) AS (VALUES {", ".join(f"({i}, '{w}', {suggester.spelling_edits(w)})" for i, w in enumerate(SPELT))}),
    near AS (SELECT pos, term, word, levenshtein(term, word) AS d, row_number() OVER (PARTITION BY pos ORDER BY levenshtein(term, word), n DESC, term) AS nth FROM q, u WHERE term <> word AND term[1] = word[1] AND levenshtein(term, word) <= edits AND n > coalesce((SELECT n FROM u x WHERE x.term = word), 0)),
    v AS (SELECT -1 AS id, -1 AS spot, '' AS term, 1.0::DOUBLE AS channel UNION ALL SELECT pos * 100 + nth, pos, term, 1.0 - d / greatest(length(term), length(word)) FROM near WHERE nth <= 5),
    tried AS (SELECT v.id, q.pos, CASE WHEN q.pos = v.spot THEN v.term ELSE q.word END AS term, CASE WHEN q.pos = v.spot THEN v.channel ELSE 0.95 END AS channel FROM v, q),
    seen AS (SELECT *, lag(term) OVER (PARTITION BY id ORDER BY pos) AS first FROM tried),
    likely AS (SELECT s.*, coalesce(u.n, 0.5)::DOUBLE / (SELECT n FROM total) AS alone, p.n / f.n AS after FROM seen s LEFT JOIN u USING (term) LEFT JOIN p ON p.first = s.first AND p.term = s.term LEFT JOIN u f ON f.term = s.first),
    scored AS (SELECT id, string_agg(term, ' ' ORDER BY pos) AS suggestion, round(sum(ln(CASE WHEN first IS NULL THEN alone ELSE coalesce(after, 0.4 * alone) END) + ln(channel)), 9) AS score FROM likely GROUP BY id)
    SELECT suggestion, round(score, 6) AS score FROM scored s WHERE id >= 0 AND score > (SELECT score FROM scored WHERE id = -1) ORDER BY s.score DESC, suggestion LIMIT 10""",
)
def phrase_suggestion(t, spark):
    path = new_folder(spark, "phrases")
    suggester.write_phrase_model(t("documents"), T.words(F.col("text")), path)
    return suggester.phrase_suggestions(spark, path, SPELT, size=10).select("suggestion", F.round("score", 6).alias("score"))


TYPED = ["s", "sma", "small", "Hot  pl", "w", "gizm", "zzz"]


@R.add(
    "completions",
    " UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT '{p}' AS typed, v AS suggestion FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part) WHERE regexp_matches(v, '(?i)(^|[^a-z0-9]){'[^a-z0-9]+'.join(p.split())}') ORDER BY v LIMIT 10)" for p in TYPED),
)
def completions(t, spark):
    path = new_folder(spark, "completions")
    suggester.write_completions(t("part"), ["p_name", "p_type"], path)
    parts = [suggester.completions(spark, path, p, 10).select(F.lit(p).alias("typed"), "suggestion") for p in TYPED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cells(t, spark) -> cells.Cells:
    path = new_folder(spark, "cells")
    cells.write_cells(t("embeddings"), "vec_id", "embedding", path, cells=32)
    return cells.Cells(spark, path, "vec_id", "embedding")


@R.add("cells_topk", f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, {COS} AS score FROM (SELECT vec_id, label, embedding AS e FROM embeddings)) ORDER BY score DESC, vec_id LIMIT 50")
def cells_topk(t, spark):
    return _cells(t, spark).top_k(_query(t), 50).select("vec_id", "label", F.round("score", 6).alias("score"))


@R.add(
    "cells_best_chunk",
    f"""WITH s AS (SELECT vec_id, vec_id // 5 AS text_id, {COS} AS score FROM (SELECT vec_id, embedding AS e FROM embeddings WHERE label < 7)), n AS (SELECT * FROM s WHERE score >= 0.05 ORDER BY score DESC, vec_id LIMIT 50),
    b AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, vec_id) AS k FROM n) SELECT text_id, vec_id, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY score DESC, vec_id LIMIT 10""",
)
def cells_best_chunk(t, spark):
    near = _cells(t, spark).top_k(_query(t), 50, where=F.col("label") < 7, least=0.05).withColumn("text_id", F.floor(F.col("vec_id") / 5))
    best = ranking.first_per_key(near, ["text_id"], [F.desc("score"), "vec_id"]).orderBy(F.desc("score"), "vec_id").limit(10)
    return best.select("text_id", "vec_id", F.round("score", 6).alias("score"))


SOUGHT = ["the", "reth", "was"]
CUT = r"(?s).{0,119}[^.!?。！？；\n]*(?:[.!?。！？；\n]+|$)"


@R.add(
    "content_fragments",
    f"""WITH p AS (SELECT doc_id, length(text) AS size, unnest(list_filter(regexp_extract_all(text, '{CUT}'), lambda x: x <> '')) AS p, unnest(range(len(list_filter(regexp_extract_all(text, '{CUT}'), lambda x: x <> '')))) AS i FROM documents),
    c AS (SELECT *, {", ".join(f"len(list_filter({WORDS.format('p')}, lambda x: x = '{w}')) AS t{j}" for j, w in enumerate(SOUGHT))} FROM p),
    w AS (SELECT *, {", ".join(f"2.2 * ln(1 + (1 + size / 87 + 0.5) / (sum(t{j}) OVER (PARTITION BY doc_id) + 0.5)) AS w{j}" for j in range(len(SOUGHT)))} FROM c),
    s AS (SELECT *, round({" + ".join(f"w{j} * t{j} / (t{j} + 1.2 * (0.25 + 0.75 * length(p) / 87))" for j in range(len(SOUGHT)))}, 9) AS score FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE score > 0)
    SELECT doc_id, string_agg(trim(p, ' '), ' … ' ORDER BY i) AS fragments, min(n)::INT AS n_passages FROM r WHERE k <= 3 GROUP BY doc_id""",
)
def content_fragments(t, spark):
    found = search.content_fragments(t("documents"), "doc_id", "text", SOUGHT)
    return found.select("doc_id", F.regexp_replace(F.array_join("fragments", " … "), "</?em>", "").alias("fragments"), "n_passages")


@R.add(
    "longest_match",
    """WITH s AS (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part)), m AS (SELECT DISTINCT substr(p_name, i, n) AS k FROM s, range(2, 6) t(n) WHERE i + n <= length(p_name) + 1 AND NOT contains(substr(p_name, i, n), ' '))
    SELECT doc_id, regexp_replace(text, (SELECT '(' || string_agg(k, '|' ORDER BY length(k) DESC, k) || ')' FROM m), '<\\1>', 'g') AS text FROM documents""",
)
def longest_match(t, spark):
    names = t("part").select("p_name").distinct()
    places = names.select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name"))).alias("i")).withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(5))))
    keys = places.filter("i + n <= length(p_name) + 1").select(F.expr("substring(p_name, i, n)").alias("k")).filter("NOT contains(k, ' ')").distinct()
    mapping = rewriting.mapping_of(keys.withColumn("v", F.concat(F.lit("<"), "k", F.lit(">"))), "k", "v")
    return t("documents").select("doc_id", rewriting.replace_longest(F.col("text"), mapping).alias("text"))
