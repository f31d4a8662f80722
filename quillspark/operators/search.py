"""Keyword search: postings, BM25, catalog and content search, dictionaries, suggestions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, names
from ..functions import text as T
from .ranking import capped_groups, collapse, first_per_key, page

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf, length): an inverted index; terms are counted within a document before the shuffle."""
    rows = docs.select(key, terms.alias("terms")).filter(F.size("terms") > 0).withColumn("length", F.size("terms"))
    return rows.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def edits_allowed(term: str) -> int:
    """How many edits a term forgives: none up to 2 characters, one up to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _matches(terms: Column, word: str, fuzzy: bool) -> Column:
    """How many of a row's terms are the word, or lie within the edits it forgives."""
    edits = edits_allowed(word) if fuzzy else 0
    return F.size(F.filter(terms, lambda t: F.levenshtein(t, F.lit(word), edits) >= 0 if edits else t == F.lit(word)))


def bm25_weight(tf: Column, df: Column, length: Column, rows: Column, mean: Column) -> Column:
    return F.ln(1 + (rows - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, key: str, terms: Column, query: Sequence[str]) -> DataFrame:
    """(key, score, n_terms) of the documents with a query term.

    Term frequencies are counted in place by one scan; only documents that match are kept.  Where one
    corpus is searched often, :func:`write_postings` and :func:`bm25_of_postings` read the query's terms alone.
    """
    wanted = list(dict.fromkeys(query))
    rows = docs.select(key, terms.alias("terms")).withColumn("length", F.size("terms")).filter(F.col("length") > 0)
    rows = rows.select(key, "length", *[_matches(F.col("terms"), w, False).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    parts = [bm25_weight(F.col(f"tf{i}"), F.col(f"_df{i}"), F.col("length"), F.col("_n"), F.col("_mean")) for i in range(len(wanted))]
    met = [(F.col(f"tf{i}") > 0).cast("int") for i in range(len(wanted))]
    score, hit = sum(parts[1:], parts[0]), sum(met[1:], met[0])
    return rows.join(F.broadcast(stats)).filter(hit > 0).select(key, score.alias("score"), hit.alias("n_terms"))  # stats is one row


def write_postings(docs: DataFrame, key: str, terms: Column, path: str, buckets: int = 256) -> None:
    """Write the inverted index of ``docs`` under ``path``: postings in folders by a hash of the term, and one row of totals.

    A term's document frequency is written beside its postings, so a query reads its own terms' folders only.
    """
    rows = postings(docs, key, terms)
    frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = rows.join(frequency, "term").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    totals = docs.select(F.size(terms).alias("length")).filter("length > 0").agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_mean"), F.lit(buckets).alias("buckets"))
    totals.write.parquet(f"{path}/totals")


def bm25_of_postings(spark: SparkSession, path: str, key: str, query: Sequence[str]) -> DataFrame:
    """The rows of :func:`bm25` from a written index; partition pruning and the term filter reach the scan."""
    totals = spark.read.parquet(f"{path}/totals")
    buckets = totals.first()["buckets"]
    wanted = list(dict.fromkeys(query))
    places = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets))).collect()]
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(places) & F.col("term").isin(wanted))
    weight = bm25_weight(F.col("tf"), F.col("df"), F.col("length"), F.col("_n"), F.col("_mean"))
    return rows.join(F.broadcast(totals)).groupBy(key).agg(F.sum(weight).alias("score"), F.count(F.lit(1)).cast("int").alias("n_terms"))


def catalog_search(texts: DataFrame, key: str, query: str, fields: dict[str, float], phrase: dict[str, float], filters: dict[str, str | None], expansion: str | None = None, analyser: Callable[[Column], Column] = T.cjk_bigrams) -> DataFrame:
    """Rows with a score: the boosted BM25 score of the best field, plus phrase boosts.

    Every term of the query must be in a field, give or take the edits it forgives, for the field to
    count; frequencies and lengths are each field's own over all texts.  A phrase boost is added for a
    field that holds the whole query.  An empty query keeps all rows that pass the filters.
    ``expansion`` is the full title a short query stands for (by default that of the fixed table); a title that holds it gets 30 more.
    Filters of None are no filters.
    """
    expansion = fixed.TITLE_ABBREVIATIONS.get(query.strip()) if expansion is None else expansion
    passes = F.lit(True)
    for column, value in filters.items():
        if value is not None:
            passes = passes & (F.col(column) == value)
    found = texts.sparkSession.range(1).select(analyser(F.lit(query)).alias("t")).first()["t"]
    terms = list(dict.fromkeys(found))
    if not terms:
        return texts.filter(passes).withColumn("score", F.lit(1.0))
    columns = {}
    for i, c in enumerate(fields):
        own = analyser(F.coalesce(F.col(c), F.lit("")))
        columns |= {f"_len{i}": F.size(own)} | {f"_tf{i}_{j}": _matches(own, t, True) for j, t in enumerate(terms)}
    rows = texts.withColumns(columns)
    named = [(i, w, [F.col(f"_tf{i}_{j}") for j in range(len(terms))]) for i, w in enumerate(fields.values())]
    stats = rows.agg(*[x for i, _, tfs in named for x in (F.count_if(F.col(f"_len{i}") > 0).alias(f"_n{i}"), F.avg(F.nullif(F.col(f"_len{i}"), F.lit(0))).alias(f"_mean{i}"), *[F.count_if(tf > 0).alias(f"_df{i}_{j}") for j, tf in enumerate(tfs)])])
    scores = []
    for i, w, tfs in named:
        parts = [bm25_weight(tf, F.col(f"_df{i}_{j}"), F.col(f"_len{i}"), F.col(f"_n{i}"), F.col(f"_mean{i}")) for j, tf in enumerate(tfs)]
        scores.append(F.when(F.least(*tfs, F.lit(1 << 30)) > 0, w * sum(parts[1:], parts[0])).otherwise(0.0))
    more = [F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower())), F.lit(w)).otherwise(0.0) for c, w in phrase.items()]
    if expansion is not None:
        more += [F.when(F.contains(F.col(c), F.lit(expansion)), 30.0).otherwise(0.0) for c in list(phrase)[:1]]
    scored = rows.join(F.broadcast(stats)).filter(passes).withColumn("score", F.greatest(*scores, F.lit(0.0)) + sum(more, F.lit(0.0)))  # stats is one row
    return scored.filter(F.col("score") > 0).select(*texts.columns, "score")


def totalled(hits: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """A page of hits, each beside the number of all hits."""
    return page(hits, order, number, size).join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))))  # one row


def merged_editions(hits: DataFrame, title: str, translator: str, has_content: str, number: str, rank: str) -> DataFrame:
    """Search hits of one title and translator as one: with content first, then the smaller number (a missing one last).

    A translator is known without the dynasty before the name.
    """
    own = names.without_dynasty(F.coalesce(F.col(translator), F.lit("")))
    return first_per_key(hits.withColumn("_tr", own), [title, "_tr"], [F.desc(has_content), F.coalesce(F.col(number), F.lit("ZZZZ")), rank]).drop("_tr")


def content_search(chapters: DataFrame, work: str, chapter: str, terms: Column, query: Sequence[str], inner: int = 5, digits: int = 9) -> DataFrame:
    """Works by their best chapter, with up to ``inner`` chapters and the number that match.

    Scores are rounded to ``digits`` before they are ranked, so that equal ones go by chapter.
    """
    keyed = chapters.withColumn("_c", F.struct(work, chapter))
    hits = bm25(keyed, "_c", terms, query).select(F.col("_c")[work].alias(work), F.col("_c")[chapter].alias(chapter), F.round("score", digits).alias("score"))
    return collapse(hits, work, "score", chapter, inner)


def fragments(text: Column, term: str, size: int = 120, n: int = 3) -> Column:
    """Up to ``n`` stretches around the term, about ``size`` characters each, with the term marked."""
    side = max(0, (size - len(term)) // 2)
    found = F.regexp_extract_all(text, F.lit(f"(?is)(.{{0,{side}}}{re.escape(term)}.{{0,{side}}})"), F.lit(1))
    return F.transform(F.slice(found, 1, n), lambda x: T.highlight(x, term))


#: The weights by which search engines rank passages.
PIVOT, PASSAGE_K1, PASSAGE_B = 87, 1.2, 0.75


def content_fragments(texts: DataFrame, key: str, text: str, query: Sequence[str], analyser: Callable[[Column], Column] = T.words, size: int = 120, n: int = 3) -> DataFrame:
    """(key, fragments, n_passages): the best ``n`` passages of each text that holds a query term, in the order of the text, terms marked.

    A text is cut at the first sentence end after ``size`` characters; a passage scores by the terms it holds, each weighted by its rarity in its own
    text and set off against the passage's length; of equal scores the first counts.  n_passages is how many hold a term.
    Everything is computed within a row.
    """
    words = list(dict.fromkeys(query))
    ends = ".!?。！？；\n"
    cut = F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)(.{{0,{size - 1}}}[^{ends}]*(?:[{ends}]+|$))"), F.lit(1)), lambda p: p != "")
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  (a value used often is worked out once)
    weight = lambda size, n: (PASSAGE_K1 + 1) * F.log1p((1 + size / PIVOT + 0.5) / (n + 0.5))

    def ranked(d: Column) -> Column:
        """Of the passages with a term: (less the score, place, passage), best first."""

        def scored(w: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                drag = PASSAGE_K1 * (1 - PASSAGE_B + PASSAGE_B * F.length(x["p"]) / PIVOT)
                parts = [w[j] * x["tf"][j] / (x["tf"][j] + drag) for j in range(len(words))]
                return F.struct((-F.round(sum(parts[1:], parts[0]), 9)).alias("s"), i.alias("i"), x["p"].alias("p"))

            return F.array_sort(F.filter(F.transform(d["x"], one), lambda x: x["s"] < 0))

        return bound(F.array(*[weight(d["size"], total(d["x"], j)) for j in range(len(words))]), scored)

    def total(x: Column, j: int) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, y: s + y["tf"][j])

    counted = F.transform(cut, lambda p: bound(analyser(p), lambda ts: F.struct(p.alias("p"), F.array(*[_matches(ts, w, False) for w in words]).alias("tf"))))
    held = bound(F.struct(F.length(text).alias("size"), counted.alias("x")), ranked)
    rows = texts.select(key, held.alias("_held")).filter(F.size("_held") > 0)
    pattern = r"(?iu)(?<![\p{L}])(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?![\p{L}])"
    best = F.array_sort(F.transform(F.slice("_held", 1, n), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))))
    marked = F.transform(best, lambda x: F.regexp_replace(F.trim(x["p"]), pattern, "<em>$1</em>"))
    return rows.select(key, marked.alias("fragments"), F.size("_held").alias("n_passages"))


def suggest(texts: DataFrame, columns: Sequence[str], prefix: str, size: int = 5) -> DataFrame:
    """Distinct values that hold the words of the prefix in a row, the last one as the start of a word."""
    phrase = r"[^\p{L}\p{N}]+".join(re.escape(w) for w in prefix.split())
    values = None
    for c in columns:
        one = texts.select(F.col(c).alias("suggestion")).filter(F.col("suggestion").rlike(r"(?i)(^|[^\p{L}\p{N}])" + phrase))
        values = one if values is None else values.unionByName(one)
    return values.distinct().orderBy("suggestion").limit(size)


def did_you_mean(vocabulary: DataFrame, term: str, frequency: str, query: str, distance: int = 2) -> DataFrame:
    """The nearest, then most frequent term within an edit distance; none if the query itself is a term."""
    near = vocabulary.withColumn("distance", F.levenshtein(F.col(term), F.lit(query), distance)).filter(F.col("distance") >= 0)
    return near.orderBy("distance", F.desc(frequency), term).limit(1).filter(F.col("distance") > 0)


def relevance(name: Column, spellings: Sequence[str]) -> Column:
    """0: equal, 1: starts with a spelling, 2: else."""
    low = [s.lower() for s in spellings]
    exact = F.lower(name).isin(low)
    prefix = F.lower(name).startswith(low[0])
    for s in low[1:]:
        prefix = prefix | F.lower(name).startswith(s)
    return F.when(exact, 0).when(prefix, 1).otherwise(2)


def contains_any(name: Column, spellings: Sequence[str]) -> Column:
    """Whether a spelling occurs, % and _ as plain characters."""
    out = F.contains(F.lower(name), F.lit(spellings[0].lower()))
    for s in spellings[1:]:
        out = out | F.contains(F.lower(name), F.lit(s.lower()))
    return out


#: The order of kinds among equally relevant entities; others come last.
KINDS = ["person", "school", "dynasty"]


def search_entities(entities: DataFrame, relations: DataFrame, spellings: Sequence[str], kind: str | None = None, related: bool = False, number: int = 1, size: int = 20) -> DataFrame:
    """A page of visible entities whose name holds a spelling, beside the number of all: by relevance, then kind, then id.

    With ``kind`` only of that kind, with ``related`` only those at an end of a relation.
    """
    from .graph import hidden, with_relations

    rows = entities.filter(contains_any(F.col("name"), spellings) & ~hidden())
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    rows = with_relations(rows, relations) if related else rows
    first = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    return totalled(rows.withColumn("relevance", relevance(F.col("name"), spellings)), ["relevance", first, "id"], number, size)


def dictionary_search(entries: DataFrame, key: str, headword: str, query: str, spellings: Sequence[str] | None = None, enough: int = 5, most: int = 200) -> DataFrame:
    """Exact and prefix hits (phase 1); where those are fewer than ``enough``, other hits too (phase 2).

    Ordered by relevance, length of the headword, headword and key.
    """
    spellings = list(spellings or [query])
    rows = entries.withColumn("relevance", relevance(F.col(headword), spellings)).filter(contains_any(F.col(headword), spellings))
    first = rows.filter("relevance < 2")
    order = ["relevance", F.length(headword), headword, key]
    found = F.broadcast(first.limit(enough).agg(F.count(F.lit(1)).alias("_found")))  # one row
    hits = rows.join(found).filter((F.col("relevance") < 2) | (F.col("_found") < enough)).drop("_found")
    return hits.withColumn("phase", F.when(F.col("relevance") < 2, 1).otherwise(2)).orderBy("phase", *order).limit(most)


def grouped_dictionary_search(hits: DataFrame, source: str, key: str, headword: str, size: int) -> DataFrame:
    """Hits of each source, at most ``size``, beside the source's total."""
    return capped_groups(hits, source, ["phase", "relevance", F.length(headword), headword, key], size)


def browse_dictionary(entries: DataFrame, source: str, wanted: str, headword: str, key: str, number: int, size: int = 50) -> DataFrame:
    """A page of one dictionary's entries in order of headword, each beside the dictionary's total."""
    return totalled(entries.filter(F.col(source) == wanted), [headword, key], number, size)


def translations(relations: DataFrame, texts: DataFrame, ids: DataFrame, key: str, title: str) -> DataFrame:
    """Other ends of relations that touch the ids: (id, other, relation, title), one for a pair, the first relation kept."""
    both = relations.select(F.col("a").alias("id"), F.col("b").alias("other"), "relation", "rel_id").unionByName(relations.select(F.col("b").alias("id"), F.col("a").alias("other"), "relation", "rel_id"))
    mine = both.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    one = first_per_key(mine, ["id", "other"], ["rel_id"])
    return one.join(texts.select(F.col(key).alias("other"), F.col(title).alias("title")), "other").select("id", "other", "relation", "title")
