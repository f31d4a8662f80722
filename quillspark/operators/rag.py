"""Retrieval for answers: reranking, context assembly, prompt budget, question rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import first_per_key

LEAST_SCORE, CONTEXT_CHUNKS, PARALLELS, PARALLEL_CHARS = 0.35, 5, 3, 300


def keyword_score(similarity: Column, query: str, chunk: Column, title: Column) -> Column:
    """.7 similarity + .2 share of the query's characters in the chunk's first 500 + .1 if 2 to 7 characters of the title are in the query."""
    overlap = T.shared_characters(F.lit(query), F.substring(chunk, 1, 500)) / F.lit(max(len(query), 1))
    n = F.coalesce(F.length(title), F.lit(0))

    def parts(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
        return (n >= size) & F.exists(starts, lambda i: F.contains(F.lit(query), F.substring(title, i, F.lit(size))))

    hit = parts(2)
    for size in range(3, 8):
        hit = hit | parts(size)
    return similarity * 0.7 + overlap * 0.2 + F.coalesce(hit, F.lit(False)).cast("double") * 0.1


def model_score(similarity: Column, judged: Column) -> Column:
    """.4 similarity + .6 of a reranker's score, 0 where it gave none."""
    return similarity * 0.4 + F.coalesce(judged, F.lit(0.0)) * 0.6


def context(hits: DataFrame, text: str, chapter: str, key: str, score: str) -> DataFrame:
    """The best chunk of each (text, chapter) of score .35 or more, 5 at most, in score order."""
    good = hits.filter(F.col(score) >= LEAST_SCORE)
    return first_per_key(good, [text, chapter], [F.desc(score), key]).orderBy(F.desc(score), key).limit(CONTEXT_CHUNKS)


def context_block(label: Column, chunk: Column, parallels: Column) -> Column:
    """One source's block: label, chunk, and up to 3 parallels of 300 characters."""
    more = F.transform(F.slice(F.coalesce(parallels, F.array().cast("array<string>")), 1, PARALLELS), lambda p: F.concat(F.lit("\n  ∥ "), F.substring(p, 1, PARALLEL_CHARS)))
    return F.concat(F.lit("["), label, F.lit("]\n"), chunk, F.array_join(more, ""))


def context_text(blocks: DataFrame, block: str, order: str) -> DataFrame:
    """One row: the blocks in order, two line feeds between."""
    return blocks.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, block))), lambda x: x[block]), "\n\n").alias("context"))


def within_token_budget(messages: DataFrame, conversation: str, turn: str, text: str, budget: int = 6000, most: int = 10) -> DataFrame:
    """The newest messages of each conversation, ``most`` at most, while their estimated tokens fit the budget."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    rows = messages.withColumn("tokens", T.estimated_tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({"_n": F.row_number().over(w), "_sum": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter((F.col("_n") <= most) & (F.col("_sum") <= budget)).drop("_n", "_sum")


def question_kind(question: Column, meta: Sequence[str], lookup: Sequence[str], compare: Sequence[str], history: Sequence[str]) -> Column:
    """meta (40 characters at most), lookup, compare, history or general, by keyword in that order."""
    has = lambda words: F.lower(question).rlike("|".join(words))
    return F.when((F.length(question) <= 40) & has(meta), "meta").when(has(lookup), "lookup").when(has(compare), "compare").when(has(history), "history").otherwise("general")


def query_terms(question: Column, stop: str, most: int = 5) -> Column:
    """Up to 5 distinct runs of 2 to 8 ideographs once question words are gone."""
    bare = F.regexp_replace(question, stop, " ")
    return F.slice(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"([\x{4E00}-\x{9FFF}]{2,8})"), F.lit(1))), 1, most)


def strip_followups(text: Column) -> Column:
    """Without lines that suggest further questions."""
    return T.drop_lines(text, r"^\s*\[?(追问|追問|Follow-?up)")


def clamped(scores: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    return scores.withColumns({c: F.greatest(F.lit(a), F.least(F.lit(b), F.col(c))) for c, (a, b) in limits.items()})
