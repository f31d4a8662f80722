"""Vector retrieval: top-k, best chunk, similar passages, alignment, reranking.

A query vector is a constant of the plan; source chunks of an alignment meet only the
target chunks of their own pair of texts, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranking import first_per_key, running_total


def top_k(chunks: DataFrame, vector: str, query: Sequence[float], k: int, key: str, where: Column | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` rows nearest by cosine, filters applied before the cut; ties go to the smaller key."""
    rows = chunks if where is None else chunks.filter(where)
    rows = rows.withColumn("score", V.cosine(F.col(vector), V.literal(query)))
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    return rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), key).limit(k)


def best_chunk_per_text(chunks: DataFrame, vector: str, query: Sequence[float], text: str, key: str, size: int, least: float = 0.35) -> DataFrame:
    """Semantic search: of the ``5 * size`` nearest chunks the best of each text, ``size`` at most."""
    near = top_k(chunks, vector, query, 5 * size, key, least=least)
    return first_per_key(near, [text], [F.desc("score"), key]).orderBy(F.desc("score"), key).limit(size)


def in_scope(chunks: DataFrame, text: str, scope: DataFrame | None) -> DataFrame:
    """The chunks of the texts in a scope (its first column); no scope, or an empty one, is no limit."""
    if scope is None:
        return chunks
    ids = scope.select(F.col(scope.columns[0]).alias(text)).dropna().distinct()
    empty = F.broadcast(ids.agg((F.count(F.lit(1)) == 0).alias("_all")))  # one row
    marked = chunks.join(ids.withColumn("_in", F.lit(True)), text, "left").join(empty)
    return marked.filter(F.col("_all") | F.col("_in").isNotNull()).drop("_all", "_in")


def mean_vector(rows: DataFrame, vector: str) -> list[float] | None:
    """The mean of the rows' vectors; its length is the vectors' own."""
    means = rows.select(F.posexplode(vector)).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m")).orderBy("pos").collect()
    return [r.m for r in means] or None


def similar_passages(chunks: DataFrame, vector: str, text: str, chunk: str, of_text, where: Column, n: int, least: float = 0.7, compat: bool = False) -> DataFrame:
    """Other texts by their chunk nearest to the mean vector of a passage.

    ``compat`` first cuts to the 50 smallest text ids, as the service being rebuilt does.
    """
    mean = mean_vector(chunks.filter((F.col(text) == of_text) & where), vector)
    if mean is None:
        return chunks.limit(0).withColumn("score", F.lit(None).cast("double"))
    others = chunks.filter(F.col(text) != of_text).withColumn("score", V.cosine(F.col(vector), V.literal(mean))).filter(F.col("score") >= least)
    best = first_per_key(others, [text], [F.desc("score"), chunk])
    if compat:
        best = best.orderBy(text).limit(50)
    return best.orderBy(F.desc("score"), text).limit(n)


def nearest_of_blocks(source: DataFrame, target: DataFrame, pair: str, key: str, vector: str, k: int, least: float, block: int = 1024, digits: int = 9, held: int = 4_000_000) -> DataFrame:
    """(pair, a, b, score): for each source row the ``k`` nearest target rows of its pair with a cosine of ``least`` or more.

    Both sides of a pair are dealt to blocks of about ``held`` vector components (32 MB in double precision) and at least ``block`` rows, the source
    to four at least if it has them; each two blocks meet in a task of their own, where matrix products of ``block`` source rows leave ``k``
    rows for each; what is left is merged.  No task holds a whole pair, and a side is sent once for each block of the other, so as long
    as a pair's target fits a block what is sent grows with the rows.  Scores are rounded to ``digits``, ties go to the smaller key.
    Vectors that are null, not finite or zero are near nothing, and those of another length not compared.
    """
    keys = [pair, "_d"]
    real = lambda df: F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    sides = {s: df.select(pair, F.col(key).alias(s), real(df).alias("v"), F.size(vector).alias("_d")).filter("_d > 0") for s, df in (("a", source), ("b", target))}
    rows, most = F.count(F.lit(1)), F.greatest(F.lit(block), F.floor(F.lit(held) / F.col("_d")))
    count = {"a": F.greatest(F.ceil(rows / most), F.least(F.lit(4), F.ceil(rows / block))), "b": F.ceil(rows / most)}
    sizes = {s: df.groupBy(*keys).agg(count[s].cast("int").alias("_n")) for s, df in sides.items()}
    dealt = {}
    for s, other in (("a", "b"), ("b", "a")):
        own = sides[s].join(sizes[s], keys).withColumn(f"_{s}", F.pmod(F.xxhash64(s), F.col("_n"))).drop("_n").join(sizes[other], keys)
        dealt[s] = own.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1).cast("array<bigint>"))).drop("_n")

    def matrix(rows: pa.Table, name: str) -> tuple[pa.Table, np.ndarray]:
        rows = rows.sort_by(name)
        if not len(rows):
            return rows, np.zeros((0, 0))
        values = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
        norms = np.linalg.norm(values, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        return rows.filter(pa.array(good)), values[good] / norms[good, None]

    schema = f"{pair} {dict(source.dtypes)[pair]}, a {dict(source.dtypes)[key]}, b {dict(target.dtypes)[key]}, score double"

    def near_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, score) of the first ``k`` columns of each row, from tiles of the product."""
        found = []
        for at in range(0, len(y), 4096):
            score = np.round(x @ y[at : at + 4096].T, digits)
            good = score >= least
            if score.shape[1] > k:
                good &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            row, column = np.nonzero(good)
            found.append((row, column + at, score[row, column]))
        row, column, value = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[first], column[first], value[first]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, x), (b, y) = matrix(left, "a"), matrix(right, "b")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(a) if len(b) else 0, block):
            row, column, value = near_rows(x[at : at + block], y)
            found.append((row + at, column, value))
        row, column, value = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({pair: a.column(pair).take(pa.array(row)), "a": a.column("a").take(pa.array(row)), "b": b.column("b").take(pa.array(column)), "score": value})

    blocks = [*keys, "_a", "_b"]
    near = dealt["a"].groupBy(*blocks).cogroup(dealt["b"].groupBy(*blocks)).applyInArrow(kernel, schema)
    return first_per_key(near, [pair, "a"], [F.desc("score"), "b"], k)


def align(source: DataFrame, target: DataFrame, pair: str, key: str, vector: str, k: int = 20, least: float = 0.35, accept: int = 3, verdict: Callable[[Column, Column, Column], Column] | None = None, block: int = 1024) -> DataFrame:
    """For each source chunk the first ``accept`` accepted of its ``k`` nearest target chunks.

    Both sides carry ``pair``, the pair of texts to compare.  ``verdict`` (a column of booleans
    from the two keys and the score) judges candidates in score order; it accepts all if absent.
    """
    near = nearest_of_blocks(source, target, pair, key, vector, k, least, block)
    good = near if verdict is None else near.filter(verdict(F.col("a"), F.col("b"), F.col("score")))
    return first_per_key(good, [pair, "a"], [F.desc("score"), "b"], accept)


def within_budget(calls: DataFrame, order: Sequence[str], cost: Column, ceiling: float) -> DataFrame:
    """The calls, in order, whose running cost stays within the ceiling."""
    return running_total(calls, order, cost, "spent").filter(F.col("spent") <= ceiling)


def merged_top_k(chunks: DataFrame, vector: str, query: Sequence[float], key: str, language: str, budgets: Sequence[tuple[str, int]]) -> DataFrame:
    """Top-k of each language by its own budget, merged by score; ties keep the order of the languages."""
    k = F.create_map(*[F.lit(x) for pair in budgets for x in pair])
    turn = F.create_map(*[F.lit(x) for i, (lang, _) in enumerate(budgets) for x in (lang, i)])
    scored = chunks.filter(F.col(language).isin([lang for lang, _ in budgets])).withColumn("score", V.cosine(F.col(vector), V.literal(query)))
    most = max(n for _, n in budgets)
    rank = F.row_number().over(Window.partitionBy(language).orderBy(F.desc("score"), key))
    near = scored.withColumn("_rank", rank).filter(F.col("_rank") <= most).filter(F.col("_rank") <= k[F.col(language)])
    return near.orderBy(F.desc("score"), turn[F.col(language)], key).drop("_rank")


def attach_parallels(hits: DataFrame, pairs: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """For (text, chapter, chunk) hits, up to ``most`` aligned chunks by confidence as an array.

    ``pairs`` has a_/b_ keys and confidence; a pair without a chunk on either side is ignored.
    ``texts`` has text, chapter, chunk and content.
    """
    names = ["text", "chapter", "chunk"]
    turn = lambda x, y: pairs.select(*[F.col(f"{x}_{n}").alias(n) for n in names], *[F.col(f"{y}_{n}").alias(f"o_{n}") for n in names], "confidence")
    both = turn("a", "b").unionByName(turn("b", "a")).filter(F.col("chunk").isNotNull() & F.col("o_chunk").isNotNull())
    near = both.join(hits.select(*names).distinct(), names, "left_semi")
    near = first_per_key(near, names, [F.desc("confidence"), "o_text", "o_chapter", "o_chunk"], most)
    other = texts.select(*[F.col(n).alias(f"o_{n}") for n in names], "content")
    full = near.join(other, [f"o_{n}" for n in names])
    listed = full.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "o_text", "o_chapter", "o_chunk", "content"))).alias("parallels"))
    return hits.join(listed, names, "left")
