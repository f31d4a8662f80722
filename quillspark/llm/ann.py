"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``prefix`` nearest pivots and posted, with its place
in that order, in the inverted file of each of them.  A query reads the files of its own
nearest pivots only and adds up the footrule distance from what is posted there: of a pivot
that both orders hold the difference of places, of any other the places cut off at
``prefix``; what is left of that sum for a vector, less the same constant for all, is its
``prefix - max(place, place)`` over the files in which it is met.  The ``rerank`` share of a
block that is nearest by footrule is ranked by the exact inner product.

Vectors are dealt in blocks of bounded size with files of their own, and queries too, so
memory in a task is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector array<double> of the vectors that can be compared: not null, empty or zero, all components finite."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = "forall(vector, x -> x IS NOT NULL AND x = x AND abs(x) < double('infinity')) AND exists(vector, x -> x != 0)"
    return rows.filter(F.expr(finite))


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """``count`` vectors at most, from a bounded sample: the 4 * count distinct vectors of least hash."""
    hashed = rows.select("vector", F.xxhash64("vector").alias("h")).groupBy("h").agg(F.first("vector").alias("vector"))
    return chosen(np.array([r.vector for r in hashed.orderBy("h").limit(4 * count).collect()], np.float64), count)


def chosen(sample: np.ndarray, count: int, apart: float = 0.8) -> np.ndarray:
    """``count`` vectors of a sample at most.

    Of vectors with a cosine above ``apart`` only the first is taken, so that a crowd of near
    copies does not fill the orders with one pivot many times over.  Where too few are that far apart
    (vectors in narrow cones) the count is filled up from the rest, always with the one least
    like any taken.
    """
    unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    taken: list[int] = []
    for i in range(len(sample)):
        if len(taken) < count and (not taken or (unit[taken] @ unit[i]).max() <= apart):
            taken.append(i)
    if taken and len(taken) < count:
        nearest = (unit @ unit[taken].T).max(axis=1)
        nearest[taken] = np.inf
        while len(taken) < min(count, len(sample)):
            i = int(nearest.argmin())
            taken.append(i)
            nearest = np.maximum(nearest, unit @ unit[i])
            nearest[i] = np.inf
    return sample[taken]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The order of each vector's ``prefix`` nearest pivots (vectors x prefix), ties to the first pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """For each pivot the vectors that have it among their nearest, with its place in their order."""

    def __init__(self, near: np.ndarray, pivots: int):
        n, self.prefix = near.shape
        by_pivot = np.argsort(near.reshape(-1).astype(np.uint16), kind="stable")
        self.vector, self.place = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.start = np.append(0, np.cumsum(np.bincount(near.reshape(-1), minlength=pivots)))
        self.n = n

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """A constant less half the footrule distance of every vector to a query's order; 0 for one met in none of its files."""
        files = [slice(self.start[p], self.start[p + 1]) for p in order]
        met = np.concatenate([self.vector[f] for f in files])
        gain = np.concatenate([self.prefix - np.maximum(self.place[f], j) for j, f in enumerate(files)])
        return np.bincount(met, gain, self.n)


def ranked(ids: np.ndarray, vectors: np.ndarray, ask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and inner products of the ``k`` best, ties to the smaller id, each id once.

    A first product picks the finalists; their scores are summed again in one order, so that equal
    vectors have equal scores wherever they lie.
    """
    rough = vectors @ ask
    if len(rough) > 4 * k:
        cut = np.partition(rough, len(rough) - k)[len(rough) - k]
        distinct = k
        while True:  # more where an id repeats
            some = rough >= cut - 1e-9 * max(1.0, abs(cut))
            if len(np.unique(ids[some])) >= k or some.all():
                break
            distinct = min(2 * distinct, len(rough))
            cut = np.partition(rough, len(rough) - distinct)[len(rough) - distinct]
        ids, vectors = ids[some], vectors[some]
    score = (vectors * ask[None, :]).sum(axis=1)
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], score[order]


def search(table: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, prefix: int = 64, rerank: float = 0.2, least: int = 256, block: int = 8192, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query by inner product, its own row left out.

    Ties go to the smaller vec_id.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids; a query is compared with the vectors of its own
    length.  Rows repeated with one id count once, by their largest score.  Fewer
    candidates than ``k`` give fewer rows; an empty table none.  The index is fitted on
    a sample of 4 * ``pivots`` vectors, that of unusual lengths on as many of each block; every vector is indexed.  Of each block the ``rerank``
    share and ``least`` vectors at least are reranked.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col).filter("vec_id IS NOT NULL")
    asked = usable(queries, id_col, vector_col).filter("vec_id IS NOT NULL")
    rows, asked = rows.withColumn("dim", F.size("vector")), asked.withColumn("dim", F.size("vector"))
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    usual = sizes[0]["dim"]
    shared = spark.sparkContext.broadcast(pivots_of(rows.filter(F.col("dim") == usual), pivots))  # pivots x dim: a fixed size
    blocks = max(1, -(-rows.count() // block))
    query_blocks = max(1, -(-asked.count() // query_block))
    seat = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    query_seat = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    left = rows.select("dim", "vec_id", "vector", seat.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = asked.select("dim", "vec_id", "vector", query_seat.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def nearest(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(wanted):
            ids = index["vec_id"].to_numpy()
            vectors, asks = np.stack(index["vector"].to_list()), np.stack(wanted["vector"].to_list())
            own_kind = int(index["dim"].iloc[0]) == usual
            points = shared.value if own_kind else chosen(vectors[np.argsort(ids, kind="stable")[: 4 * pivots]], pivots)
            depth = min(prefix, len(points))
            files = InvertedFiles(nearest_pivots(vectors, points, depth), len(points))
            keep = min(len(ids), max(least, 4 * k, int(rerank * len(ids))) + 1)
            for own, ask, order in zip(wanted["vec_id"].to_numpy(), asks, nearest_pivots(asks, points, depth), strict=True):
                close = files.closeness(order)
                some = np.argpartition(-close, keep - 1)[:keep] if keep < len(ids) else np.arange(len(ids))
                some = some[ids[some] != own]
                best, score = ranked(ids[some], vectors[some], ask, k)
                found.append(pd.DataFrame({"query_id": own, "vec_id": best, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    right = right.toDF(*right.columns)  # fresh column ids: both sides may come from the same rows
    near = right.groupBy("dim", "b", "q").cogroup(left.groupBy("dim", "b", "q")).applyInPandas(lambda wanted, index: nearest(index, wanted), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows of each block
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
