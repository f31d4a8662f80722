"""A written vector index: vectors in folders by their nearest centre, and what is known of each folder.

Centres are fitted by spherical k-means on a bounded sample of unit vectors; every vector is written to the cell of its nearest
centre.  A query reads the cells nearest to it (partition pruning) and ranks their vectors exactly.  Beside each
centre stands the smallest cosine of its members with it, which bounds what a cell can hold: the exact search ranks the
nearest cells and then reads only the cells that may hold a vector as near as the k-th found.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .vector import top_k


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction (finite, not zero)."""
    norms = np.linalg.norm(rows, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return np.where(good[:, None], rows / np.where(good, norms, 1.0)[:, None], 0.0), good


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means; first centres are taken far from those before, by chance."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    gap = 1.0 - sample @ centres[0]
    while len(centres) < cells and gap.max() > 1e-9:
        weight = np.clip(gap, 0, None)
        centres.append(sample[rng.choice(len(sample), p=weight / weight.sum())])
        gap = np.minimum(gap, 1.0 - sample @ centres[-1])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        moved, good = unit(sums)
        centres = np.where(good[:, None], moved, centres)
    return centres


def write_cells(vectors: DataFrame, key: str, vector: str, path: str, cells: int = 64, sample: int = 16_384) -> None:
    """Write the index of ``vectors`` (all their columns) under ``path``.

    Centres are fitted on ``sample`` rows at most, those of least hash of the key.  Vectors without a direction, and those not as long as
    the centres, stand in cell -1, which the searches always read.
    """
    spark = vectors.sparkSession
    usual = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = usual.d if usual else 0
    chosen = vectors.filter((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).select(key, vector, F.xxhash64(key).alias("_h")).orderBy("_h", key).limit(sample).toArrow()
    flat = chosen.column(vector).combine_chunks()
    rows, good = unit(flat.flatten().to_numpy().astype(float).reshape(-1, size)) if len(flat) else (np.zeros((0, size)), np.zeros(0, bool))
    centres = fitted_centres(rows[good], cells) if good.any() else np.zeros((0, size))

    @F.pandas_udf("cell int, near double")
    def nearest(values: pd.Series) -> pd.DataFrame:
        fit = np.array([v is not None and len(v) == size for v in values], bool) & bool(len(centres))
        cell, near = np.full(len(values), -1, np.int32), np.full(len(values), np.nan)
        if fit.any():
            x, straight = unit(np.stack(values[fit].to_list()).astype(float))
            score = x @ centres.T
            best = score.argmax(axis=1)
            cell[fit] = np.where(straight, best, -1)
            near[fit] = np.where(straight, score[np.arange(len(best)), best], np.nan)
        return pd.DataFrame({"cell": cell, "near": near})

    placed = vectors.withColumn("_c", nearest(F.col(vector))).withColumns({"cell": F.col("_c.cell"), "near": F.col("_c.near")}).drop("_c")
    # a crowded cell is written by several tasks
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(placed.select(*[c for c in placed.columns if c != "cell"], "cell").schema.json(),)], "json string").write.parquet(f"{path}/schema")
    least = {r.cell: (r.least, r.n) for r in _rows(spark, path).groupBy("cell").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n")).collect()}  # one row for each cell
    known = [(i, c.tolist(), *least.get(i, (None, 0))) for i, c in enumerate(centres)]
    spark.createDataFrame(known, "cell int, centre array<double>, least double, n long").coalesce(1).write.parquet(f"{path}/cells")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first().json))).parquet(f"{path}/vectors")


class Cells:
    """The index under a path, for searches."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str):
        self.key, self.vector = key, vector
        self.rows = _rows(spark, path).drop("near")
        self.cells = [r for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect() if r.n]  # as many as were asked for

    def order(self, query: Sequence[float]) -> list[tuple[int, float]]:
        """Cells, nearest first, with the largest cosine that a member of each can have."""
        q, good = unit(np.array([query], float))
        if not good[0] or not self.cells:
            return [(r.cell, 1.0) for r in self.cells]
        near = np.clip(np.array([r.centre for r in self.cells]) @ q[0], -1, 1)
        radius = np.arccos(np.clip([r.least for r in self.cells], -1, 1))
        bound = np.cos(np.maximum(0.0, np.arccos(near) - radius))
        return [(self.cells[i].cell, float(bound[i])) for i in np.argsort(-near, kind="stable")]

    def near(self, query: Sequence[float], probes: int) -> DataFrame:
        """The vectors of the ``probes`` nearest cells: candidates for any search by cosine."""
        return self.rows.filter(F.col("cell").isin([-1, *(c for c, _ in self.order(query)[:probes])]))

    def top_k(self, query: Sequence[float], k: int, probes: int | None = None, where: Column | None = None, least: float | None = None, first: int = 4) -> DataFrame:
        """The ``k`` nearest by cosine that pass the filter: of the nearest ``probes`` cells, or of all (exactly), reading only cells that can hold one."""
        if probes is not None:
            return top_k(self.near(query, probes), self.vector, query, k, self.key, where, least)
        sure = [r.score for r in top_k(self.near(query, first), self.vector, query, k, self.key, where, least).select("score").collect()]
        floor = max(sure[-1] if len(sure) == k else -1.0, -1.0 if least is None else least) - 1e-9
        may = [c for c, bound in self.order(query) if bound >= floor]
        return top_k(self.rows.filter(F.col("cell").isin([-1, *may])), self.vector, query, k, self.key, where, least)
