"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets the concatenated signs of random projections as a key;
vectors of a label are sorted by it and each is compared with the ``window`` that follow.
Pairs of at least the threshold's cosine are links, and their union over the passes gives the
groups.

What a pass may miss is known for each vector.  Two vectors at the threshold agree in a sign with probability
1 - arccos(threshold) / pi, and they meet if they share one sign more than the vector shares with those a
window before and behind it.  The product over the passes is the chance that a link stays unseen: it is large where
windows are full of unrelated vectors, as in narrow cones.  Vectors with a chance above ``missed`` are crowded, and so are those
to which an eighth of a window links in any pass, or whose links found by few passes tell that others were found by none
(Chao's estimate: of f1 links met in one pass and f2 in two, about f1 (f1 - 1) / 2 (f2 + 1) were missed).
All links of the crowded are found by comparing them with every vector of their label, block by block, with sums and
spanning links as the only output.  The number of passes follows from the largest label, so that evenly spread vectors
stay a tenth below that chance.

Equal vectors of a label are one class with a number of its own and a count; they are never
expanded, and what links are found between are these numbers, as several vectors may share an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components, roots

GROUP = ["label", "dim"]


def _scaled(vectors) -> np.ndarray:
    """Rows times powers of two, which round nothing, so that squares do not overflow."""
    x = np.array(list(vectors), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(vectors) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with that row of y, summed in one order."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y reach the threshold.

    The product of matrices rounds by place; pairs within rounding of the threshold are summed again, one by one.
    """
    cosine = _unit(x) @ _unit(y).T
    link = cosine >= threshold - 1e-12
    i, j = np.nonzero(link)
    near = cosine[i, j] < threshold + 1e-12
    i, j = i[near], j[near]
    if len(i):
        link[i, j] = _cosines(_scaled(x)[i], _scaled(y)[j]) >= threshold
    return link


def agreement(threshold: float) -> float:
    """The probability that two vectors at the threshold's cosine have one sign under a random projection."""
    return 1.0 - float(np.arccos(np.clip(threshold, -1.0, 1.0))) / np.pi


def passes_for(largest: int, threshold: float, window: int, missed: float) -> int:
    """So many passes that of evenly spread vectors, ``largest`` of a label, a tenth of ``missed`` stays unseen."""
    bits = max(0.0, np.log2(max(largest, 1) / window)) + 1.5
    return max(4, int(np.ceil(np.log(missed / 10) / np.log1p(-(agreement(threshold) ** bits)))))


def shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits of 63-bit keys are the same."""
    differ = (a ^ b).astype(np.uint64)
    high = (differ >> np.uint64(32)).astype(np.float64)  # each half is exact as a double
    low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    return 63 - length


def keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """The classes once for each pass, with that pass's 63-bit sort key."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys = np.zeros((passes, len(dims)), np.int64)
            vectors = batch.column("vector").to_pylist()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, 63 * passes))
                at = np.flatnonzero(dims == dim)
                signs = (_unit([vectors[i] for i in at]) @ planes[dim] > 0).reshape(len(at), passes, 63)
                keys[:, at] = (signs * weight).sum(axis=2).T
            for p in range(passes):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(dims), p, np.int32)), pa.array(keys[p])], names=[*batch.schema.names, "pass", "key"])

    return classes.mapInArrow(run, "label string, dim int, rep long, n long, vector array<double>, pass int, key long")


def window_links(classes: DataFrame, threshold: float, passes: int, window: int, seed: int, part_rows: int) -> DataFrame:
    """(a, b, crowded, unseen): links a - b found in the windows; a row with crowded set names a crowded vector in a, one with
    ``unseen`` the logarithm of the chance that this pass misses a link of a.

    Sorted parts are written with their rows' places, and each part reads the head of the
    next one after its own rows, so no window is cut at a part's end.
    """
    rows = classes.count() * passes
    parts = max(1, -(-rows // part_rows))
    ordered = keyed(classes, passes, seed).repartitionByRange(parts, "pass", *GROUP, "key", "rep").sortWithinPartitions("pass", *GROUP, "key", "rep")

    def numbered(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "place"])
            at += n

    schema = "label string, dim int, rep long, n long, vector array<double>, pass int, key long"
    sorted_rows = stored(ordered.mapInArrow(numbered, schema + ", part int, place long"), "passes")
    heads = sorted_rows.filter(F.col("place") < window)
    # Spark leaves no row to some parts; a head goes to the last part with rows before it
    used = sorted_rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row for each part
    before = used.withColumn("to", F.lag("part").over(Window.orderBy("part"))).select("part", "to")
    heads = heads.join(F.broadcast(before), "part").filter(F.col("to").isNotNull())
    work = sorted_rows.withColumn("to", F.col("part")).withColumn("head", F.lit(0)).unionByName(heads.withColumn("head", F.lit(1)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["head", "place"], kind="stable")
        own = int((pdf["head"].to_numpy() == 0).sum())
        group = pd.factorize(pd.MultiIndex.from_frame(pdf[["pass", "label", "dim"]]))[0]
        reps = pdf["rep"].to_numpy()
        left, right, crowded, unseen = [], [], [], []
        keys, agree = pdf["key"].to_numpy(), agreement(threshold)
        begins = not own or int(pdf["part"].iloc[0]) == 0  # else the first group may begin in the part before
        for g in np.unique(group[:own]):
            at = np.flatnonzero(group == g)
            vectors = np.stack(pdf["vector"].iloc[at])
            mine = int((at < own).sum())
            if not mine:
                continue
            ahead = np.full(len(at), -1)  # signs shared with the vector a window further on, none where there is none
            ahead[: max(len(at) - window, 0)] = shared_signs(keys[at[:-window]], keys[at[window:]])
            behind = np.full(len(at), -1)
            behind[window:] = ahead[: max(len(at) - window, 0)]
            chance = agree ** (np.maximum(ahead, behind)[:mine] + 1.0)
            if at[0] == 0 and not begins:
                chance[:window] = 0.0
            unseen.append(pd.DataFrame({"a": reps[at[:mine]], "b": reps[at[:mine]], "crowded": False, "unseen": pd.array(np.log(np.maximum(1.0 - chance, 1e-9)), "Float64")}))
            for s in range(0, mine, window):
                e = min(s + window, mine)
                i, j = np.nonzero(linked(vectors[s:e], vectors[s : e + window], threshold))
                ahead = (j > i) & (j <= i + window)
                i, j = i[ahead], j[ahead]
                full = np.bincount(i, minlength=e - s) >= max(1, window // 8)  # so dense that more links lie beyond
                crowded += reps[at[s:e][full]].tolist()
                some = ~full[i]
                left += reps[at[s + i[some]]].tolist()
                right += reps[at[s + j[some]]].tolist()
        links = pd.DataFrame({"a": left + crowded, "b": right + crowded, "crowded": [False] * len(left) + [True] * len(crowded), "unseen": pd.array([None] * (len(left) + len(crowded)), "Float64")})
        return pd.concat([x for x in (links, *unseen) if len(x)] or [links]).astype({"a": "int64", "b": "int64", "crowded": "bool"})

    return work.groupBy("to").applyInPandas(compare, "a long, b long, crowded boolean, unseen double")


def crowded_links(classes: DataFrame, crowded: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, links, root) from comparing the crowded with all vectors of their label.

    ``links`` counts a crowded vector's links to others, and another vector's links to crowded
    ones; ``root`` is a vector it hangs together with.  One row for a vector and block.
    """
    marked = classes.join(crowded, "rep", "left").withColumn("is_crowded", F.col("crowded").isNotNull())
    groups = marked.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("all"), F.count_if("is_crowded").alias("some")).filter("some > 0")
    seated = marked.join(groups, GROUP).withColumn("all_blocks", F.expr(f"cast((all + {block - 1}) div {block} AS int)")).withColumn("some_blocks", F.expr(f"cast((some + {block - 1}) div {block} AS int)"))
    hashed = F.xxhash64("rep", F.lit(3))
    every = seated.select(*GROUP, "rep", "n", "vector", "is_crowded", F.pmod(hashed, F.col("all_blocks")).alias("x"), F.explode(F.expr("sequence(0L, some_blocks - 1L)")).alias("y"))
    some = seated.filter("is_crowded").select(*GROUP, "rep", "n", "vector", F.pmod(hashed, F.col("some_blocks")).alias("y"), F.explode(F.expr("sequence(0L, all_blocks - 1L)")).alias("x"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        link = linked(np.stack(a["vector"]), np.stack(b["vector"]), threshold) & (ra[:, None] != rb[None, :])
        of_crowded = link @ b["n"].to_numpy()
        of_others = (a["n"].to_numpy() @ link) * ~b["is_crowded"].to_numpy()
        ids, at = np.unique(np.concatenate((ra, rb)), return_inverse=True)
        i, j = np.nonzero(link)
        root = ids[roots(len(ids), at[i], at[len(ra) + j])]
        out = pd.DataFrame({"rep": np.concatenate((ra, rb)), "links": np.concatenate((of_crowded, of_others)), "root": root[at]})
        return out[np.concatenate((link.any(axis=1), link.any(axis=0)))]

    by = [*GROUP, "x", "y"]
    # fresh column ids on one side: both come from the same rows
    every = every.toDF(*every.columns)
    return some.groupBy(*by).cogroup(every.groupBy(*by)).applyInPandas(compare, "rep long, links long, root long")


def _without(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """The pairs of which neither end is among the ``rep`` of ``some``."""
    for end in ("a", "b"):
        pairs = pairs.join(some.select(F.col("rep").alias(end)), end, "left_anti")
    return pairs


def near_duplicates(table: DataFrame, threshold: float = 0.98, passes: int | None = None, window: int = 128, missed: float = 0.01, seed: int = 11, part_rows: int = 16384, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is
    at least ``threshold``.  A vector that is null, empty, zero or holds null or non-finite
    components, a null label and a null id link with nothing; vectors of different
    lengths do not link.  Rows repeated with one id and vector link with each other as copies do; rows
    of one id with other vectors or labels are vectors of their own.
    component_id is the smallest id reachable, the row's own at least; kept marks that row.
    An empty table gives no rows.
    """
    labelled = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    valid = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND x = x AND abs(x) < double('infinity')) AND exists(vector, x -> x != 0)")
    counted = labelled.filter(valid).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # numbered once, as the table is written
    numbered = stored(counted.withColumns({"dim": F.size("vector"), "rep": F.monotonically_increasing_id()}), "vectors")
    classes = numbered.select("label", "dim", "rep", "n", "vector")
    if passes is None:
        largest = numbered.groupBy(*GROUP).count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 0, threshold, window, missed)
    found = stored(window_links(classes, threshold, passes, window, seed, part_rows), "found")
    unsure = found.filter("unseen IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("unseen").alias("s")).filter(F.col("s") > float(np.log(missed))).select("rep")
    dense = found.filter("crowded").select(F.col("a").alias("rep")).unionByName(unsure).distinct()
    met = found.filter("NOT crowded AND unseen IS NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    met = stored(_without(met, dense), "met")
    by_end = met.select(F.col("a").alias("rep"), "met").unionByName(met.select(F.col("b").alias("rep"), "met"))
    once = by_end.groupBy("rep").agg(F.count_if(F.col("met") == 1).alias("f1"), F.count_if(F.col("met") == 2).alias("f2"))
    missed = once.filter("f1 * (f1 - 1) >= f2 + 1").select("rep")  # half a link or more
    crowded = stored(dense.unionByName(missed).withColumn("crowded", F.lit(True)), "crowded")
    # links that touch a crowded vector are counted below, from all of them
    pairs = stored(_without(met, crowded).select("a", "b"), "pairs")
    dense = stored(crowded_links(classes, crowded, threshold, block), "dense")
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    sizes = classes.select(F.col("rep").alias("other"), "n")
    links = ends.join(sizes, "other").select("rep", F.col("n").alias("links")).unionByName(dense.select("rep", "links"))
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(pairs.unionByName(dense.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    members = numbered.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = members.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = members.join(heads, "component").join(links, "rep", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # a class of very many copies is one row on its side of the join
    rows = labelled.withColumn("label", F.when(valid, F.col("label")))
    out = rows.join(by_class, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def oracle_sql(threshold: float = 0.98) -> str:
    """DuckDB SQL over embeddings, for tables of valid vectors."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, (SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id) AS component_id, (SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id) = v.vec_id AS kept FROM v
"""
