"""Jaccard join of word shingles with Bayesian candidate pruning.

Documents are sets of ``shingle`` consecutive words.  Documents with equal sets are one class,
known by a 64-bit hash of its set and not by an id, which several texts may have.
Candidates share a band of MinHash values (32 bands of 5: a pair at 0.8 shares none with
probability 3e-6).  A candidate's MinHash values are compared in rounds; it is dropped as
soon as the posterior probability that its similarity reaches the threshold, given the
matches so far and a uniform prior, falls below ``tolerance``.  Those left are verified on their
whole sets.

Buckets of several bands with the same members are compared once, and a pair only in the
least bucket it shares.  A large bucket is cut into blocks that are compared two by
two, by signatures alone.  Whole sets are sent only to those members of a block that have a pair
left there.  What leaves a block is a link count and a spanning link for each document, never pairs.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chars_grouped, documents, forget, stored
from .components import components, roots

NO_ID = -(1 << 63)
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20240131)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_MIX = (_RNG.integers(0, 1 << 62, ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)).astype(np.uint64)


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a shorter text is one shingle, an empty one none."""
    own = words.word_hashes(text)
    return np.unique(words.run_hashes(own, min(size, len(own)))) if len(own) else np.zeros(0, np.uint64)


def minhash(shingle_set: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = (x[None, at : at + 2048] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def fewest_matches(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches is dropped.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its mass
    above t is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance or m == n:
                break
            m += 1
        out.append((n, m))
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, set_key (128 bits of the shingle set), n_shingles and signature of each row."""

    def run(batches):
        forget()
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            keys, counts, signatures = [], [], []
            for text in texts:
                own = shingles(text, size)
                counts.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signatures.append(minhash(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "th", "set_key", "n_shingles", "signature"])

    return docs.mapInArrow(run, "doc_id long, th long, set_key binary, n_shingles long, signature binary")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The 64-bit key of each band of each signature."""
    values = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = words.mixed((words.mixed(values + np.uint64(1)) * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :])
    return key.view(np.int64)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): one row for each band of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key = keys_of(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long")


def buckets(bands: DataFrame) -> DataFrame:
    """(key, n, rep): members of the buckets to compare; of buckets with equal members the one of least key."""
    hashed = F.xxhash64("rep")
    sums = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.sum(hashed % 1_000_000_007).alias("sum"), F.bit_xor(hashed).alias("xor")).filter("n > 1")
    kept = sums.groupBy("n", "least", "most", "sum", "xor").agg(F.min("key").alias("key")).select("key", "n")
    return bands.join(kept, "key")


def _verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by whole sets."""
    sizes = np.array([len(s) for s in sets])
    both = np.zeros(len(left), np.int64)
    if len(left) <= 4 * len(sets):
        for p, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both[p] = int((b[at] == a).sum())
    else:  # a dense block: shared shingles as columns, some at a time
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count > 1
        renumbered = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], renumbered[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        product = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            product += part @ part.T
        both = product[left, right].astype(np.int64)
    return both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9


class Blocks:
    """Rows of whole blocks, held until there are enough of them to be compared together."""

    def __init__(self, rows: int = 1024, size: int = 32_000_000):
        self.rows, self.size, self.held = rows, size, []

    def grouped(self, batches):
        """Arrow tables of whole (key, x, y) groups; rows of one group follow each other."""
        held, rows, size = [], 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.append(True, _changed(batch)) if n > 1 else np.array([True])
            if held and _group(held[-1], held[-1].num_rows - 1) == _group(batch, 0):
                fresh[0] = False
            at = 0
            bytes_each = batch.nbytes / n
            for cut in np.flatnonzero(fresh).tolist():
                if rows + cut - at >= self.rows or size + (cut - at) * bytes_each > self.size:
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    if held:
                        yield pa.Table.from_batches(held).combine_chunks()
                    held, rows, size, at = [], 0, 0, cut
            held.append(batch.slice(at))
            rows, size = rows + n - at, size + (n - at) * bytes_each
        if held:
            yield pa.Table.from_batches(held).combine_chunks()


def _changed(batch) -> np.ndarray:
    columns = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def _group(batch, row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in ("key", "x", "y"))


def surviving(rows: pa.Table, rounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places of rows) of each group that outlive every round and have no lesser key in common.

    In a block of x = y all pairs are compared, else those of side 0 with side 1.
    """
    fresh = np.append(True, _changed(rows)) if len(rows) > 1 else np.array([True])
    starts = np.append(np.flatnonzero(fresh), len(rows))
    side, rep = rows["side"].to_numpy(), rows["rep"].to_numpy()
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
    own, kept_keys = rows["key"].to_numpy(), pc.unique(pc.list_flatten(rows["keys"])).to_numpy()
    keys = keys_of(signature)
    known = np.isin(keys, kept_keys)
    pairs = starts[:-1][np.diff(starts) == 2]
    some = [(pairs, pairs + 1)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 2:
            cut = a + int(np.searchsorted(side[a:b], 1))
            i, j = np.indices((cut - a, b - cut)).reshape(2, -1) if cut < b else np.triu_indices(b - a, 1)
            some.append((i + a, j + (cut if cut < b else a)))
    lefts, rights = [], []
    for all_left, all_right in some:
        for at in range(0, len(all_left), 1 << 18):
            left, right = all_left[at : at + (1 << 18)], all_right[at : at + (1 << 18)]
            other = rep[left] != rep[right]
            left, right = left[other], right[other]
            matches, done = np.zeros(len(left), np.int32), 0
            for n, least in rounds:
                matches += (signature[left, done:n] == signature[right, done:n]).sum(axis=1, dtype=np.int32)
                go = matches >= least
                left, right, matches, done = left[go], right[go], matches[go], n
            for p in range(0, len(left), 1 << 15):
                i, j = left[p : p + (1 << 15)], right[p : p + (1 << 15)]
                shared = (keys[i] == keys[j]) & known[i]
                mine = np.where(shared, keys[i], np.iinfo(np.int64).max).min(axis=1) == own[i]
                lefts.append(i[mine])
                rights.append(j[mine])
    return np.concatenate(lefts) if lefts else np.zeros(0, int), np.concatenate(rights) if rights else np.zeros(0, int)


def candidates(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The members (key, x, y, side, rep, ...) that have a pair left in their block, by signatures alone."""
    rounds = fewest_matches(threshold, tolerance)

    def run(batches):
        forget()
        for rows in Blocks(rows=4096).grouped(batches):
            left, right = surviving(rows, rounds)
            if len(left):
                yield from rows.take(pa.array(np.unique(np.concatenate((left, right))))).combine_chunks().to_batches()

    return members.mapInArrow(run, members.schema)


def compare(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, links, root) of the blocks of candidates, which have their whole ``set`` beside them."""
    rounds = fewest_matches(threshold, tolerance)

    def run(batches):
        forget()
        for rows in Blocks().grouped(batches):
            left, right = surviving(rows, rounds)
            if not len(left):
                continue
            used, at = np.unique(np.concatenate((left, right)), return_inverse=True)
            i, j = at[: len(left)], at[len(left) :]
            sets = [np.frombuffer(x, np.uint64) for x in rows["set"].take(pa.array(used)).to_pylist()]
            good = _verified(sets, i, j, threshold)
            i, j = i[good], j[good]
            if not len(i):
                continue
            weight = rows["n"].to_numpy()[used].astype(np.float64)
            links = np.bincount(i, weight[j], len(used)) + np.bincount(j, weight[i], len(used))
            reps, where = np.unique(rows["rep"].to_numpy()[used], return_inverse=True)
            root = reps[roots(len(reps), where[i], where[j])]
            total = np.bincount(where, links, len(reps)).astype(np.int64)
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(total[some]), pa.array(root[some])], names=["rep", "links", "root"])

    return members.mapInArrow(run, "rep long, links long, root long")


def similar_documents(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-5, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept: one row for each input row.

    class_id is the smallest doc_id with the same shingle set; n_links counts the other rows whose
    set has a Jaccard similarity of ``threshold`` or more, copies included; component_id is
    the smallest doc_id reachable by links; kept marks that document.  A null or empty text
    has no shingles and links with nothing; a text of fewer than ``shingle`` words is one
    shingle.  A null doc_id comes before all others; rows repeated with one doc_id and
    text are copies of each other and are kept or not alike; other texts of one doc_id are
    documents of their own, of which one in a group is kept.  With ``hashed``, th (xxhash64 of
    the text) tells them apart.  An empty table gives no rows.
    """
    plain = documents(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    rows = stored(sketches(plain, shingle), "sketches")
    counted = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature"))
    classes = stored(counted.withColumn("rep", F.xxhash64("set_key")), "classes")
    bucketed = stored(buckets(band_keys(classes)), "buckets")
    lists = bucketed.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most 32
    named = classes.select("rep", F.col("n").alias("weight"), "signature").join(lists, "rep")

    def whole_sets(batches):
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([shingles(t, shingle).tobytes() for t in texts], pa.binary())], names=["rep", "set"])

    blocks = F.expr(f"cast((n + {block - 1}) div {block} AS int)")
    members = bucketed.join(named, "rep").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a member of block i meets the blocks from i on as x, and those before as y
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    placed = members.select("key", x.alias("x"), y.alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", F.col("weight").alias("n"), "keys", "signature")
    by_block = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    left = stored(candidates(by_block(placed), threshold, tolerance), "candidates")
    firsts = classes.join(left.select("rep").distinct(), "rep").select("first.doc_id", "first.th", "rep")  # one text of each class that is left
    sets = plain.join(firsts, ["doc_id", "th"]).select("rep", "text").mapInArrow(whole_sets, "rep long, set binary").dropDuplicates(["rep"])
    found = stored(compare(by_block(left.join(sets, "rep")), threshold, tolerance), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # components go by class; of each the class of the smallest doc_id is its head
    own = F.struct(F.col("first.doc_id").alias("doc_id"), "rep")
    members_of = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumns({"component": F.coalesce("component", "rep"), "own": own})
    heads = members_of.groupBy("component").agg(F.min("own").alias("head"))
    by_class = members_of.join(heads, "component").join(links, "rep", "left")
    by_class = by_class.select("set_key", F.col("own.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("head.doc_id").alias("component_id"), (F.col("head.rep") == F.col("rep")).alias("at_head"))
    out = rows.join(by_class, "set_key", "left")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    component = F.coalesce("component_id", "doc_id")
    kept = (component == F.col("doc_id")) & F.coalesce("at_head", F.lit(True))
    return out.select(real("doc_id").alias("doc_id"), real(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), kept.alias("kept"), *(["th"] if hashed else []))


def oracle_sql(threshold: float = 0.8, shingle: int = 5) -> str:
    """DuckDB SQL over documents with unique ids."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, k + 1, k + {shingle}), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {shingle - 1}, 1))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, ' ' ORDER BY g)) AS k FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links, r.m AS component_id, r.m = d.doc_id AS kept
FROM documents d LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n) c USING (doc_id)
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
