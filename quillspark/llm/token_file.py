"""Token files: patched frame-of-reference blocks of ids, written and read by Spark.

A segment holds the ids of consecutive documents.  Its image is, little-endian:

    magic "PFR1", u32 ids, u32 blocks, u32 exceptions
    block index: u32 start of each block's words, u32 first exception of each block (one more of each at the end)
    block heads: u32 minimum, u8 width
    packed words: u64, 2 * width for each block of 128 ids
    exceptions: u8 place in the block, u32 value less the minimum

The width of a block is what ``percentile`` of its values need; larger ones are exceptions.
Images are rows of a Parquet table (Spark's writer commits them atomically and reaches any
store), beside the ids and lengths of their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import binary_rows, cached_library_encoder, ended
from .common import documents, give_back, sized

BLOCK = 128
MAGIC = b"PFR1"
SEGMENT_SCHEMA = "part int, base long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, image binary"


def encode_segment(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """The image of an array of unsigned 32-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not blocks:
        return MAGIC + np.zeros(3, "<u4").tobytes() + np.zeros(2, "<u4").tobytes()
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    values = padded.reshape(blocks, BLOCK)
    low = values.min(axis=1)
    values = values - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    cut = np.partition(values, rank, axis=1)[:, rank].astype(np.float64)
    width = np.frexp(cut)[1].astype(np.uint8)  # bits of the cut value; 0 for 0
    limit = np.left_shift(np.uint64(1), width.astype(np.uint64))
    row, place = np.nonzero(values >= limit[:, None])
    patch = values[row, place]
    words_at = np.zeros(blocks + 1, np.uint32)
    np.cumsum(2 * width.astype(np.uint32), out=words_at[1:])
    patch_at = np.searchsorted(row, np.arange(blocks + 1)).astype(np.uint32)
    words = np.zeros(int(words_at[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            lanes = np.ascontiguousarray(values[own].T).astype(np.uint64) & np.uint64((1 << int(w)) - 1)
            packed = np.zeros((2 * int(w), len(own)), np.uint64)
            for i in range(BLOCK):
                at, shift = divmod(i * int(w), 64)
                packed[at] |= lanes[i] << np.uint64(shift)
                if shift + w > 64:
                    packed[at + 1] |= lanes[i] >> np.uint64(64 - shift)
            words[words_at[own][:, None] + np.arange(2 * int(w))] = packed.T
    return b"".join([MAGIC, np.array([n, blocks, len(patch)], "<u4").tobytes(), words_at.tobytes(), patch_at.tobytes(), low.astype("<u4").tobytes(), width.tobytes(), words.tobytes(), place.astype(np.uint8).tobytes(), patch.astype("<u4").tobytes()])


def decode_range(image: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids of an image from ``start`` on (all that follow without it).

    The block index tells where the blocks that hold them lie; no others are unpacked.
    """
    if image[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks, patches = np.frombuffer(image, "<u4", 3, 4).tolist()
    count = n - start if count is None else min(count, n - start)
    if count <= 0:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, (start + count - 1) // BLOCK + 1
    index = 16
    heads = index + 8 * (blocks + 1)
    packed_at = heads + 5 * blocks
    words_at, patch_at = (np.frombuffer(image, "<u4", last - first + 1, index + 4 * (k * (blocks + 1) + first)).astype(np.int64) for k in (0, 1))
    low = np.frombuffer(image, "<u4", last - first, heads + 4 * first)
    width = np.frombuffer(image, np.uint8, last - first, heads + 4 * blocks + first)
    all_words = int(np.frombuffer(image, "<u4", 1, index + 4 * blocks)[0])
    words = np.frombuffer(image, "<u8", int(words_at[-1] - words_at[0]), packed_at + 8 * int(words_at[0]))
    exceptions = packed_at + 8 * all_words
    some = int(patch_at[-1] - patch_at[0])
    place = np.frombuffer(image, np.uint8, some, exceptions + int(patch_at[0]))
    patch = np.frombuffer(image, "<u4", some, exceptions + patches + 4 * int(patch_at[0]))
    words_at -= words_at[0]
    values = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = np.ascontiguousarray(words[words_at[own][:, None] + np.arange(2 * int(w))].T)
            lanes = np.empty((BLOCK, len(own)), np.uint32)
            mask = np.uint64((1 << int(w)) - 1)
            for i in range(BLOCK):
                bit, shift = divmod(i * int(w), 64)
                v = packed[bit] >> np.uint64(shift)
                if shift + w > 64:
                    v = v | packed[bit + 1] << np.uint64(64 - shift)
                lanes[i] = v & mask
            values[own] = lanes.T
    values[np.repeat(np.arange(last - first), np.diff(patch_at)), place] = patch
    return (values + low[:, None]).reshape(-1)[start - first * BLOCK :][:count]


def decode_segment(image: bytes) -> np.ndarray:
    """All ids of an image."""
    return decode_range(image)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment_ids: int = 1 << 20, percentile: float = 90.0, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4_000_000) -> None:
    """Encode every text, append the end id, and write segments in ascending doc_id order.

    The documents are range-partitioned by doc_id, so parts follow one another; in a part,
    segments do.  Nulls sort first; rows of equal doc_id follow by a hash of their text.  A null text
    is its end id alone.  A document lies in one segment.  An empty table writes no segment.
    """

    def run(batches):
        encoder = cached_library_encoder(tokenizer_path, False)
        context = TaskContext.get()
        part, base = context.partitionId() if context else 0, 0
        held: list[tuple] = []

        def flush():
            nonlocal base, held
            ids, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            one = pa.array([0, len(sizes)], pa.int32())
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.ListArray.from_arrays(one, pa.concat_arrays([h[0] for h in held])), pa.ListArray.from_arrays(one, pa.array(sizes)), pa.array([len(ids)], pa.int64()), pa.array([encode_segment(ids, percentile)], pa.binary())],
                names=["part", "base", "doc_ids", "doc_tokens", "n_tokens", "image"],
            )
            base, held = base + len(ids), []
            return row

        total = 0
        for batch in sized(batches, "text", batch_bytes):
            ids, sizes = ended(*encoder.encode(batch.column("text")), end_id)
            ends, first, done = np.cumsum(sizes), 0, 0
            while first < len(sizes):  # up to the document that fills the segment
                last = min(int(np.searchsorted(ends, done + segment_ids - total)), len(sizes) - 1) + 1
                held.append((batch.column("doc_id").slice(first, last - first), ids[done : ends[last - 1]], sizes[first:last]))
                total += int(ends[last - 1]) - done
                first, done = last, int(ends[last - 1])
                if total >= segment_ids:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        give_back()

    keyed = documents(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))  # the range sample reaches the driver: no texts in it
    ordered = keyed.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids (packed u32).

    A segment knows the ids before it in its part.  The parts' own starts are one row for each
    partition of the write, a number its settings bound, so that table is broadcast; images
    are read where they lie, without a shuffle.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_base"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                image = batch.column("image")[i].as_py()
                doc_ids, sizes = batch.column("doc_ids")[i].values, batch.column("doc_tokens")[i].values.to_numpy()
                base = batch.column("base")[i].as_py()
                starts = np.cumsum(sizes) - sizes
                for at in range(0, len(sizes), 2000):
                    own = sizes[at : at + 2000]
                    ids = decode_range(image, int(starts[at]), int(own.sum()))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(own)), pa.array(base + starts[at : at + len(own)]), pa.array(own), binary_rows(ids, own)], names=["doc_id", "start", "n_tokens", "ids"])

    joined = segments.join(F.broadcast(parts), "part").select("doc_ids", "doc_tokens", (F.col("base") + F.col("part_base")).alias("base"), "image")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
