"""Packing by power-of-two decomposition: every piece is a sequence of binary length.

A document of n tokens is cut into pieces whose lengths are the powers of two of n's binary
form (with as many pieces of ``max_len`` as fit first).  Each piece is a sequence of its own,
so no sequence crosses documents and none needs padding.  Equal lengths share a bucket;
a batch is made of rows of one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import binary_rows, cached_library_encoder, ended
from .common import documents, give_back, sized

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


def pieces(tokens: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of the pieces of documents of ``tokens`` ids: n // max_len full ones, then the set bits of the rest."""
    sizes = max_len >> np.arange(max_len.bit_length())
    counts = np.concatenate((tokens[:, None] // max_len, (tokens[:, None] & sizes[None, 1:]) != 0), axis=1)
    return np.repeat(np.arange(len(tokens)), counts.sum(axis=1)), np.repeat(np.tile(sizes, len(tokens)), counts.reshape(-1))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """One row for each piece, with its packed little-endian unsigned 32-bit ``ids``.

    ``start`` counts the document's ids before the piece; ``sequence_id`` is unique over the
    result and orders sequences by bucket; ``offset`` is 0, as a sequence is one piece.
    A null or empty text is its end id alone.  A null doc_id stays null; repeated rows are
    packed each on its own; an empty table gives no rows; other columns are left out.
    No shuffle: each task numbers its sequences under its partition's number.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches):
        give_back()
        encoder = cached_library_encoder(tokenizer_path, True)
        give_back()  # what reading the vocabulary took
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 34
        made = np.zeros(max_len.bit_length(), np.int64)
        for batch in sized(batches, "text", batch_bytes):
            ids, tokens = ended(*encoder.encode(batch.column("text")), end_id)
            row, length = pieces(tokens, max_len)
            bucket = np.log2(length).astype(np.int64)
            before = np.cumsum(length) - length
            order = np.argsort(bucket, kind="stable")
            count = np.bincount(bucket, minlength=len(made))
            turn = np.empty(len(row), np.int64)  # how many of its bucket come before it
            turn[order] = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = bucket << 58 | base | made[bucket] + turn
            made += count
            starts = before - (np.cumsum(tokens) - tokens)[row]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(starts), pa.array(length), pa.array(tokens[row]), pa.array(sequence), pa.array(np.zeros(len(row), np.int64)), pa.array(bucket.astype(np.int32)), binary_rows(ids, length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids"])
            del ids, columns
            give_back()  # a worker of the pipeline shares its executor with those of the stages before

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces with one folder for each length, so that a reader draws equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
