"""Periodic runs of words by bit-parallel lags.

A run is a stretch of words whose smallest period is q (words q apart are identical), at least
``max(least, copies * q)`` words long, that no neighbouring word extends keeping the period q.

The ids of a document's words are held as bit planes, one big integer for each bit.  For a lag q
each plane is XORed with itself shifted by q and the results are ORed: what stays zero are the
places that agree with the word q further on.  ANDs with shifts that double leave only the starts
of stretches of agreement long enough for a run.  A stretch found at a multiple of its smallest
period spans the same words as the run of that period, so the first lag that gives a stretch is its period.

Lags are screened first, so that long texts do not pay for all of them: for lags from B to
2B - 1 (B a power of two) a run's agreement covers ``copies - 2`` aligned blocks of B words at
least, so only lags at which that many blocks in a row have the hash of the words one lag on are looked
at.  That takes one comparison for each word and B, a hash can only let too many lags pass, and
periods already found are set aside; by the bound on the repetitions of a text some sqrt(n) lags are left of n / copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, sized
from .words import joined, mixed, split_texts

_MIX = np.uint64(0xD1342543DE82EF95)


def planes_of(codes: np.ndarray) -> list[int]:
    """The bits of word ids as big integers: bit i of plane b is bit b of the i-th word's id."""
    distinct, ids = np.unique(codes, return_inverse=True)
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range((len(distinct) - 1).bit_length())]


def stretches(planes: list[int], n: int, lag: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each maximal set of consecutive starts of ``length`` words that equal those ``lag`` further on."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    agree, have = ~differ & ((1 << (n - lag)) - 1), 1
    while have < length and agree:
        step = min(have, length - have)
        agree &= agree >> step
        have += step
    if not agree:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(agree.to_bytes((n - lag + 7) // 8, "little"), np.uint8), bitorder="little")
    edges = np.diff(np.concatenate(([0], bits, [0])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def periodic_stretches(codes: np.ndarray, sizes: np.ndarray, copies: int = 4, least: int = 6) -> np.ndarray:
    """Rows (document, start, length, period) of the runs of many documents, in that order.

    ``codes`` are the word ids of all documents in turn, ``sizes`` the number of words of each.
    """
    if copies < 3:
        raise ValueError("copies must be 3 or more")
    n, first = len(codes), np.append(0, np.cumsum(sizes))
    at = first[:-1] + np.arange(len(sizes))  # one symbol of its own stands between documents
    symbols = np.empty(n + len(sizes), np.uint64)
    own = np.ones(len(symbols), bool)
    own[at + sizes] = False
    symbols[own], symbols[~own] = codes, np.arange(len(sizes)) + (int(codes.max()) + 1 if n else 0)
    hashes, block = mixed(symbols + np.uint64(1)), 1
    planes: dict[int, list[int]] = {}
    found: dict[tuple[int, int, int], int] = {}
    longest = int(sizes.max()) if len(sizes) else 0
    while max(least, copies * block) <= longest:
        rows = -(-(len(hashes) - block) // block)
        ahead = np.concatenate((hashes[block:], np.zeros(rows * block - (len(hashes) - block), np.uint64))).reshape(rows, block)
        equal = ahead == hashes[: rows * block : block, None]
        for (doc, start, end), period in found.items():  # what a smaller period explains at its multiples
            if end - start >= 3 * block:
                equal[-(-(at[doc] + start) // block) : max((at[doc] + end) // block - 2, 0), -block % period :: period] = False
        hit = equal
        for i in range(1, copies - 2):
            hit = hit[:-1] & equal[i : i + len(hit) - 1]
        j, lag = np.nonzero(hit)
        doc, lag = np.searchsorted(at, j * block, "right") - 1, lag + block
        for d, q in sorted(set(zip(doc.tolist(), lag.tolist(), strict=True))):
            size, need = int(sizes[d]), max(least, copies * q)
            if need > size:
                continue
            if d not in planes:
                planes = {d: planes_of(codes[first[d] : first[d + 1]])}
            for s, e in zip(*map(np.ndarray.tolist, stretches(planes[d], size, q, need - q)), strict=True):
                found.setdefault((d, s, e + need), q)
        hashes = mixed(hashes[:-block] * _MIX + hashes[block:]) if len(hashes) > block else hashes[:0]
        block *= 2
    out = sorted((d, s, e - s, q) for (d, s, e), q in found.items())
    return np.array(out, np.int64).reshape(-1, 4)


_SCHEMA = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"


def periodic_runs(docs: DataFrame, copies: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """For each row: doc_id, n_words, its runs by start and period, and the text with every run cut to its first period.

    Words are runs of bytes that are no ASCII white space; a word goes if any run contains it after that
    run's first period, and those that stay are joined by one space.  A null or empty text has
    no words and no runs and gives an empty text; a null doc_id stays null; repeated rows are each
    answered; other columns are ignored.  An empty table gives no rows.  Memory is some 100 bytes for each word of a batch
    (``batch_bytes`` of text, or one text that is longer).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", batch_bytes):
            words, doc, _, _ = split_texts(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            sizes = np.bincount(doc, minlength=batch.num_rows)
            runs = periodic_stretches(codes, sizes, copies, least)
            begin = (np.cumsum(sizes) - sizes)[runs[:, 0]] + runs[:, 1]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, begin + runs[:, 3], 1)
            np.add.at(cover, begin + runs[:, 2], -1)
            stays = np.cumsum(cover)[:-1] == 0
            kept = joined(words.filter(pa.array(stays)), np.bincount(doc[stays], minlength=batch.num_rows))
            offsets = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=batch.num_rows)))
            spans = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), kept], ["doc_id", "n_words", "runs", "text"])

    return documents(docs, id_col, text_col).mapInArrow(search, _SCHEMA)
