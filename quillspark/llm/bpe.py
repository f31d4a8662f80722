"""Byte-level BPE from a rank file: encoding by a hierarchical-bitmap rank queue, and decoding.

The bytes of a pre-token are linked to their neighbours.  Each merge rank has a bucket of
positions whose pair would merge at that rank; a bitmap of bitmaps marks the buckets in use.
Find-first-set gives the lowest rank, entries whose pair has changed since are skipped, and
what a merge makes is put in its own bucket.

The short pre-tokens of a batch share one queue: a bucket is emptied in one go, as array
operations.  A pre-token of more than ``LONG`` bytes has a queue of its own, whose buckets are heaps that
give the leftmost place first, so its time follows the number of its merges.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder, Ids, binary_rows, flattened, gathered
from .common import documents, give_back, kept, sized

NONE = 1 << 30
LONG = 256


class RankBitmap:
    """A set of ranks with find-first-set: each level marks the words in use of the level below."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            rank, bit = rank >> 6, rank & 63
            was = level[rank]
            level[rank] = was | 1 << bit
            if was:
                return

    def discard(self, rank: int) -> None:
        for level in self.levels:
            rank, bit = rank >> 6, rank & 63
            level[rank] &= ~(1 << bit)
            if level[rank]:
                return

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank


class Merger:
    """Merges of one rank table, for many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [NONE], np.int64)
        self.keys = np.append(self.keys, np.int64(-1) & np.int64((1 << 62) - 1))
        lowest = np.full(self.size, NONE, np.int64)
        for side in (self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF):
            np.minimum.at(lowest, side, self.merged[:-1])
        # no pair that holds the token merges before the token itself: all its places can be merged in one go
        self.together = (lowest > np.arange(self.size)).tolist()

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each byte string."""
        return binary_rows(*self.ids(words)).to_pylist()

    def ids(self, words: list[bytes]) -> Ids:
        """Flat ids of byte strings and the number of ids of each."""
        whole = [self.ranks.get(w) for w in words]
        parts, order = [flattened([[r] for r in whole if r is not None])], [i for i, r in enumerate(whole) if r is not None]
        rest = [i for i, r in enumerate(whole) if r is None]
        short = [i for i in rest if 0 < len(words[i]) <= LONG]
        if short:
            sizes = np.array([len(words[i]) for i in short])
            data = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
            ids, alive, word = self._merge(self.byte_ids[data], sizes)
            parts.append((ids[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(short))))
            order += short
        for i in rest:
            if not 0 < len(words[i]) <= LONG:
                one = self._merge_long(words[i])
                parts.append((one, np.array([len(one)])))
                order.append(i)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return gathered(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), place)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one byte string, by a queue whose buckets are heaps of places."""
        start = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(start)
        rank = np.append(self._pair(start[:-1], start[1:]), NONE) if n else start
        places = np.flatnonzero(rank < NONE)
        places = places[np.argsort(rank[places], kind="stable")]
        heads = np.flatnonzero(np.append(True, np.diff(rank[places]) > 0)) if len(places) else places
        buckets, used = {}, RankBitmap(self.size)
        for r, part in zip(rank[places[heads]].tolist(), np.split(places, heads[1:]), strict=True) if len(places) else ():
            buckets[r] = part.tolist()  # ascending, so a heap
            used.add(r)
        ids, rank, after, before = start.tolist(), rank.tolist(), list(range(1, n + 1)), list(range(-1, n))
        pair = self.pairs.get
        while (r := used.first()) >= 0:
            bucket, low = buckets[r], NONE
            while bucket and low > r:  # until a merge brings a lower rank
                at = heappop(bucket)
                if rank[at] != r:
                    continue
                gone = after[at]
                then = after[gone]
                ids[at], after[at], rank[gone] = r, then, NONE
                before[then] = at
                rank[at] = new = pair(r << 32 | ids[then], NONE) if then < n else NONE
                if new < NONE:
                    low = min(low, new)
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        used.add(new)
                left = before[at]
                if left >= 0:
                    rank[left] = new = pair(ids[left] << 32 | r, NONE)
                    if new < NONE:
                        low = min(low, new)
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            buckets[new] = [left]
                            used.add(new)
            if not bucket:
                del buckets[r]
                used.discard(r)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return np.array(out, np.uint32)

    def _merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(ids)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # n: none
        before = np.arange(-1, n - 1)
        before[ends - sizes] = n
        before = np.append(before, n)
        ids = np.append(ids, 0)
        alive = np.ones(n, bool)
        rank = np.full(n + 1, NONE, np.int64)
        linked = np.flatnonzero(after < n)
        rank[linked] = self._pair(ids[linked], ids[linked + 1])
        linked = linked[rank[linked] < NONE]
        order = linked[np.argsort(rank[linked], kind="stable")]
        ordered = rank[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, int)
        used, buckets = RankBitmap(self.size), {}
        for r, part in zip(ordered[starts].tolist(), np.split(order, starts[1:]), strict=True) if len(order) else ():
            buckets[r] = part.tolist()
            used.add(r)
        while (r := used.first()) >= 0:
            at = np.array(buckets.pop(r))
            used.discard(r)
            at = at[rank[at] == r]  # entries whose pair has changed are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                if self.together[r]:
                    touching = after[at[:-1]] == at[1:]
                    if touching.any():  # runs of one token: every other pair merges, from the left
                        index = np.arange(len(at))
                        run = np.maximum.accumulate(np.where(np.append(False, touching), 0, index))
                        at = at[(index - run) % 2 == 0]
                else:  # a merge may bring a lower rank: only the leftmost of each pre-token, the others wait
                    own = word[at]
                    leftmost = np.append(True, own[1:] != own[:-1])
                    if not leftmost.all():
                        buckets[r] = at[~leftmost].tolist()
                        used.add(r)
                        at = at[leftmost]
            gone = after[at]
            then = after[gone]
            ids[at] = r
            after[at] = then
            before[then] = at
            before[n] = n
            alive[gone] = False
            rank[gone] = NONE
            left = before[at]
            left = left[left < n]
            has = then < n
            rank[at] = np.where(has, self._pair(ids[at], ids[then]), NONE)
            rank[left] = self._pair(ids[left], ids[after[left]])
            new = np.concatenate((at, left))
            ranks = rank[new]
            ok = ranks < NONE
            for p, k in zip(new[ok].tolist(), ranks[ok].tolist(), strict=True):
                if k in buckets:
                    buckets[k].append(p)
                else:
                    buckets[k] = [p]
                    used.add(k)
        return ids[:n], alive, word


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def text_encoder(ranks: dict[bytes, int], pattern: str) -> ChunkEncoder:
    """Encode texts: every match of ``pattern`` separately, the distinct ones of a batch together."""
    import regex

    merger, split = Merger(ranks), regex.compile(pattern)

    def words(strings: list[str], led: bool) -> Ids:
        return merger.ids([(" " + w if led else w).encode() for w in strings])

    def whole(strings: list[str]) -> Ids:
        matches = [split.findall(w) for w in strings]
        codes: dict[str, int] = {}
        flat = [codes.setdefault(m, len(codes)) for own in matches for m in own]
        values, n = gathered(*merger.ids([m.encode() for m in codes]), np.array(flat, np.int64))
        ends = np.append(0, np.cumsum(n, dtype=np.int64))[np.cumsum([0, *map(len, matches)])]
        return values, np.diff(ends)

    return ChunkEncoder(words, whole, True)


def _token_bytes(ranks_path: str) -> pa.Array:
    """The bytes of each id."""
    ranks = load_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def _decoded(ids: np.ndarray, counts: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The joined bytes of each row's ids."""
    pieces = tokens.take(pa.array(ids.astype(np.int32, copy=False)))
    ends = pieces.buffers()[1]
    bounds = np.frombuffer(ends, np.int32, len(ids) + 1) if ends is not None else np.zeros(1, np.int32)
    offsets = bounds[np.append(0, np.cumsum(counts, dtype=np.int64))]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pieces.buffers()[2] or pa.py_buffer(b"")])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 6_000_000, decoded: bool = False) -> DataFrame:
    """doc_id and ids array<int> of each whole text, as the rank file's tokenizer gives them without special tokens.

    With ``decoded``, also that column: the bytes that the ids decode to, made in the same pass.
    A null or empty text has no ids; a null doc_id stays null; repeated rows are each encoded;
    an empty table gives no rows; other columns are left out.
    """

    def run(batches):
        encoder, tokens = kept(("ranks", ranks_path, pattern), lambda: (text_encoder(load_ranks(ranks_path), pattern), _token_bytes(ranks_path)))
        for batch in sized(batches, "text", batch_bytes):
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts, dtype=np.int64)
            for i in range(0, len(counts), 2000):
                own = counts[i : i + 2000]
                values = ids[ends[i] - counts[i] : ends[i + len(own) - 1]]
                offsets = np.append(0, np.cumsum(own)).astype(np.int32)
                columns = {"doc_id": batch.column("doc_id").slice(i, len(own)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))}
                if decoded:
                    columns["decoded"] = _decoded(values, own, tokens)
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` binary, the bytes of the ids; null ids decode to no bytes."""

    def run(batches):
        tokens = kept(("token bytes", ranks_path), lambda: _token_bytes(ranks_path))
        for batch in batches:
            column = batch.column(ids_col)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(column.flatten().to_numpy(zero_copy_only=False), counts, tokens)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary")
