"""Vectorised hashes of words and word runs.

A word is a run of bytes that are no ASCII white space.  Hashes are polynomial sums modulo
2 ** 64 taken from running sums, then mixed; equal runs have equal hashes wherever they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
PART = 1 << 18


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i <= n."""
    up, down = _TABLES.get(base, (np.ones(1, np.uint64),) * 2)
    if len(up) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, base, np.uint64)))
            down = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, inverse, np.uint64)))
        if size <= PART + 1:
            _TABLES[base] = (up, down)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """One unsigned 64-bit hash for each word of the text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, first = [], 0
    while first < len(starts):  # long texts in parts, cut between words
        last = int(np.searchsorted(ends, starts[first] + PART, "right"))
        last = max(last, first + 1)
        a, b = starts[first:last] - starts[first], ends[first:last] - starts[first]
        part = data[starts[first] : ends[last - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(_BASE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        first = last
    return out[0] if len(out) == 1 else np.concatenate(out)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words, by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, n, PART):
        part = words[at : at + PART + length - 1]
        up, down = _powers(_STEP, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - length + 1
        out.append(mixed((sums[length:] - sums[:m]) * down[:m]))
    return out[0] if len(out) == 1 else np.concatenate(out)


def least_of_window(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its least (the leftmost of equals)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = hashes, np.arange(len(hashes)), 1
    while span < width:  # minima of spans that double, the last overlapping
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        span += step
    return at


def split_texts(texts: pa.Array, blank: np.ndarray = _SPACE, folded: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of an array of texts (null: none), the row of each, where each starts, and the texts' joined bytes.

    Bytes marked in ``blank`` part words, and no word crosses from one text to the next; ``folded`` maps bytes first.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if folded is not None:
        data = folded[data]
    inside = ~blank[data]
    first = np.zeros(len(data) + 1, bool)  # the first byte of a text
    first[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return words, np.searchsorted(offsets, starts, "right") - 1, starts, data


def joined(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """The words of each row, ``counts`` of them in turn, joined by one space."""
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), b" ").cast(pa.string())
