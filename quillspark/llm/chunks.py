"""Exact tokenising of Arrow text columns, each distinct chunk of a batch once.

A pre-tokeniser never lets a piece run across a space that follows a visible character, so a
text may be cut there; the ids of a text are then the joined ids of its chunks.  Splitting,
finding the distinct chunks and joining their ids are array operations; only distinct words
reach the tokenizer.  Nothing is kept from batch to batch, so memory is bounded by the batch.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Flat ids and the number of ids of each string.
Ids = tuple[np.ndarray, np.ndarray]

#: Every character that some tokenizer may hold to be white space, as members of a character class.
_BLANK = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"[{_BLANK}][{_BLANK}]|\A[{_BLANK}]|[{_BLANK}]\z|[{_BLANK.replace(r'\n', '', 1).replace(' ', '', 1)}]"
_CUT = "\x01"
#: ASCII punctuation; the apostrophe is left out, as contractions begin with it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters up to U+00FF: what they are is the same in every version of Unicode, and normal forms leave them alone.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_WORD = r"\A[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+\z"


def gathered(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> Ids:
    """The joined runs of ``codes``, where run i is the i-th of ``values`` cut by ``lengths``."""
    starts = (np.cumsum(lengths) - lengths).astype(np.int32)
    n = lengths.astype(np.int32)[codes]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    at += np.repeat(starts[codes] - (ends - n), n)
    return values[at], n


def flattened(lists: list) -> Ids:
    return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int32, len(lists))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def binary_rows(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Packed little-endian unsigned 32-bit ids of each row; the ids themselves are not copied."""
    offsets = np.append(0, np.cumsum(4 * lengths.astype(np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4", copy=False))])


def ended(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> Ids:
    """The rows with ``end_id`` after each."""
    more = lengths.astype(np.int64) + 1
    out = np.full(int(more.sum()), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(more) - 1] = False
    out[own] = ids
    return out, more


class ChunkEncoder:
    """Encode text arrays by their distinct chunks.

    ``words(list, led)`` encodes plain words, with a space before each where ``led``;
    ``whole(list)`` any strings.  ``spaced`` says whether a leading space belongs to the word
    that follows (byte-level BPE) or is dropped, in which case ``lower`` tells that cases are folded.
    """

    def __init__(self, words: Callable[[list[str], bool], Ids], whole: Callable[[list[str]], Ids], spaced: bool, lower: bool = False):
        self.words, self.whole, self.spaced, self.lower = words, whole, spaced, lower

    def _distinct(self, strings: pa.Array, led: bool) -> Ids:
        """Ids of distinct strings: of a word and the marks at its end each, or of the whole."""
        bodies = pc.utf8_rtrim(strings, characters=_MARKS)
        plain = pc.match_substring_regex(bodies, _WORD)
        others = strings.filter(pc.invert(plain))
        bodies, strings = bodies.filter(plain), strings.filter(plain)
        tails = pc.utf8_ltrim(strings, characters=_LETTERS).dictionary_encode()
        bodies = (pc.utf8_lower(bodies) if self.lower else bodies).dictionary_encode()
        others = _strings(others)
        parts = [self.words(_strings(bodies.dictionary), led), self.whole([*_strings(tails.dictionary), ""]), self.whole([" " + x for x in others] if led else others)]
        n_words, n_tails, n_others = (len(p[1]) for p in parts)
        pairs = np.empty((len(plain), 2), np.int64)
        where = plain.to_numpy(zero_copy_only=False)
        pairs[where, 0] = bodies.indices.to_numpy(zero_copy_only=False)
        pairs[where, 1] = n_words + tails.indices.to_numpy(zero_copy_only=False)
        pairs[~where, 0] = np.arange(n_others) + n_words + n_tails
        pairs[~where, 1] = n_words + n_tails - 1
        values, n = gathered(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pairs.reshape(-1))
        return values, n.reshape(-1, 2).sum(axis=1)

    def _joined(self, codes: np.ndarray, strings: pa.Array, led: np.ndarray, offsets: np.ndarray) -> Ids:
        """Ids of texts whose chunks are ``strings[codes]``, a space before those that are ``led``."""
        parts, coded = [], np.zeros(len(codes), np.int32)
        base = 0
        for side in (True, False):
            mine = led if side else ~led
            used = np.zeros(len(strings), bool)
            used[codes[mine]] = True
            parts.append(self._distinct(strings.filter(pa.array(used)), side))
            place = np.cumsum(used, dtype=np.int32) + np.int32(base - 1)
            coded[mine] = place[codes[mine]]
            base += int(used.sum())
        values, n = gathered(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), coded)
        return values, np.diff(np.append(0, np.cumsum(n, dtype=np.int64))[offsets])

    def _plain(self, texts: pa.Array) -> Ids:
        """Texts whose blanks are single spaces and line feeds between visible characters."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.spaced else " "), " ")
        offsets = chunks.offsets.to_numpy()
        flat = chunks.values.dictionary_encode()
        codes, strings = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        led = np.full(len(codes), self.spaced)
        if self.spaced:
            led[offsets[:-1]] = False
            feed = pc.index(strings, "\n").as_py()
            if feed >= 0:  # a line feed is a piece of its own, and no space follows it
                feeds = np.flatnonzero(codes == feed)
                led[feeds] = False
                led[feeds + 1] = False
        return self._joined(codes, strings, led, offsets)

    def _cut(self, texts: pa.Array) -> Ids:
        """Any texts: cut before each space that follows a visible character, except in a text that holds the cut mark."""
        marked = pc.match_substring(texts, _CUT)
        cut = pc.if_else(marked, texts, pc.replace_substring_regex(texts, rf"([^{_BLANK}]) ", r"\1" + _CUT + " "))
        chunks = pc.split_pattern(cut, _CUT)
        flat = chunks.values.dictionary_encode()
        codes, strings = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        if pc.any(marked).as_py():  # put back what was cut at the texts' own marks
            rows = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
            out = [self._cut(texts.filter(pc.invert(marked))), self.whole(_strings(texts.take(pa.array(rows))))]
            order = np.empty(len(texts), np.int64)
            order[np.flatnonzero(~marked.to_numpy(zero_copy_only=False))] = np.arange(len(texts) - len(rows))
            order[rows] = np.arange(len(texts) - len(rows), len(texts))
            return gathered(np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out]), order)
        follows = pc.match_substring_regex(strings, rf"\A [^{_BLANK}]")
        strings = pc.if_else(follows, pc.utf8_slice_codeunits(strings, start=1), strings)
        return self._joined(codes, strings, follows.to_numpy(zero_copy_only=False)[codes], np.append(0, np.cumsum(counts)))

    def encode(self, texts: pa.Array) -> Ids:
        """Flat ids of a text array and the number of ids of each; a null text is empty."""
        collecting = gc.isenabled()
        gc.disable()  # many short-lived lists, none in a cycle
        try:
            return self._encode(texts.fill_null(""))
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> Ids:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.spaced:
            return self._plain(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        some = odd.to_numpy(zero_copy_only=False)
        if not some.any():
            return self._plain(texts)
        plain = self._plain(texts.filter(pc.invert(odd))) if not some.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        cut = self._cut(texts.filter(odd))
        order = np.empty(len(texts), np.int64)
        order[~some] = np.arange(len(plain[1]))
        order[some] = np.arange(len(plain[1]), len(texts))
        return gathered(np.concatenate((plain[0], cut[0])), np.concatenate((plain[1], cut[1])), order)


def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """An encoder over a tokenizers file; special tokens' strings count as ordinary text.

    A plain word is one pre-token, so it goes straight to the library's BPE model, in the form
    its normaliser and byte mapping would give it.  All else takes the full path.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model = tokenizer.model
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    mapped = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(256)}  # a character's bytes, as the model's symbols

    def words(strings: list[str], led: bool) -> Ids:
        lead = mapped[32] if led else ""
        pieces = [lead + (w if w.isascii() else w.translate(mapped)) for w in strings]
        return flattened([[t.id for t in model.tokenize(p)] for p in pieces])

    def whole(strings: list[str]) -> Ids:
        found = (tokenizer.encode_batch_fast(strings[i : i + 2000], add_special_tokens=False) for i in range(0, len(strings), 2000))
        return flattened([e.ids for part in found for e in part])

    return ChunkEncoder(words, whole, spaced, lower=not spaced)


def cached_library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return kept(("library", path, spaced), lambda: library_encoder(path, spaced))
