"""Token counts under a unigram vocabulary: Viterbi that keeps only score and count.

Aho-Corasick enumerates the vocabulary's matches that end at each character; the best score
and the number of pieces of the best path there are all that is kept.  Ties go as in the
public tokenizers library: of equal scores the piece that starts first wins (strictly
greater replaces), a character without a one-character piece gets the lowest score less 10,
unknown characters are spelled by their bytes if the vocabulary has all byte pieces, else a
run of them is one piece.  Scores are summed in double precision.
"""

from __future__ import annotations

import gc
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chars_grouped, documents, kept

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_AFTER_VISIBLE = re.compile(r"(?<=[^ ]) ")


class PieceCounter:
    """Count pieces of texts.  The text is read with every space as ▁ and one ▁ put before it."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, limit: int = 500_000, longest: int = 64):
        import ahocorasick

        self.limit, self.longest = limit, longest
        pieces = {}
        for i, (piece, score) in enumerate(vocabulary):
            pieces.setdefault(piece, (score, i))
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        # Sums of whole numbers are exact, so a text may be cut wherever no piece can cross.
        exact = all(float(s).is_integer() for _, s in vocabulary)
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.cut_words = exact and not inner and self.bytes
        self.cut_lines = self.cut_words and not any("\n" in p for p in pieces)
        self.cache: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """The number of pieces of one string, which has ▁ for spaces already."""
        n = len(text)
        if not n:
            return 0
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end in range(n):
            best, start, single = None, 0, False
            for length, piece_score in sorted(ends[end], reverse=True):  # the longest starts first
                single |= length == 1
                s = score[end + 1 - length] + piece_score
                if best is None or s > best:
                    best, start, known = s, end + 1 - length, True
            if not single:
                s = score[end] + self.unknown_score
                if best is None or s > best:
                    best, start, known = s, end, False
            score[end + 1], unknown[end + 1] = best, not known
            if known:
                count[end + 1] = count[start] + 1
            elif self.bytes:
                count[end + 1] = count[start] + len(text[end].encode())
            else:
                count[end + 1] = count[start] + (not unknown[start])
        return count[n]

    def _chunk(self, chunk: str) -> int:
        text = chunk.replace(" ", SPACE)
        if not self.cut_lines or "\n" not in text:
            return self.viterbi(text)
        lines = text.split("\n")
        return sum(map(self.viterbi, lines)) + len(lines) - 1  # a line feed is one byte piece

    def counts(self, texts: list[str]) -> list[int]:
        """Pieces of each text."""
        if not self.cut_words:
            return [self.viterbi((" " + t).replace(" ", SPACE)) if t else 0 for t in texts]
        collecting = gc.isenabled()
        gc.disable()
        try:
            # chunk c stands for " " + c
            split = [(t.split(" ") if "  " not in t and t[0] != " " else _AFTER_VISIBLE.split(t)) if t else [] for t in texts]
            wanted: set[str] = set()
            for s in split:
                wanted.update(s)
            missing = [c for c in wanted if c not in self.cache]
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
                missing = list(wanted)
            for c in missing:
                self.cache[c] = self._chunk(" " + c)
            get = self.cache.__getitem__
            out = [sum(map(get, s)) for s in split]
            for c in missing:
                if len(c) > self.longest:
                    del self.cache[c]
            return out
        finally:
            if collecting:
                gc.enable()


def load_sentencepiece(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 500_000) -> DataFrame:
    """doc_id and n_tokens long of each whole text.

    A null or empty text has 0; a null doc_id stays null; repeated rows are counted each;
    an empty table gives no rows; other columns are left out.  No shuffle.
    """

    def run(batches):
        counter = kept(("pieces", model_path, cache_words), lambda: PieceCounter(load_sentencepiece(model_path), limit=cache_words))
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counter.counts(texts), pa.int64())], names=["doc_id", "n_tokens"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
