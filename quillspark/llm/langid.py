"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of 1 to 3, within the lower-cased text with digits and marks
folded, hashed to ``2 ** bits`` slots and weighted by term frequency (share of the text's
n-grams) times inverse document frequency.  Document frequencies cover every learning row.
Weights are trained with follow-the-regularised-leader (proximal, per-coordinate rates) under
elastic-net penalties, then one temperature is fitted on learning rows kept from training.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chars_grouped, documents, forget, give_back

UNDETERMINED = "und"
SIZES = (1, 2, 3)
#: Odd multipliers that mix up to three characters into a hash.
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
WINDOW = 1 << 21  # characters hashed at a time; n-grams across its edge are kept


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text; all that is no letter counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    low = points < len(table)
    if low.all():
        return table[points]
    out = points.copy()
    out[low] = table[points[low]]
    others = np.unique(points[~low])
    for p in others[[not chr(p).isalpha() for p in others]]:
        out[points == p] = 32
    return out


_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([i if chr(i).isalpha() else 32 for i in range(0x3000)], np.uint32)
    return _LETTERS


def has_letter(points: np.ndarray) -> bool:
    return bool((points != 32).any())


def hashes(points: np.ndarray, bits: int):
    """For each window and n-gram size, the slots of the n-grams that begin there."""
    shift = np.uint32(32 - bits)
    for at in range(0, max(len(points), 1), WINDOW):
        part = points[at : at + WINDOW + max(SIZES) - 1]
        for size in SIZES:
            n = min(len(part) - size + 1, WINDOW)
            if n > 0:
                h = np.full(n, size, np.uint32) * np.uint32(374761393)
                for k in range(size):
                    h = (h ^ part[k : k + n]) * MIX[k]
                    h ^= h >> np.uint32(15)
                yield (h * MIX[0]) >> shift


@dataclass
class LanguageModel:
    """Languages, the weights times idf by slot (slots x languages), the biases and the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    @cached_property
    def weighted(self) -> np.ndarray:
        return self.table.any(axis=1)

    def judge(self, text: str) -> tuple[str, float, float]:
        """The likeliest language, ties to the first in order, its calibrated probability, and the share of n-grams known.

        That share is of the n-grams of two or more characters; a single character counts as known.
        """
        points = folded(text)
        if not self.languages or not has_letter(points):
            return UNDETERMINED, 0.0, 0.0
        total, grams, known, longer = np.zeros(len(self.languages)), 0, 0, 0
        for i, h in enumerate(hashes(points, self.bits)):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            grams += len(h)
            if i % len(SIZES):
                known += int(np.count_nonzero(self.weighted[h]))
                longer += len(h)
        z = (self.bias + total / grams) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum()), known / longer if longer else 1.0

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language and its calibrated probability."""
        return self.judge(text)[:2]


def _sample(learn: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of each language, those of the lowest text hashes.

    The sample is drawn by a threshold on a hash, so that no group is gathered: the threshold
    is set by each language's count of distinct hashes, with twice the rows aimed at, then cut by
    rank.  So copies do not thin a language out, and only hashes are counted and ranked.
    """
    from pyspark.sql import Window

    hashed = learn.withColumn("_h", F.xxhash64("text", F.lit("sample")))
    unit = F.shiftrightunsigned("_h", 12).cast("double") / float(1 << 52)
    distinct = hashed.select("lang", "_h").distinct().withColumn("_unit", unit)
    counts = distinct.groupBy("lang").count()  # one row for each language
    share = F.lit(2.0 * rows) / F.col("count")
    few = distinct.join(F.broadcast(counts), "lang").filter(F.col("_unit") < share)
    # about 2 * rows hashes of a language are left, and ``rows`` of them are broadcast
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_unit", "_h"))
    chosen = few.withColumn("_rank", rank).filter(F.col("_rank") <= rows).select("lang", "_h", "_unit")
    return hashed.join(F.broadcast(chosen), ["lang", "_h"]).select("lang", "text", "_unit").dropDuplicates(["lang", "text"])


def _features(sample: DataFrame, bits: int) -> DataFrame:
    """Sparse slot counts of each sampled text: lang, fold, slots, counts, grams."""

    def run(batches):
        forget()
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            langs, units = batch.column("lang").to_pylist(), batch.column("_unit").to_pylist()
            slots, counts, grams = [], [], []
            for text in texts:
                count = np.zeros(1 << bits, np.int64)
                for h in hashes(folded(text), bits):
                    count += np.bincount(h, minlength=1 << bits)
                used = np.flatnonzero(count)
                slots.append(used.astype("<i4").tobytes())
                counts.append(count[used].astype("<u4").tobytes())  # a text has fewer than 2 ** 31 characters
                grams.append(int(count.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(units, pa.float64()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary()), pa.array(grams, pa.int64())], names=["lang", "unit", "slots", "counts", "grams"])

    return sample.mapInArrow(run, "lang string, unit double, slots binary, counts binary, grams long")


def document_frequency(docs: DataFrame, bits: int) -> DataFrame:
    """slot int, df long over all rows; slot -1 counts the rows.  Tasks add up before the shuffle."""

    def run(batches):
        forget()
        df, rows = np.zeros(1 << bits, np.int64), 0
        for _, texts in chars_grouped(batches, "text", 2_000_000):
            for text in texts:
                seen = np.zeros(1 << bits, np.uint8)
                for h in hashes(folded(text), bits):
                    seen[h] = 1
                df += seen
                rows += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], rows))], names=["slot", "df"])

    return docs.select("text").mapInArrow(run, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df"))


class Rows(Sequence):
    """Rows (label, slots, values) for :func:`ftrl`, of which only slots and counts are held; values are made anew at each turn."""

    def __init__(self, held: list[tuple], idf: np.ndarray):
        self.held, self.idf = held, idf

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        label, slots, counts, grams = self.held[i]
        return label, slots, counts / grams * self.idf[slots]


def ftrl(rows: Sequence, turns: list[int], size: int, k: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights ((size + 1) x k, the last of them the bias) after the rows (label, slots, values) in the order of ``turns``.

    Follow-the-regularised-leader with a rate for each coordinate and elastic-net penalties.
    """
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for i in turns:
        y, slots, x = rows[i]
        at, x = np.append(slots, size), np.append(x, 0.1)
        w = weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        square = g * g
        z[at] += g - (np.sqrt(g2[at] + square) - np.sqrt(g2[at])) / alpha * w
        g2[at] += square
    return weights(np.arange(size + 1))


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature from 0.1 to 20 of the least mean log loss, by golden-section search on its logarithm."""

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]))

    low, high = np.log(0.1), np.log(20.0)
    for _ in range(60):
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, rows: int = 1500, bits: int = 16, epochs: int = 4, alpha: float = 4.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, seed: int = 7) -> LanguageModel:
    """Learn from columns text and lang.

    At most ``rows`` texts of each language are trained on (whole texts; a fifth of them fit the
    temperature only); document frequencies count every row.  What reaches the driver is bounded
    by ``rows`` x languages x 2 ** bits.  Rows of null text or lang are left out; without
    rows the model knows no language.
    """
    learn = labelled.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = 1 << bits
    df = np.zeros(size)
    n = 0
    for row in document_frequency(learn, bits).toLocalIterator():  # at most 2 ** bits + 1 rows
        if row.slot < 0:
            n = row.df
        else:
            df[row.slot] = row.df
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = [(r.lang, r.unit, np.frombuffer(r.slots, "<i4"), np.frombuffer(r.counts, "<u4"), r.grams) for r in _features(_sample(learn, rows), bits).toLocalIterator()]
    sample = sorted((s for s in sample if s[4]), key=lambda s: (s[1], s[0]))
    languages = sorted({s[0] for s in sample})
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0, bits)
    label = {lang: i for i, lang in enumerate(languages)}
    held = [(label[lang], slots, counts, grams) for lang, _, slots, counts, grams in sample]
    check, fit = (Rows(part, idf) for part in ((held[::5], [r for i, r in enumerate(held) if i % 5]) if len(held) >= 50 else (held, held)))

    rng = np.random.default_rng(seed)
    w = ftrl(fit, [i for _ in range(epochs) for i in rng.permutation(len(fit))], size, k, alpha, beta, l1, l2)
    table, bias = (w[:size] * idf[:, None]).astype(np.float32), 0.1 * w[size]
    scores = np.array([bias + (x / idf[slots]) @ table[slots] for _, slots, x in check])
    truth = np.array([row[0] for row in check.held])
    del sample, held, check, fit
    give_back()  # this is the driver's process, which goes on

    return LanguageModel(languages, table, bias, temperature(scores, truth), bits)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred string and score double of each whole text, from the text alone.

    A text that is null, empty or without a letter is ``und`` with score 0; a null doc_id
    stays null; repeated rows are predicted each; an empty table gives no rows; other columns
    are left out.  The model has a fixed size (2 ** bits x languages) and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        for batch, texts in chars_grouped(batches, "text", 2_000_000):
            found = [shared.value.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: LanguageModel, least: float = 0.4, familiar: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is of a language that the model knows.

    A text is rejected when its likeliest language has a probability below ``least`` (no evidence at all
    leaves the languages' own shares), or when fewer than ``familiar`` of its n-grams are known: the
    text of another language or script meets weights by chance only.  A null, empty or letterless text is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        forget()

        def one(text):
            language, score, known = shared.value.judge(text)
            return language != UNDETERMINED and score >= least and known >= familiar

        return texts.map(lambda t: one(t or ""))

    return docs.filter(good(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """A model from the rows that are not held out."""
    return train(docs.filter(~held_out(id_col)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), **options)
