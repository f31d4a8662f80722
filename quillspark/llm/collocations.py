"""Collocations by pivot partitioning: every n-gram is counted where its rarest word is.

Words are counted for each language, then brought into one order, rare to frequent, by a table of fixed size: 2 ** 20
buckets of word hashes hold the largest count met in each, so it never gives less than a word's count, and the hash itself
breaks ties.  Words that the table shows to be too rare for any candidate part a text like a mark.

In a second pass the text around each word is rewritten to the stretch of words at least as frequent, at
most ``max_words`` - 1 to each side; words to its left must be strictly more frequent, so that an n-gram
with its rarest word twice belongs to the first of them.  The distinct stretches of a batch, with
their counts, are sent to that word's (the pivot's) partition, where the n-grams that hold it
are enumerated and counted: each occurrence once, and by one pivot alone.  What is too rare ends there.  A pivot with more than
``share`` occurrences (a 1024th of all words, 2 ** 19 at most, so that a group fits in memory) is dealt to several
tasks and its n-grams are summed once more.

Scores and containment come from joins of the candidates with the counts of their parts, hot parts dealt to
several tasks.  Nothing is ranked in one task but the first rows of each slice of a language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, sized, stored
from .words import joined, split_texts

BUCKETS = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = _BREAK.copy()
_BLANK[[9, 32]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def _languages(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


class Words:
    """The words of a batch as numbers: one for each pair of a language and a word."""

    def __init__(self, batch: pa.RecordBatch):
        words, doc, starts, data = split_texts(batch.column("text"), _BLANK, _FOLDED)
        coded = words.dictionary_encode()
        self.langs, lang = _languages(batch)
        both = lang[doc].astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
        pairs, self.codes = np.unique(both, return_inverse=True)
        self.lang, word = np.divmod(pairs, max(len(coded.dictionary), 1))
        self.words = coded.dictionary.take(pa.array(word))
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        self.piece = breaks[starts] + doc  # words of one piece have the same number

    def hashes(self) -> np.ndarray:
        """crc32 of language, line feed and word, for each number."""
        seeds = [zlib.crc32(x.encode() + b"\n") for x in self.langs.to_pylist()]
        return np.fromiter((zlib.crc32(w, seeds[k]) for w, k in zip(self.words.to_pylist(), self.lang.tolist(), strict=True)), np.int64, len(self.words))


def word_counts(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """lang, phrase (one word), a: occurrences of each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", batch_bytes):
            w = Words(batch)
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang)), w.words.cast(pa.string()), pa.array(np.bincount(w.codes, minlength=len(w.words)))], ["lang", "phrase", "a"])

    return docs.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def stretches(docs: DataFrame, table: np.ndarray, max_words: int, least: int, share: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """lang, pivot, turns, turn, lines: what each pivot is sent of a batch, one line for each distinct stretch.

    A line has the numbers of words to the left and right of the pivot (a digit each) and how often it occurs, then those words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in sized(batches, "text", batch_bytes):
            w = Words(batch)
            hashes = w.hashes()
            count = counts[hashes % BUCKETS]
            order = np.lexsort((hashes, count))
            fresh = np.ones(len(order), np.int32)
            fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (count[order[1:]] != count[order[:-1]])
            rank = np.empty(len(order), np.int32)
            rank[order] = np.cumsum(fresh)  # words of one hash share a rank: the first of them in an n-gram owns it
            rank[count < least] = 0
            n, reach = len(w.codes), max_words - 1
            padded = lambda x, fill: np.concatenate((np.full(reach, fill, np.int32), x.astype(np.int32), np.full(reach, fill, np.int32)))
            key, piece, code = padded(rank[w.codes], 0), padded(w.piece, -1), padded(w.codes, -1)
            own, mine = key[reach : n + reach], piece[reach : n + reach]
            sides = {0: code[reach : n + reach]}
            for step in (-1, 1):
                going = own > 0
                for d in range(1, max_words):
                    a = reach + step * d
                    other = key[a : a + n]
                    going = going & (piece[a : a + n] == mine) & ((other > own) if step < 0 else (other >= own))
                    sides[step * d] = np.where(going, code[a : a + n], np.int32(-1))
            some = np.flatnonzero((sides[-1] >= 0) | (sides[1] >= 0))
            names = [f"c{d}" for d in range(-reach, max_words)]
            grouped = pa.table({f"c{d}": sides[d][some] for d in range(-reach, max_words)}).group_by(names).aggregate([([], "count_all")])
            matrix = np.stack([grouped.column(c).to_numpy() for c in names], axis=1)
            times = grouped.column("count_all").to_numpy()
            del sides, key, piece, code, grouped
            left, right = (matrix[:, :reach] >= 0).sum(axis=1), (matrix[:, reach + 1 :] >= 0).sum(axis=1)
            heads, head = np.unique((times * 10 + left) * 10 + right, return_inverse=True)
            heads = pa.array([f"{x // 10 % 10}{x % 10}{x // 100}".encode() for x in heads.tolist()], pa.binary())
            pivot = matrix[:, reach].copy()
            matrix[:, 1 : reach + 1] = matrix[:, :reach].copy()
            matrix[:, 0] = len(w.words) + head
            lines = joined(pa.concat_arrays([w.words, heads]).take(pa.array(matrix[matrix >= 0])), left + right + 1)
            turns = -(-count // share)[pivot]
            turn, hot = np.zeros(len(pivot), np.int64), np.flatnonzero(turns > 1)
            turn[hot] = np.fromiter((zlib.crc32(x) for x in lines.take(pa.array(hot)).cast(pa.binary()).to_pylist()), np.int64, len(hot)) % turns[hot]
            order = np.lexsort((turn, pivot))
            pivot, turn = pivot[order], turn[order]
            first = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (turn[1:] != turn[:-1]))[: len(pivot)])
            each = pa.ListArray.from_arrays(pa.array(np.append(first, len(pivot)), pa.int32()), lines.take(pa.array(order)))
            at = pivot[first]
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[at])), w.words.take(pa.array(at)).cast(pa.string()), pa.array(turns[order][first]), pa.array(turn[first]), pc.binary_join(each, "\n")], ["lang", "pivot", "turns", "turn", "lines"])
        forget()

    return docs.mapInArrow(rewrite, "lang string, pivot string, turns long, turn long, lines string")


def _counted(rows: pa.Table, max_words: int, least: int) -> list[pa.RecordBatch]:
    """The n-grams of whole groups of rows (one pivot and turn each)."""
    rows = rows.combine_chunks()
    lang, pivot, turns, turn, lines = (rows.column(c).chunk(0) for c in ("lang", "pivot", "turns", "turn", "lines"))
    same = pc.and_(pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(pivot[1:], pivot[:-1])), pc.equal(turn[1:], turn[:-1])).to_numpy(zero_copy_only=False)
    group = np.append(0, np.cumsum(~same))
    lines = pc.split_pattern(lines, "\n")
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(lines).to_numpy())
    words = pc.split_pattern(lines.flatten(), " ")
    counts = pc.list_value_length(words).to_numpy()
    start = np.cumsum(counts, dtype=np.int64) - counts
    coded = words.flatten().dictionary_encode()
    code, strings = coded.indices.to_numpy(), coded.dictionary
    heads, head = np.unique(code[start], return_inverse=True)
    left, right, times = np.array([(int(h[0]), int(h[1]), int(h[2:])) for h in strings.take(pa.array(heads)).to_pylist()], np.int64).reshape(-1, 3)[head].T
    more, partial = len(strings), turns.to_numpy() > 1
    out = []
    for i in range(max_words):
        for j in range(max_words - i):
            have = np.flatnonzero((left >= i) & (right >= j)) if i + j else ()
            if not len(have):
                continue
            places = [start[have] + 1 + left[have] - d for d in range(i, 0, -1)] + [start[have] + left[have] + d for d in range(1, j + 1)]
            key, bound = group[row[have]], int(group[-1]) + 1
            for p in places:
                if bound * more >= 1 << 62:
                    distinct, key = np.unique(key, return_inverse=True)
                    bound = len(distinct)
                key, bound = key * more + code[p], bound * more
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            sums = np.add.reduceat(times[have][order], first)
            at = order[first]
            stays = (sums >= least) | partial[row[have[at]]]
            at, sums = at[stays], sums[stays]
            own = row[have[at]]
            columns = [code[p[at]] for p in places[:i]] + [more + np.arange(len(at))] + [code[p[at]] for p in places[i:]]
            both = pa.concat_arrays([strings, pivot.take(pa.array(own))]).cast(pa.binary())
            phrases = joined(both.take(pa.array(np.stack(columns, axis=1).reshape(-1))), np.full(len(at), i + j + 1))
            out.append(pa.record_batch([lang.take(pa.array(own)), phrases, pa.array(np.full(len(at), i + j + 1), pa.int32()), pa.array(sums)], ["lang", "phrase", "words", "a"]))
    return out


def mined(sent: DataFrame, max_words: int, least: int, batch_bytes: int = 8 << 20) -> DataFrame:
    """lang, phrase, words, a: the n-grams of 2 to ``max_words`` words that occur ``least`` times or more."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in sized([batch], "lines", batch_bytes):
                table = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
                last = table.num_rows - 1
                alike = [pc.equal(table.column(c), table.column(c)[last]) for c in ("lang", "pivot", "turn")]
                cut = pc.index(pc.and_(pc.and_(alike[0], alike[1]), alike[2]), True).as_py()  # the last group may go on
                if cut and table.nbytes >= batch_bytes:
                    yield from _counted(table.slice(0, cut), max_words, least)
                    held = table.slice(cut).combine_chunks()
                else:
                    held = table
        if held is not None:
            yield from _counted(held, max_words, least)
        forget()

    dealt = sent.repartition("lang", "pivot", "turn").sortWithinPartitions("lang", "pivot", "turn")
    # n-grams of a pivot that was dealt to several tasks are summed again, all others are complete
    return dealt.mapInArrow(mine, "lang string, phrase string, words int, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, overlap: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs.  A phrase of 2 to ``max_words`` words with
    a >= ``least`` occurrences (overlapping ones count) is a candidate; cut after its first k words its parts occur l and r times and it scores
    floor(1000000 * a * a / (l * r)), in exact decimals; its lowest cut counts, of equal ones the first.  It is dropped if its words lie inside a longer
    candidate with 100 * a' >= ``overlap`` * a.  Order: score and a descending, phrase by bytes.  n counts the words of the language.

    A null language is ``und``, a null or empty text has no words, repeated rows count as often as they are there, a null id and other columns do not
    matter.  A language without candidates, and an empty table, give no rows.
    """
    if not 2 <= max_words <= 9:
        raise ValueError("max_words must be from 2 to 9")
    plain = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    single = stored(word_counts(plain), "words")
    bucket = F.pmod(F.crc32(F.concat("lang", F.lit("\n"), "phrase").cast("binary")), F.lit(BUCKETS)).alias("b")
    largest = single.groupBy(bucket).agg(F.max("a").alias("a")).toArrow()  # a table of fixed size
    table = np.zeros(BUCKETS, np.int64)
    table[largest.column("b").to_numpy()] = largest.column("a").to_numpy()
    total = single.groupBy("lang").agg(F.sum("a").alias("n"))
    share = min(max(1024, (total.agg(F.sum("n")).first()[0] or 0) // 1024), 1 << 19)
    phrases = stored(mined(stretches(plain, table, max_words, least, share), max_words, least), "phrases")

    known = single.filter(F.col("a") >= least).select("lang", F.col("phrase").alias("part"), "a").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = join_hot(cuts, known.select("lang", F.col("part").alias(side), F.col("a").alias(count)), ["lang", side], ["phrase"])
    score = F.expr("(cast(1000000 AS decimal(38, 0)) * cast(a AS decimal(19, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # a longer candidate's parts of one word less are candidates at least as frequent, so one step finds all that matter
    longer = phrases.filter("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < overlap * F.col("a")))
    rows = left.select("lang", "phrase", "a", "s.l", "s.r", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(128)).alias("_slice"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for keys in (["lang", "_slice"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, overlap: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for phrases of 2 and 3 words over documents."""
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten([[array_to_string(w[i : i + m - 1], ' ') for i in range(1, len(w) - m + 2)] for m in range(1, 4)])) AS phrase FROM lists),
f AS MATERIALIZED (SELECT lang, phrase, count(*)::BIGINT AS a, len(string_split(phrase, ' ')) AS m FROM grams GROUP BY lang, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {least}),
cuts AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
scored AS (SELECT c.lang, c.phrase, c.a, c.m, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a), k) AS nth
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[: k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
kept AS (SELECT * FROM scored s WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = s.lang AND b.m = s.m + 1 AND 100 * b.a >= {overlap} * s.a AND s.phrase IN (array_to_string(b.w[: s.m], ' '), array_to_string(b.w[2 :], ' '))))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {top}
"""
