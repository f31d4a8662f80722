"""Collocations, periodic runs and mixing against brute force, on small and odd inputs."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations, mixing, periodic, queries

ODD = [None, "", " \n\t", "a", "b " * 40, "x y " * 30 + "z", "A a A a. a A", "one two three " * 20, "é É é É é É é É " * 5, "end\x0bof\x0cline\rnow " * 9, "a\x85b c\xa0d " * 12]


def rows_of(spark, rows, parts=3):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(k, t, la, s, 1, 2, "q", 3) for k, t, la, s in rows], "doc_id long, text string, lang string, source string, size int, rank int, phrase string, start int").repartition(parts)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_model(words, copies=4, least=6):
    """Every lag and every stretch, the smallest period of each span first."""
    n, found = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, copies * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, ln, q) for (s, ln), q in found.items())


def collapsed_model(words, runs):
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng):
    out = []
    while len(out) < rng.randint(0, 200):
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randint(0, len(part))]
    return rng.choice([" ", "\n", " \t "]).join(out)


@pytest.mark.parametrize(("copies", "least"), [(4, 6), (3, 3), (5, 12)])
def test_periodic_runs(spark, copies, least):
    rng = random.Random(copies)
    texts = [*ODD, *(random_text(rng) for _ in range(150)), "w " * 3000, " ".join(str(i % 700) for i in range(4000))]
    rows = [(i if i else None, t, None, None) for i, t in enumerate(texts)]
    out = periodic.periodic_runs(rows_of(spark, rows), copies, least, batch_bytes=2000).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    for k, t, *_ in rows:
        words, r = words_of(t), got[k]
        runs = runs_model(words, copies, least)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs and r.n_words == len(words)
        assert r.text == collapsed_model(words, runs)


def test_periodic_runs_of_long_texts():
    """A million words with periods of all sizes: lags are screened, so this takes seconds."""
    rng = np.random.default_rng(3)
    parts, expected, at = [], [], 0
    for period in (1, 7, 100, 3000, 40_000):
        noise = rng.integers(0, 1 << 40, 50_000)
        unit = rng.integers(0, 1 << 40, period)
        parts += [noise, np.tile(unit, 5)]
        if 5 * period >= 6:
            expected.append((0, at + 50_000, 5 * period, period))
        at += 50_000 + 5 * period
    parts.append(np.zeros(500_000, np.int64))
    expected.append((0, at, 500_000, 1))
    codes = np.concatenate(parts)
    found = periodic.periodic_stretches(np.unique(codes, return_inverse=True)[1], np.array([len(codes)]))
    assert found.tolist() == [list(x) for x in expected]


def test_periodic_runs_query(spark):
    """The registered query against its contract, worked out document by document."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op12_periodic_runs(spark, sf).collect()
    assert len(out) == len(docs) and sum(r.n_runs > 0 for r in out) > 5
    for r in out:
        words = words_of(docs[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_model(words)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{ln},{q}\n" for s, ln, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_model(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)


def collocation_model(rows, max_words, least, overlap, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        holds = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))  # noqa: B023, E731
        if not any(la == lang and len(x) > len(w) and holds(x) and 100 * b >= overlap * a for (la, x), b in candidates.items()):
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize(("max_words", "least", "overlap", "top"), [(3, 10, 50, 2000), (4, 3, 70, 25), (2, 2, 50, 7)])
def test_collocations(spark, max_words, least, overlap, top):
    rng = random.Random(max_words)
    vocabulary = ["the", "of", "a", "Big", "big", "é", "x-ray", "zebra", "rare"] + [f"w{i}" for i in range(20)]
    texts = [*ODD, *("".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1))[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60))]
    rows = [(i or None, t, rng.choice(["en", "de", None]), None) for i, t in enumerate(texts)]
    out = collocations.collocations(rows_of(spark, rows), max_words, least, overlap, top).collect()
    expected = collocation_model(rows, max_words, least, overlap, top)
    assert {tuple(r) for r in out} == expected and len(out) == len(expected) > 5


def test_collocations_of_shared_hashes_and_hot_pivots(spark, monkeypatch):
    """All words in few buckets, and a pivot dealt to many tasks, give the same counts."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=60)), "en", None) for i in range(60)]
    monkeypatch.setattr(collocations, "BUCKETS", 2)
    docs = rows_of(spark, rows).select("lang", "text")
    table = np.full(2, 3000)
    got = {(r.phrase, r.a) for r in collocations.mined(collocations.stretches(docs, table, 3, 10, 10, batch_bytes=500), 3, 10).collect()}
    f = collections.Counter(" ".join(w[i : i + m]) for _, t, *_ in rows for w in [t.split()] for m in (2, 3) for i in range(len(w) - m + 1))
    assert got == {(p, a) for p, a in f.items() if a >= 10}


def test_collocations_of_a_very_long_text(spark):
    """A text of several megabytes, longer than a batch, beside short ones and a word that fills it."""
    rng = random.Random(12)
    long = " ".join(rng.choices(["alpha", "beta", "gamma", "the", "the", "the"], k=400_000)) + " x" * 200_000
    rows = [(1, long, "en", None), (2, "alpha beta the", "en", None), (3, None, "en", None)]
    got = {(r.phrase, r.a, r.l, r.r, r.n) for r in collocations.collocations(rows_of(spark, rows), overlap=1000).collect()}
    f = collections.Counter()
    for text in (long, "alpha beta the"):
        words = text.split()
        for m in (1, 2, 3):
            f.update(zip(*[words[i:] for i in range(m)], strict=False))
    n = sum(c for w, c in f.items() if len(w) == 1)
    assert {(p, a, n) for p, a, _, _, n in got} == {(" ".join(w), c, n) for w, c in f.items() if len(w) > 1 and c >= 10}
    assert ("x x", f["x", "x"], f["x",], f["x",], n) in got


def targets_model(sizes, weights, most):
    """Exact shares: excess is dealt again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(most * sizes[s] for s in held)
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return share | {s: Fraction(most * sizes[s]) for s in held}
        held |= over


def test_mixing(spark):
    rng = random.Random(4)
    sources = ["a", "B", "é", None, "z", "tiny", "void"]
    rows = [(i or None, " ".join("w" * rng.randint(1, 300)), None, rng.choices(sources[:5], [30, 8, 4, 2, 1])[0]) for i in range(900)]
    rows += [(2000, "one two three", None, "tiny"), (2001, None, None, "void"), (2002, "", None, "void"), (2003, "w " * 60_000, None, "z"), (5, "same", None, "a"), (5, "same", None, "a")]
    df = rows_of(spark, rows)
    out = mixing.mix(df, shard_docs=100).collect()
    assert len(out) == len(rows) and len({r.shard for r in out}) > 5
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(words_of(t))
    target, taken = targets_model(size, (5, 2, 1), 3), collections.Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(float(target[r.source])) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert taken[s] == pytest.approx(float(target[s]), abs=40, rel=0.01), s
    again = mixing.mix(df.repartition(7), shard_docs=100).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))


@pytest.mark.parametrize("seats", [0, 1, 7, 40, 1000])
def test_apportionment(spark, seats):
    """Quotas equal those of ranking every quotient."""
    rng = random.Random(seats)
    votes = [rng.choice([0.0, rng.random(), 10 * rng.random(), 5.0]) for _ in range(30)]
    scale = seats / max(sum(votes), 1e-9)
    votes = [v * scale for v in votes]
    parties = [(i, v, int(v) + rng.randint(1, 3)) for i, v in enumerate(votes)]
    df = spark.createDataFrame(parties, "i int, votes double, bound long").withColumn("seats", F.lit(seats))
    got = {r.i: r.quota for r in mixing.apportioned(df, [], ["i"], "seats").collect()}
    claims = sorted((-v / (2 * k + 1), i) for i, v, bound in parties for k in range(bound))
    assert got == collections.Counter({i: 0 for i, *_ in parties}) | collections.Counter(i for _, i in claims[:seats]) or got == {i: sum(j == i for _, j in claims[:seats]) for i, *_ in parties}


def test_empty_tables(spark):
    none = rows_of(spark, [], 1)
    assert collocations.collocations(none).count() == 0
    assert periodic.periodic_runs(none).count() == 0
    assert mixing.mix(none).count() == 0
    zero = mixing.mix(rows_of(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r.target, r.taken) for r in zero] == [(0.0, 0)] * 2
