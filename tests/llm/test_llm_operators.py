"""Each operator against brute force or a library, on small and odd inputs."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from quillspark.llm import ann, bpe, components, embedding_dedup, jaccard, langid, line_dedup, packing, queries, suffix_dedup, token_counts, token_file

ODD = [
    None, "", " ", "\n\n", "a", "  two  spaces \n and\ttab ", "tr ", "It's they'll  ok　 x \xa0 y", "a\r\nb", "<|endoftext|> <s>", "x" * 5000, "ab" * 3000,
    "é ́a ΣΑΣ. 12,345 don't!!", "a\x1c b\x85 c  d ​ e", "日本語 " * 50, "☃ 🎉 end", "same text twice", "same text twice",
]


def docs(spark, texts, parts=3):
    """Documents with clashing extra columns; the last id is null."""
    rows = [(i if i < len(texts) - 1 else None, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(parts)


def tokenizer(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_packing(spark):
    t = tokenizer("byte_bpe_50k.json")
    rows = packing.pack(docs(spark, ODD), P.path("byte_bpe_50k.json")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(ODD):
        ids = packed(t.encode(text or "", add_special_tokens=False).ids + [1])
        own = sorted(by_doc[i if i < len(ODD) - 1 else None], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and {r.doc_tokens for r in own} == {len(ids) // 4}
    row, length = packing.pieces(np.array([5000, 1, 2048, 4096]), 2048)
    assert length.tolist() == [2048, 2048, 512, 256, 128, 8, 1, 2048, 2048, 2048] and row.tolist() == [0] * 6 + [1, 2, 3, 3]
    assert packing.pack(docs(spark, ODD).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe(spark):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, batch_bytes=20), P.path("byte_bpe_50k.tiktoken")).collect()
    got = {r.doc_id: r for r in out}
    for i, text in enumerate(ODD):
        r = got[i if i < len(ODD) - 1 else None]
        assert r.ids == library.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    rng = random.Random(5)
    words = ["".join(rng.choice("abeinrst haö.0") for _ in range(rng.randint(1, 80))).encode() for _ in range(3000)] + [b"ab" * 50_000, b"a" * 9999]
    for w, ids in zip(words, bpe.Merger(ranks).encode(words), strict=True):
        assert ids == packed(library._encode_single_piece(w))


def test_merges_that_open_lower_ranks():
    # abc (rank 300) also forms from ab (rank 301) + c
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"ab": 301, b"cab": 299}
    library = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    for w, ids in zip(words, bpe.Merger(ranks).encode(words), strict=True):
        assert ids == packed(library._encode_single_piece(w)), w


@pytest.mark.parametrize("unit", ["nd", "th", "and", "ab c"])
def test_very_long_pre_tokens(unit):
    """The queue of long pre-tokens gives the library's ids, and its time follows the length."""
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger = bpe.Merger(ranks)
    for n in (300, 9001):
        word = (unit * n).encode()
        assert merger.ids([word])[0].tolist() == library._encode_single_piece(word)
    begun = time.process_time()
    merger.ids([(unit * (1_000_000 // len(unit))).encode()])
    assert time.process_time() - begun < 20  # quadratic time would take hours


def test_token_ranges():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint32)
    image = token_file.encode_segment(ids)
    for start, count in ((0, 5000), (0, 1), (127, 2), (128, 128), (4999, 1), (1000, 777), (4990, 100), (5000, 3)):
        assert (token_file.decode_range(image, start, count) == ids[start : start + count]).all()


def test_rank_bitmap():
    bitmap, model, rng = bpe.RankBitmap(50_000), set(), random.Random(2)
    for _ in range(5000):
        r = rng.randrange(50_000)
        (bitmap.discard if r in model else bitmap.add)(r)
        model ^= {r}
        assert bitmap.first() == min(model, default=-1)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 1 << 32])
def test_token_segment_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::50] = high - 1
    assert (token_file.decode_segment(token_file.encode_segment(ids)) == ids).all()


def test_token_file(spark, tmp_path):
    t = tokenizer("word_bpe_49k.json")
    for size in (50, 1 << 20):
        path = f"file://{tmp_path}/tokens{size}"
        token_file.write_tokens(docs(spark, ODD), path, P.path("word_bpe_49k.json"), segment_ids=size)
        got = {r.doc_id: r for r in token_file.read_tokens(spark, path).collect()}
        start = 0
        for i in [None, *range(len(ODD) - 1)]:
            ids = t.encode(ODD[-1 if i is None else i] or "", add_special_tokens=False).ids + [2]
            assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), packed(ids))
            start += len(ids)
    path = f"file://{tmp_path}/none"
    token_file.write_tokens(docs(spark, ODD).limit(0), path, P.path("word_bpe_49k.json"))
    assert token_file.read_tokens(spark, path).count() == 0


def test_token_counts(spark):
    vocabulary = token_counts.load_sentencepiece(P.path("piece_bpe_32k.model"))

    def library(vocab, spell):
        out = Tokenizer(models.Unigram(vocab, 0, spell))
        out.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        return out

    reference = library(vocabulary, True)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, ODD), P.path("piece_bpe_32k.model")).collect()}
    for i, text in enumerate(ODD):
        assert got[i if i < len(ODD) - 1 else None] == len(reference.encode(text or "").ids)
    rng = random.Random(2)
    for _ in range(100):  # ties, unknown runs, pieces across spaces
        pieces = ["<unk>"] + sorted({"".join(rng.choice("ab▁c\n") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))})
        vocab = [(p, rng.choice([-1.0, -2.0, -3.0, -1.5, -0.1])) for p in pieces]
        counter, reference = token_counts.PieceCounter(vocab), library(vocab, False)
        for _ in range(20):
            text = "".join(rng.choice("ab c\nd") for _ in range(rng.randint(0, 15)))
            assert counter.counts([text]) == [len(reference.encode(text).ids)]


def lines_model(rows, run, long=250):
    """The kept text and the number of removed lines of (id, text) rows with unique ids."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    seen, out = set(), {}
    for i in order:
        key, text = rows[i]
        if text is None:
            out[key] = (None, 0)
            continue
        raw = text.split("\n")
        full = [j for j, x in enumerate(raw) if x.strip(" ")]
        gone = set()
        lines = [raw[j].strip(" ") for j in full]
        windows = [("run", k, run) for k in range(len(lines) - run + 1)]
        windows += [("line", k, 1) for k, x in enumerate(lines) if len(x) >= long]
        windows += [("document", 0, len(lines))] if 0 < len(lines) < run else []
        for kind, k, n in windows:
            window = (kind, *lines[k : k + n])
            if window in seen:
                gone |= set(range(k, k + n))
            seen.add(window)
        cut = set()
        for k in gone:
            cut.add(full[k])
            if k + 1 in gone:
                cut |= set(range(full[k], full[k + 1]))
        # two removed runs that touch are one run
        out[key] = ("\n".join(x for j, x in enumerate(raw) if j not in cut), len(gone))
    return out


def test_line_dedup_against_model(spark):
    rng = random.Random(11)
    for run in (2, 3):
        texts = ["\n".join(rng.choice(["a", "b", " c ", "d", "", "e"]) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None, "", "a\nb\nc\nd", "a\nb\nc\nd"]
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "k", "p") for i, t in rows], "doc_id long, text string, key string, th string").repartition(4)
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df, run).collect()}
        assert got == lines_model(rows, run)


def test_long_lines_and_short_documents_against_model(spark):
    rng = random.Random(12)
    for run in (2, 3, 4):
        texts = ["\n".join(rng.choice(["a", "b", "c", "", "long " * 4, "  other " * 3, "llllllllllll"]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df, run, long=12).collect()}
        assert got == lines_model(rows, run, 12)
        assert sum(n for _, n in got.values()) > 60


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(None, "1\n2\n3"), (5, "1\n2\n3\n\n4"), (5, "1\n2\n3\n\n4"), (5, "9"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(None, "1\n2\n3", 3, 0), (5, "\n4", 4, 3), (5, "\n4", 4, 3), (5, "9", 1, 0), (7, None, 0, 0)], key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def passages_model(rows, passage):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = (text or "").split()
        gone = set()
        for k in range(len(words) - passage + 1):
            window = tuple(words[k : k + passage])
            if window in seen:
                gone |= set(range(k, k + passage))
            seen.add(window)
        out[key] = gone
    return out


def test_suffix_dedup_against_model(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randint(8, 30))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice("xyz") + str(rng.randrange(50)) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        texts.append(f"{parts[0]} {rng.choice(shared)}\n{parts[1]}  {rng.choice(shared)} {parts[2]}")
    texts += [None, "", "one", texts[0], texts[0], "q " * 60, "é ü " * 30]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, first int, n_words string").repartition(5)
    found = suffix_dedup.repeated_passages(df, passage=10, prefix=4)
    model = passages_model(rows, 10)
    got = {r.doc_id: {w for x in r.runs for w in range(x.a, x.b + 1)} for r in found.collect()}
    assert got == model
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_passages(df, found).collect()}
    for i, t in rows:
        assert (kept[i] or "").split() == [w for k, w in enumerate((t or "").split()) if k not in model[i]]
        if not model[i]:
            assert kept[i] == t


def test_suffix_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (3, long), (3, long), (3, "short"), (4, "x " + long + " y")], "doc_id long, text string")
    found = suffix_dedup.repeated_passages(df)
    got = sorted(((r.doc_id, r.n_words, [(x.a, x.b) for x in r.runs]) for r in found.collect()), key=repr)
    assert got == sorted([(None, 60, []), (3, 60, [(0, 59)]), (3, 60, [(0, 59)]), (3, 1, []), (4, 62, [(1, 60)])], key=repr)
    assert sorted(repr(r.text) for r in suffix_dedup.remove_passages(df, found).collect()) == sorted([repr(long), "''", "''", "'short'", "'x y'"])
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0


def jaccard_model(rows, threshold, size):
    sets = {}
    for key, text in rows:
        w = (text or "").split()
        sets[key] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    keys = sorted(sets)
    links = {a: [b for b in keys if a != b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9] for a in keys}
    top = {}
    for a in keys:
        if a not in top:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in top:
                    top[x] = a
                    todo += links[x]
    return {a: (len(links[a]), top[a]) for a in keys}


def test_jaccard_against_model(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(8):
        base = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(999)}"
            texts += [" ".join(copy)] * rng.randint(1, 2)
    texts += [None, "", "a b", "a b", "a  b\n", "a b c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, set_key string, n int").repartition(4)
    for block in (1024, 4):  # small blocks: a bucket is compared in several
        got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.similar_documents(df, block=block).collect()}
        assert got == jaccard_model(rows, 0.8, 5)


def test_jaccard_edges(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in jaccard.similar_documents(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (2, 2, None, False), (2, 2, None, False), (3, 0, 3, True)], key=repr)
    assert jaccard.similar_documents(df.limit(0)).count() == 0
    # the posterior rule keeps what can still reach the threshold
    assert all(m < 0.8 * n for n, m in jaccard.fewest_matches(0.8, 1e-5))


def test_jaccard_of_texts_with_one_id(spark):
    """Texts are told apart by their words, not by an id that they share or lack."""
    import corpus_pipeline

    near = " ".join(f"w{i}" for i in range(100))
    lone = " ".join(f"x{i}" for i in range(100))
    twin = " ".join(f"y{i}" for i in range(100))
    rows = [(3, near), (7, near + " end"), (7, lone), (None, twin), (None, twin + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_documents(df, hashed=True).join(df.select("text", F.xxhash64("text").alias("th")), "th").collect()
    assert len(got) == 5
    by = {r.text: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[near] == (1, 3, True) and by[near + " end"] == (1, 3, False) and by[lone] == (0, 7, True)
    assert by[twin][:2] == by[twin + " end"][:2] == (1, None) and by[twin][2] != by[twin + " end"][2]
    left = {r.text for r in corpus_pipeline.jaccard_join(spark, df, "").collect()}
    assert {near, lone} < left and len(left) == 3


def vectors(rng, n, dim=16, labels=3):
    base = rng.standard_normal((n, dim))
    base[n // 2 :] = base[rng.integers(0, 5, n - n // 2)] + 0.06 * rng.standard_normal((n - n // 2, dim))
    rows = [(i, [float(x) for x in v.astype(np.float32)], int(rng.integers(labels))) for i, v in enumerate(base)]
    rows[3] = (3, rows[2][1], rows[2][2])
    bad = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
    return rows + [(n + i, v, 1) for i, v in enumerate(bad)] + [(n + 20, rows[0][1], None), (n + 21, rows[0][1], None)]


def embedding_model(rows, threshold):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = collections.defaultdict(list)
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold:
                links[a[0]].append(b[0])
    top = {}
    for key in sorted(r[0] for r in rows):
        todo = [key] if key not in top else []
        while todo:
            x = todo.pop()
            if x not in top:
                top[x] = key
                todo += links[x]
    return {r[0]: (len(links[r[0]]), top[r[0]], top[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("window", [128, 4])
def test_embedding_dedup_against_model(spark, window):
    rows = vectors(np.random.default_rng(1), 160)
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<float>, label int, vector string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, window=window, part_rows=300, block=16).collect()}
    assert got == embedding_model(rows, 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    """Rows of one id with other vectors or labels are rows of their own; links never cross labels."""
    v, w, u = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0]
    rows = [(1, v, 0), (1, w, 1), (2, u, 0), (3, w, 1), (None, v, 0), (4, v, None), (5, None, 0), (1, v, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id or -1, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_cosine_at_the_threshold():
    """A pair that lies on the threshold links or not alike wherever it stands in a block."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((70, 24))
    y = rng.standard_normal((90, 24))
    x[::7], y[::9] = x[0], y[0]
    threshold = float(embedding_dedup._cosines(x[:1], y[:1])[0])
    for rows in (1, 13, 70):
        link = embedding_dedup.linked(x[:rows], y, threshold)
        assert link[::7][:, ::9].all()


def test_embedding_dedup_of_a_loose_cluster(spark):
    """1200 vectors whose cosines lie around the threshold, among unrelated ones of their label: all links count."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    near = centre + 0.0178 * rng.standard_normal((1200, 64))
    x = np.concatenate((near, rng.standard_normal((2800, 64))))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert 300 < want[:1200].mean() < 900
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(got[i] != n for i, n in enumerate(want.tolist())) == 0


@pytest.mark.parametrize("mean", [0.0, 0.93])
def test_embedding_dedup_in_a_narrow_cone(spark, mean):
    """Planted pairs just above the threshold among unrelated vectors of one label that have a high mean cosine: none is lost."""
    n, dim = 12_000, 32
    rng = np.random.default_rng(int(100 * mean))
    x = rng.standard_normal((n, dim))
    x[:, 0] = 0
    x *= np.sqrt(1 - mean) / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(mean)
    side = rng.standard_normal((200, dim))
    side -= (side * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    cosine = rng.uniform(0.9805, 0.985, (200, 1))
    x[200:400] = cosine * x[:200] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).filter("n_links > 0").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {int(i): int(c) for i, c in enumerate((unit @ unit.T >= 0.98).sum(axis=1) - 1) if c}
    assert len(want) >= 400 and set(got) <= set(want)
    assert sum(got.get(k) == c for k, c in want.items()) >= 0.99 * len(want)


def test_chance_of_unseen_links():
    """Shared signs by plain strings; passes grow with the size of a label."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 500), rng.integers(0, 1 << 63, 500)
    b[:400] = a[:400] ^ (np.int64(1) << rng.integers(0, 63, 400))
    plain = [next((i for i, (x, y) in enumerate(zip(f"{p:063b}", f"{q:063b}", strict=True)) if x != y), 63) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert embedding_dedup.shared_signs(a, b).tolist() == plain and embedding_dedup.shared_signs(a, a).tolist() == [63] * 500
    assert [embedding_dedup.passes_for(n, 0.98, 128, 0.01) for n in (0, 10**4, 10**6, 10**9)] == [4, 8, 15, 31]


@pytest.mark.parametrize("spread", [0.056, 0.04])
def test_nearest_in_a_narrow_cone(spark, spread):
    """Vectors with a mean cosine of about 0.83 and 0.91 still have pivots enough."""
    rng = np.random.default_rng(6)
    x = np.eye(1, 64) + spread * rng.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    assert len(ann.pivots_of(ann.usable(df, "vec_id", "embedding"), 256)) == 256
    hits = 0
    asked = df.filter("vec_id % 64 = 0")
    for q, group in _by_query(ann.search(df, asked, k=20, least=0).collect()):
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
        hits += len(set(order) & {g.vec_id for g in group})
    assert hits / (64 * 20) >= 0.9


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 1500)
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<float>, label int, vector string").repartition(3)
    asked = df.filter("vec_id % 20 = 0")
    ok = {r[0]: np.array(r[1], np.float64) for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    ids, matrix = np.array(list(ok)), np.stack(list(ok.values()))
    hits = total = 0
    for r_query, group in _by_query(ann.search(df, asked, k=20, block=400, query_block=20, least=200).collect()):
        score = matrix @ ok[r_query]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != r_query][:20]
        assert [g.rank for g in group] == list(range(1, 21)) and r_query not in [g.vec_id for g in group]
        assert all(abs(g.score - ok[r_query] @ ok[g.vec_id]) < 1e-9 for g in group)
        assert [(-g.score, g.vec_id) for g in group] == sorted((-g.score, g.vec_id) for g in group)
        hits += len({int(ids[i]) for i in order} & {g.vec_id for g in group})
        total += 20
    assert total == 20 * sum(1 for i in ok if i % 20 == 0) and hits / total >= 0.95
    few = ann.search(df.filter("vec_id < 5"), df.filter("vec_id < 5"), k=20).collect()
    assert len(few) == 20
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_nearest_ties_and_odd_rows(spark):
    """Equal vectors score alike and go by id; repeated ids count once; bad vectors and null ids take no part."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 48))
    rows = [(i, base[i % 40].tolist()) for i in range(2000)]
    rows += [(7, base[7].tolist()), (None, base[1].tolist()), (5000, [1.0] * 47), (5001, None), (5002, [0.0] * 48), (5003, [float("nan")] * 48), (5004, [None] * 48)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for q, group in _by_query(ann.search(df, df.filter("vec_id % 500 = 0"), k=20, block=300, least=100).collect()):
        score = {i: (base[i % 40] * base[q % 40]).sum() for i in range(2000) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [g.vec_id for g in group] == want and all(g.score == score[g.vec_id] for g in group)


def test_nearest_of_every_length(spark):
    """Vectors of a less usual length are searched among themselves."""
    rng = np.random.default_rng(21)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(300)] + [(900, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = dict(rows)
    got = _by_query(ann.search(df, df.filter("vec_id % 30 IN (0, 1)"), k=5, block=100).collect())
    found = {q: [r.vec_id for r in sorted(group, key=lambda r: r.rank)] for q, group in got}
    asked = [k for k in vectors if k % 30 in (0, 1) and k < 300]
    for q in asked:
        own = [(-float(np.dot(v, vectors[q])), k) for k, v in rows if k != q and len(v) == len(vectors[q])]
        assert found[q] == [k for _, k in sorted(own)[:5]], q
    assert set(found) == set(asked)


def test_nearest_recall_of_blocks():
    """Recall of the footrule order against brute force, on one block of unrelated vectors, the hardest case."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[rng.permutation(8192)[:256]]
    near = ann.nearest_pivots(x, pivots, 64)
    files, hits = ann.InvertedFiles(near, 256), 0
    places = np.full((8192, 256), 64)
    np.put_along_axis(places, near, np.arange(64)[None, :], 1)
    for q in range(0, 8192, 256):
        close = files.closeness(near[q])
        assert (close == (64 * 63 // 2 + 64) - np.abs(places - places[q]).sum(axis=1) / 2).all()  # the footrule distance itself
        best = np.argsort(-(x @ x[q]), kind="stable")[1:21]
        hits += len(set(best) & set(np.argsort(-close, kind="stable")[:1639]))
    assert hits / (32 * 20) >= 0.95


def _by_query(rows):
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        groups[r.query_id].append(r)
    return groups.items()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(top)}


def test_language_id(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_on_documents(docs_, rows=60)
    assert model.languages == ["de", "en", "es", "fr"] and (model.table == 0).mean() > 0.5
    found = langid.identify(docs_, model).join(docs_.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, ODD), model).collect()}
    assert odd[0] == odd[1] == odd[3] == ("und", 0.0) and odd[4][0] in model.languages

    assert langid.accept(docs(spark, ODD), model, 1e-9, 0.0).count() == sum(any(c.isalpha() for c in t or "") for t in ODD)
    blank = langid.train_on_documents(docs_.limit(0))
    assert langid.identify(docs_.limit(3), blank).first().lang_pred == "und"


def test_ftrl_against_plain_loops():
    """The array form gives the weights of the textbook update, coordinate by coordinate."""
    import math

    rng = random.Random(4)
    size, k, alpha, beta, l1, l2 = 12, 3, 0.7, 1.0, 0.02, 0.3
    rows = []
    for _ in range(40):
        slots = sorted(rng.sample(range(size), 4))
        rows.append((rng.randrange(k), np.array(slots), np.array([rng.random() for _ in slots])))
    turns = [rng.randrange(40) for _ in range(120)]
    z, n = [[0.0] * k for _ in range(size + 1)], [[0.0] * k for _ in range(size + 1)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for t in turns:
        y, slots, values = rows[t]
        x = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), size: 0.1}
        w = {i: [weight(i, c) for c in range(k)] for i in x}
        e = [math.exp(sum(v * w[i][c] for i, v in x.items())) for c in range(k)]
        for i, v in x.items():
            for c in range(k):
                g = v * (e[c] / sum(e) - (c == y))
                sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                z[i][c] += g - sigma * w[i][c]
                n[i][c] += g * g
    got = langid.ftrl(rows, turns, size, k, alpha, beta, l1, l2)
    assert np.allclose(got, [[weight(i, c) for c in range(k)] for i in range(size + 1)], atol=1e-12)
    assert (got == 0).any() and (got != 0).any()


def test_temperature_against_a_grid():
    rng = np.random.default_rng(1)
    scores = 6 * rng.standard_normal((500, 4))
    truth = np.array([rng.choice(4, p=np.exp(s / 3) / np.exp(s / 3).sum()) for s in scores])

    def loss(t):
        p = np.exp(scores / t) / np.exp(scores / t).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(500), truth]).mean()

    grid = np.linspace(0.2, 10, 2000)
    assert abs(langid.temperature(scores, truth) - grid[np.argmin([loss(t) for t in grid])]) < 0.01


def test_texts_of_no_known_language_are_rejected(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_on_documents(docs_, rows=300)
    strange = docs(spark, ["Привет, мир! Как дела сегодня?", "日本語のテキストです。", "ελληνικά κείμενα εδώ", "1234 5678", "", None, "x"])
    kept = langid.accept(strange, model).select("text").collect()
    assert not any(r.text and len(r.text) > 5 for r in kept)
    assert langid.accept(docs_, model).count() == docs_.count()


def test_language_sample_of_copies(spark):
    """A language of very many copies keeps all its texts in the sample; a language of many texts is cut to ``rows``."""
    copies = spark.range(40000).select(F.concat(F.lit("text "), F.col("id") % 4).alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(3000).select(F.concat(F.lit("other "), "id").alias("text"), F.lit("bb").alias("lang"))
    got = langid._sample(copies.unionByName(many), 20).collect()
    assert sorted(r.text for r in got if r.lang == "aa") == [f"text {i}" for i in range(4)]
    assert len({r.text for r in got if r.lang == "bb"}) == sum(r.lang == "bb" for r in got) == 20


def test_language_windows():
    text = "Ab c" * 30
    whole = np.concatenate(list(langid.hashes(langid.folded(text), 16)))
    old, langid.WINDOW = langid.WINDOW, 7
    try:
        cut = np.concatenate(list(langid.hashes(langid.folded(text), 16)))
    finally:
        langid.WINDOW = old
    assert collections.Counter(whole.tolist()) == collections.Counter(cut.tolist())


def test_contracts(spark):
    sf = "/root/testdata/sf0.001"
    types = {
        "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op2_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op4_token_file": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, columns in types.items():
        df = queries.QUERIES[name](spark, sf)
        assert dict(df.dtypes) == columns
        rows = df.collect()
        assert {r.doc_id for r in rows} == set(text)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in queries.QUERIES["op2_byte_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    t = tokenizer("word_bpe_49k.json")
    start = 0
    for r in sorted(queries.QUERIES["op4_token_file"](spark, sf).collect(), key=lambda r: r.doc_id):
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert {r.held_out for r in queries.QUERIES["op8_language_id"](spark, sf).select(F.col("held_out")).collect()} <= {True, False}


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunk_encoder_at_odd_marks(name, spaced):
    """Cached chunks give the library's ids where marks, blanks, cases and scripts meet."""
    import pyarrow as pa

    from quillspark.llm.chunks import binary_rows, library_encoder

    parts = ["foo", "Foo", "Äpfel", "ΣΑΣ", "İx", "don't", "'s", "3", "²", ".", ",", "!", "...", "$$$", "###", '"', "_", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\u00a0", "中文", "。", "\u0301", "\u037e", "🙂", "<|endoftext|>", "a" * 70, "\x01", "ª", "\u180e"]
    rng = random.Random(5)
    texts = ["", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(25))) for _ in range(3000))]
    library = tokenizer(name)
    library.encode_special_tokens = True
    expected = [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = library_encoder(P.path(name), spaced)
    assert [x for i in range(0, len(texts), 100) for x in binary_rows(*encoder.encode(pa.array(texts[i : i + 100]))).to_pylist()] == expected


def test_chars_grouped():
    import pyarrow as pa

    from quillspark.llm.common import chars_grouped

    batch = pa.RecordBatch.from_pydict({"k": [0, 1, 2, 3, 4], "text": ["aaaaa", None, "", "c" * 30, "d"]})
    for size in (1, 3, 10, 1000):
        groups = list(chars_grouped([batch, batch.slice(1, 2), batch.slice(0, 0)], "text", size))
        assert [k for b, _ in groups for k in b.column("k").to_pylist()] == [0, 1, 2, 3, 4, 1, 2]
        assert [t for _, ts in groups for t in ts] == ["aaaaa", "", "", "c" * 30, "d", "", ""]
        assert all(b.num_rows == len(ts) for b, ts in groups)
