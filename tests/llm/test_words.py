"""Word hashing helpers against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import components, jaccard, words
from quillspark.llm.chunks import ChunkEncoder, flattened

TEXT = st.text(alphabet="ab é\n\t日", max_size=40)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_equal_words_have_equal_hashes(a, b):
    x, y = a.split(), b.split()
    hx, hy = words.word_hashes(a), words.word_hashes(b)
    assert len(hx) == len(x) and len(hy) == len(y)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            assert (p == q) == (hx[i] == hy[j])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
def test_runs_and_windows(values, size):
    hashes = np.array(values, np.uint64)
    runs = words.run_hashes(hashes, size)
    keys = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(runs) == len(keys)
    assert len(set(keys)) == len(set(runs.tolist()))
    at = words.least_of_window(hashes, size)
    assert at.tolist() == [i + values[i : i + size].index(min(values[i : i + size])) for i in range(len(keys))]


def test_long_texts_are_hashed_in_parts():
    text = " ".join(f"w{i % 97}" for i in range(4000)) + " " + "y" * 500
    whole = words.word_hashes(text)
    old, words.PART = words.PART, 256
    try:
        assert (words.word_hashes(text) == whole).all()
        assert (words.run_hashes(whole, 7) == words.run_hashes(whole, 7)).all()
        small = words.run_hashes(whole, 7)
    finally:
        words.PART = old
    assert (small == words.run_hashes(whole, 7)).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=25))
def test_local_roots(links):
    up = components.roots(12, [a for a, _ in links], [b for _, b in links]) if links else np.arange(12)
    top = list(range(12))
    for _ in range(12):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert up.tolist() == top


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_verification_is_exact(a, b):
    sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
    pairs = np.array([0]), np.array([1])
    dense = np.zeros(9, int), np.ones(9, int)
    expected = len(a & b) >= 0.8 * len(a | b) - 1e-9
    assert jaccard._verified(sets, *pairs, 0.8).tolist() == [expected]
    assert jaccard._verified(sets, *dense, 0.8).tolist() == [expected] * 9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n,é　\x01", max_size=20), max_size=6))
def test_chunks_join_to_the_whole(texts):
    import regex
    import public_tokenizers as P

    pattern = regex.compile(P.PATTERN)
    spelled = lambda t: [ord(c) for m in pattern.findall(t) for c in f"<{m}>"]
    encoder = ChunkEncoder(lambda ws, led: flattened([spelled(" " * led + w) for w in ws]), lambda ws: flattened([spelled(w) for w in ws]), True)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == sum(map(spelled, texts), []) and counts.tolist() == [len(spelled(t)) for t in texts]
