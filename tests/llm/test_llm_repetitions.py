"""Periodic runs against a search of every period, and the parts they are found with."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import repetitions


def every_period(w):
    spans = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                spans.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def by_search(texts):
    return [sorted(zip(*(x.tolist() for x in r))) for r in repetitions.text_runs(texts)]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b


def text(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 100)
    out = []
    base = [b"%d" % rng.randrange(k + 1) for _ in range(rng.randint(1, 40))]
    while len(out) < n:
        out += base if rng.random() < 0.6 else [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            out += out[-rng.randint(1, len(out)) :]
    return out[:n]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_many_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [text(rng) for _ in range(rng.randint(1, 6))]
        assert by_search(texts) == list(map(every_period, texts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), min_size=1, max_size=3))
def test_runs_over_two_words(texts):
    assert by_search(texts) == list(map(every_period, texts))


def test_repetitive_texts():
    joined = [b"a", b"b"] * 20 + [b"b", b"a"] * 25
    texts = [fibonacci(400), [b"x"] * 333, joined, [b"y"] * 11, [b"y"] * 12, [], [str(i).encode() for i in range(500)]]
    assert by_search(texts) == list(map(every_period, texts))


def test_a_text_over_a_chunk(monkeypatch):
    monkeypatch.setattr(repetitions, "CHUNK_WORDS", 64)
    rng = random.Random(3)
    texts = [text(rng) for _ in range(9)] + [[b"p", b"q", b"r"] * 100, [b"z"] * 70]
    assert by_search(texts) == list(map(every_period, texts))


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        matrix = repetitions.WaveletMatrix(values)
        low = rng.integers(0, n, 50)
        high = np.array([rng.integers(a, n + 1) for a in low])
        bound = rng.integers(0, n + 3, 50)
        want = [min((v for v in values[a:b] if v >= c), default=n) for a, b, c in zip(low, high, bound)]
        assert matrix.successor(low, high, bound, n).tolist() == want


def test_suffixes_and_extensions():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 90):
        s = np.append(rng.integers(0, 2, n), 9)
        suffixes = repetitions.Suffixes(s, n)
        assert suffixes.order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        for _ in range(40):
            i, j = sorted(rng.integers(0, n + 1, 2).tolist())
            if i == j:
                continue
            ahead = next(k for k in range(n + 2) if j + k > n or s[i + k] != s[j + k])
            behind = next(k for k in range(n + 2) if i - k < 1 or s[i - k - 1] != s[j - k - 1])
            a, b = np.array([i]), np.array([j])
            assert (suffixes.forward(a, b)[0], suffixes.backward(a, b)[0]) == (ahead, behind)


def model(doc_id, text):
    words = (text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_period(words)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    fields = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *fields, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_rows(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))) for i in range(80)]
    docs += [(None, "a b " * 9), (None, None), (7, ""), (8, " \t\n "), (9, "x y \x0b z\x1c " * 8), (9, "x y \x0b z\x1c " * 8), (-3, "é ß " * 10)]
    docs += [(k, "one long word" + "w" * 100_000) for k in (1, 2)]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id bigint, text string, start int, period string")
    got = repetitions.periodic_runs(df, plant=True)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    want = [model(*d) for d in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5
    assert repetitions.periodic_runs(df.limit(0), plant=True).collect() == []
