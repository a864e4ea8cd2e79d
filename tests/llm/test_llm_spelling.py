"""Spelling variants against every pair of words, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from gristmill.llm import spelling
from gristmill.scratch import Scratch

COLUMNS = "doc_id bigint, text string, word string, near string, n int, node int"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def model(docs, plant):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if plant and doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def found(spark, docs, plant=True):
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in docs], COLUMNS)
    rows = spelling.spelling_variants(df, plant=plant).collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    if kind == 1:
        return word[:i] + word[i + 1 :]
    return word[:i] + rng.choice(letters) + word[i + 1 :]


@pytest.mark.parametrize("letters, size", [("ab", 60), ("abcé", 120), ("abcdefghijklmnopqrstuvwxyzßÿÀ", 250)])
def test_all_pairs(spark, letters, size):
    rng = random.Random(size)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(size // 3)]
    while len(words) < size:
        words.append(variants(rng, rng.choice(words), letters))
    # Repeated letters, where one edit has many places, and prefixes of one another.
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "bababa", "abababa", "ababababab"]
    docs = []
    for i in range(40):
        times = [rng.choice([4, 8] if k < size // 3 else [0, 0, 1]) for k in range(len(words))]
        text = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in zip(words, times) for _ in range(n)]
        docs.append((i * 7919, " ".join(text)))
    docs += [(None, " ".join(words[:9] * 5)), (3, None), (4, ""), (5, "..."), (5, "...")]
    got = found(spark, docs)
    assert got == model(docs, True)
    assert any(form for _, form, *_ in got) and any(n for *_, n, _ in got)


def test_chains_are_followed(spark):
    # Each is one edit from the next and five times as rare.
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcduzyx"]
    docs = [(None, " ".join(w for k, w in enumerate(chain) for _ in range(5 * 5 ** (4 - k))))]
    got = found(spark, docs)
    assert got == model(docs, True)
    assert {r[2] for r in got} == {"abcdefgh"}


def test_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab") for _ in range(20_000))
    other = long[:15_000] + "c" + long[15_001:]
    docs = [(1, " ".join([long] * 30 + [other] * 6 + [long[:-1]] * 5 + ["abcdef"] * 5))]
    got = {(len(w), None if f is None else len(f), n, k) for w, f, _, n, k, _ in found(spark, docs, plant=False)}
    assert got == {(20_000, None, 30, 2), (20_000, 20_000, 6, 1), (19_999, 20_000, 5, 1), (6, None, 5, 0)}


def test_ties_take_the_smallest_word(spark):
    docs = [(None, "letterb letterc " * 50 + "lettera " * 5)]
    assert found(spark, docs) == model(docs, True)
    assert ("lettera", "letterb", "letterb", 5, 2, 50) in found(spark, docs)


def test_no_frequent_words(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "few words only here")]) == set()


def test_levels_are_joined_on_the_edge_table(spark):
    words = spark.createDataFrame([("lettera", 5), ("letterb", 6), ("letters", 7)], "word string, n bigint")
    pairs = spelling.neighbours(words, Scratch(spark, "spelling-test"))
    assert sorted(map(tuple, pairs.collect())) == sorted(
        (a, b, {"lettera": 5, "letterb": 6, "letters": 7}[b]) for a in ("lettera", "letterb", "letters") for b in ("lettera", "letterb", "letters") if a != b
    )
