"""DartMinHash classes against all pairs in plain Python."""

import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from gristmill.functions.hashing import mix
from gristmill.llm import dart_minhash
from gristmill.operators import buckets, components
from gristmill.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, digest string, node bigint, keys string"


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def weighted_jaccard(a, b):
    shared = sum((a & b).values())
    whole = sum((a | b).values())
    return shared / whole if whole else 0.0


def expected_classes(rows):
    """doc id -> least id of its class; ids are unique here."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in rows if t is not None}
    texts = dict(rows)
    for (i, a), (j, b) in combinations(sets.items(), 2):
        if texts[i] == texts[j] or (a and weighted_jaccard(a, b) >= 0.8):
            p, q = root(i), root(j)
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def close_clusters(seed, clusters):
    """Three close versions and, some edits further, a pair that is similar to one another only."""
    rng, texts = random.Random(seed), []
    for c in range(clusters):
        base = [f"w{c}x{rng.randrange(400)}" for _ in range(200)]
        texts += [" ".join(edited(rng, base, 1)) for _ in range(3)]
        far = edited(rng, base, 6)
        texts += [" ".join(edited(rng, far, 2)), " ".join(edited(rng, far, 2))]
    return list(enumerate(texts))


def classes_of(df):
    return {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df, "doc_id", "text").collect()}


@pytest.mark.parametrize("small_bucket", [8, 0])
def test_close_clusters_lose_no_link(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(buckets, "SMALL_BUCKET", small_bucket)
    rows = close_clusters(small_bucket, 40)
    assert classes_of(frame(spark, rows)) == expected_classes(rows)


def test_one_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SLICE", 16)
    monkeypatch.setattr(buckets, "COMPARISONS", 8)
    monkeypatch.setattr(buckets, "COLUMNS", 64)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(1, 14)))) for i in range(160)]
    assert classes_of(frame(spark, rows)) == expected_classes(rows)


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, ""), (4, "..."), (5, "two words"), (6, "Two, WORDS"), (7, long), (8, long + " end"), (9, None)]
    found = classes_of(frame(spark, rows))
    assert found == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    assert frame(spark, []).count() == 0 and classes_of(frame(spark, [])) == {}


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "other words")]
    found = dart_minhash.near_duplicates(frame(spark, rows), "doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in found) == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]
    kept = dart_minhash.first_of_each_class(frame(spark, rows + [(3, None), (None, None)]), "doc_id", "text")
    assert kept.columns == ["doc_id", "text", "digest", "node", "keys"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]


def test_agreement_is_weighted_jaccard():
    rng = random.Random(5)
    a = [f"w{rng.randrange(60)}" for _ in range(300)]
    b = a[:230] + [f"z{rng.randrange(60)}" for _ in range(70)]
    texts = [" ".join(a).encode(), " ".join(b).encode()]
    truth = weighted_jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
    assert buckets.similarity(dart_minhash.weighted_sets, texts[:1], texts[1:])[0] == pytest.approx(truth)
    row, element, weight = dart_minhash.weighted_sets(texts)
    found = []
    for salt in range(30):
        moved = mix(element + np.uint64(salt * 977 + 1))
        s = dart_minhash.signatures(row, moved, weight * 3, 2, 128)
        assert (s != 0).all()
        found.append((s[0] == s[1]).mean())
    assert np.mean(found) == pytest.approx(truth, abs=0.03)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = components.connected_components(df, Scratch(spark, "t"), "c").collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in list(parent)}
    empty = components.connected_components(df.where("a < 0"), Scratch(spark, "t"), "e")
    assert empty.count() == 0


def test_many_short_texts_are_signed_in_bounded_memory():
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(4000)] + [None, "", "word " * 60_000]
    arrays = [pa.array(range(len(texts))), pa.array([b"x"] * len(texts)), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(arrays, ["_id", "digest", "_text"])
    sign = dart_minhash._signature_rows(dart_minhash.BANDS, dart_minhash.BAND_ROWS)
    tracemalloc.start()
    out = pa.Table.from_batches(sign(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["_id"].to_pylist() == list(range(len(texts)))
    assert [len(x) for x in out["keys"].to_pylist()] == [dart_minhash.BANDS] * 4000 + [0, 0, dart_minhash.BANDS]
    assert peak < 64 << 20
