"""Shared n-grams against plain sets, and sketches within their error."""

import gc
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.operators import curate, overlap


def grams(text, n):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def of(rows, n):
    out = {}
    for name, text in rows:
        out.setdefault(name, set()).update(grams(text, n))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "İx"]
    out = [(rng.choice(["a", "b", "c", None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 60])))) for _ in range(200)]
    shared = " ".join(words[:9])
    return out + [("a", shared), ("b", "Start " + shared), ("b", shared.upper()), ("d", None), ("e", " \t\n"), ("e", "long " * 3000)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_keys_are_n_grams(spark, rows, n):
    df = spark.createDataFrame(rows, "name string, text string")
    got = {r["name"]: r["n"] for r in overlap.gram_keys(df, "name", "text", n).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {name: len(g) for name, g in of(rows, n).items() if g}


@pytest.mark.parametrize("limit", [overlap.BROADCAST_KEYS, 0])
def test_shared_grams(spark, rows, limit, monkeypatch):
    """Broadcast and, beyond the size limit, shuffled."""
    monkeypatch.setattr(overlap, "BROADCAST_KEYS", limit)
    held = [("w0 w1 w2 w3 w4 w5",), ("nothing in common here at all",), ("short one",), (None,)]
    df, other = spark.createDataFrame(rows, "name string, text string"), spark.createDataFrame(held, "body string")
    want = set().union(*(grams(t, 5) for (t,) in held))
    result = overlap.shared_with(df, "name", "text", other, "body")
    got = {r["name"]: (r["shared_grams"], r["overlap_ratio"]) for r in result.collect()}
    own = of(rows, 5)
    assert got == {name: (len(own[name] & want), round(len(own[name] & want) / len(want), 4)) for name in own}
    assert got["a"][0] == 2 and got["d"] == (0, 0.0)
    exact = curate.overlap_with(df, "name", "text", other, "body").collect()
    assert {r["name"]: r["grams"] for r in exact if r["name"]} == {k: len(v) for k, v in own.items() if k and v}


def test_only_shared_keys_are_shuffled(spark, rows):
    df, other = spark.createDataFrame(rows, "name string, text string"), spark.createDataFrame([("w0 w1 w2 w3 w4",)], "body string")
    plan = overlap.shared_with(df, "name", "text", other, "body")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("LeftSemi") > plan.index("Exchange hashpartitioning")


def test_without_other_or_own(spark, rows):
    df, none = spark.createDataFrame(rows, "name string, text string"), spark.createDataFrame([], "body string")
    assert {r["shared_grams"] for r in overlap.shared_with(df, "name", "text", none, "body").collect()} == {0}
    assert overlap.shared_with(df.limit(0), "name", "text", none, "body").collect() == []


def test_sketches_are_exact_while_small_and_close_when_large(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(500)]
    rows = [(name, " ".join(rng.choice(words) for _ in range(400))) for name in "xy" for _ in range(60)]
    rows += [("y", t) for name, t in rows[:30]]
    df = spark.createDataFrame(rows, "name string, text string")
    own = of(rows, 3)
    for log_entries, error in ((16, 0.0), (10, 4 / 2**5)):
        made = overlap.sketches(df, "name", "text", 3, log_entries)
        got = {r["name"]: (r["grams"], r["shared_grams"]) for r in overlap.estimates(made, "name", made.where("name = 'y'"), log_entries).collect()}
        for name in "xy":
            assert abs(got[name][0] - len(own[name])) <= error * len(own[name])
            assert abs(got[name][1] - len(own[name] & own["y"])) <= error * max(map(len, own.values()))


def test_words_of_a_chunk_are_freed_at_once():
    gc.collect()
    gc.disable()
    try:
        overlap.chunk_keys(["a b c d e f", "a"], 5)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_texts_become_objects_chunk_by_chunk():
    texts = [f"{i} " + f"{'é' * 999} " * 50 for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 300), pa.array(texts)], ["_dataset", "_text"])
    size = batch.nbytes
    del texts
    tracemalloc.start()
    try:
        assert sum(len(hi) for _, _, hi, _ in overlap.batch_keys(iter([batch]), 5)) == 300 * 47
        assert tracemalloc.get_traced_memory()[1] < size / 3
    finally:
        tracemalloc.stop()


@pytest.fixture(params=[(2000, 70, 3), (2000, 500, 10**6), (8 << 20, 1 << 19, 20)])
def limits(request, monkeypatch):
    """Many parts, several packed rows a part, and parts whose repeated keys are dropped early."""
    for name, value in zip(("PART_BYTES", "PACKED_KEYS", "MERGED_KEYS"), request.param):
        monkeypatch.setattr(overlap, name, value)


def test_between_datasets_by_packed_keys(spark, rows, limits):
    df = spark.createDataFrame(rows + rows[:50], "name string, text string")
    result = curate.overlap_between(df, "name", "text")
    own = {name: g for name, g in of(rows, 5).items() if g}
    got = {r["name"]: (r["grams"], r["shared_grams"], r["overlap_ratio"]) for r in result.collect()}
    want = {}
    for name, g in own.items():
        both = len(g & set().union(*(other for n, other in own.items() if n != name)))
        want[name] = (len(g), both, round(both / len(g), 4))
    assert got == want and None in got
    # No row, sort or window for each key.
    assert "Window" not in result._jdf.queryExecution().executedPlan().toString()


def test_other_collection_by_packed_keys(spark, rows, limits):
    held = [(t,) for _, t in rows[::5]] * 2 + [(None,), ("not in any",)]
    df, other = spark.createDataFrame(rows, "name string, text string"), spark.createDataFrame(held, "body string")
    want = set().union(*(grams(t, 5) for (t,) in held))
    result = curate.overlap_with(df, "name", "text", other, "body")
    got = {r["name"]: (r["grams"], r["shared_grams"], r["overlap_ratio"]) for r in result.collect()}
    assert got == {name: (len(g), len(g & want), round(len(g & want) / len(want), 4)) for name, g in of(rows, 5).items() if g}
    assert "Join" not in result._jdf.queryExecution().executedPlan().toString()


def test_a_key_in_many_rows_is_held_some_times():
    piece = (pa.array(["a", "b"]), *overlap.np.array([[0, 0, 1, -1], [5, 5, 5, 7], [1, 1, 1, 2]], dtype="i8"))
    packed = pa.Table.from_batches([overlap.packed(piece, 3)] * 5000).combine_chunks().sort_by("hi").to_batches(max_chunksize=10)
    del piece
    tracemalloc.start()
    try:
        ((part, (names, code, hi, lo)),) = overlap.by_part(iter(packed), 100)
        assert tracemalloc.get_traced_memory()[1] < 100_000
    finally:
        tracemalloc.stop()
    found = {(names[c].as_py() if c >= 0 else None, *k) for c, *k in zip(code.tolist(), hi.tolist(), lo.tolist())}
    assert part == 0 and len(code) == 3 and found == {("a", 5, 1), ("b", 5, 1), (None, 7, 2)}
