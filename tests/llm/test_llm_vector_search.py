"""Top-k search against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import vector_search

SCHEMA = "vec_id bigint, embedding array<double>, shard string, score int"


def expected(rows, k, asks):
    whole = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, v) in enumerate(whole):
        if asks(q):
            others = [(i, w) for place, (i, w) in enumerate(whole) if place != at and len(w) == len(v)]
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in others)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k, step):
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    out = vector_search.top_k(df, F.col("vec_id") % step == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("values", [1 << 19, 64])
def test_random_rows(spark, monkeypatch, values):
    monkeypatch.setattr(vector_search, "SHARD_VALUES", values)
    monkeypatch.setattr(vector_search, "TILE_VALUES", values // 2)
    monkeypatch.setattr(vector_search, "COLUMNS", 7)
    monkeypatch.setattr(vector_search, "FAN", 3)
    rng = random.Random(values)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, 2.0]) for _ in range(rng.choice([4, 4, 3]))]) for i in range(150)]
    rows += rows[:20] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)]
    rows += [(None, [1.0] * 4), (300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4)]
    assert run(spark, rows, 5, 10) == expected(rows, 5, lambda i: i % 10 == 0)


def test_few_rows(spark):
    assert run(spark, [], 5, 1) == []
    assert run(spark, [(1, [1.0])], 5, 1) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])], 5, 2) == [(2, 1, 1, 131072)]


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e5 + 0.5, 3.0]), (1, [1e5, 1.0]), (2, [1e5, 1.25])]
    assert run(spark, rows, 5, 5) == expected(rows, 5, lambda i: i % 5 == 0)
    rows = [(i, [1e6 + i, 7.0]) for i in range(4)]
    assert run(spark, rows, 5, 1) == expected(rows, 5, lambda i: True)


def test_outliers_cost_no_other_result(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(8)]) for i in range(40)]
    at = lambda **places: [places.get(f"p{i}", 0.0) for i in range(8)]
    rows += [(40, at(p6=2e6)), (41, at(p5=2e6)), (42, at(p4=3e14, p7=0.5))]
    # Sums that leave 64 bits on the way and come back, and one that falls below without being among the best.
    rows += [(50, at(p0=3e13, p1=3e13, p2=3e13)), (51, at(p0=3e13, p1=-3e13, p3=1.0)), (52, at(p2=-3e13))]
    want = expected(rows, 5, lambda i: i % 10 == 0)
    assert all(abs(score) < 2**63 for *_, score in want)
    assert run(spark, rows, 5, 10) == want


def test_a_returned_score_beyond_64_bits_stops_the_query(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e16]), (1, [1e16])], 5, 1)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e16]), (1, [-1e16])], 5, 1)


def test_repeated_rows_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (4, []), (4, []), (3, [0.0, 1.0])]
    got = run(spark, rows, 3, 2)
    assert got == expected(rows, 3, lambda i: i % 2 == 0)
    assert (2, 1, 4, 0) in got and got.count((0, 1, 0, 5 * 65536)) == 2
