"""Pages by counted ranges against a plain sort."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import paging

WORDS = ["", "a", "a\0", "ab", "prefix-prefix-prefix-1", "prefix-prefix-prefix-2", "prefix-prefix-é", "zz", "漢字"]


def key(value):
    """Nulls first, texts by their bytes."""
    return (value is not None, value.encode() if isinstance(value, str) else value) if value is not None else (False, 0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = []
    for i in range(700):
        out.append(
            (
                rng.choice([None, rng.choice(WORDS), rng.choice(WORDS) + str(rng.randrange(5))]),
                rng.choice([None, 5, 5, 5, -(2**63), 2**63 - 1, rng.randrange(10**6)]),
                rng.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(10**6))]),
                dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(50)),
                rng.random(),
                i,
            )
        )
    return out, spark.createDataFrame(out, "s string, n long, t timestamp, d date, x double, id int")


NAMES = ("s", "n", "t", "d", "x", "id")


@pytest.mark.parametrize("order", [("s", "id"), ("n", "id"), ("t", "s", "id"), ("d", "n", "id"), ("x", "id"), ("d", "x", "id")])
def test_pages_are_those_of_a_sort(rows, order, monkeypatch):
    monkeypatch.setattr(paging, "SORT_ROWS", 40)
    monkeypatch.setattr(paging, "BUCKETS", 8)
    data, df = rows
    at = [NAMES.index(c) for c in order]
    ids = [r[5] for r in sorted(data, key=lambda r: [key(r[i]) for i in at])]
    for page in (1, 9, 12, 35):
        got = paging.paginate(df, list(order), page, 20).orderBy("position").collect()
        assert [r["id"] for r in got] == ids[(page - 1) * 20 : page * 20]
        assert [r["position"] for r in got] == list(range((page - 1) * 20, page * 20))


def test_only_the_pages_ranges_are_sorted(rows, monkeypatch):
    monkeypatch.setattr(paging, "SORT_ROWS", 40)
    monkeypatch.setattr(paging, "BUCKETS", 8)
    _, df = rows
    segments = paging.page_segments(df, ["id"], 700, 340, 359)
    assert sum(df.where(s.where).count() for s in segments) <= 2 * 40
    # Half of the rows have one value: the next column tells them apart.
    segments = paging.page_segments(df.withColumn("same", F.lit(1)), ["same", "id"], 700, 340, 359)
    assert sum(df.withColumn("same", F.lit(1)).where(s.where).count() for s in segments) <= 2 * 40
    assert paging.page_segments(df, ["x", "id"], 700, 0, 19) is None


def test_rows_alike_in_all_columns(spark, monkeypatch):
    monkeypatch.setattr(paging, "SORT_ROWS", 10)
    df = spark.range(100).select(F.lit(7).alias("v"), F.lit("same").alias("s"))
    got = paging.paginate(df, ["v", "s"], 3, 30).collect()
    assert sorted(r["position"] for r in got) == list(range(60, 90))


def test_clamped_pages(spark):
    df = spark.range(95)
    got = paging.paginate(df, ["id"], 2, 20).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(20, 40))
    assert (got[0]["total"], got[0]["total_pages"], got[0]["has_next"], got[0]["has_prev"]) == (95, 5, True, True)
    last = paging.paginate(df, ["id"], 99, 20).collect()
    assert {r["page"] for r in last} == {5} and len(last) == 15 and not last[0]["has_next"]
    assert len(paging.paginate(df, ["id"], -3, 0).collect()) == 1
    assert paging.paginate(df, ["id"], 1, 5000).count() == 95
    assert paging.paginate(df.limit(0), ["id"], 1, 20).collect() == []
