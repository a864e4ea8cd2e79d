"""Quantile sketches: exact while small, within their rank error when large, the same in any cut."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import sketches
from gristmill.streaming import jobs

SHARES = (0.01, 0.5, 0.95, 1.0)


def exact(values, share):
    values = sorted(v for v in values if v is not None)
    return values[math.ceil(round(share * len(values), 7)) - 1] if values else None


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows = [("m%d" % rng.randrange(3), 3600 * rng.randrange(60) + 5, rng.choice([None, rng.gauss(0, 5), 1.0])) for _ in range(900)]
    rows += [("nothing", 5, None)]
    return rows, spark.createDataFrame(rows, "m string, s long, v double").selectExpr("m", "timestamp_seconds(s) AS ts", "v")


def test_small_metrics_are_exact(samples):
    rows, df = samples
    got = df.groupBy("m").agg(sketches.values_sketch("v").alias("k")).select("m", *[sketches.quantile("k", q).alias(str(q)) for q in SHARES])
    for r in got.collect():
        assert [r[str(q)] for q in SHARES] == [exact([v for m, _, v in rows if m == r["m"]], q) for q in SHARES]


def test_hours_add_up_to_days(samples):
    rows, df = samples
    days = sketches.rolled_up(sketches.metric_sketches(df, "m", "ts", "v"), "m")
    got = {(r["m"], r["span"].day): (r["count"], r["p"]) for r in days.select("m", "span", "count", sketches.quantile("sketch", 0.95).alias("p")).collect()}
    want = {}
    for m, s, v in rows:
        want.setdefault((m, s // 86_400 + 1), []).append(v)
    assert got == {k: (sum(v is not None for v in vs), exact(vs, 0.95)) for k, vs in want.items()}


def test_large_metrics_are_within_the_rank_error(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("m"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    got = df.repartition(6).groupBy("m").agg(sketches.values_sketch("v").alias("k")).select(
        *[sketches.quantile("k", q).alias(str(q)) for q in SHARES]
    ).first()
    values = sorted(r["v"] for r in df.select("v").collect())
    for q in SHARES:
        assert abs(bisect.bisect_right(values, got[str(q)]) / len(values) - q) < 0.005


def test_rolling_windows(samples):
    rows, df = samples
    got = {(r["m"], r["window_start"].timestamp()): r["p95"] for r in jobs.rolling_metrics(df, "m", "ts", "v", "6 hours").collect()}
    want = {}
    for m, s, v in rows:
        want.setdefault((m, s // 21_600 * 21_600), []).append(v)
    assert got == {k: exact(vs, 0.95) for k, vs in want.items()}
