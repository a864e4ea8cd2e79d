"""Events as a call log: errors are failures, the value is the latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import call_log
from gristmill.plans.registry import query, table

CHAIN = ("p0", "p1", "p2", "p3", "p4", "idle")
PRIVATE = "p3"
POLICIES = ["balanced", "fastest", "cheapest", "highest_quality", "privacy"]

_CALLS_SQL = """
  SELECT 'p' || user_id % 5 AS provider, NOT (event_type = 'error' OR (user_id % 5 = 2 AND event_type <> 'view')) AS success, value AS latency_ms,
    value / 1000 * (1 + user_id % 5) AS cost_usd, user_id % 5 = 1 AND event_id % 3 = 0 AS unavailable, event_id % 4 = 0 AS fallback_used FROM events"""
_STATS_SQL = f"""
  WITH calls AS ({_CALLS_SQL}), chain(provider, position) AS (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(CHAIN))}),
  c AS (SELECT provider, count(*) FILTER (WHERE success) AS s, count(*) FILTER (WHERE NOT success) AS f,
    sum(latency_ms) FILTER (WHERE success) AS lat, sum(cost_usd) FILTER (WHERE success) AS cost,
    count(*) FILTER (WHERE NOT success AND unavailable) AS u FROM calls GROUP BY 1),
  stats AS (SELECT provider, position, coalesce(s, 0) AS success_count, coalesce(f, 0) AS failure_count, coalesce(u, 0) AS unavailable_count,
    coalesce(s / (s + f), 1.0) AS success_rate, coalesce(f / (s + f), 0.0) AS failure_rate,
    round_even(coalesce(lat / nullif(s, 0), 0.0), 8) AS avg_latency_ms, round_even(coalesce(cost, 0.0), 8) AS total_cost_usd
    FROM chain LEFT JOIN c USING (provider))"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("user_id") % 5
    failed = (F.col("event_type") == "error") | ((kind == 2) & (F.col("event_type") != "view"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), kind.cast("string")).alias("provider"),
        (~failed).alias("success"),
        F.col("value").alias("latency_ms"),
        (F.col("value") / 1000 * (1 + kind)).alias("cost_usd"),
        ((kind == 1) & (F.col("event_id") % 3 == 0)).alias("unavailable"),
        (F.col("event_id") % 4 == 0).alias("fallback_used"),
    )


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = spark.createDataFrame([(p, i) for i, p in enumerate(CHAIN)], "provider string, position int")
    return call_log.provider_stats(_calls(spark, sf_dir), chain)


@query("provider_stats", f"{_STATS_SQL} SELECT * FROM stats")
def provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(
    "provider_ranking",
    f"""{_STATS_SQL}, k AS (
      SELECT *, 'balanced' AS policy, 0.0 AS key FROM stats UNION ALL SELECT *, 'fastest', avg_latency_ms FROM stats
      UNION ALL SELECT *, 'cheapest', total_cost_usd FROM stats UNION ALL SELECT *, 'highest_quality', -success_rate FROM stats
      UNION ALL SELECT *, 'privacy', CASE WHEN provider = '{PRIVATE}' THEN 0 ELSE 1 END FROM stats),
    r AS (SELECT policy, provider, success_rate >= 0.5 AND unavailable_count < 3 AS healthy,
      row_number() OVER (PARTITION BY policy ORDER BY key, position) AS place FROM k)
    SELECT policy, provider, place, healthy, place = coalesce(min(place) FILTER (WHERE healthy) OVER (PARTITION BY policy),
      max(place) OVER (PARTITION BY policy)) AS selected FROM r""",
)
def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_log.rank_providers(_stats(spark, sf_dir), POLICIES, PRIVATE)


@query(
    "call_counters",
    f"""SELECT provider, count(*) AS calls, count(*) FILTER (WHERE fallback_used) AS fallback,
      count(*) FILTER (WHERE NOT fallback_used) AS "primary" FROM ({_CALLS_SQL}) GROUP BY 1""",
)
def call_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_log.call_counters(_calls(spark, sf_dir))


@query(
    "metric_histogram",
    """WITH k AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 1000)
    SELECT event_type, count(*) AS count, round_even(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round_even(avg(value), 8) AS avg,
      list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95 FROM k GROUP BY 1""",
)
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    return call_log.histogram_snapshot(samples, "event_type", "value", ["ts", "event_id"])
