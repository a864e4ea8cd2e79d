"""Statistics over a provider call log and over metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Health limits of a provider, samples kept per metric, percentile.
MIN_SUCCESS_RATE = 0.5
MAX_UNAVAILABLE = 3
KEPT_SAMPLES = 1000
PERCENTILE = 0.95


def provider_stats(calls: DataFrame, chain: DataFrame) -> DataFrame:
    """Rates, latency and cost per provider of ``chain`` (``provider, position``).

    ``calls`` has ``provider, success, latency_ms, cost_usd, unavailable``. A provider without
    calls counts as fully successful.
    """
    ok = F.col("success")
    counted = calls.groupBy("provider").agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.sum(F.when(ok, F.col("latency_ms"))).alias("_latency"),
        F.sum(F.when(ok, F.col("cost_usd"))).alias("_cost"),
        F.count_if(~ok & F.col("unavailable")).alias("unavailable_count"),
    )
    joined = chain.join(counted, "provider", "left").na.fill(
        0, ["success_count", "failure_count", "unavailable_count"]
    )
    total = F.col("success_count") + F.col("failure_count")
    return joined.select(
        "provider",
        "position",
        "success_count",
        "failure_count",
        "unavailable_count",
        F.coalesce(F.try_divide("success_count", total), F.lit(1.0)).alias("success_rate"),
        F.coalesce(F.try_divide("failure_count", total), F.lit(0.0)).alias("failure_rate"),
        F.bround(F.coalesce(F.try_divide("_latency", "success_count"), F.lit(0.0)), 8).alias("avg_latency_ms"),
        F.bround(F.coalesce("_cost", F.lit(0.0)), 8).alias("total_cost_usd"),
    )


def policy_key(policy: str, private_provider: str) -> Column:
    """Sort key of a routing policy; equal keys keep the chain's order."""
    keys = {
        "fastest": F.col("avg_latency_ms"),
        "cheapest": F.col("total_cost_usd"),
        "highest_quality": -F.col("success_rate"),
        "privacy": F.when(F.col("provider") == private_provider, 0.0).otherwise(1.0),
    }
    return keys.get(policy, F.lit(0.0)).cast("double")


def rank_providers(stats: DataFrame, policies: list[str], private_provider: str) -> DataFrame:
    """Each policy's order of the providers and its pick: the first healthy one, else the last."""
    healthy = (F.col("success_rate") >= MIN_SUCCESS_RATE) & (F.col("unavailable_count") < MAX_UNAVAILABLE)
    entries = F.array(
        *[F.struct(F.lit(p).alias("policy"), policy_key(p, private_provider).alias("key")) for p in policies]
    )
    spread = stats.withColumn("healthy", healthy).select("*", F.explode(entries).alias("e"))
    # One row per provider of the chain, hence small.
    by_policy = Window.partitionBy("policy")
    ranked = spread.select("e.policy", "e.key", "provider", "position", "healthy").withColumn(
        "place", F.row_number().over(by_policy.orderBy("key", "position"))
    )
    first_healthy = F.min(F.when(F.col("healthy"), F.col("place"))).over(by_policy)
    last = F.max("place").over(by_policy)
    return ranked.select(
        "policy", "provider", "place", "healthy", (F.col("place") == F.coalesce(first_healthy, last)).alias("selected")
    )


def call_counters(calls: DataFrame) -> DataFrame:
    """Calls, and how many were answered by the fallback, per provider."""
    return calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("fallback_used")).alias("fallback"),
        F.count_if(~F.col("fallback_used")).alias("primary"),
    )


def last_samples(samples: DataFrame, metric: str, order: list[str], n: int = KEPT_SAMPLES) -> DataFrame:
    """Newest ``n`` samples per metric; tasks forward at most ``n`` rows per metric."""
    age = F.row_number().over(Window.partitionBy(metric).orderBy(*[F.desc(c) for c in order]))
    return samples.withColumn("_age", age).where(F.col("_age") <= n).drop("_age")


def histogram_snapshot(samples: DataFrame, metric: str, value: str, order: list[str]) -> DataFrame:
    """Count, sum, min, max, mean and nearest-rank p95 of each metric's newest samples."""
    kept = last_samples(samples, metric, order)
    ranked = F.sort_array(F.collect_list(value))  # at most KEPT_SAMPLES values
    at = F.bround(F.lit(PERCENTILE) * (F.count(F.lit(1)) - 1)).cast("int")
    return kept.groupBy(metric).agg(
        F.count(F.lit(1)).alias("count"),
        F.bround(F.sum(value), 4).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.bround(F.avg(value), 8).alias("avg"),
        F.get(ranked, at).alias("p95"),
    )
