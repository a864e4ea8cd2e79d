"""Quantiles of metrics by mergeable KLL sketches: one small row per metric and time span.

A sketch keeps all values up to some thousand and then a sample with a bounded error of rank, so
a metric with most of the samples costs a task no more than any other, and sketches of hours add
up to those of days without reading the samples again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank error of some 0.1 %; up to this many values the quantiles are exact.
SKETCH_K = 4096


def values_sketch(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.kll_sketch_agg_double(column.cast("double"), SKETCH_K)


def quantile(sketch: Column | str, share: float) -> Column:
    """The least value that at least ``share`` of the values don't exceed; null without values."""
    sketch = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def metric_sketches(samples: DataFrame, metric: str, ts: str, value: str, unit: str = "hour") -> DataFrame:
    """(metric, span, count, sum, min, max, sketch) per time unit, to be kept and added up later."""
    return samples.groupBy(metric, F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("span")).agg(
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        values_sketch(value).alias("sketch"),
    )


def rolled_up(kept: DataFrame, metric: str, unit: str = "day") -> DataFrame:
    """Kept rows added up over longer spans, without the samples."""
    return kept.groupBy(metric, F.date_trunc(unit, F.col("span")).alias("span")).agg(
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"),
    )
