"""Pages of an ordered listing, without sorting the listing in one task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.session import durable

MAX_PAGE_SIZE = 200
ROW_BITS = 33
# Rows that are sorted for a page, and ranges that are counted at a time on the way to them.
SORT_ROWS = 100_000
BUCKETS = 1024


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position`` (from 0) in the order of ``order``, which must be a total order.

    Rows are range-partitioned and sorted in parallel; a row's position is its place in its
    partition plus the sizes of the earlier partitions. The sorted copy is written once,
    since the sampled partition bounds must be the same for sizes and rows.
    """
    in_order = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = durable(
        in_order.withColumn("_part", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        )
    )
    # One row per partition from here on.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return numbered.join(starts, "_part").withColumn("position", F.col("_start") + F.col("_place")).drop(
        "_part", "_place", "_start"
    )


@dataclass(frozen=True)
class _Segment:
    """Rows that meet ``where`` have ``before`` rows ahead of them; the page takes some of their places."""

    where: Column
    before: int
    first: int
    last: int


def _digits(df: DataFrame, name: str) -> Iterator[Column] | None:
    """Whole numbers in whose order, one after the other, a column's values sort; nulls are null."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return iter([value.cast("bigint")])
    if isinstance(kind, T.DateType):
        return iter([F.unix_date(value).cast("bigint")])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iter([F.unix_micros(value.cast("timestamp"))])
    if isinstance(kind, T.StringType):
        # Seven bytes at a time as one number; beyond a text's end they are 0.
        part = lambda at: F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), at, 7)), 14, "0"), 16, 10)
        longest = df.agg(F.max(F.octet_length(value))).first()[0] or 0
        return (F.when(value.isNotNull(), part(at).cast("bigint")) for at in range(1, longest + 1, 7))
    return None


def _histogram(rows: DataFrame, digit: Column, least: int, greatest: int) -> list:
    """Rows, least and greatest number in each of up to ``BUCKETS`` ranges, in order; nulls come first."""
    width = (greatest - least) / BUCKETS
    place = F.floor((digit.cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")).cast("double") / F.lit(width))
    place = F.when(place.isNotNull(), F.least(place, F.lit(BUCKETS - 1)))
    counted = rows.groupBy(place.alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_digit").alias("least"), F.max("_digit").alias("greatest")
    )
    return sorted(counted.collect(), key=lambda r: -1 if r["place"] is None else r["place"])


def _narrowed(df: DataFrame, digit: Column, segment: _Segment, n: int, least, greatest) -> tuple[list[_Segment], list]:
    """The ranges of ``digit`` that hold places of the page, and each one's (n, least, greatest)."""
    rows = df.where(segment.where).select(digit.alias("_digit"))
    out, stats, before = [], [], segment.before
    for r in _histogram(rows, F.col("_digit"), least, greatest):
        first, last = max(segment.first, before), min(segment.last, before + r["n"] - 1)
        if first <= last:
            inside = digit.isNull() if r["least"] is None else digit.between(r["least"], r["greatest"])
            out.append(_Segment(segment.where & inside, before, first, last))
            stats.append((r["n"], r["least"], r["greatest"]))
        before += r["n"]
    return out, stats


def page_segments(df: DataFrame, order: list[str], total: int, first: int, last: int) -> list[_Segment] | None:
    """Sets of rows, of about ``SORT_ROWS`` at most, that hold the places ``first`` to ``last``.

    Found by counting rows in ranges of the order's columns, finer and finer around the page: each
    step is a scan that shuffles nothing but counts. Rows alike in all columns stay together,
    however many they are. None if a column's type has no order by whole numbers.
    """
    open_ = [(_Segment(F.lit(True), 0, first, last), total)]
    for name in order:
        digits = _digits(df, name)
        if digits is None:
            return None if any(n > SORT_ROWS for _, n in open_) else [s for s, _ in open_]
        for digit in digits:
            if all(n <= SORT_ROWS for _, n in open_):
                return [s for s, _ in open_]
            done = []
            for segment, n in open_:
                todo = [(segment, n, None, None)]
                if n > SORT_ROWS:
                    r = df.where(segment.where).agg(F.min(digit), F.max(digit), F.count(digit)).first()
                    # Nulls stand before all numbers and are told apart by the first histogram.
                    todo = [(segment, n, r[0], r[1])] if r[2] == n else [(segment, n, r[0], None)]
                while todo:
                    segment, n, least, greatest = todo.pop()
                    if n <= SORT_ROWS or least is None or least == greatest:
                        done.append((segment, n))
                        continue
                    if greatest is None:
                        greatest = df.where(segment.where).agg(F.max(digit)).first()[0]
                        greatest = greatest + 1 if greatest == least else greatest
                    parts, stats = _narrowed(df, digit, segment, n, least, greatest)
                    todo += [(p, *s) for p, s in zip(parts, stats)]
            open_ = done
    return [s for s, _ in open_]


def paginate(df: DataFrame, order: list[str], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page with its bookkeeping; page and size are clamped to what exists and is allowed.

    Only the rows of the ranges that hold the page are sorted, see ``page_segments``; columns
    whose type it can't count (fractions, structures) take ``positions`` of all rows instead.
    """
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    total = df.count()
    pages = max(1, -(-total // size))
    page = max(1, min(page, pages))
    start = (page - 1) * size
    segments = page_segments(df, order, total, start, min(total, start + size) - 1)
    if segments is None:
        placed = positions(df, order).where((F.col("position") >= start) & (F.col("position") < start + size))
    else:
        parts = []
        for s in segments:
            some = df.where(s.where).orderBy(*order).offset(s.first - s.before).limit(s.last - s.first + 1)
            # At most a page of rows is numbered.
            place = F.row_number().over(Window.orderBy(*order)) + F.lit(s.first - 1)
            parts.append(some.withColumn("position", place.cast("bigint")))
        placed = reduce(DataFrame.unionAll, parts)
    return placed.select(
        "*",
        F.lit(total).cast("bigint").alias("total"),
        F.lit(pages).cast("bigint").alias("total_pages"),
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).alias("page_size"),
        F.lit(page < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def latest_per(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Newest row of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each parent with its children as flat rows and their number; childless parents stay."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counted = parents.join(counts, key, "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_n")
    return counted.join(children, key, "left")
