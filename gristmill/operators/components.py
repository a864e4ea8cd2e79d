"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.scratch import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (columns ``a``, ``b``); the least node names it.

    Each half step replaces a node's links by links to its least neighbour; the least neighbour
    is written first, so a node with very many links joins it in several tasks. No links or
    labels pass through the driver, only a count and a checksum that tell whether a step
    changed anything. No links give no rows.
    """

    def keep(df: DataFrame, label: str) -> DataFrame:
        return scratch.keep(df, f"{name}-{label}")

    edges = keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0"
    )
    state, step = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state, step = tuple(now), step + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(_least_neighbour(both).select("u", F.least("u", "m").alias("m")), f"{step}-least")
        large = keep(
            both.where("v > u")
            .join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            f"{step}-large",
        )
        hubs = keep(_least_neighbour(large), f"{step}-hubs")
        moved = large.join(hubs, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(moved.union(hubs.select("u", F.col("m").alias("v"))).distinct(), str(step))
        scratch.drop(*[f"{name}-{x}" for x in (f"{step}-least", f"{step}-large", f"{step}-hubs", str(step - 1))])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
