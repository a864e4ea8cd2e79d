"""Classes of similar texts from buckets that similar texts are likely to share.

A *node* is a distinct text with the keys of its buckets. ``sets(texts)`` gives the texts'
weighted sets as arrays (row, element, weight), sorted by row; the similarity of two texts is the
weighted Jaccard similarity of their sets, computed on whole texts.

1. Every member of a bucket is compared with the bucket's least member (a star, no pairs within
   the bucket); links give components.
2. Buckets that still hold several components are compared across components. In small ones the
   known distances to the least member prune pairs (the distance is a metric: texts whose
   distances to it differ by more than 1 - threshold can't be linked). Large ones are cut into
   slices, and pairs of slices are compared by matrix products within a task, which puts out
   only links that connect components. So a link between two texts counts whenever they share a
   bucket, whatever else is in it.
3. Components of all links are the classes.

A bucket that most rows share is spread: its least member's text is copied for many comparisons,
and slices are of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import GOLDEN, mix
from gristmill.operators.components import connected_components
from gristmill.scratch import Scratch

# A text compared with more others than this is copied, so that its comparisons spread.
COMPARISONS = 256
# Buckets of several components: up to this many rows they are compared as pairs, beyond it in
# blocks of slices of about SLICE rows, of which only a spanning set of links comes out.
SMALL_BUCKET = 8
SLICE = 256
# Slices that a block compares with one, at most.
PARTNERS = 4
# Elements that a block compares at a time, and bytes of texts that are compared at a time.
COLUMNS = 4096
CHUNK_BYTES = 1 << 18

Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def linked_components(
    nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float, scratch: Scratch
) -> DataFrame:
    """(node, component) of every node linked to another; the least node names the component.

    ``nodes`` has ``node`` (bigint, unique) and ``keys`` (array<bigint>); ``texts_of(wanted)``
    gives (node, text) of the nodes in ``wanted``, each once.
    """
    banded = nodes.select("node", F.explode("keys").alias("bucket"))
    leaders = scratch.keep(
        banded.groupBy("bucket")
        .agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "leaders",
    )
    members = scratch.keep(banded.join(leaders, "bucket"), "members")
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    texts = scratch.keep(texts_of(members.select("node").distinct()), "texts")
    compared = _compared(star, texts, sets, scratch, "star")
    links = compared.where(F.col("similarity") >= threshold).select("a", "b")
    first = connected_components(links, scratch, "first")
    pairs, slices = _across(members, first, compared, threshold, scratch)
    more = _compared(pairs, texts, sets, scratch, "across").where(F.col("similarity") >= threshold).select("a", "b")
    blocks = slices.join(texts, "node").select("block", "side", "node", "component", "text")
    inside = scratch.keep(
        blocks.groupBy("block").applyInPandas(_block_links(sets, threshold), "a bigint, b bigint"), "inside"
    )
    scratch.drop("members", "leaders", "texts")
    links = first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more).union(inside)
    return scratch.keep(connected_components(links, scratch, "final"), "components")


def similarity(sets: Sets, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of paired texts; 0 where both have no words."""
    out = np.zeros(len(a))
    sides = []
    for texts in (a, b):
        row, element, weight = _sets_of_all(sets, texts)
        sides.append((mix(element + row.astype(np.uint64) * GOLDEN), row, weight))
    (ka, ra, wa), (kb, rb, wb) = sides
    key = np.concatenate([ka, kb])
    order = np.argsort(key)
    key = key[order]
    # Each key occurs once in a side, so equal neighbours are one of either side.
    same = np.flatnonzero(key[1:] == key[:-1])
    ia, ib = np.minimum(order[same], order[same + 1]), np.maximum(order[same], order[same + 1]) - len(ka)
    shared = np.bincount(ra[ia], weights=np.minimum(wa[ia], wb[ib]), minlength=len(a))
    total = np.bincount(ra, weights=wa, minlength=len(a)) + np.bincount(rb, weights=wb, minlength=len(b))
    return np.divide(shared, total - shared, out=out, where=total > 0)


def _sets_of_all(sets: Sets, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sets(texts)``, but repeated texts are worked off once."""
    number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    row, element, weight = sets([*number])
    if len(number) == len(texts):
        return row, element, weight
    which = np.array([number[t] for t in texts])
    size = np.bincount(row, minlength=len(number))
    first, size = (np.cumsum(size) - size)[which], size[which]
    take = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    return np.repeat(np.arange(len(texts)), size), element[take], weight[take]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _compare(sets: Sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("_text_a"), batch.column("_text_b")
            size = sum(pc.binary_length(x).to_numpy().astype(np.int64) for x in (left, right))
            ends = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES, prepend=0))
            # Only the texts of one chunk at a time are held as Python objects.
            found = [
                similarity(sets, _bytes(left.slice(i, j - i)), _bytes(right.slice(i, j - i)))
                for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(size)])
                if j > i
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(np.concatenate(found) if found else [], pa.float64())],
                ["a", "b", "similarity"],
            )

    return run


def _compared(pairs: DataFrame, texts: DataFrame, sets: Sets, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b); an ``a`` in many pairs is copied to spread them."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    often = scratch.keep(
        pairs.groupBy("a")
        .agg(F.ceil(F.count(F.lit(1)) / COMPARISONS).cast("bigint").alias("copies"))
        .where("copies > 1"),
        f"{name}-often",
    )
    copies = F.coalesce("copies", F.lit(1).cast("bigint"))
    dealt = pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("copy"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_text_a")).join(often, "a", "left")
    left = left.select("a", "_text_a", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy"))
    joined = dealt.join(right, "b").join(left, ["a", "copy"]).select("a", "b", "_text_a", "_text_b")
    out = scratch.keep(joined.mapInArrow(_compare(sets), "a bigint, b bigint, similarity double"), f"{name}-compared")
    scratch.drop(f"{name}-pairs", f"{name}-often")
    return out


def _across(
    members: DataFrame, labels: DataFrame, compared: DataFrame, threshold: float, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in buckets that hold several components.

    Returns (pairs, slices): the pairs (a, b) of buckets of up to ``SMALL_BUCKET`` rows, and for
    larger buckets (block, side, node, component), where each block is one slice (side 0) and those
    to be compared with it (side 1), or a slice to be compared with itself (side 2).
    """
    distance = compared.select(
        F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("distance")
    )
    placed = (
        members.join(labels, "node", "left")
        .join(distance, ["leader", "node"], "left")
        .select(
            "bucket",
            "node",
            "leader",
            F.coalesce("component", "node").alias("component"),
            F.coalesce("distance", F.lit(0.0)).alias("distance"),
        )
    )
    placed = scratch.keep(placed, "placed")
    mixed = scratch.keep(
        placed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high")
        .select("bucket", "n"),
        "mixed",
    )
    # The least member has been compared with all of its bucket already.
    rest = scratch.keep(placed.where("node <> leader").join(mixed, "bucket").drop("leader"), "rest")
    few, many = rest.where(F.col("n") <= SMALL_BUCKET), rest.where(F.col("n") > SMALL_BUCKET)
    x = few.select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("node", "component", "distance")])
    y = few.select("bucket", *[F.col(c).alias(f"{c}_y") for c in ("node", "component", "distance")])
    near = F.abs(F.col("distance_x") - F.col("distance_y")) <= 1 - threshold + 1e-9
    pairs = (
        x.join(y, "bucket")
        .where((F.col("component_x") < F.col("component_y")) & near)
        .select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
        .distinct()
    )
    return pairs, _slices(many.select("bucket", "node", "component"), scratch)


def _slices(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Cuts buckets into slices of about ``SLICE`` rows and pairs the slices within a bucket.

    A component with more rows than that in a bucket gets slices of its own, which are not
    paired with one another; small components share slices.
    """
    held = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.keep(held.where(F.col("n") > SLICE).withColumnRenamed("n", "large"), "large")
    small = scratch.keep(
        held.where(F.col("n") <= SLICE).groupBy("bucket").agg(F.sum("n").alias("small")), "small"
    )
    own = F.col("large").isNotNull()
    parts = F.ceil(F.coalesce("large", "small") / SLICE)
    slot = F.pmod(F.when(own, F.xxhash64("node")).otherwise(F.xxhash64("component")), parts)
    cut = rows.join(large, ["bucket", "component"], "left").join(small, "bucket", "left")
    cut = scratch.keep(
        cut.select(
            "bucket", "node", "component", F.when(own, F.col("component")).otherwise(-1).alias("of"), slot.alias("slot")
        ),
        "cut",
    )
    slices = scratch.keep(cut.select("bucket", "of", "slot").distinct(), "slices")
    one = slices.select("bucket", F.struct("of", "slot").alias("one"))
    two = slices.select("bucket", F.struct("of", "slot").alias("two"))
    worth = (F.col("one") < F.col("two")) & ((F.col("one.of") != F.col("two.of")) | (F.col("one.of") == -1))
    worth = worth | ((F.col("one") == F.col("two")) & (F.col("one.of") == -1))
    same = F.col("one") == F.col("two")
    # Several slices are compared with one that is worked off once.
    some = F.when(~same, F.struct("two.of", F.floor(F.col("two.slot") / PARTNERS).alias("slots")))
    blocks = one.join(two, "bucket").where(worth).withColumn("block", F.xxhash64("bucket", "one", some))
    blocks = scratch.keep(blocks, "blocks")
    sides = blocks.select("bucket", "block", F.col("one").alias("slice"), F.when(same, 2).otherwise(0).alias("side"))
    sides = sides.distinct().union(blocks.where(~same).select("bucket", "block", "two", F.lit(1)))
    return cut.withColumn("slice", F.struct("of", "slot")).join(sides, ["bucket", "slice"]).select(
        "block", "side", "node", "component"
    )


def _units(row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element of weight w as w elements of weight one, the i-th shared with another's i-th."""
    times = weight.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row, times), mix(np.repeat(element, times) + nth.astype(np.uint64) * GOLDEN)


def shared_weights(a: tuple, rows: int) -> Callable[[tuple, int], np.ndarray]:
    """Function giving, for other sets and their number of rows, the sum of the lesser weights of
    shared elements for every row of ``a`` with every row of these."""
    ra, ka = _units(*a)
    order = np.argsort(ka)
    ra, ka = ra[order], ka[order]
    new = np.ones(len(ka), dtype=bool)
    new[1:] = ka[1:] != ka[:-1]
    known, column = ka[new], np.cumsum(new) - 1

    def shared(b: tuple, others: int) -> np.ndarray:
        out = np.zeros((rows, others))
        rb, kb = _units(*b)
        if not len(known) or not len(kb):
            return out
        at = np.minimum(np.searchsorted(known, kb), len(known) - 1)
        found = known[at] == kb
        used = np.zeros(len(known), dtype=bool)
        used[at[found]] = True
        number = np.cumsum(used) - 1
        mine = used[column]
        order = np.argsort(at[found])
        sides = ((ra[mine], number[column[mine]], rows), (rb[found][order], number[at[found][order]], others))
        columns = int(used.sum())
        for first in range(0, columns, COLUMNS):
            last = min(first + COLUMNS, columns)
            grids = []
            for row, col, n in sides:
                low, high = np.searchsorted(col, (first, last))
                grid = np.zeros((n, last - first), dtype=np.float32)
                grid[row[low:high], col[low:high] - first] = 1
                grids.append(grid)
            out += grids[0] @ grids[1].T
        return out

    return shared


def _block_links(sets: Sets, threshold: float):
    def measured(side: pd.DataFrame) -> tuple[tuple, np.ndarray]:
        found = sets([t.encode() for t in side.text])
        return found, np.bincount(found[0], weights=found[2], minlength=len(side))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        first, others = block[block.side != 1], block[block.side == 1]
        found, total = measured(first)
        shared_with = shared_weights(found, len(first))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        # One slice at a time bounds the memory.
        for second in [others[at : at + SLICE] for at in range(0, len(others), SLICE)] or [first]:
            theirs, sums = (found, total) if second is first else measured(second)
            shared = shared_with(theirs, len(second))
            whole = total[:, None] + sums[None, :] - shared
            one, two = np.nonzero((shared >= threshold * whole) & (whole > 0))
            if not len(one):
                continue
            parts = np.stack([first.component.to_numpy()[one], second.component.to_numpy()[two]])
            # One link of each two components; those that the block has linked already need none.
            pairs, chosen = np.unique(parts, axis=1, return_index=True)
            nodes = zip(first.node.to_numpy()[one[chosen]].tolist(), second.node.to_numpy()[two[chosen]].tolist())
            for (x, y), link in zip(pairs.T.tolist(), nodes):
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    links.append(link)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run
