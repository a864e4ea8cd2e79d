"""Duplicates, merging with lineage, cleaning, overlap and balancing.

Copies are never paired with each other. Every copy is tied to one leader (the lowest id),
so a text held by a third of all rows costs one row of output per copy, not a square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions.hashing import GOLDEN, mix, word_hashes
from gristmill.operators import gates, overlap
from gristmill.operators.buckets import linked_components
from gristmill.operators.overlap import Packed, chunk_bounds, text_bytes
from gristmill.scratch import Scratch

# Rows of one slice when a stratum is ranked.
SLICE_ROWS = 50_000
# N-grams whose minimal hashes are sought at a time: 128 KB.
CACHED_GRAMS = 1 << 14


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(tx.strip(text), F.lit("")), 256)


def copy_groups(df: DataFrame, row_id: str, digest: Column, *within: str) -> DataFrame:
    """Leader (lowest id) and number of copies per distinct content; only digests are shuffled."""
    return df.select(*within, digest.alias("digest"), row_id).groupBy(*within, "digest").agg(
        F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies")
    )


def drop_exact_copies(df: DataFrame, row_id: str, digest: Column, *within: str) -> DataFrame:
    """Rows that lead their group of copies. The join is on the unique row id, hence not skewed."""
    leaders = copy_groups(df, row_id, digest, *within).select(row_id)
    return df.join(leaders, row_id, "left_semi")


def merge_with_lineage(df: DataFrame, origin: str, row_id: str, digest: Column) -> DataFrame:
    """One row per distinct content: its leader, the leader's origin and the spread over origins."""
    by_origin = df.select(digest.alias("digest"), origin, row_id).groupBy("digest", origin).agg(
        F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies")
    )
    return by_origin.groupBy("digest").agg(
        F.min(row_id).alias(row_id),
        F.min_by(origin, row_id).alias(origin),
        F.count(F.lit(1)).alias("n_origins"),
        F.sum("copies").alias("copies"),
    )


def merge_summary(candidates: DataFrame, dataset: str, rows: str, license_name: str, order: str) -> DataFrame:
    """Sources, rows and license of a merge: the first source's license, and how many differ."""
    return candidates.agg(
        F.count(dataset).alias("sources"),
        F.coalesce(F.sum(rows), F.lit(0)).alias("row_count"),
        F.coalesce(F.min_by(license_name, order), F.lit("unknown")).alias("license"),
        F.count_distinct(license_name).alias("licenses"),
    )


def cleaning_report(df: DataFrame, dataset: str, text: str) -> DataFrame:
    """Input and output rows, removed copies, personal-data findings, broken characters."""
    findings = sum(gates.pii_counts(F.col(text)).values(), F.lit(0)).cast("long")
    rows = df.select(
        dataset,
        text_digest(F.col(text)).alias("_digest"),
        findings.alias("_pii"),
        F.col(text).contains("�").cast("long").alias("_broken"),
        tx.blank_to_null(F.col(text)).isNull().cast("long").alias("_blank"),
    )
    by_text = rows.groupBy(dataset, "_digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_pii").alias("pii"),
        F.sum("_broken").alias("broken"),
        F.max("_blank").alias("blank"),
    )
    counted = by_text.groupBy(dataset).agg(
        F.sum("n").alias("input_rows"),
        F.count_if(F.col("blank") == 0).alias("output_rows"),
        F.sum(F.when(F.col("blank") == 0, F.col("n") - 1).otherwise(0)).alias("duplicates_removed"),
        F.sum("pii").alias("pii_findings"),
        F.sum("broken").alias("encoding_errors"),
    )
    return counted


def modification_log(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Every change curation makes to a row, one line per change."""
    counts = gates.pii_counts(F.col(text))
    entry = "struct<action:string,detail:string>"
    masked = [
        F.when(
            n > 0, F.struct(F.lit(f"mask_{kind}").alias("action"), n.cast("string").alias("detail"))
        ).cast(entry)
        for kind, n in counts.items()
    ]
    trimmed = F.when(
        F.col(text) != tx.strip(F.col(text)),
        F.struct(F.lit("strip").alias("action"), F.lit("").alias("detail")),
    ).cast(entry)
    own = df.select(row_id, F.explode(F.array_compact(F.array(trimmed, *masked))).alias("c")).select(
        row_id, "c.action", "c.detail"
    )
    leaders = copy_groups(df, row_id, text_digest(F.col(text))).select(row_id)
    removed = df.select(row_id).join(leaders, row_id, "left_anti").select(
        row_id, F.lit("drop_copy").alias("action"), F.lit("").alias("detail")
    )
    return own.unionByName(removed)


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the texts' word n-grams, sorted by row; repeated ones stay.

    A text of fewer words is its own single n-gram, a text without words has none.
    """
    words: list[str] = []
    sizes = []
    for text in texts:
        # Without an argument the white space is that of ``functions.text``.
        own = text.decode("utf-8", "replace").lower().split()
        words += own
        sizes.append(len(own))
    word = word_hashes(words)
    size = np.array(sizes, dtype=np.int64)
    number = np.where(size < n, np.minimum(size, 1), size - n + 1)
    row = np.repeat(np.arange(len(size)), number)
    at = np.arange(len(row)) + np.repeat(np.cumsum(size) - size - np.cumsum(number) + number, number)
    length = np.minimum(size, n)[row]
    key = length.astype(np.uint64)
    for j in range(n):
        longer = mix(key * GOLDEN + word[np.minimum(at + j, len(word) - 1)])
        key = np.where(j < length, longer, key)
    return row, key


def gram_sets(n: int):
    """Function giving texts' distinct word n-grams as arrays (row, hash, 1.0), sorted by row."""

    def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, key = grams(texts, n)
        own = mix(key + row.astype(np.uint64) * GOLDEN)
        order = np.argsort(own)
        own = own[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        chosen = np.sort(order[new])
        return row[chosen], key[chosen], np.ones(len(chosen))

    return sets


def _signature_rows(shingle: int, bands: int, band_rows: int):
    """Bucket keys of each text: a min-hash signature cut into bands."""
    # The hashes are mixed already; times an odd number they come in another order.
    seeds = mix(np.arange(1, bands * band_rows + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)

    def keys_of(texts: list[bytes]) -> list[list[int]]:
        # A repeated n-gram changes no minimum.
        row, element = grams(texts, shingle)
        filled, starts = np.unique(row, return_index=True)
        keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(filled), axis=0)
        ends = np.append(starts[1:], len(element))
        # Some texts at a time, so that their n-grams stay in the processor's cache.
        cuts = np.flatnonzero(np.diff(starts // CACHED_GRAMS, prepend=-1))
        for first, last in zip(cuts, np.append(cuts[1:], len(filled))):
            part, begins = element[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
            value = np.empty_like(part)
            for at, seed in enumerate(seeds):
                least = np.minimum.reduceat(np.multiply(part, seed, out=value), begins)
                # The j-th value of a band is mixed into its key after the ones before it.
                band = at // band_rows
                keys[first:last, band] = mix(keys[first:last, band] * GOLDEN + least)
        out: list[list[int]] = [[] for _ in texts]
        for text, own in zip(filled.tolist(), keys.view(np.int64).tolist()):
            out[text] = own
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            keys: list[list[int]] = []
            for begin, end in chunk_bounds([len(t) for t in texts]):
                keys += keys_of(texts[begin:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "keys"]
            )

    return run


def near_duplicates(
    df: DataFrame,
    row_id: str,
    text: str,
    shingle: int = 3,
    threshold: float = 0.8,
    bands: int = 16,
    band_rows: int = 4,
) -> DataFrame:
    """Each row's standing: ``unique``, ``exact`` copy or ``near`` copy, and of which row.

    A text's near copies are all it is linked to, directly or over others, by a Jaccard
    similarity of whole n-gram sets of at least ``threshold``; each is a copy of the lowest id
    among them. One map-only pass over the texts leaves a digest and bucket keys per row; exact
    copies collapse to their leader, the lowest id; leaders are compared as ``buckets``
    describes, which reads the texts of leaders sharing a bucket again. ``row_id`` is unique.
    """
    scratch = Scratch(df.sparkSession, "near-duplicates")
    id_type = df.schema[row_id].dataType.simpleString()
    source = df.select(F.col(row_id).alias("id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    signed = scratch.keep(
        source.mapInArrow(
            _signature_rows(shingle, bands, band_rows), f"id {id_type}, digest string, keys array<bigint>"
        ),
        "signed",
    )
    nodes = scratch.keep(
        signed.groupBy("digest")
        .agg(F.min("id").alias("leader"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = scratch.keep(wanted.join(nodes.select("node", F.col("leader").alias("id")), "node"), "chosen")
        # If they are few enough, no text is shuffled to find theirs.
        side = F.broadcast(chosen) if chosen.count() <= overlap.BROADCAST_KEYS else chosen
        return source.select("id", "text").join(side, "id").select("node", "text")

    linked = linked_components(nodes.select("node", "keys"), texts_of, gram_sets(shingle), threshold, scratch)
    named = nodes.select("node", "digest", "leader").join(linked, "node", "left")
    least = scratch.keep(
        named.where("component IS NOT NULL").groupBy("component").agg(F.min("leader").alias("near_of")), "least"
    )
    groups = scratch.keep(named.join(least, "component", "left").select("digest", "leader", "near_of"), "groups")
    scratch.drop("nodes", "chosen", "components", "least")
    copy, near = F.col("leader") != F.col("id"), F.col("near_of") != F.col("id")
    return (
        signed.select("id", "digest")
        .join(groups, "digest")
        .select(
            F.col("id").alias(row_id),
            F.when(copy, "exact").when(near, "near").otherwise("unique").alias("kind"),
            F.when(copy, F.col("leader")).otherwise(F.coalesce("near_of", "id")).alias("copy_of"),
        )
    )


def overlap_between(df: DataFrame, dataset: str, text: str, n: int = 5) -> DataFrame:
    """Per dataset, how many of its distinct n-grams also occur in another dataset."""
    size = text_bytes(df, text)
    keys = Packed(df.schema[dataset].dataType.simpleString(), n, size)
    counts = keys.counts(keys.keys(df, dataset, text), dataset, size, against=False)
    return counts.withColumn("overlap_ratio", F.bround(F.col("shared_grams") / F.col("grams"), 4))


def overlap_with(df: DataFrame, dataset: str, text: str, other: DataFrame, other_text: str, n: int = 5) -> DataFrame:
    """Per dataset, its distinct n-grams and the share of the other collection's that it contains.

    Counting the distinct n-grams shuffles their keys; where the shared ones are enough, use
    ``overlap.shared_with``, and ``overlap.estimates`` where an estimate is.
    """
    size, other_size = text_bytes(df, text), text_bytes(other, other_text)
    keys = Packed(df.schema[dataset].dataType.simpleString(), n, size, other_size)
    held = keys.distinct(other, other_text, other_size)
    # All names are null, so a row has one count.
    total = held.agg(F.sum(F.col("counts")[0])).first()[0] or 0
    counts = keys.counts(keys.keys(df, dataset, text).unionByName(held), dataset, size + other_size, against=True)
    return counts.withColumn("overlap_ratio", F.bround(F.col("shared_grams") / total, 4))


def balance(df: DataFrame, stratum: str, row_id: str, quota: int | None = None) -> DataFrame:
    """Keep the same number of rows per stratum, chosen by SHA-256 order of the row id.

    Without ``quota`` the smallest stratum sets it. Only ids are ranked: counts per slice of
    the digest tell which slices lie wholly beyond the limit, and those go before any row is
    sorted. The slices are as many as keep about ``SLICE_ROWS`` rows in one, so a stratum with
    most of the rows is ranked in many tasks. ``row_id`` is unique.
    """
    digest = F.sha2(F.col(row_id).cast("string"), 256)
    rows = df.count()
    prefix = max(1, math.ceil(math.log(max(rows / SLICE_ROWS, 1), 16)))
    ids = df.select(stratum, row_id, digest.alias("_digest")).withColumn("_slice", F.substring("_digest", 1, prefix))
    sliced = ids.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(
        Window.partitionBy(stratum).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    smallest = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n"))
    limit = F.lit(quota) if quota is not None else smallest.scalar()
    offsets = sliced.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_n").where(F.col("_before") < limit)
    inside = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_digest", row_id))
    offsets = offsets.select(F.col(stratum).alias("_stratum"), F.col("_slice").alias("_of"), "_before")
    ranked = ids.join(offsets, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_slice") == F.col("_of")))
    chosen = ranked.withColumn("balance_rank", F.col("_before") + inside).where(F.col("balance_rank") <= limit)
    return df.join(chosen.select(row_id, "balance_rank"), row_id)
