"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized once; one narrow row per piece goes on. Only the number of pieces of
each length, at most ``capacity`` numbers, reaches the driver. There best-fit decreasing runs
over counts: sequences with equal free space are one group, and all pieces of a length go to the
fullest groups they fit into, many sequences at a time. Every length visits a group once, a
group that was visited has lost at least half of its space, and a length splits at most one
group, so the plan has at most about 3 x capacity x log2(capacity) rows, whatever the input; it
is broadcast. Each piece then takes its planned slot by joining on its rank within its length.
Ranks come from counts per (length, cell) with cells of at most 65,536 consecutive rows, so a
length that holds most pieces is ranked in many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import textbatch
from gristmill.scratch import Scratch
from gristmill.llm.tokens import Encoder, pieces

CAPACITY = 1024
END_ID = 2
CELL_BITS = 16


class Slots(NamedTuple):
    """``per_sequence`` pieces go to each of ``sequences`` sequences, from ``offset`` on."""

    length: int
    first_rank: int
    sequences: int
    per_sequence: int
    first_sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Best-fit decreasing over counts; ranks within a length and sequences count from 0."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, sequences)
    out: list[Slots] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(space: int, first: int, sequences: int, each: int) -> None:
            nonlocal left, rank
            if not sequences or not each:
                return
            out.append(Slots(length, rank, sequences, each, first, capacity - space))
            rank += sequences * each
            left -= sequences * each
            if space > each * length:
                free.setdefault(space - each * length, []).append((first, sequences))

        for space in sorted(s for s in free if s >= length):
            groups, rest = free.pop(space), []
            for first, sequences in groups:
                full = min(sequences, left // (space // length))
                put(space, first, full, space // length)
                first, sequences = first + full, sequences - full
                if sequences and left:
                    put(space, first, 1, left)
                    first, sequences = first + 1, sequences - 1
                if sequences:
                    rest.append((first, sequences))
            if rest:
                free.setdefault(space, []).extend(rest)
            if not left:
                break
        each = capacity // length
        full, part = divmod(left, each)
        put(capacity, opened, full, each)
        put(capacity, opened + full, 1 if part else 0, part)
        opened += full + (part > 0)
    return out


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, end_id)
        for batch in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for first, part in textbatch.parts(batch.column("_text")):
                for i, text in enumerate(part, first):
                    ids = encode((text or b"").decode("utf-8", "replace"))
                    for k, (a, n) in enumerate(pieces(len(ids), capacity)):
                        own.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(ids[a : a + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(own, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(
    documents: DataFrame,
    tokenizer: str,
    row_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``row_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file that every worker has. Null and empty texts
    are the end id alone; a document over ``capacity`` ids is cut into pieces of ``capacity``,
    the first of which may be shorter; repeated rows are packed one by one; no documents give
    no rows. Other columns are left out.
    """
    scratch = Scratch(documents.sparkSession, "best-fit")
    id_type = documents.schema[row_id].dataType.simpleString()
    cut = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        _tokenize(tokenizer, capacity, end_id),
        f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint",
    )
    rows = scratch.keep(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")
    cell = F.shiftright("place", CELL_BITS).alias("cell")
    cells = rows.groupBy("length", cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.keep(cells.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = documents.sparkSession.createDataFrame(
        plan(histogram, capacity),
        "length bigint, first_rank bigint, sequences bigint, per_sequence bigint, first_sequence bigint, first_offset bigint",
    )
    within = Window.partitionBy("length", "cell").orderBy("place")
    ranked = (
        rows.select("*", cell)
        .withColumn("number", F.row_number().over(within))
        .join(cells.select("length", "cell", "earlier"), ["length", "cell"])
        .withColumn("rank", F.col("earlier") + F.col("number") - 1)
    )
    inside = (F.col("rank") >= F.col("first_rank")) & (
        F.col("rank") < F.col("first_rank") + F.col("sequences") * F.col("per_sequence")
    )
    slots = slots.withColumnRenamed("length", "slot_length")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & inside)
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        F.col("_id").alias(row_id),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - first_rank) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
