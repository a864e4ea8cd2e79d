"""Near-duplicate classes by DartMinHash over weighted word shingles.

A text is the weighted set of its runs of five words, a run weighing as often as it occurs; two
texts are linked when the weighted Jaccard similarity of these sets is at least 0.8.

*Darts.* Every shingle owns the axis of its weight, cut into cells [0,1), [1,2), [2,4), ...; each
cell owns a rank axis, cut into pieces of area one. A hash of (shingle, cell, piece) says how
many darts (Poisson with mean one) fall into the piece and where. A dart counts for a text if it
lies below the shingle's weight there. The earliest dart of each of ``k`` coordinates is the
signature: two texts agree in a coordinate with the probability of their similarity. Only
pieces with ranks up to about (k ln k + 2k) / weight are looked at, which costs
O(shingles + k log k) a text; a text with an empty coordinate is thrown again with twice that.

*Joining.* Exact copies collapse first. The rest are joined by bands of the signature and
compared exactly, on whole texts, as ``operators.buckets`` describes: without all pairs of a
bucket, yet so that a link between two texts counts whenever they share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import GOLDEN, mix, unit
from gristmill.llm import textbatch
from gristmill.operators.buckets import linked_components
from gristmill.scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
# A similar pair (0.8) shares no bucket with probability (1 - 0.8**5)**25, about 5 in 100,000.
BANDS = 25
BAND_ROWS = 5

# Some 900 darts are thrown for a text however short it is, and more for a long one: texts and
# bytes that are signed at a time.
PART_ROWS = 128
PART_BYTES = 1 << 17

_U = np.uint64


def weighted_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), sorted by row, of a chunk of texts; shingles are 48-bit hashes."""
    row, value = textbatch.shingles(textbatch.words(texts), SHINGLE)
    packed = np.sort((row.astype(np.uint64) << _U(48)) | (value >> _U(16)))
    if not len(packed):
        return row, value, np.empty(0)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    weight = np.diff(np.concatenate([first, [len(packed)]])).astype(np.float64)
    packed = packed[first]
    return (packed >> _U(48)).astype(np.int64), packed & _U((1 << 48) - 1), weight


def _poisson_steps() -> np.ndarray:
    """Distribution function of a Poisson count with mean one."""
    mass = np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 18.0))])
    return np.cumsum(mass)[:-1]


def throw(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray, rank_limit: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, rank, dart) of all darts in the rows' weighted sets up to their rank limit."""
    cells = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    owner = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    seed = mix(element[owner] + (cell.astype(np.uint64) + _U(1)) * GOLDEN)
    pieces = np.ceil(rank_limit[row[owner]] * width).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), pieces)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    seed = mix(seed[at] ^ (piece.astype(np.uint64) * GOLDEN + _U(7)))
    darts = np.searchsorted(_poisson_steps(), unit(seed), side="right")
    of = np.repeat(np.arange(len(at)), darts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(seed[of] + (number.astype(np.uint64) + _U(1)) * GOLDEN)
    place = at[of]
    rank = (piece[of] + unit(mix(dart + _U(1)))) / width[place]
    height = low[place] + width[place] * unit(mix(dart + _U(2)))
    coordinate = (mix(dart + _U(3)) % _U(k)).astype(np.int64)
    own = owner[place]
    inside = (height < weight[own]) & (rank < rank_limit[row[own]])
    return row[own[inside]], coordinate[inside], rank[inside], dart[inside]


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) darts; a row without elements has zeros only."""
    out = np.zeros((rows, k), dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(rows), where=total > 0)
    todo = total > 0
    while todo.any():
        part = todo[row]
        r, c, rank, dart = throw(row[part], element[part], weight[part], limit, k)
        slot = r * k + c
        best = np.full(rows * k, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        full = np.isfinite(best).reshape(rows, k).all(axis=1) & todo
        keep = won & full[r]
        out.reshape(-1)[slot[keep]] = dart[keep]
        todo &= ~full
        limit = limit * 2
    return out


def band_keys(signature: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """(rows, bands) 64-bit bucket keys."""
    keys = np.zeros((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for j in range(b * band_rows, (b + 1) * band_rows):
            key = mix(key * GOLDEN + signature[:, j])
        keys[:, b] = key
    return keys.view(np.int64)


def _signature_rows(bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in textbatch.parts(batch.column("_text"), PART_BYTES, PART_ROWS):
                row, element, weight = weighted_sets(part)
                keys = band_keys(signatures(row, element, weight, len(part), bands * band_rows), bands, band_rows)
                some = np.bincount(row, minlength=len(part)) > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(first, len(part)),
                        batch.column("digest").slice(first, len(part)),
                        pa.ListArray.from_arrays(offsets, keys[some].ravel()),
                    ],
                    ["_id", "digest", "keys"],
                )

    return run


def near_duplicate_classes(
    df: DataFrame,
    row_id: str,
    text: str,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    threshold: float = SIMILARITY,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's id and text digest; each distinct text's class.

    ``rows`` has (``row_id``, digest), one per row of ``df``. ``classes`` has (digest, first_id,
    class_id, leads): the least id with exactly this text, the least id in its class, and
    whether this text is the one of that row. Ids must be of an ordered type.

    Defined results: a null text has a null digest and no class; texts without words are copies
    of equal texts only; a text of fewer than five words is one shingle; repeated rows and ids
    are allowed; null ids are never the least unless there is no other.
    """
    scratch = Scratch(df.sparkSession, "dart-minhash")
    id_type = df.schema[row_id].dataType.simpleString()
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    source = df.select(F.col(row_id).alias("_id"), digest.alias("digest"), F.col(text).alias("_text"))
    signed = scratch.keep(
        source.mapInArrow(
            _signature_rows(bands, band_rows), f"_id {id_type}, digest binary, keys array<bigint>"
        ),
        "signed",
    )
    nodes = scratch.keep(
        signed.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("_id").alias("first_id"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = wanted.join(nodes.select("node", "first_id", "digest"), "node")
        same = source["digest"].eqNullSafe(chosen["digest"]) & source["_id"].eqNullSafe(chosen["first_id"])
        # Repeated rows leave several equal texts of a node.
        return source.join(chosen, same).groupBy("node").agg(F.first("_text").alias("text"))

    final = linked_components(nodes.select("node", "keys"), texts_of, weighted_sets, threshold, scratch)
    named = nodes.select("digest", "first_id", "node").join(final, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = scratch.keep(
        named.where("component IS NOT NULL").groupBy("component").agg(
            F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("least")
        ),
        "least",
    )
    classes = scratch.keep(
        named.join(least, "component").select(
            "digest",
            "first_id",
            F.col("least.first_id").alias("class_id"),
            (F.col("node") == F.col("least.node")).alias("leads"),
        ),
        "classes",
    )
    scratch.drop("nodes", "components", "least")
    return signed.select(F.col("_id").alias(row_id), "digest"), classes


def near_duplicates(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per row of ``df``: ``row_id``, ``exact_of``, ``class_id``, ``is_first``.

    ``exact_of`` is the least id with the same text, ``class_id`` the least id in the class of
    near copies, ``is_first`` whether the row's id is that one. Null texts stand for themselves.
    """
    rows, classes = near_duplicate_classes(df, row_id, text)
    alone = F.col("digest").isNull()
    return rows.join(classes, "digest", "left").select(
        row_id,
        F.when(alone, F.col(row_id)).otherwise(F.col("first_id")).alias("exact_of"),
        F.when(alone, F.col(row_id)).otherwise(F.col("class_id")).alias("class_id"),
        (alone | F.col(row_id).eqNullSafe(F.col("class_id"))).alias("is_first"),
    )


def first_of_each_class(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Rows of ``df`` with one row per class of near copies: that with the least id; columns kept.

    Rows with a null text all stay. Among repeated rows one stays.
    """
    _, classes = near_duplicate_classes(df, row_id, text)
    kept = classes.where("leads").select("digest", "first_id")
    marked = df.where(F.col(text).isNotNull()).withColumn("_digest", F.unhex(F.md5(F.col(text).cast("binary"))))
    same = marked["_digest"].eqNullSafe(kept["digest"]) & marked[row_id].eqNullSafe(kept["first_id"])
    stay = marked.join(kept, same, "left_semi").dropDuplicates([row_id, "_digest"]).drop("_digest")
    return stay.union(df.where(F.col(text).isNull()))
