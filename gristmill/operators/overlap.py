"""Shared word n-grams between collections: exact keys, a filter in the scan, and theta sketches.

An n-gram is a key of two 64-bit numbers computed per Arrow batch, and a chunk of a batch puts out
each key of a dataset once. ``shared_with`` joins the keys with those of the other collection before
any shuffle, so only shared keys travel; the other side is broadcast if its counted size allows, else
both sides are shuffled. ``sketches`` shuffles none: a theta sketch per dataset and task is merged,
and estimates come from their intersections.

Where all keys have to meet, they travel packed: a row has the keys of one part, as 12 bytes each, and
how many of them are whose. Parts are the leading bits of keys, so all that is known of a key is
in its part, and a task holds one part at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import GOLDEN, mix

# Keys of 16 bytes: 64 MB at most as a broadcast table.
BROADCAST_KEYS = 1 << 20
# Logarithm of a sketch's entries: relative error of some 1 / sqrt(2**14), 0.8 %.
SKETCH_LOG = 14
_LANES = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
CHUNK_CHARS = 1 << 20
# Text of one task; a part of its keys, of which there are two to four a task, takes some 50 MB.
PART_BYTES = 8 << 20
# Keys that are packed at a time, and keys of a part beyond which repeated ones are dropped early.
PACKED_KEYS = 1 << 19
MERGED_KEYS = 1 << 21
# 96 bits: of 10**12 n-grams two are taken for one with a chance of less than 1 in 100,000.
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u4")])
_HELD = -2
# Dataset names, their numbers (-1 is null, -2 a held key of the other collection), and keys.
Keys = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def chunk_keys(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hi, lo) of all n-grams of some texts; a text of fewer words is one n-gram."""
    # A new word gets the next number. Nothing here refers to itself, so all goes at once.
    known: defaultdict[str, int] = defaultdict(count().__next__)
    numbers, sizes = [], []
    for text in texts:
        # Without an argument the white space is that of ``functions.text``.
        words = text.lower().split()
        numbers += map(known.__getitem__, words)
        sizes.append(len(words))
    digests = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=16).digest() for w in known), dtype="<u8")
    own = digests.reshape(-1, 2)[np.array(numbers, dtype=np.int64)] if known else np.empty((0, 2), dtype=np.uint64)
    size = np.array(sizes, dtype=np.int64)
    first = np.cumsum(size) - size
    rows, keys = [], []
    for length in range(1, n + 1):
        chosen = np.flatnonzero(size == length) if length < n else np.flatnonzero(size >= n)
        grams = size[chosen] - length + 1
        row = np.repeat(chosen, grams)
        start = np.repeat(first[chosen], grams) + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
        both = []
        for lane, salt in enumerate(_LANES):
            key = np.full(len(row), np.uint64(length) ^ salt, dtype=np.uint64)
            for j in range(length):
                key = mix(key * GOLDEN + own[start + j, lane])
            both.append(key)
        rows.append(row)
        keys.append(both)
    return np.concatenate(rows), *(np.concatenate([k[lane] for k in keys]).view(np.int64) for lane in (0, 1))


def chunk_bounds(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive texts of about ``CHUNK_CHARS``; a longer text stands alone."""
    begin = 0
    while begin < len(sizes):
        end, size = begin, 0
        while end < len(sizes) and (end == begin or size + sizes[end] <= CHUNK_CHARS):
            size += sizes[end]
            end += 1
        yield begin, end
        begin = end


def batch_keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[Keys]:
    """(names, number, hi, lo) of all n-grams, chunk by chunk of about ``CHUNK_CHARS`` bytes.

    Only a chunk's texts are Python objects at a time, so memory is bounded by that and the longest text.
    """
    for batch in batches:
        text, encoded = batch.column("_text"), batch.column("_dataset").dictionary_encode()
        codes = np.asarray(encoded.indices.fill_null(-1), dtype=np.int64)
        for begin, end in chunk_bounds(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
            row, hi, lo = chunk_keys([t or "" for t in text.slice(begin, end - begin).to_pylist()], n)
            yield encoded.dictionary, codes[begin:end][row], hi, lo


def _named(df: DataFrame, dataset: str, text: str) -> DataFrame:
    return df.select(F.col(dataset).alias("_dataset"), F.col(text).alias("_text"))


def gram_keys(df: DataFrame, dataset: str, text: str, n: int) -> DataFrame:
    """(dataset, hi, lo): word n-grams in lower case, each at most once per dataset and chunk of a batch.

    Texts without words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, code, hi, lo in batch_keys(batches, n):
            order = np.lexsort((lo, hi, code))
            code, hi, lo = code[order], hi[order], lo[order]
            new = changes(code, hi, lo)
            yield pa.RecordBatch.from_arrays(
                [_names_of(names, code[new]), pa.array(hi[new]), pa.array(lo[new])], ["_dataset", "hi", "lo"]
            )

    name = df.schema[dataset].dataType.simpleString()
    rows = _named(df, dataset, text).mapInArrow(run, f"_dataset {name}, hi bigint, lo bigint")
    return rows.withColumnRenamed("_dataset", dataset)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _names_of(names: pa.Array, code: np.ndarray) -> pa.Array:
    return names.take(pa.array(code, pa.int64(), mask=code < 0))


def joined(pieces: list[Keys]) -> Keys:
    """Pieces as one, with one number for each name."""
    names = pa.concat_arrays([p[0] for p in pieces]).dictionary_encode()
    number = np.asarray(names.indices, dtype=np.int32)
    first = np.cumsum([0] + [len(p[0]) for p in pieces])
    # Numbers below 0 stay.
    codes = [np.where(c < 0, c, number[np.maximum(c + at, 0)] if len(number) else c) for (_, c, _, _), at in zip(pieces, first)]
    return names.dictionary, np.concatenate(codes).astype(np.int32), *(np.concatenate([p[i] for p in pieces]) for i in (2, 3))


def packed(keys: Keys, bits: int, held: bool = False) -> pa.RecordBatch:
    """One row a part: its leading ``bits``, whose keys it has, how many, and the keys in that order.

    Keys that one dataset has twice are dropped, if they come to lie side by side.
    """
    names, code, hi, lo = keys
    width = np.uint64(len(names) + 1)
    hi = hi.view(np.uint64)
    group = (hi >> np.uint64(64 - bits)) * width + (code + 1).astype(np.uint64)
    top = np.uint64(((len(names) + 1) << bits).bit_length())
    order = np.argsort((group << (np.uint64(64) - top)) | ((hi << np.uint64(bits)) >> top))
    group, hi, lo = group[order], hi[order], lo.view(np.uint64)[order].astype(np.uint32)
    new = changes(group, hi, lo)
    group = group[new]
    out = np.empty(len(group), dtype=_KEY)
    out["hi"], out["lo"] = hi[new], lo[new]
    run = np.flatnonzero(changes(group)) if len(group) else np.empty(0, dtype=np.int64)
    part, whose = group[run] // width, (group[run] % width).astype(np.int64) - 1
    row = np.flatnonzero(changes(part)) if len(part) else run
    lists = pa.array(np.append(row, len(run)), pa.int32())
    counts = pa.array(np.diff(run, append=len(group)), pa.int32())
    ends = np.append(run[row], len(group)) * _KEY.itemsize
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out.tobytes())])
    columns = {
        "hi": pa.array(part[row].astype(np.int32)),
        "names": pa.ListArray.from_arrays(lists, _names_of(names, whose)),
        "counts": pa.ListArray.from_arrays(lists, counts),
        "keys": blobs,
        "held": pa.array(np.full(len(row), held)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def opened(rows: pa.RecordBatch) -> Keys:
    """Packed rows as keys."""
    names, counts = rows.column("names"), np.asarray(rows.column("counts").flatten(), dtype=np.int64)
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=_KEY)
    encoded = names.flatten().dictionary_encode()
    code = np.asarray(encoded.indices.fill_null(-1), dtype=np.int32)
    held = np.repeat(np.asarray(rows.column("held").to_pylist(), dtype=bool), np.asarray(names.value_lengths()))
    code = np.repeat(np.where(held, np.int32(_HELD), code), counts)
    return encoded.dictionary, code, keys["hi"].copy(), keys["lo"].copy()


def merged(pieces: list[Keys]) -> Keys:
    """Each key of each dataset once, sorted by key and number."""
    names, code, hi, lo = joined(pieces)
    order = np.argsort(hi)
    ordered = hi[order]
    same = ordered[1:] == ordered[:-1]
    # Few keys share the first number, so only these are sorted by all columns.
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    some = order[tied]
    order[tied] = some[np.lexsort((code[some], lo[some], hi[some]))]
    code, hi, lo = code[order], ordered, lo[order]
    new = changes(code, hi, lo)
    return names, code[new], hi[new], lo[new]


def by_part(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Keys]]:
    """Keys of each part, of packed rows sorted by part.

    A key in very many rows is held some times only: beyond ``limit`` keys repeated ones are dropped.
    """
    part, pieces, size, most = -1, [], 0, limit
    for batch in batches:
        parts = np.asarray(batch.column("hi"))
        at = np.flatnonzero(changes(parts)).tolist() if len(parts) else []
        for begin, end in zip(at, [*at[1:], len(parts)]):
            if parts[begin] != part:
                if pieces:
                    yield part, merged(pieces)
                part, pieces, size, most = int(parts[begin]), [], 0, limit
            pieces.append(opened(batch.slice(begin, end - begin)))
            size += len(pieces[-1][1])
            if size > most:
                pieces = [merged(pieces)]
                size = len(pieces[0][1])
                most = max(limit, 2 * size)
    if pieces:
        yield part, merged(pieces)


class Packed:
    """Packed keys of collections that are compared, in as many parts as their texts need."""

    def __init__(self, kind: str, n: int, *sizes: int):
        self.n, self.schema = n, f"hi int, names array<{kind}>, counts array<int>, keys binary, held boolean"
        self.kind, self.bits = kind, (2 * sum(sizes) // PART_BYTES + 1).bit_length()

    def keys(self, df: DataFrame, dataset: str, text: str) -> DataFrame:
        """Packed rows of a collection."""
        n, bits, size = self.n, self.bits, PACKED_KEYS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, waiting = [], 0
            for piece in batch_keys(batches, n):
                pieces.append(piece)
                waiting += len(piece[1])
                if waiting >= size:
                    keys = joined(pieces)
                    for at in range(0, waiting - size + 1, size):
                        yield packed((keys[0], *(c[at : at + size] for c in keys[1:])), bits)
                    left = waiting // size * size
                    pieces, waiting = [(keys[0], *(c[left:].copy() for c in keys[1:]))], waiting - left
            if waiting:
                yield packed(joined(pieces), bits)

        return _named(df, dataset, text).mapInArrow(run, self.schema)

    def distinct(self, other: DataFrame, text: str, size: int) -> DataFrame:
        """Packed rows of another collection, each key once, marked as held."""
        bits, limit = self.bits, MERGED_KEYS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (names, code, hi, lo) in by_part(batches, limit):
                yield packed((names, code, hi, lo.astype(np.uint64)), bits, held=True)

        rows = self.keys(other.select(F.lit(None).cast(self.kind).alias("_all"), text), "_all", text)
        return _placed(rows, size).mapInArrow(run, self.schema)

    def counts(self, rows: DataFrame, dataset: str, size: int, against: bool) -> DataFrame:
        """(dataset, grams, shared_grams): keys of each, and how many of them are held, or else another dataset's too."""
        limit = MERGED_KEYS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (names, code, hi, lo) in by_part(batches, limit):
                new = changes(hi, lo)
                key = np.cumsum(new) - 1
                # A held key has the least number.
                shared = (code[new] == _HELD)[key] if against else (np.bincount(key) > 1)[key]
                own = code != _HELD
                grams = np.bincount(code[own] + 1, minlength=len(names) + 1)
                both = np.bincount(code[own & shared] + 1, minlength=len(names) + 1)
                some = np.flatnonzero(grams)
                yield pa.RecordBatch.from_arrays(
                    [_names_of(names, some - 1), pa.array(grams[some]), pa.array(both[some])], ["_dataset", "grams", "shared_grams"]
                )

        counted = _placed(rows, size).mapInArrow(run, f"_dataset {self.kind}, grams bigint, shared_grams bigint")
        return counted.groupBy(F.col("_dataset").alias(dataset)).agg(F.sum("grams").alias("grams"), F.sum("shared_grams").alias("shared_grams"))


def _placed(rows: DataFrame, size: int) -> DataFrame:
    """Packed rows in as many tasks as ``size`` bytes of text need, sorted by part."""
    return rows.repartition(1 + size // PART_BYTES, "hi").sortWithinPartitions("hi")


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def distinct_keys(other: DataFrame, text: str, n: int) -> DataFrame:
    """(hi, lo) of a whole collection."""
    return gram_keys(other.select(F.lit(0).alias("_all"), text), "_all", text, n).select("hi", "lo").distinct()


def shared_with(df: DataFrame, dataset: str, text: str, other: DataFrame, other_text: str, n: int = 5) -> DataFrame:
    """Per dataset the number and share of the other collection's distinct n-grams that it contains."""
    held = distinct_keys(other, other_text, n)
    total = held.count()
    side = F.broadcast(held) if total <= BROADCAST_KEYS else held
    shared = gram_keys(df, dataset, text, n).join(side, ["hi", "lo"], "left_semi").distinct()
    counts = shared.groupBy(F.col(dataset).alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(dataset).distinct()
    number = F.coalesce("n", F.lit(0))
    return every.join(counts, F.col(dataset).eqNullSafe(F.col("_of")), "left").select(
        dataset, number.alias("shared_grams"), F.bround(number / F.lit(max(1, total)), 4).alias("overlap_ratio")
    )


def sketches(df: DataFrame, dataset: str, text: str, n: int = 5, log_entries: int = SKETCH_LOG) -> DataFrame:
    """(dataset, sketch): theta sketches of the datasets' n-grams, to be kept, united and intersected."""
    return gram_keys(df, dataset, text, n).groupBy(dataset).agg(F.theta_sketch_agg("hi", log_entries).alias("sketch"))


def estimates(of: DataFrame, dataset: str, other: DataFrame, log_entries: int = SKETCH_LOG) -> DataFrame:
    """Estimated distinct n-grams per dataset, and how many of them the united ``other`` sketches share.

    Exact up to 2**log_entries n-grams; beyond that off by about that number's inverse root, in
    parts of the larger of the two sides.
    """
    held = other.agg(F.theta_union_agg("sketch", log_entries)).scalar()
    return of.select(
        dataset,
        F.theta_sketch_estimate("sketch").alias("grams"),
        F.theta_sketch_estimate(F.theta_intersection("sketch", held)).alias("shared_grams"),
    )
