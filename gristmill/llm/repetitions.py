"""Periodic runs of words by internal pattern matching.

A run of period q repeats its first words q places later, so some dyadic block of 2**k words
(a block that begins at a multiple of its length) within its first words occurs again exactly q
places to the right, in the neighbouring window. Over a chunk of texts the steps are:

1. Prefix doubling gives the suffix array and, for every k, the rank of the 2**k words from each
   place on; equal ranks mean equal words, which answers longest common extensions.
2. A wavelet matrix over the suffix array answers range successor: the next occurrence of a block
   from some place on is the least value not below it within the block's range of suffixes.
3. For each block the occurrences in its window are asked for one after the other. Two that lie
   closer than half of the block belong to a progression, whose other terms need no query.
   Distances to the block are the candidate periods.
4. Each candidate is extended to both sides as far as words q apart are equal. What is at least
   2q and ``LEAST_LENGTH`` long is a run, with the least period of those that give the same span.

Blocks of 4 words serve the periods 1 to 14, longer ones the rest; the period 6 also looks to
the left, since a shortest run of it may hold a block only in its second half. Every step works
on all blocks of a level at once. A level has n / 2**k blocks with windows of some 2**(k+1)
places, so a text of n words has n log n candidates at most, however repetitive it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textbatch

LEAST_LENGTH = 12
FIRST_LEVEL = 2
# Words of the texts that are searched together; a longer text is searched alone.
CHUNK_WORDS = 1 << 16


class Suffixes:
    """Suffix array of a sequence of numbers and the ranks of all blocks of 2**k of them."""

    def __init__(self, sequence: np.ndarray, longest: int):
        """``longest`` bounds the length of equal stretches at different places."""
        n = len(sequence)
        self.n = n
        order = np.argsort(sequence, kind="stable")
        sorted_ = sequence[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        # The rank of a block is the place of its first suffix in the order of all suffixes.
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks = [rank]
        while (1 << (len(self.ranks) - 1)) < longest:
            step = 1 << (len(self.ranks) - 1)
            rank = rank.copy()
            # Places in the order whose block is not unique yet; groups are stretches of these.
            group = rank[order]
            same_next = np.concatenate([group[1:] == group[:-1], [False]])
            open_ = np.flatnonzero(same_next | np.concatenate([[False], same_next[:-1]]))
            if len(open_):
                at = order[open_]
                beyond = at + step
                second = np.where(beyond < n, self.ranks[-1][np.minimum(beyond, n - 1)], -1)
                first = group[open_]
                by = np.argsort(first * (n + 1) + second + 1, kind="stable")
                at, first, second = at[by], first[by], second[by]
                order[open_] = at
                new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
                rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
            self.ranks.append(rank)
        self.order = order

    def range_of(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place, in the order, of the suffixes that begin with a place's block."""
        sizes = np.bincount(self.ranks[level], minlength=self.n)
        low = self.ranks[level][at]
        return low, low + sizes[low]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on; ``a < b``."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.ranks) - 1, -1, -1):
            # A block is as long as its ranks say only if it ends within the sequence.
            fits = b + (1 << level) <= self.n
            equal = fits & (self.ranks[level][np.minimum(a, self.n - 1)] == self.ranks[level][np.minimum(b, self.n - 1)])
            a = a + (equal << level)
            b = b + (equal << level)
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before ``a`` and ``b``; ``a < b``."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.ranks) - 1, -1, -1):
            fits = a >= 1 << level
            step = 1 << level
            equal = fits & (self.ranks[level][np.maximum(a - step, 0)] == self.ranks[level][np.maximum(b - step, 0)])
            a = a - (equal << level)
            b = b - (equal << level)
        return start - a


class WaveletMatrix:
    """Range successor over a permutation of 0 to n - 1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            is_zero = (values >> bit & 1) == 0
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(is_zero, out=before[1:])
            self.zeros_before.append(before)
            values = np.concatenate([values[is_zero], values[~is_zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Number of values under ``bound`` at places ``low`` to ``high - 1``."""
        out, all_ = np.zeros(len(low), dtype=np.int64), high - low
        for depth, before in enumerate(self.zeros_before):
            zero_low, zero_high = before[low], before[high]
            one = (bound >> (self.bits - 1 - depth) & 1) == 1
            out += np.where(one, zero_high - zero_low, 0)
            low = np.where(one, before[-1] + low - zero_low, zero_low)
            high = np.where(one, before[-1] + high - zero_high, zero_high)
        return np.where(bound >> self.bits > 0, all_, out)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones among places ``low`` to ``high - 1``."""
        out = np.zeros(len(low), dtype=np.int64)
        for depth, before in enumerate(self.zeros_before):
            zero_low, zero_high = before[low], before[high]
            zeros = zero_high - zero_low
            one = n >= zeros
            n = np.where(one, n - zeros, n)
            out |= one.astype(np.int64) << (self.bits - 1 - depth)
            low = np.where(one, before[-1] + low - zero_low, zero_low)
            high = np.where(one, before[-1] + high - zero_high, zero_high)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """Least value of at least ``bound`` at places ``low`` to ``high - 1``, else ``none``."""
        n = self.below(low, high, bound)
        out = np.full(len(low), none, dtype=np.int64)
        some = n < high - low
        out[some] = self.nth(low[some], high[some], n[some])
        return out


def _window(level: int) -> tuple[int, int]:
    """Least and greatest period that blocks of a level serve."""
    return (1 if level == FIRST_LEVEL else (2 << level) - 1), (4 << level) - 2


def _occurrences(
    suffixes: Suffixes, matrix: WaveletMatrix, level: int, block: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(block, place) of occurrences of each block from place ``first`` to ``last``.

    Of a progression that the block itself belongs to only the nearest term counts: from the block
    to any other the words have the progression's smaller period throughout.
    """
    length, n = 1 << level, suffixes.n
    low, high = suffixes.range_of(level, block)
    several = high - low > 1
    block, first, last, low, high = (x[several] for x in (block, first, last, low, high))
    blocks, places = [], []
    while len(block):
        at = matrix.successor(low, high, first, n)
        found = at <= last
        block, last, low, high, at = (x[found] for x in (block, last, low, high, at))
        after = matrix.successor(low, high, at + 1, n)
        gap = after - at
        dense = gap <= length // 2
        blocks.append(block[~dense])
        places.append(at[~dense])
        first = np.where(after <= last, after, n)
        if dense.any():
            x, y, step = block[dense], at[dense], gap[dense]
            reach = y + step + suffixes.forward(y, y + step)
            terms = (np.minimum(reach - length, last[dense]) - y) // step + 1
            first[dense] = y + ((reach - length - y) // step) * step + 1
            begin = y - suffixes.backward(y, y + step)
            own = (x >= begin) & (x + length <= reach)
            nearest = own & (y - x == step)
            terms[nearest] = 1
            x, y, step, terms = (v[~own | nearest] for v in (x, y, step, terms))
            which = np.repeat(np.arange(len(x)), terms)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(terms) - terms, terms)
            blocks.append(x[which])
            places.append(y[which] + nth * step[which])
        more = first <= last
        block, first, last, low, high = (v[more] for v in (block, first, last, low, high))
    if not blocks:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(blocks), np.concatenate(places)


def runs(sequence: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period.

    ``longest`` is the length of the longest stretch between numbers that occur only once, such
    as the ends of texts; no run is longer.
    """
    n = len(sequence)
    empty = np.empty(0, dtype=np.int64)
    if longest < LEAST_LENGTH:
        return empty, empty, empty
    suffixes = Suffixes(sequence, longest)
    matrix = WaveletMatrix(suffixes.order)
    found = []
    level = FIRST_LEVEL
    while 2 * _window(level)[0] <= longest or level == FIRST_LEVEL:
        length = 1 << level
        block = np.arange(0, n - length + 1, length, dtype=np.int64)
        least, greatest = _window(level)
        asked = [(block + least, np.minimum(block + greatest, n - 1))]
        if level == FIRST_LEVEL:
            asked.append((block - 6, block - 6))
        for first, last in asked:
            inside = first >= 0
            b, place = _occurrences(suffixes, matrix, level, block[inside], first[inside], last[inside])
            found.append(np.stack([np.minimum(b, place), np.abs(place - b)]))
        level += 1
    at, period = np.concatenate(found, axis=1)
    start = at - suffixes.backward(at, at + period)
    end = at + period + suffixes.forward(at, at + period)
    whole = end - start >= np.maximum(LEAST_LENGTH, 2 * period)
    start, end, period = start[whole], end[whole], period[whole]
    # One span has several periods only as multiples of the least one.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words after the repetition that the id may ask for."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def _chunks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for words in texts:
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words) + 1
    if chunk:
        yield chunk


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """All words as numbers, one number that occurs only once after each text."""
    flat = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    ids = np.asarray(flat.indices).astype(np.int64)
    sizes = np.array([len(words) for words in texts])
    ends = np.cumsum(sizes)
    return np.insert(ids, ends, len(flat.dictionary) + np.arange(len(texts)))


def text_runs(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of the runs of each text, starts as word numbers."""
    for chunk in _chunks(texts):
        sizes = np.array([len(words) for words in chunk])
        starts = np.cumsum(sizes + 1) - sizes - 1
        start, end, period = runs(_numbered(chunk), int(sizes.max()))
        cuts = np.searchsorted(start, np.append(starts, starts[-1] + sizes[-1] + 1))
        for k in range(len(chunk)):
            own = slice(cuts[k], cuts[k + 1])
            yield start[own] - starts[k], end[own] - start[own], period[own]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not len(start):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


FIELDS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _describe(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    kept = b" ".join(collapsed(words, start, length, period))
    longest: tuple = (None,) * 4
    if len(start):
        # Runs are in order of start, then period: the first of greatest length.
        i = int(np.argmax(length))
        longest = (int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i]))
    return (len(start), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_runs(documents: DataFrame, row_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: ``row_id, n_runs``, the longest run and digests of runs and remaining words.

    Words are what ASCII white space separates. ``start, length, period, exponent_milli`` describe
    the longest run (ties: smallest start, then period) and are null without one. ``runs_sha256``
    is over the line ``start,length,period`` of every run, ``collapsed_sha256`` over the words
    that no run holds after its first period, joined by one space. Null and empty texts have no
    words; repeated rows are judged one by one; no documents give no rows; other columns are left
    out. ``plant`` first repeats a tail of the documents whose ids ask for it (a null id never
    does).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textbatch.utf8(batch.column("_text"))
            ids = batch.column("_id").to_pylist() if plant else [None] * len(texts)
            for first, chunk in textbatch.chunks(texts):
                words = [(t or b"").split() for t in chunk]
                if plant:
                    words = [planted(w, i) for w, i in zip(words, ids[first:])]
                found = [_describe(w, *r) for w, r in zip(words, text_runs(words))]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 5 + [pa.string()] * 2)]
                own = batch.column("_id").slice(first, len(chunk))
                yield pa.RecordBatch.from_arrays([own, *columns], ["_id", *(f.split()[0] for f in FIELDS.split(", "))])

    id_type = documents.schema[row_id].dataType.simpleString()
    rows = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {id_type}, {FIELDS}").withColumnRenamed("_id", row_id)
