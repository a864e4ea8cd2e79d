"""Texts of an Arrow batch as flat numpy arrays: bytes, words, word and shingle hashes.

A word is a maximal run of digits, a-z (A-Z are lowered) and characters beyond ASCII. Batches
are cut into chunks of about ``CHUNK_BYTES`` so that the arrays of a task stay bounded by that
size and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gristmill.functions.hashing import GOLDEN, mix

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
SEPARATOR = b"\n"

_U = np.uint64
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, nulls kept."""
    return column.cast(pa.large_binary()).to_pylist()


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of consecutive chunks; every text is in exactly one chunk."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and (size + n > CHUNK_BYTES or i - first >= CHUNK_ROWS):
            yield first, texts[first:i]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, texts[first:]


def parts(
    column: pa.Array, most_bytes: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS
) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of consecutive parts of a column; every text is in exactly one part.

    Only the part at hand is held as Python objects. A text over ``most_bytes`` is a part alone.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        before = ends[first] - sizes[first]
        last = int(np.searchsorted(ends, before + most_bytes, side="right"))
        last = max(first + 1, min(last, first + most_rows))
        yield first, utf8(column.slice(first, last - first))
        first = last


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    is_word = np.zeros(256, dtype=bool)
    is_word[48:58] = is_word[97:123] = is_word[128:] = True
    return lower, is_word


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of a chunk in order; ``doc`` is the row each belongs to within the chunk."""

    data: np.ndarray  # lowered bytes of the chunk
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray  # words of each text
    first: np.ndarray  # position of each text's first word


def words(texts: list[bytes | None]) -> Words:
    lower, is_word = _tables()
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    data = lower[np.frombuffer(SEPARATOR.join(t or b"" for t in texts) + SEPARATOR, dtype=np.uint8)]
    flags = is_word[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[0::2], edges[1::2]
    doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    doc = np.searchsorted(doc_start, start, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    raw = (sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data) + 1)[start]
    return Words(data, start, end, doc, mix(raw + (end - start).astype(np.uint64) * GOLDEN), per_doc, first)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` consecutive words that begin at each word (as far as they exist)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        out = out * _U(_BASE) + mix(hashes[j : j + n] + _U(j + 1))
    return mix(out)


def shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``length`` words; a shorter text is one run of all its words."""
    h = runs(w.hash, length)
    row = w.doc[: len(h)]
    inside = row == w.doc[length - 1 :] if len(h) else np.empty(0, dtype=bool)
    rows, values = [row[inside]], [h[inside]]
    for short in range(1, length):
        some = np.flatnonzero(w.per_doc == short)
        if len(some):
            rows.append(some)
            values.append(runs(w.hash, short)[w.first[some]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return row[order], value[order]
