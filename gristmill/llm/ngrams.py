"""Hashed character n-grams and tokens of a chunk of texts as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gristmill.functions.hashing import GOLDEN, mix

_U = np.uint64
_SPACE = ord(" ")


def code_points(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(points, first): every text between two spaces, white space as one kind, and each text's place.

    Text ``i`` and the spaces around it lie in ``points[first[i] : first[i + 1] + 1]``.
    """
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    flat = " " + " ".join(decoded) + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where((points <= _SPACE) | (points == 0xA0) | (points == 0x3000), _SPACE, points).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in decoded])])
    return points, first


def lowered(points: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters."""
    capital = ((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222) & (points != 215))
    return points + capital.astype(np.uint32) * np.uint32(32)


def character_ngrams(points: np.ndarray, sizes: range, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per size (size, place, bucket) of the n-grams inside words.

    A word's ends are marked by one space; an n-gram reaches over one end at most.
    """
    space = points == _SPACE
    spaces = np.concatenate([[0], np.cumsum(space)])
    spread = mix(points.astype(np.uint64) + _U(1))
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, sizes.stop):
        if n > len(points):
            return
        rolling = rolling[: len(points) - n + 1] * GOLDEN + spread[n - 1 :]
        if n not in sizes:
            continue
        places = len(points) - n + 1
        # Only the first or the last character may be white space.
        inner = spaces[n - 1 : n - 1 + places] - spaces[1 : 1 + places] if n > 2 else np.zeros(places, dtype=np.int64)
        inside = (inner == 0) & ~(space[:places] & space[n - 1 :])
        place = np.flatnonzero(inside)
        yield n, place, (mix(rolling[place] + _U(n)) % _U(buckets)).astype(np.int64)


def tokens(points: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of the white-space separated tokens."""
    space = points == _SPACE
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return start, start
    number = np.cumsum(np.bincount(start, minlength=len(points))) - 1  # of the token a point belongs to
    within = np.arange(len(points)) - start[np.maximum(number, 0)]
    point = mix(mix(points.astype(np.uint64) + _U(1)) + within.astype(np.uint64) * GOLDEN)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(point, dtype=np.uint64)])
    return start, (mix(sums[end] - sums[start] + _U(99)) % _U(buckets)).astype(np.int64)
