"""64-bit hash values in numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)
_M1 = _U(0xBF58476D1CE4E5B9)
_M2 = _U(0x94D049BB133111EB)
# By number of bytes, from the lowest.
_FIRST_BYTES = np.array([256**n - 1 for n in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer: turns any 64-bit value into a well spread one."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hash values as doubles in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def word_hashes(words: list[str]) -> np.ndarray:
    """Hash values of words that hold no space and are not empty; eight bytes of all words at a time."""
    out = np.array([], dtype=_U)
    if words:
        data = np.frombuffer(f"{' '.join(words)} ".encode() + bytes(8), dtype=np.uint8)
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        last = np.flatnonzero(data == 32)
        at = np.append(0, last[:-1] + 1)
        left = last - at
        out = left.astype(_U)
        some = np.arange(len(words))
        while len(some):
            piece = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
            out[some] = mix(out[some] * GOLDEN + piece)
            more = left > 8
            some, at, left = some[more], at[more] + 8, left[more] - 8
    return out
