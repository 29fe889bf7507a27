"""64-bit hashes of words and of runs of words, for whole texts at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Words are runs of anything but these bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = (np.arange(1, 4097, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def mix(x: np.ndarray, by: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers; another one for each `by`."""
    x = x + U((0x632BE59BD9B4E019 * (by + 1)) & (1 << 64) - 1)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Multipliers of the first and second hash of words.
_FACTORS = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


def words(raw: bytes, which: int = 0) -> np.ndarray:
    """One hash for each word: the sum of what its bytes hash to at their places, mixed with its length. There are two
    hashes, 0 and 1, of which neither tells anything of the other."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    letters = data[inside].astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    place = np.minimum(place, 1 << 40).astype(np.uint64)
    x = (place << U(8)) + letters + U(1)
    x *= _FACTORS[which]
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93) if not which else U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    return mix(np.add.reduceat(x, first) + sizes.astype(np.uint64), which)


def runs(hashes: np.ndarray, n: int, by: int = 0) -> np.ndarray:
    """One hash for each run of n words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += mix(hashes[k : k + count] * _ODD[k], by) if n <= 5 else hashes[k : k + count] * _ODD[k]
        if n > 5:
            total ^= total >> U(29)
            total *= U(0xBF58476D1CE4E5B9)
    return mix(total, by)
