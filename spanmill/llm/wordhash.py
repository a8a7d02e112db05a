"""Vectorised 64-bit hashes of byte ranges: prefix sums of a polynomial modulo 2**64, with odd multipliers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHUNK = (1 << 20) - 2
#: fixed values: odd multipliers of the polynomials
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return table(MULTIPLIERS[which]), table(pow(MULTIPLIERS[which], -1, 1 << 64))


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the low bits over all 64."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[s:e] for ascending starts and ends, alike wherever the bytes stand; bounded memory beside it."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        size = int(ends[to - 1]) - low
        power, inverse = _powers(which, 1 << max(CHUNK, size).bit_length())
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out
