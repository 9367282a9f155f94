"""Content hashes of every byte range of a buffer, from one running sum."""

from __future__ import annotations

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """Hashes of byte ranges; equal bytes hash alike wherever they stand. Power tables are kept between buffers."""

    def __init__(self):
        self.up = self.down = self.sums = np.zeros(0, np.uint64)

    def load(self, data: np.ndarray) -> Ranges:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(FACTOR, n), _powers(_INVERSE, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[: n - 1], out=self.sums[1:])
        return self

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Of all ranges of one width."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])
