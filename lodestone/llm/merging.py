"""A table of symbol pairs that is looked up for whole numpy arrays at once."""

from __future__ import annotations

import numpy as np

#: The rank of a pair that joins to nothing.
NONE = np.int64(1) << 40


class PairTable:
    """Open addressing: pair (a, b) of symbols, its rank, and the symbol they join to."""

    def __init__(self, base: int, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        size = 1 << 18
        while size < 4 * keys.size:
            size *= 2
        self.base = np.int64(base)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.key = np.full(size + 64, -1, dtype=np.int64)
        self.rank = np.full(size + 64, NONE, dtype=np.int64)
        self.made = np.zeros(size + 64, dtype=np.int64)
        for key, at, rank, new in zip(keys.tolist(), self._home(keys).tolist(), ranks.tolist(), made.tolist(), strict=True):
            while self.key[at] != -1:
                at += 1
            self.key[at], self.rank[at], self.made[at] = key, rank, new

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or the empty slot that ends its search."""
        keys = left * self.base + right
        at = self._home(keys)
        held = self.key[at]
        rest = np.flatnonzero((held != keys) & (held != -1))
        while rest.size:
            at[rest] += 1
            held = self.key[at[rest]]
            rest = rest[(held != keys[rest]) & (held != -1)]
        return at
