"""Lookup of many (left, right) symbol pairs at once."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank and merged symbol of symbol pairs, in a flat open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank, self.merged = np.full(1 << bits, NONE, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        self.steps, todo, slot = 0, np.arange(len(key)), self._slot(key)
        while len(todo):
            self.steps += 1
            free = self.key[slot[todo]] < 0
            at = todo[free]
            self.key[slot[at]] = key[at]
            won = self.key[slot[todo]] == key[todo]
            at = todo[won]
            self.rank[slot[at]], self.merged[slot[at]] = rank[at], merged[at]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where the pair never merges) and merged symbol."""
        key = left << 32 | right
        slot = self._slot(key)
        there = self.key[slot]
        look = np.flatnonzero((there != key) & (there >= 0))
        for _ in range(self.steps - 1):
            if not len(look):
                break
            slot[look] = (slot[look] + 1) & self.mask
            there = self.key[slot[look]]
            look = look[(there != key[look]) & (there >= 0)]
        hit = self.key[slot] == key
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]
