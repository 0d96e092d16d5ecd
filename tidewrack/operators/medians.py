"""Medians of moving windows from counts over ranks."""

from __future__ import annotations

import numpy as np


def smallest(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of ``ranks[lo:hi]`` for many windows at once.

    Ranks are split bit by bit from the top, zeros before ones. Counts of zeros up to
    each place tell every window how many of its values go left, hence on which side its
    answer lies and where the window stands in the next row: one step a bit for all windows.
    """
    lo, hi, k = lo.copy(), hi.copy(), k.copy()
    found = np.zeros(len(lo), dtype=np.int64)
    for bit in range(int(ranks.max()).bit_length() - 1 if len(ranks) else -1, -1, -1):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[lo], zeros[hi]
        right = k >= b - a
        k -= np.where(right, b - a, 0)
        lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
        found |= right.astype(np.int64) << bit
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return found


def window_medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Median of ``values[lo:hi]`` without missing ones (NaN) for each window; NaN where none is left."""
    known = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(known)])
    lo, hi = before[lo], before[np.maximum(hi, lo)]
    out = np.full(len(lo), np.nan)
    some = np.flatnonzero(hi > lo)
    if len(some):
        levels, ranks = np.unique(values[known], return_inverse=True)
        lo, hi = lo[some], hi[some]
        n = hi - lo
        a, b = (levels[smallest(ranks, lo, hi, k)] for k in ((n - 1) // 2, n // 2))
        out[some] = a + (b - a) * 0.5
    return out
