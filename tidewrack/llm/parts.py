"""Ids of parts of texts, kept once and put together for whole texts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of many stretches, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


class PartStore:
    """Ids by part, in one array; forgotten when there are more than ``most`` parts or twenty ids for each of these."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. A text is a list of parts."""
        if len(self.rows) > self.most or len(self.flat) > 20 * self.most:
            self._forget()
        found = [list(map(self.rows.get, parts)) for parts in texts]
        open_texts = [k for k, x in enumerate(found) if None in x]
        if open_texts:
            new = list({p for k in open_texts for p, x in zip(texts[k], found[k]) if x is None})
            flat, sizes = self.encode(new)
            self.rows.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, flat]
            for k in open_texts:
                found[k] = list(map(self.rows.__getitem__, texts[k]))
        n_parts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        rows = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(n_parts.sum()))
        sizes = self.sizes[rows]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(n_parts)]
        return self.flat[ragged(self.starts[rows], sizes)], np.diff(np.r_[0, ends])


def joined(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and their lengths."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.fromiter(chain.from_iterable(words), dtype=np.int32, count=int(sizes.sum())), sizes
