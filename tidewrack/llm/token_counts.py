"""Token counts of a piece vocabulary by rank-synchronous merging.

Words (a run of blanks and what follows it) never merge with each other, since
no piece has a blank behind another character. Words not met before are held as
one ragged array: their symbols end to end. In each round every word merges its
lowest-rank pair, all words at once. All occurrences of that pair in a word merge
in the same round unless one of the pairs this makes would come first; such a
word merges its leftmost pair only. What survives is counted: a piece is one
token, a character without a piece is one per UTF-8 byte.

A null or empty text has no tokens. Repeated rows are counted each. Other columns
pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import slices, vocabulary
from tidewrack.llm.pairs import NONE, PairTable

BLANK = "▁"
#: Characters of text handled at once, words kept from earlier texts, and the longest such word.
SLICE_CHARS, KEPT_WORDS, KEPT_CHARS = 4_000_000, 600_000, 64
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens as the library does for a BPE vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                pieces[sp.id_to_piece(i)] = sp.get_score(i)
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank behind another character; words are not independent")
        names = {p: n for n, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.size = len(names)
        by_score = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        found = []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in names and p[k:] in names:
                    found.append((names[p[:k]], names[p[k:]], by_score[score], names[p]))
        self.pairs = PairTable(*(np.ascontiguousarray(c) for c in np.array(found, dtype=np.int64).reshape(-1, 4).T))
        # A symbol counts one if it is a piece, else its UTF-8 bytes; size + n stands for unknown characters of n bytes.
        self.weight = np.array([1 if p in pieces else len(p.encode()) for p in names] + [0, 1, 2, 3, 4], dtype=np.int64)
        chars = {ord(p): n for p, n in names.items() if len(p) == 1}
        self.chars = np.full(max(chars) + 1, -1, dtype=np.int64)
        self.chars[list(chars)] = list(chars.values())
        self.kept: dict[str, int] = {}

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, blanks written as ``BLANK``; no word is empty."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = np.where(code < len(self.chars), self.chars[np.minimum(code, len(self.chars) - 1)], -1)
        sym = np.where(sym < 0, self.size + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), sym)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), length)
        counts = np.zeros(len(words), dtype=np.int64)
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], _ = self.pairs.find(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = lowest == NONE
            if over.any():
                counts += np.bincount(word[over], weights=self.weight[sym[over]], minlength=len(words)).astype(np.int64)
                go = ~over
                sym, word, rank, lowest = sym[go], word[go], rank[go], lowest[go]
                if not len(sym):
                    break
            sel = np.flatnonzero(rank == lowest)
            # In a row of overlapping pairs every second one merges, from the left.
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(sel) > 1], np.arange(len(sel)), 0))
            sel = sel[(np.arange(len(sel)) - run) % 2 == 0]
            new = self.pairs.find(sym[sel], sym[sel + 1])[1]
            good = self._safe(sym, word, lowest, sel, new)
            sel = sel[good]
            sym[sel] = new[good]
            keep = np.ones(len(sym), dtype=bool)
            keep[sel + 1] = False
            at = (np.cumsum(keep) - 1)[sel]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            flag = np.zeros(len(sym) + 1, dtype=bool)
            flag[at] = flag[at - 1] = True  # -1 is the spare last place
            touched = np.flatnonzero(flag[:-1])
            rank[touched] = NONE
            inner = touched[touched + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner], _ = self.pairs.find(sym[inner], sym[inner + 1])
        return counts

    def _safe(self, sym, word, lowest, sel, new) -> np.ndarray:
        """Which pairs merge now: of words where a merge makes a pair that comes first, the leftmost only."""
        n = len(sym)
        bad = np.zeros(len(sel), dtype=bool)
        right = np.minimum(sel + 2, n - 1)
        has = (sel + 2 < n) & (word[right] == word[sel])
        bad |= has & (self.pairs.find(new, sym[right])[0] <= lowest[sel])
        left = np.maximum(sel - 1, 0)
        before = sym[left].copy()
        joined = np.r_[False, np.diff(sel) == 2] if len(sel) else np.zeros(0, dtype=bool)
        before[joined] = new[np.flatnonzero(joined) - 1]
        has = (sel > 0) & (word[left] == word[sel])
        bad |= has & (self.pairs.find(before, new)[0] <= lowest[sel])
        first = np.r_[True, word[sel[1:]] != word[sel[:-1]]]
        spoilt = np.zeros(int(word[-1]) + 1, dtype=bool)
        spoilt[word[sel[bad]]] = True
        return first | ~spoilt[word[sel]]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split = [self._words(t) for t in texts]
        missing = [w for w in {w for ws in split for w in ws} if w not in self.kept]
        fresh = dict(zip(missing, self.count_words([BLANK + w for w in missing]).tolist())) if missing else {}
        rare = {w: n for w, n in fresh.items() if len(w) > KEPT_CHARS}
        self.kept.update(fresh if not rare else {w: n for w, n in fresh.items() if w not in rare})
        if rare:
            return [sum(rare[w] if w in rare else self.kept[w] for w in ws) for ws in split]
        get = self.kept.__getitem__
        return [sum(map(get, ws)) for ws in split]

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words without their first blank; the library puts one before the text."""
        if not text:
            return []
        if "  " not in text and BLANK not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [w[1:] for w in _WORDS.findall(BLANK + text.replace(" ", BLANK))]


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column (long), without begin, end or added special tokens."""
    path = vocabulary("piece_bpe_32k.model", path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = counter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.tolist()]
            out: list[int] = []
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                out += pieces.count(texts[a:b])
            yield pd.Series(out, dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 4096, path: str | None = None) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); own columns of these names are replaced."""
    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).withColumn("n_tokens", token_count(F.col(text), path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
