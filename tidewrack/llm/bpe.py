"""Byte-level BPE encoding with a segment tree over adjacent pair ranks, and decoding.

A pre-token is a row of symbols; leaf k of its tree holds rank and place of the
pair that starts at symbol k, every inner node the smaller of its two children.
The root therefore names the leftmost lowest-rank merge. A merge changes three
leaves (the pair, the one before, the one after), each updated along its path to
the root, until the root is empty. Pre-tokens with equally many leaves are one
array and take their steps together.

Texts are cut at single blanks between other characters, where no pre-token can
span; what such a cut gives is kept for later texts. Special strings inside a
text become their id, as the library's default is. A null or empty text has no
ids; null ids decode to the empty text. Repeated rows are each encoded. Other
columns pass through untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.common import slices, vocabulary
from tidewrack.llm.pairs import NONE, PairTable
from tidewrack.llm.parts import PartStore, ragged

#: Characters of text handled at once, parts of texts kept, leaves of all trees that take steps together.
SLICE_CHARS, KEPT_PARTS, CELLS = 1_000_000, 200_000, 1 << 17
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands before a part without leading blank; no text holds a lone surrogate.
FIRST = "\udfff"
_CODECS: dict[str, ByteCodec] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteCodec:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters], dtype=np.int64)
        sides = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64)
        self.pairs = PairTable(sides[:, 0], sides[:, 1], np.arange(len(sides)), sides[:, 2])
        self.merged = sides[:, 2]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in w) for w, i in vocab.items()}
        self.bytes_of.update({i: w.encode() for w, i in self.special.items()})
        self.cut = regex.compile(_PATTERN)
        self.by_special = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.store = PartStore(self._encode_parts, KEPT_PARTS)

    # Encoding

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty pre-tokens end to end, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        leaves = np.left_shift(1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        counts = np.zeros(len(words), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(leaves).tolist():
            which = np.flatnonzero(leaves == width)
            step = max(1, CELLS // width)
            for a in range(0, len(which), step):
                part = which[a:a + step]
                ids, counts[part] = self._merge([words[i] for i in part.tolist()], lengths[part], width)
                done.append((part, ids))
        out = np.empty(int(counts.sum()), dtype=np.int32)
        starts = np.cumsum(counts) - counts
        for part, ids in done:
            out[ragged(starts[part], counts[part])] = ids
        return out, counts

    def _merge(self, words: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        count, levels = len(words), width.bit_length() - 1
        kind = np.int32 if levels < 14 else np.int64  # a key is a rank and a place
        place = np.arange(width)
        filled = place[None, :] < length[:, None]
        sym = np.full((count, width), -1, dtype=np.int64)
        sym[filled] = self.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
        # Places one word after another; the place before the first and after the last of a word is -1.
        after = np.where(place[None, :] + 1 < length[:, None], np.arange(count)[:, None] * width + place + 1, -1).ravel()
        before = np.where((place[None, :] > 0) & filled, np.arange(count)[:, None] * width + place - 1, -1).ravel()
        sym = sym.ravel()
        alive = filled.ravel().copy()
        none = kind((1 << 17) << levels)
        tree = np.full((count, 2 * width), none, dtype=kind)
        has = np.flatnonzero(after >= 0)
        rank, _ = self.pairs.find(sym[has], sym[after[has]])
        leaf = tree[:, width:]
        leaf[has // width, has % width] = np.where(rank == NONE, none, rank << levels | has % width)
        for level in range(levels, 0, -1):
            half = 1 << (level - 1)
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        flat = tree.ravel()

        def update(row: np.ndarray, at: np.ndarray, value) -> None:
            """Write leaves (one a row) and the nodes above them."""
            node = row * (2 * width) + width + at
            root = row * (2 * width)
            flat[node] = value
            at = at + width
            for _ in range(levels):
                at = at >> 1
                flat[root + at] = np.minimum(flat[root + 2 * at], flat[root + 2 * at + 1])

        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            top = flat[row * (2 * width) + 1]
            at = top & (width - 1)
            here = row * width + at
            gone = after[here]
            sym[here] = self.merged[top >> levels]
            alive[gone] = False
            behind = after[gone]
            after[here] = behind
            follows = behind >= 0
            before[behind[follows]] = here[follows]
            update(row, gone - row * width, none)
            value = np.full(len(row), none, dtype=kind)
            rank, _ = self.pairs.find(sym[here[follows]], sym[behind[follows]])
            value[follows] = np.where(rank == NONE, none, rank << levels | at[follows])
            update(row, at, value)
            ahead = before[here]
            led = ahead >= 0
            if led.any():
                front, lead = ahead[led], row[led]
                rank, _ = self.pairs.find(sym[front], sym[here[led]])
                spot = front - lead * width
                update(lead, spot, np.where(rank == NONE, none, rank << levels | spot))
            row = row[flat[row * (2 * width) + 1] < none]
        alive = alive.reshape(count, width)
        return sym[alive.ravel()], alive.sum(axis=1)

    def _pre_tokens(self, part: str) -> list[str]:
        if part.isascii() or max(part) < "ɐ":
            return self.cut.findall(part)
        return [part[a:b] for _, (a, b) in self.library_cut(part)]

    def _cut(self, part: str) -> tuple[str, ...] | list[str]:
        """Pre-tokens of a part: a word, a word and one mark, or what the pattern says."""
        if part[0] == FIRST:
            return (part,) if part[1:] in self.special else self._pre_tokens(part[1:])
        if part.isascii() or max(part) < "ɐ":
            if part.isalpha():
                return (" " + part,)
            if part[-1] in ".,;:!?" and part[:-1].isalpha():
                return (" " + part[:-1], part[-1])
        return self._pre_tokens(" " + part)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has."""
        cut = [self._cut(p) for p in parts]
        index: dict[str, int] = {}
        of_word = np.array([index.setdefault(w, len(index)) for ws in cut for w in ws], dtype=np.int64)
        special = self.special
        ids, counts = self.merge_all([b"?" if w[0] == FIRST else w.encode() for w in index])
        starts = np.cumsum(counts) - counts
        for w, k in index.items() if special else ():
            if w[0] == FIRST:
                ids[starts[k]] = special[w[1:]]
        n_words = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        return ids[ragged(starts[of_word], counts[of_word])], np.add.reduceat(counts[of_word], np.cumsum(n_words) - n_words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, as the library gives them without added special tokens, and how many each has."""
        return self.store.ids([self._parts(t) for t in texts])

    def _parts(self, text: str) -> list[str]:
        """Parts of a text that no pre-token spans: ``FIRST`` and the part, or a part without its leading blank."""
        if not text:
            return []
        if self.by_special is not None and any(w in text for w in self.special):
            return [p for x in self.by_special.split(text) if x for p in ([FIRST + x] if x in self.special else _plain_parts(x))]
        return _plain_parts(text)

    # Decoding

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _plain_parts(text: str) -> list[str]:
    parts = text.split(" ")
    if not parts[0] or not parts[-1] or "  " in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
        parts = _careful(parts)
    parts[0] = FIRST + parts[0]
    return parts


def _careful(parts: list[str]) -> list[str]:
    """Undo the cuts beside which white space stands, so that runs of white space stay whole."""
    out, open_part = [], [parts[0]]
    for last, p in zip(parts, parts[1:]):
        if not last or not p or last[-1].isspace() or p[0].isspace():
            open_part.append(p)
        else:
            out.append(" ".join(open_part))
            open_part = [p]
    return [*out, " ".join(open_part)]


def codec(path: str) -> ByteCodec:
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


def encoded(text: Column, path: str | None = None) -> Column:
    """Ids (array of int) of a text column."""
    path = vocabulary("byte_bpe_50k.json", path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in batches:
            texts = batch.to_pylist()
            done = []
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                ids, lengths = c.encode(texts[a:b])
                done.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(ids)))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of a column of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
    path = vocabulary("byte_bpe_50k.json", path)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in batches:
            flat, ends = batch.flatten().to_numpy(), batch.offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            yield pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())

    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a column of ids."""
    return docs.withColumn(ids, encoded(F.col(text), path))


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of a column of ids."""
    return rows.withColumn(text, decoded(F.col(ids), path))
