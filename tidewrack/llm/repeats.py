"""Long repeated passages by run-length indexes over the pieces of text that could repeat.

Every window of ``length`` bytes holds an anchor, the string of ``gram`` bytes
with the least hash (the leftmost of equals); windows in a row with one anchor
make a piece. Equal windows have equal anchors, so only pieces whose anchor is
met twice or more matter, and pieces of one anchor go to one bucket, each
distinct text once with its number of copies. A bucket builds the Burrows-Wheeler
transform of its pieces in runs, with the longest match of the suffixes sampled
at the ends of runs. Between samples the length of the longest match falls by one
a byte, so matching statistics are streamed from the samples alone.

An anchor with more distinct pieces than ``most`` is no bucket of its own: its
pieces are cut again by anchors of longer grams. At ``gram`` = ``length`` a piece
is one window and an anchor has one distinct piece, so this ends with every
window compared.

A null text counts as empty; texts shorter than ``length`` keep all bytes. Rows
with equal id and text are documents of their own, copies of each other. Rows
without doc_id are handled like others. Empty tables give empty tables. Other
columns are not carried. ``docs`` is read several times: store it first if it is
costly to compute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import discard, durable, slices

#: Bytes of text hashed at once, bytes of the pieces of a bucket, distinct pieces of an anchor, bytes of the first anchors.
SLICE_BYTES, BUCKET_BYTES, MOST, GRAM = 2_000_000, 300_000, 2_000, 64
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_PLACES = "row binary, copies long, anchor long, content binary, size int, starts array<long>"
_SPANS = "array<struct<a:long,b:long>>"


def words_at(data: bytes, order: str) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; zeros follow the end."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty(n, dtype=np.uint64)
    for s in range(min(8, n)):
        out[s::8] = np.frombuffer(padded, dtype=f"{order}u8", offset=s, count=(n - s + 7) // 8)
    return out


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 or more) from each place on."""

    def mixed(h: np.ndarray, factor: int, shift: int) -> np.ndarray:
        h *= np.uint64(factor)
        h ^= h >> np.uint64(shift)
        return h

    h, size = mixed(words_at(data, "<"), 0x9E3779B97F4A7C15, 29), 8
    while size < gram:
        step = min(size, gram - size)
        h = mixed(mixed(h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:], 0x94D049BB133111EB, 31), 0x9E3779B97F4A7C15, 29)
        size += step
    return h[:len(data) - gram + 1]


def pieces(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each piece of the texts in ``data``, which end at ``ends``."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = gram_hashes(data, gram)
    least, size, width = hashes & _HIGH | np.arange(len(hashes), dtype=np.uint64), 1, length - gram + 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = (least[windows] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(windows) != 1)])) if len(windows) else windows
    return hashes[anchor[new]], windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1] if len(windows) else windows


def _cut(length: int, gram: int):
    """Pieces of texts: (row, copies, text) to ``_PLACES``. Very long texts are hashed slice by slice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a in range(0, len(text or b"") - length + 1, SLICE_BYTES):
                    parts.append((i, a, text[a:a + SLICE_BYTES + length - 1]))
            for a, b in slices([len(p[2]) for p in parts], SLICE_BYTES):
                yield _places(batch, parts[a:b], length, gram)

    return cut


def _places(batch: pa.RecordBatch, parts: list[tuple[int, int, bytes]], length: int, gram: int) -> pa.RecordBatch:
    data = b"".join(p[2] for p in parts)
    ends = np.cumsum([len(p[2]) for p in parts])
    anchor, first, last = pieces(data, ends, length, gram)
    part = np.searchsorted(ends, first, side="right")
    rows = np.array([p[0] for p in parts])[part]
    starts = first - (ends - [len(p[2]) for p in parts])[part] + np.array([p[1] for p in parts])[part]
    view, found = memoryview(data), {}
    for k, (row, a, b) in enumerate(zip(rows.tolist(), first.tolist(), (last + length).tolist())):
        found.setdefault((row, xxhash.xxh3_128_digest(view[a:b])), []).append(k)
    at = [own[0] for own in found.values()]
    row = pa.array(rows[at])
    flat = starts[[k for own in found.values() for k in own]]
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in found.values()])])
    return pa.RecordBatch.from_arrays(
        [batch.column("row").take(row), batch.column("copies").take(row), pa.array(anchor[at].view(np.int64)), pa.array([c for _, c in found], pa.binary()),
         pa.array((last - first)[at] + length, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
        names=["row", "copies", "anchor", "content", "size", "starts"])


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the pieces that a text is asked for: (text, asked) to (anchor, content, n, members, text)."""
    for batch in batches:
        texts, asked = batch.column("text").to_pylist(), batch.column("asked")
        lists = asked.flatten()
        of = np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
        out = [texts[i][a:a + n] for i, a, n in zip(of.tolist(), lists.field("start").to_pylist(), lists.field("size").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(lists.field(c) for c in ("anchor", "content", "n", "members")), pa.array(out, pa.binary())], names=["anchor", "content", "n", "members", "text"])


def _in_order(first: np.ndarray, second: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (second < ``limit``) as single numbers in order, and where each came from."""
    low, place = int(limit).bit_length(), len(first).bit_length()
    key = first << low | second
    if int(first.max()).bit_length() + low + place > 62:
        by = np.argsort(key)
        return key[by], by
    # places ride along in the low bits, since plain sorting is faster than sorting places
    both = np.sort(key << place | np.arange(len(key)))
    return both >> place, both & ((1 << place) - 1)


class RunIndex:
    """Burrows-Wheeler transform of some texts in runs, with longest matches sampled at the ends of runs.

    Every text ends in a mark of its own that sorts before all bytes, so no match crosses an end.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = b"".join(texts)
        self.ends = np.cumsum(sizes)
        self.left = np.repeat(self.ends, sizes) - np.arange(len(self.data))
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.ranks: list[tuple[int, np.ndarray]] = []
        order = self._sorted()
        before = np.frombuffer(self.data, dtype=np.uint8)[order - 1].astype(np.int16)
        first = order == self.ends[self.owner[order]] - sizes[self.owner[order]]
        before[first] = -1
        change = (before[1:] != before[:-1]) | first[1:]
        #: Last suffix of each run but the last, first suffix of the run behind it, bytes these two share.
        self.tails, self.heads = order[:-1][change], order[1:][change]
        self.shared = self._shared(self.tails, self.heads)
        self.n_runs = len(self.heads) + 1

    def _sorted(self) -> np.ndarray:
        """Places in the order of their suffixes, by ranks of 8, 16, 32 ... bytes, which are kept.

        A rank is the first slot of its equals; only slots that share a rank are sorted again.
        """
        n = len(self.data)
        self.words = words_at(self.data, ">")
        short = np.flatnonzero(self.left < 8)
        self.words[short] &= ~np.uint64(0) << (8 * (8 - self.left[short])).astype(np.uint64)
        order, depth, rank = np.argsort(self.words), 8, np.empty(n, dtype=np.int64)
        head = np.ones(n + 1, dtype=bool)
        head[1:n] = np.diff(self.words[order]) != 0
        heads = np.flatnonzero(head)
        rank[order] = np.repeat(heads[:-1], np.diff(heads))
        while True:
            self.ranks.append((depth, rank))
            shared = np.flatnonzero(~(head[:-1] & head[1:]))
            if not len(shared):
                return order
            at = order[shared]
            # behind the end: shorter texts first, then the marks of the texts
            marks = len(self.ends) * (depth + 1)
            ended = self.left[at] <= depth
            behind = np.where(ended, self.left[at] * len(self.ends) + self.owner[at], marks + rank[np.minimum(at + depth, n - 1)])
            key, by = _in_order(rank[at], behind, marks + n)
            at = at[by]
            order[shared] = at
            head[shared[1:]] = np.diff(key) != 0
            heads = np.flatnonzero(head[shared])
            rank = rank.copy()
            rank[at] = np.repeat(shared[heads], np.diff(np.concatenate([heads, [len(shared)]])))
            depth *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share."""
        most, n = np.minimum(self.left[a], self.left[b]), len(self.data)
        i, j, shared = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for depth, rank in reversed(self.ranks):
            same = (i < n) & (j < n) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            step = depth * same
            i, j, shared = i + step, j + step, shared + step
        differ = self.words[np.minimum(i, n - 1)] ^ self.words[np.minimum(j, n - 1)]
        for byte in range(1, 8):
            shared += (differ >> np.uint64(64 - 8 * byte)) == 0
        return np.minimum(shared, most)

    def matching_statistics(self) -> np.ndarray:
        """For every place, the longest string from it on that starts anywhere else too."""
        reach = np.zeros(len(self.data), dtype=np.int64)
        reach[self.heads] = self.heads + self.shared
        reach[self.tails] = np.maximum(reach[self.tails], self.tails + self.shared)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(self.data)), 0)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal spans in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([np.flatnonzero(new)[1:], [len(b)]]) - 1]


def _mark(length: int):
    """Spans of the pieces of a bucket that windows of ``length`` repeated elsewhere cover; of a piece met twice or more, all."""

    def mark(table: pa.Table) -> pa.Table:
        texts, copies = table.column("text").to_pylist(), np.array(table.column("n").to_pylist())
        index = RunIndex(texts)
        longest = index.matching_statistics()
        longest = np.where(copies[index.owner] > 1, index.left, longest)
        at = np.flatnonzero(longest >= length)
        a, b = covered(at, at + longest[at])
        # a span may reach the end of a piece and go on with the next piece's first byte
        cuts = index.ends[:-1]
        inner = cuts[(np.searchsorted(a, cuts, side="left") > np.searchsorted(b, cuts, side="right"))]
        a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
        owner = index.owner[a]
        base = index.ends[owner] - [len(texts[o]) for o in owner.tolist()]
        hit = np.unique(owner)
        offsets = np.searchsorted(owner, np.concatenate([hit, [len(texts)]]))
        spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], names=["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        return pa.table({"content": table.column("content").combine_chunks().take(pa.array(hit)), "spans": lists})

    return mark


def repeated_spans(texts: DataFrame, length: int, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(row, found) of texts with repeated windows: structs of starts, and of spans relative to each start.

    ``texts``: row, copies, text (binary); a row with copies > 1 stands for that many texts.
    """
    gram = max(8, min(gram, length))
    places = durable(texts.mapInArrow(_cut(length, gram), _PLACES))
    met = F.sum(F.col("copies") * F.size("starts"))
    again = places.groupBy("anchor").agg(met.alias("n")).where("n > 1").select("anchor")
    kept = durable(places.join(again, "anchor", "left_semi"))
    discard(places)
    contents = durable(kept.groupBy("anchor", "content").agg(met.alias("n"), F.min(F.struct("row", F.col("starts")[0].alias("start"), "size")).alias("at")))
    members = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"))
    sized = durable(contents.join(members, "anchor"))
    asked = sized.where("members > 1").select("at.row", F.struct("anchor", "content", "n", "members", "at.start", "at.size").alias("one"))
    asked = asked.groupBy("row").agg(F.collect_list("one").alias("asked"))
    found = durable(texts.join(asked, "row").select("text", "asked").mapInArrow(_take_out, "anchor long, content binary, n long, members long, text binary"))

    buckets = F.greatest(F.lit(1), F.ceil(F.sum("at.size") / BUCKET_BYTES)).cast("long")
    n_buckets = sized.where("members > 1").agg(F.coalesce(buckets, F.lit(1)).alias("n")).first().n
    single = found.where(F.col("members") <= most).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets)))
    marks = single.groupBy("bucket").applyInArrow(_mark(length), f"content binary, spans {_SPANS}")
    # an anchor with one text, met twice or more: nothing to compare it with
    marks = marks.unionByName(sized.where("members = 1").select("content", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("at.size").cast("long").alias("b"))).alias("spans")))
    crowded = found.where(F.col("members") > most).select(F.col("content").alias("row"), F.col("n").alias("copies"), "text")
    if gram < length and not crowded.isEmpty():
        inner = repeated_spans(crowded, length, (gram + length + 1) // 2, most)
        shifted = F.flatten(F.transform("found", lambda f: F.flatten(F.transform(f.starts, lambda s: F.transform(f.spans, lambda x: F.struct((x.a + s).alias("a"), (x.b + s).alias("b")))))))
        marks = marks.unionByName(inner.select(F.col("row").alias("content"), shifted.alias("spans")))
    marks = durable(marks)
    discard(contents, sized, found)
    return durable(kept.join(marks, "content").select("row", F.struct("starts", "spans").alias("one")).groupBy("row").agg(F.collect_list("one").alias("found")))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, left = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found")):
            text, starts, ends = text or b"", [], []
            for one in found.values if found.is_valid else ():
                at, spans = np.array(one["starts"].as_py()), one["spans"].values
                starts.append((at[:, None] + spans.field("a").to_numpy()).ravel())
                ends.append((at[:, None] + spans.field("b").to_numpy()).ravel())
            a, b = covered(np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, dtype=np.int64),) * 2
            counts.append((len(text), int((b - a).sum()), len(a)))
            left.append(b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)])))
        columns = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ((), (), ()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay (``kept``) of every document.

    Removed is every byte under a string of ``length`` (8 or more) bytes that starts anywhere else too; strings are judged on the input.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(b":"), text)))
    rows = docs.select(row.alias("row"), F.lit(1).cast("long").alias("copies"), "doc_id", text.alias("text"))
    found = repeated_spans(rows.select("row", "copies", "text"), length, gram, most)
    both = rows.select("row", "doc_id", "text").join(found, "row", "left").select("doc_id", "text", "found")
    return both.mapInArrow(_remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
