"""Token files: ids coded by a static range asymmetric numeral system.

One frequency table is counted over all ids and shared by all files. A file holds
whole documents in ascending order, in independent blocks. In a block, ``lanes``
interleaved coders take the ids in turn (id i goes to lane i mod lanes), so that
numpy codes one id of every lane per step. Layout of a block, little-endian:

    header    magic, documents, ids, lanes, checkpoints, words, crc32 of what follows
    documents doc_id (int64; flag byte apart for null) and number of ids (uint64)
    states    64-bit state of every lane at the start and at each checkpoint,
              with the place in the words: decoding may start at any of them
    words     32-bit renormalisation words in the order a decoder reads them

Each task writes files of its own under a name no other attempt uses and returns
their blocks as rows; only blocks in that table exist for a reader, so a repeated
or lost task does no harm. Order: doc_id ascending (null first), rows with equal doc_id by
a hash of their texts. A null or empty text holds the end id only; an empty table gives no file. Other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import durable, open_store, shared_folder, slices, vocabulary
from tidewrack.llm.parts import ragged

MAGIC = b"TRNS"
HEAD = struct.Struct("<4sIQIIQI")
#: Bits of a frequency, least state, lanes of a full block, ids after which a block ends, steps between checkpoints.
SCALE, LOW, LANES, BLOCK_IDS, CHECK_STEPS = 20, 1 << 31, 1024, 1 << 18, 128
#: Characters of text handled at once, parts kept with their ids, parts that the library encodes in one go, what stands between them.
SLICE_CHARS, KEPT_PARTS, AT_ONCE, MARK = 1_000_000, 800_000, 5_000, ";"
MARKS = ".,;:!?"
_NONE = np.zeros(0, dtype=np.int32)
_KEPT: dict[str, LibraryIds] = {}


# Ids of texts, by the library

class Places(dict):
    """Numbers parts as they are met; ``new`` lists those without ids yet."""

    def __init__(self, parts: list[str] = ()):
        super().__init__(zip(parts, range(len(parts))))
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        place = self[part] = len(self)
        self.new.append(part)
        return place


class LibraryIds:
    """Ids of texts. Parts between blanks or line ends do not depend on each other, so the library encodes each new part once.

    A part of letters below U+0250, perhaps with one mark behind, has the ids of its word in lower case and of the mark: the
    normaliser and the pattern would leave it as these. Not so with U+0130, whose lower case has a combining dot that the
    pattern splits off. New words and other new parts go to the library many at a time, with a mark between them whose
    id tells them apart. Beyond ``kept`` parts only the half met most often stays.
    """

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = {m: ids[0] for m, ids in zip(MARKS, self._library(list(MARKS))) if len(ids) == 1}
        self.kept = kept
        self._keep([], _NONE, np.zeros(0, dtype=np.int64))
        self._no_words()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, parts: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.places = Places(parts)
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.met = np.zeros(len(parts), dtype=np.int64)

    def _forget(self) -> None:
        often = np.sort(np.argsort(-self.met, kind="stable")[:self.kept // 2])
        parts, sizes = list(self.places), self.sizes[often]
        self._keep([parts[k] for k in often.tolist()], self.flat[ragged(self.starts[often], sizes)], sizes)

    def _no_words(self) -> None:
        self.words, self.word_ids, self.word_sizes = Places(), _NONE, np.zeros(0, dtype=np.int64)

    def _apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without the mark, end to end, and how many each has, by the library."""
        flat, sizes = [_NONE], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(parts), AT_ONCE):
            some = parts[a:a + AT_ONCE]
            ids = np.array(self._library([f" {MARK} ".join(some)])[0], dtype=np.int32)
            between = ids == self.marks[MARK]
            ends = np.concatenate([np.flatnonzero(between), [len(ids)]])
            if len(ends) != len(some):
                raise ValueError("the vocabulary joins a mark with what stands beside it")
            flat.append(ids[~between])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has."""
        if len(self.words) > self.kept:
            self._no_words()
        worded, words, tails, rest, single = [], [], [], [], []
        for k, p in enumerate(parts):
            if p and (p.isascii() or (max(p) < "ɐ" and "İ" not in p)):
                if p.isalpha():
                    worded.append(k)
                    words.append(self.words[p.lower()])
                    tails.append(-1)
                    continue
                if p[-1] in self.marks and p[:-1].isalpha():
                    worded.append(k)
                    words.append(self.words[p[:-1].lower()])
                    tails.append(self.marks[p[-1]])
                    continue
            if p:
                (single if MARK in p else rest).append(k)
        flat, sizes = self._apart(self.words.new)
        self.words.new = []
        self.word_ids, self.word_sizes = np.concatenate([self.word_ids, flat]), np.concatenate([self.word_sizes, sizes])
        n = np.zeros(len(parts), dtype=np.int64)
        row, tail = np.array(words, dtype=np.int64), np.array(tails, dtype=np.int32)
        n[worded] = self.word_sizes[row] + (tail >= 0)
        others = self._apart([parts[k] for k in rest])
        n[rest] = others[1]
        alone = self._library([parts[k] for k in single])
        n[single] = [len(x) for x in alone]
        out, at = np.empty(int(n.sum()), dtype=np.int32), np.cumsum(n) - n
        own = self.word_sizes[row]
        out[ragged(at[worded], own)] = self.word_ids[ragged((np.cumsum(self.word_sizes) - self.word_sizes)[row], own)]
        marked = np.flatnonzero(tail >= 0)
        out[(at[worded] + own)[marked]] = tail[marked]
        out[ragged(at[rest], others[1])] = others[0]
        out[ragged(at[single], n[single])] = list(chain.from_iterable(alone))
        return out, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if len(self.places) > self.kept:
            self._forget()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        n_parts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        rows = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n_parts.sum()))
        if self.places.new:
            flat, sizes = self._encode(self.places.new)
            self.places.new = []
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(sizes), dtype=np.int64)])
        self.met += np.bincount(rows, minlength=len(self.met))
        sizes = self.sizes[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n_parts)]
        return self.flat[ragged(self.starts[rows], sizes)], np.diff(np.concatenate([[0], ends]))


def library_ids(path: str) -> LibraryIds:
    if path not in _KEPT:
        _KEPT[path] = LibraryIds(path)
    return _KEPT[path]


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id and ids (binary, unsigned 32-bit little-endian, end id last) of every row."""
    path = vocabulary("word_bpe_49k.json", path)
    # Parts between blanks stand alone only if the vocabulary drops white space; checked once on the driver.
    with open(path, encoding="utf-8") as f:
        if '"Removed"' not in f.read():
            raise ValueError("the vocabulary keeps white space; parts between blanks depend on each other")

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = library_ids(path)
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                flat, sizes = encode(texts[a:b])
                flat = np.insert(flat.astype("<u4"), np.cumsum(sizes), end_id)
                ends = np.r_[0, np.cumsum(sizes + 1)] * 4
                out.append(pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))


# Coding of one block

def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to a sum of 2**scale, at least one for each id that occurs."""
    total = int(counts.sum())
    if total == 0:
        return counts.astype(np.int64)
    if int((counts > 0).sum()) > 1 << scale:
        raise ValueError("more different ids than the scale holds")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << scale) / total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - (1 << scale)
    if over < 0:
        freq[order[0]] -= over
    while over > 0:
        take = np.minimum(freq[order] // 2, over)
        take = np.minimum(take, np.maximum(0, over - np.r_[0, np.cumsum(take)[:-1]]))
        freq[order] -= take
        over -= int(take.sum())
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int, every: int = CHECK_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States at the start and checkpoints, their places in the words, and the words."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        states, places, written = [], [], 0
        limit = np.uint64(LOW >> int(self.scale) << 32)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes:(t + 1) * lanes]
            x = state[:len(s)]
            f = self.freq[s]
            full = x >= f * limit
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                written += len(words[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, f)
            state[:len(s)] = (q << self.scale) + r + self.start[s]
            if t % every == 0:
                states.append(state.copy())
                places.append(written)
        words.reverse()
        flat = np.concatenate(words) if words else np.zeros(0, dtype=np.uint32)
        return np.array(states[::-1], dtype=np.uint64).reshape(-1, lanes), written - np.array(places[::-1], dtype=np.uint64), flat

    def decode(self, states: np.ndarray, places: np.ndarray, words: np.ndarray, count: int, lanes: int, every: int = CHECK_STEPS, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last`` (the end by default)."""
        steps = -(-count // lanes)
        begin, end = first * every, steps if last is None else min(steps, last * every)
        if begin >= end:
            return np.zeros(0, dtype=np.uint32)
        x = states[first].copy()
        at = int(places[first])
        out = np.empty(min(count, end * lanes) - begin * lanes, dtype=np.uint32)
        for t in range(begin, end):
            n = min(lanes, count - t * lanes)
            y = x[:n]
            slot = y & self.mask
            s = self.symbol[slot]
            out[(t - begin) * lanes:(t - begin) * lanes + n] = s
            y = self.freq[s] * (y >> self.scale) + slot - self.start[s]
            low = np.flatnonzero(y < np.uint64(LOW))
            if len(low):
                y[low] = (y[low] << np.uint64(32)) | words[at:at + len(low)]
                at += len(low)
            x[:n] = y
        return out


def pack(coder: Coder, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One block of whole documents."""
    ids = np.concatenate(docs)
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    states, places, words = coder.encode(ids, lanes)
    body = b"".join((
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([len(d) for d in docs], dtype="<u8").tobytes(), places.astype("<u8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ))
    return HEAD.pack(MAGIC, len(docs), len(ids), lanes, len(states), len(words), zlib.crc32(body)) + body


def unpack(coder: Coder, block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents of a block; a wrong magic, length or checksum raises."""
    magic, n, count, lanes, points, n_words, crc = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size:]
    if magic != MAGIC or len(body) != n * 17 + points * 8 * (1 + lanes) + 4 * n_words or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    null = np.frombuffer(body, np.uint8, n)
    doc_ids, lengths = np.frombuffer(body, "<i8", n, n), np.frombuffer(body, "<u8", n, n * 9)
    places = np.frombuffer(body, "<u8", points, n * 17)
    states = np.frombuffer(body, "<u8", points * lanes, n * 17 + points * 8).reshape(points, lanes)
    words = np.frombuffer(body, "<u4", n_words, n * 17 + points * 8 * (1 + lanes))
    ids = coder.decode(states, places, words, count, lanes)
    return [None if z else d for z, d in zip(null.tolist(), doc_ids.tolist())], np.split(ids, np.cumsum(lengths.astype(np.int64))[:-1])


# Files

def id_counts(tokens: DataFrame) -> DataFrame:
    """symbol, n over all ids; no more rows than the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            # the ids of a batch lie end to end
            at = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1] // 4
            c = np.bincount(np.frombuffer(column.buffers()[2], "<u4", count=at[-1] - at[0], offset=4 * at[0]))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), dtype=np.int64)])
            total[:len(c)] += c
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["symbol", "n"])

    return tokens.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Write the files; returns the table of their blocks in order, and the shared frequency table.

    Blocks: file, offset, n_bytes, shard, first_row (place of the block in its shard), n_docs, n_ids, start (ids of all documents before).
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    # Ranges of doc_id in order; the place inside a range comes from the sorted rows as they are stored.
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "doc_id", F.xxhash64("text"))
    counted = tokenized(ordered.sortWithinPartitions("doc_id", F.xxhash64("text")), path=path, end_id=end_id)
    tokens = durable(counted.select(F.spark_partition_id().cast("long").alias("shard"), F.monotonically_increasing_id().alias("row"), "doc_id", "ids"))
    pairs = id_counts(tokens).collect()  # bounded by the vocabulary
    counts = np.zeros(max([r.symbol for r in pairs], default=-1) + 1, dtype=np.int64)
    for r in pairs:
        counts[r.symbol] = r.n
    freq = frequencies(counts)
    shared = spark.sparkContext.broadcast(freq)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        coder = Coder(shared.value)
        out: list[tuple] = []
        file, name, place = None, "", 0
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        shard = first = last = -1
        size = 0

        def close_block() -> None:
            nonlocal file, name, place, size
            if not held:
                return
            if file is None:
                name, place = f"{uuid.uuid4().hex}.rans", 0
                file = store.open_output_stream(f"{root}/{name}")
            block = pack(coder, held_ids, held)
            file.write(block)
            out.append((name, place, len(block), shard, first, len(held), size))
            place += len(block)
            held.clear()
            held_ids.clear()
            size = 0

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for s, row, d, x in zip(*columns, batch.column(3)):
                if s != shard or row != last + 1 or size >= BLOCK_IDS:
                    close_block()
                    if (s != shard or row != last + 1) and file is not None:
                        file.close()
                        file = None
                    shard, first = s, row
                held_ids.append(d)
                held.append(np.frombuffer(x.as_buffer(), "<u4").copy())
                size += len(held[-1])
                last = row
        close_block()
        if file is not None:
            file.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["file", "offset", "n_bytes", "shard", "first_row", "n_docs", "n_ids"])

    schema = "file string, offset long, n_bytes long, shard long, first_row long, n_docs long, n_ids long"
    blocks = durable(tokens.select("shard", "row", "doc_id", "ids").mapInArrow(write, schema))
    # ids before a shard (one row a partition), then before each block of it
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    earlier = sums.select("shard", F.coalesce(F.sum("all_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("shard_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    placed = blocks.join(earlier, "shard").withColumn("start", start).drop("shard_start").withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))
    return placed, freq


def read_token_files(blocks: DataFrame, freq: np.ndarray, ids: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(freq)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["file"])
                with store.open_input_file(path) as f:
                    f.seek(r["offset"])
                    doc_ids, docs = unpack(coder, f.read(r["n_bytes"]))
                lengths = np.array([len(d) for d in docs], dtype=np.int64)
                raw = [d.astype("<u4").tobytes() for d in docs]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(r["start"] + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = blocks.select("file", "offset", "n_bytes", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("file"), F.col("offset"))
    return spread.mapInArrow(read, schema)
