"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is its set of distinct five-word shingles. Its key signature has 64
components of 16 bits; two documents of similarity s differ in a component with
probability near 1 - s. The signature is split into chunks. If two signatures
differ in no more than 2 * chunks - 1 components, then by pigeonhole some chunk
has one error at most, and both write the same key when the wrong component is
masked: each chunk is written once for every component left out. So every pair
within the distance shares a key. The number of chunks is chosen so that a pair
of the least similarity is farther apart with probability ``MISS`` at most. Of pairs that
share a key, those within the likewise chosen distance of 256 components go on.

Equal sets are one node from the start. How the nodes of a key are compared without
all pairs is in ``links.link_nodes``; each link is confirmed on the full shingle sets
(intersection and union counted).

Rows: null or wordless text has no shingles and no links; a text with fewer words
than a shingle is one shingle. Repeated rows are one node and each get a row. A row
without doc_id is never linked: its component is null and it is kept. Of rows with
equal doc_id and different texts each has its own links. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import durable
from tidewrack.llm.links import SLOT_BITS, link_nodes, relabelled

WORDS, COMPONENTS, SKETCH, MISS = 5, 64, 256, 1e-5
#: Words whose hashes a task keeps, and more components than a chunk has.
KEPT_WORDS, LONGEST = 100_000, 32
_MULTIPLY = np.random.default_rng(20240501).integers(1 << 62, 1 << 63, SKETCH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_HASH: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_WORD_HASH) > KEPT_WORDS:
        _WORD_HASH.clear()
    codes = list(map(_WORD_HASH.get, words))
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = xxhash.xxh3_64_intdigest(words[i])
                if len(words[i]) <= 64:
                    _WORD_HASH[words[i]] = codes[i]
    w = np.array(codes, dtype=np.uint64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h + w[k:len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def signature(found: np.ndarray, count: int = SKETCH) -> np.ndarray:
    """b-bit MinHash: 16 bits of the least value under each of ``count`` hash functions."""
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 1024):  # small enough for the processor's cache
        np.minimum(least, (found[None, a:a + 1024] * _MULTIPLY[:count, None]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def chunk_count(similarity: float, count: int = COMPONENTS, miss: float = MISS) -> int:
    """Fewest chunks whose distance 2 * chunks - 1 a pair of that similarity exceeds with probability ``miss`` at most."""
    p = 1 - similarity
    for chunks in range(1, count // 2 + 1):
        if sum(comb(count, k) * p**k * (1 - p) ** (count - k) for k in range(2 * chunks, count + 1)) <= miss:
            return chunks
    return count // 2


def tail_distance(similarity: float, count: int = SKETCH, miss: float = MISS) -> int:
    """Distance of ``count`` components that a pair of that similarity exceeds with probability ``miss`` at most."""
    p, left = 1 - similarity, 1.0
    for k in range(count + 1):
        left -= comb(count, k) * p**k * (1 - p) ** (count - k)
        if left <= miss:
            return k
    return count


def first_slot(equal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first key two signatures share: chunk and component left out (the first one where the chunks are equal)."""
    out = np.full(len(equal), -1, dtype=np.int64)
    for c in range(len(bounds) - 2, -1, -1):
        part = equal[:, bounds[c]:bounds[c + 1]]
        shares = part.sum(axis=1) >= part.shape[1] - 1
        wrong = np.where(part.all(axis=1), 0, np.argmin(part, axis=1))
        out[shares] = c * LONGEST + wrong[shares]
    return out


def chunk_bounds(chunks: int) -> np.ndarray:
    return np.linspace(0, COMPONENTS, chunks + 1).round().astype(int)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128-bit hash of the set), sig and sketch (binary; null for an empty set) and th (hash of the text) of every row.

    ``sig`` holds the 64 components that keys are made of, ``sketch`` 8 bits of each of 256, on which distances are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sig, sketch = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(_mix(s ^ _MULTIPLY[-1]).sum(dtype=np.uint64).astype(np.int64)))
                full = signature(s) if len(s) else None
                sig.append(None if full is None else full[:COMPONENTS].tobytes())
                sketch.append(None if full is None else full.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "h1", "h2", "sig", "sketch", "th"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, sketch binary, th long")


def chunk_keys(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, node): for each chunk, one key for each component left out."""
    bounds = chunk_bounds(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(len(node), COMPONENTS).astype(np.uint64)
            for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                part = _mix(sig[:, a:b] + (np.arange(a, b, dtype=np.uint64) << np.uint64(20)) + np.uint64(1 << 40))
                total = part.sum(axis=1, dtype=np.uint64)
                for k in range(b - a):
                    slot = np.uint64(c * LONGEST + k)
                    key = _mix(total - part[:, k] + slot) << np.uint64(SLOT_BITS) | slot
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def similar(x: memoryview, y: memoryview, similarity: int) -> bool:
    """Whether two stored sets have 100 * intersection >= similarity * union."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(u) > len(v):
        u, v = v, u
    if 100 * len(u) < similarity * len(v):
        return False
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    both = int((v[at] == u).sum())
    return 100 * both >= similarity * (len(u) + len(v) - both)


def node_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, content) of the wanted nodes (node, doc_id, h1, h2), read from one of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = [shingles(t) for t in part.column(3).to_pylist()]
                same = [int(s.sum(dtype=np.uint64).astype(np.int64)) == h1 and int(_mix(s ^ _MULTIPLY[-1]).sum(dtype=np.uint64).astype(np.int64)) == h2 for s, h1, h2 in zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "content"]).filter(pa.array(same, pa.bool_()))

    # stored first, so that its size is known and texts are not shuffled for a few nodes
    wanted = durable(wanted.select("node", "doc_id", "h1", "h2"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = texts.join(wanted, "doc_id").select("node", "h1", "h2", "text").mapInArrow(run, "node long, content binary")
    return found.dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, similarity: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its group) and kept, one row per row of ``docs``.

    ``similarity`` in hundredths: documents are linked from 100 * intersection >= similarity * union on.
    """
    return _grouped(docs, similarity, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, similarity: int, doc_id: str, text: str) -> DataFrame:
    """Rows of ``near_duplicates`` with h1, h2 and th. Of several sets under the smallest doc_id of a group one is kept."""
    rows = durable(signatures(docs, doc_id, text))
    linkable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = durable(linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    chunks = chunk_count(similarity / 100)
    groups = link_nodes(
        nodes, chunk_keys(nodes, chunks), near=("sketch", "uint8", tail_distance(similarity / 100)), owner=("uint16", partial(first_slot, bounds=chunk_bounds(chunks))),
        contents=lambda wanted: node_sets(docs, nodes.drop("sig", "sketch").join(wanted, "node"), doc_id, text), confirm=partial(similar, similarity=similarity),
    )
    named = durable(relabelled(nodes.select("node", "h1", "h2", "doc_id"), groups, "node"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("head"))
    by_set = named.join(least, "root").select("h1", "h2", F.col("head.doc_id").alias("component_id"), ((F.col("h1") == F.col("head.h1")) & (F.col("h2") == F.col("head.h2"))).alias("first"))
    names = ["doc_id", "n_shingles", "component_id", "h1", "h2", "th"]
    alone = rows.where("doc_id IS NULL OR n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*names, F.lit(True).alias("kept"))
    linked = linkable.join(by_set, ["h1", "h2"]).select(*names, ((F.col("doc_id") == F.col("component_id")) & F.col("first")).alias("kept"))
    return linked.unionAll(alone)


def dedup(docs: DataFrame, similarity: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept; of the rows of a kept document with equal sets one stays.

    Only the ids and text hashes that go and the ids met several times travel to the texts.
    """
    found = durable(_grouped(docs, similarity, doc_id, text))
    stays = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0")
    others = stays.groupBy("doc_id", "h1", "h2").agg(F.min("th").alias("least"), F.collect_set("th").alias("all")).where("size(all) > 1").select("doc_id", F.explode(F.array_remove("all", F.col("least"))).alias("th"))
    gone = durable(found.where("NOT kept").select("doc_id", "th").unionAll(others).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    kept = docs.join(gone, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left_anti")
    if found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    hashed = kept.withColumn("_h", F.xxhash64(text))
    return hashed.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, "_h"]).unionAll(hashed.where(F.col(doc_id).isNull())).drop("_h")
