"""Ranked search by sequential reads of impact-sorted lists (NRA), one index segment at a time.

Documents are indexed in segments of bounded size: a row for every term of a
segment with its documents and occurrences, and one row for the segment's
documents and their lengths. Lists of the searched terms are picked by a join,
get their weight from counts over all segments, and meet in one task a segment.
There each list is sorted by impact, and lists are read from the top in step. A
document seen so far has a lower bound (impacts read) and an upper bound (that
plus, for lists it was not met in, the last impact read there). Reading goes on
until the first k are known, no other document can reach or tie them, and their
scores are exact. Segments' winners are merged by an ordinary top-k.

A text without terms, empty or null, is never found, and an item without terms
finds nothing. Documents without id come last among equal scores; repeated rows
are documents of their own and take a rank each; so do repeated items. Empty
tables give an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WORD_BYTES, durable
from tidewrack.operators.ordering import top_per_key, with_scalars

#: Postings of a segment, first stretch of every list, items whose lists meet in one task.
SEGMENT, FIRST_READ, ITEM_BLOCK = 1_000_000, 16, 1_000
_INDEX = "segment long, term string, docs array<long>, counts array<long>"
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


class _Segment:
    """Postings of the documents read so far, until they fill a segment."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[int] = []
        self.counts: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = Counter(terms_of(text or b""))
        place = self.vocabulary
        self.terms += [place.setdefault(t, len(place)) for t in found]
        self.counts += found.values()
        self.sizes.append(len(found))
        self.ids.append(doc_id)
        self.lengths.append(found.total())

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The documents' row (no term), then a row a term with places of documents and occurrences."""
        yield _index_rows(segment, pa.array([None], pa.string()), [0, len(self.ids)], pa.array(self.ids, pa.int64()), pa.array(self.lengths, pa.int64()))
        terms = np.array(self.terms, dtype=np.int64)
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        counts = np.array(self.counts, dtype=np.int64)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(self.vocabulary)))])
        names = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        for a in range(0, len(names), 50_000):
            b = min(a + 50_000, len(names))
            yield _index_rows(segment, names[a:b], ends[a:b + 1] - ends[a], pa.array(docs[ends[a]:ends[b]]), pa.array(counts[ends[a]:ends[b]]))


def _index_rows(segment: int, names: pa.Array, offsets, docs: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    at = pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(at, values) for values in (docs, counts)]
    return pa.RecordBatch.from_arrays([pa.array([segment] * len(names), pa.int64()), names, *lists], names=["segment", "term", "docs", "counts"])


def build_index(docs: DataFrame, text: str = "text", size: int = SEGMENT) -> DataFrame:
    """Stored index of ``docs``: segments of near ``size`` postings, each cut from the rows of one partition."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part.add(doc_id, value)
                if len(part.terms) >= size:
                    yield from part.rows(number)
                    number, part = number + 1, _Segment()
        if part.ids:
            yield from part.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return durable(rows.mapInArrow(index, _INDEX))


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """Stored (item, item_id, term), each term of an item once; ``item`` numbers the rows of ``items``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t or b""))) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            names = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at)), batch.column("item_id").take(pa.array(at)), names], names=["item", "item_id", "term"])

    rows = durable(items.select("item_id", F.col(text).cast("binary").alias("text")))
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return durable(rows.mapInArrow(split, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, term string"))


class _Seen:
    """Bounds of the documents of a segment that an item's lists have shown so far."""

    def __init__(self, n_lists: int, slots: np.ndarray):
        self.slots = slots  # by place of a document; -1 where it was not met
        self.places = np.zeros(0, dtype=np.int64)
        self.lower = np.zeros(0, dtype=np.int64)
        self.unseen = np.ones((n_lists, 0), dtype=bool)

    def meet(self, places: np.ndarray) -> None:
        new = np.unique(places[self.slots[places] < 0])
        self.slots[new] = len(self.places) + np.arange(len(new))
        self.places = np.concatenate([self.places, new])
        self.lower = np.concatenate([self.lower, np.zeros(len(new), dtype=np.int64)])
        self.unseen = np.concatenate([self.unseen, np.ones((len(self.unseen), len(new)), dtype=bool)], axis=1)

    def read(self, t: int, places: np.ndarray, impacts: np.ndarray) -> None:
        at = self.slots[places]
        self.lower[at] += impacts
        self.unseen[t, at] = False


def first_by_bounds(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, slots: np.ndarray | None = None, first_read: int = FIRST_READ) -> tuple[list[tuple[int, int]], int]:
    """(place, score) of the ``k`` best of a segment's documents, and how many postings were read.

    ``lists``: places of documents and their impacts, highest first. ``ids``: by
    which equal scores are ordered. ``slots``: -1 for every document, and so again afterwards.
    """
    slots = np.full(len(ids), -1, dtype=np.int64) if slots is None else slots
    seen = _Seen(len(lists), slots)
    bound = np.array([v[0] if len(v) else 0 for _, v in lists], dtype=np.int64)
    read, step = np.zeros(len(lists), dtype=np.int64), first_read
    while True:
        upper = seen.lower + bound @ seen.unseen
        best = np.arange(len(upper))
        if len(best) > k:
            least = -np.partition(-seen.lower, k - 1)[k - 1]
            best = np.flatnonzero(seen.lower >= least)
        names = ids[seen.places]
        best = best[np.lexsort((names[best], -seen.lower[best]))][:k]
        floor, last = (seen.lower[best[-1]], names[best[-1]]) if len(best) == k else (0, _LAST)
        undecided = (upper > floor) | ((upper == floor) & (names < last))
        undecided[best] = upper[best] > seen.lower[best]
        # a document not met yet may still be anywhere below the sum of all bounds
        needed = bound > 0 if bound.sum() >= max(floor, 1) else seen.unseen[:, undecided].any(axis=1) & (bound > 0)
        if not needed.any():
            slots[seen.places] = -1
            return [(int(seen.places[b]), int(seen.lower[b])) for b in best if seen.lower[b] > 0], int(read.sum())
        at = np.flatnonzero(needed)
        ends = {t: min(read[t] + step, len(lists[t][0])) for t in at}
        seen.meet(np.concatenate([lists[t][0][read[t]:ends[t]] for t in at]))
        for t in at:
            places, impacts = lists[t]
            seen.read(t, places[read[t]:ends[t]], impacts[read[t]:ends[t]])
            read[t], bound[t] = ends[t], impacts[ends[t] - 1] if ends[t] < len(places) else 0
        step *= 2


def _search_segment(k: int):
    def search(table: pa.Table) -> pa.Table:
        terms = table.column("term").to_pylist()
        docs, counts = (table.column(c).combine_chunks() for c in ("docs", "counts"))
        at = terms.index(None)
        names, lengths = docs[at].values, counts[at].values.to_numpy()
        n_docs, n_terms = (table.column(c)[at].as_py() for c in ("n_docs", "n_terms"))
        ids = pc.fill_null(names, int(_LAST)).to_numpy()
        spread = 100 - 90 + (90 * lengths * n_docs) // max(n_terms, 1)
        weight, users = table.column("weight").to_pylist(), table.column("items").to_pylist()
        lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r, term in enumerate(terms):
            if term is not None:
                places, tf = docs[r].values.to_numpy(), counts[r].values.to_numpy()
                impact = weight[r] * ((1_000_000_000 * tf) // (1000 * tf + 8 * spread[places]))
                order = np.lexsort((places, -impact))
                for item in users[r]:
                    lists.setdefault(item, []).append((places[order], impact[order]))
        slots = np.full(len(ids), -1, dtype=np.int64)
        found = [(item, p, score) for item, own in lists.items() for p, score in first_by_bounds(own, ids, k, slots)[0]]
        item, place, score = (np.array(c, dtype=np.int64) for c in (zip(*found) if found else ((), (), ())))
        return pa.table({"item": item, "doc_id": names.take(pa.array(place)), "score": score})

    return search


def search(index: DataFrame, items: DataFrame, k: int = 10, block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its ``k`` best documents with a score above 0, equal scores by doc_id."""
    asked = item_terms(items)
    blocks = asked.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("item") / block)).cast("long").alias("blocks"))
    documents = index.where("term IS NULL")
    lengths = documents.select(F.explode("counts").alias("n"))
    totals = lengths.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"))

    picked = durable(index.join(asked.select("term").distinct(), "term").select("segment", "term", "docs", "counts"))
    weight = F.floor(1000 * F.log((2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = with_scalars(picked.groupBy("term").agg(F.sum(F.size("docs")).alias("df")), totals).select("term", weight.alias("weight"))
    users = with_scalars(asked, blocks).withColumn("block", F.pmod(F.xxhash64("item"), "blocks")).groupBy("term", "block").agg(F.collect_list("item").alias("items"))
    lists = picked.join(durable(users.join(weights.where("weight > 0"), "term")), "term").withColumns({"n_docs": F.lit(None).cast("long"), "n_terms": F.lit(None).cast("long")})
    heads = with_scalars(with_scalars(documents, blocks), totals).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.withColumns({"items": F.lit(None).cast("array<long>"), "weight": F.lit(None).cast("long")})
    columns = ["segment", "block", "term", "docs", "counts", "weight", "items", "n_docs", "n_terms"]
    parts = lists.select(*columns).unionByName(heads.select(*columns))

    found = parts.groupBy("segment", "block").applyInArrow(_search_segment(k), "item long, doc_id long, score long")
    best = top_per_key(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
