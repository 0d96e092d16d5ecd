"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewrack.llm import search

TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [t.lower() for t in TERM.findall((text or "").encode())]


def plain(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            score = 0
            for t in set(plain_terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (100 - 90 + (90 * c.total() * N) // L)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size,block,k", [(search.SEGMENT, search.ITEM_BLOCK, 10), (500, 7, 3)])
def test_given_documents(spark, size, block, k):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert got(search.search(search.build_index(docs.repartition(3), size=size), items, k, block)) == want


def test_odd_rows(spark, odd_docs, odd_texts):
    asked = [(1, "A TEXT, the same; word"), (1, "word"), (2, None), (3, ""), (4, "nothing of this"), (None, "漢字 é enough"), (5, "user s x")]
    items = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in asked], "item_id int, text string, doc_id string, rank int, score int")
    assert got(search.search(search.build_index(odd_docs, size=5), items, 3)) == plain(odd_texts, asked, 3)


def test_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert got(search.search(search.build_index(odd_docs.where("false")), items)) == []
    assert got(search.search(search.build_index(odd_docs), items.where("false"))) == []


def test_bounds_find_what_full_sums_find():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        ids, total, lists = rng.permutation(n).astype(np.int64), np.zeros(n, dtype=np.int64), []
        for _ in range(int(rng.integers(1, 7))):
            places = rng.permutation(n)[:rng.integers(0, n + 1)]
            impacts = np.sort(rng.integers(0, 5 if trial % 2 else 1000, len(places)))[::-1]
            total[places] += impacts
            lists.append((places, impacts))
        found, _ = search.first_by_bounds(lists, ids, k, first_read=2)
        want = sorted((-int(total[p]), int(ids[p]), p) for p in range(n) if total[p] > 0)[:k]
        assert found == [(p, -s) for s, _, p in want]


def test_reading_ends_early():
    n = 10_000
    impacts = np.concatenate([np.arange(2000, 1000, -10), np.full(n - 100, 1)])
    found, read = search.first_by_bounds([(np.arange(n), impacts), (np.arange(n), impacts)], np.arange(n), 10)
    assert found == [(p, 2 * int(impacts[p])) for p in range(10)] and read < 100
