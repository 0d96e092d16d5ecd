"""Repeated passages against counting every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidewrack.llm import repeats


def plain(docs, length):
    """(doc_id, n_bytes, n_removed, n_spans, digest of what stays) of each (doc_id, text)."""
    texts = [(t if isinstance(t, bytes) else (t or "").encode()) for _, t in docs]
    seen = Counter(t[a:a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, dtype=int)
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] > 1:
                gone[a] += 1
                gone[a + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), n_spans, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length,gram,most", [(400, 64, 2_000), (400, 64, 1), (60, 20, 2), (24, 8, 1)])
def test_given_documents(spark, length, gram, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(repeats.remove_repeats(docs.repartition(5), length, gram, most)) == plain(rows, length)


def test_odd_rows(spark, odd_docs, odd_texts):
    extra = [(20, "ab" * 300), (21, "x" * 500 + "y" + "x" * 399), (22, "\0" * 50 + "z"), (23, "z" + "\0" * 60)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for length in (30, 400):
        assert got(repeats.remove_repeats(docs.withColumns({c: docs.doc_id for c in ("row", "found", "kept", "anchor")}), length)) == plain(odd_texts + extra, length)


def test_empty_table(spark, odd_docs):
    assert got(repeats.remove_repeats(odd_docs.where("false"))) == []


def test_crowded_anchors_are_cut_again(spark):
    """One passage in many contexts, and copies that differ at one place."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefgh ", dtype=np.uint8), n)).decode()
    passage = word(90)
    docs = [(i, word(int(rng.integers(0, 50))) + passage + word(int(rng.integers(0, 50)))) for i in range(60)]
    docs += [(100 + i, passage[:i] + "#" + passage[i:]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (2_000, 3, 1):
        assert got(repeats.remove_repeats(df, 64, 10, most)) == plain(docs, 64)


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 100)
    rng = np.random.default_rng(4)
    data = bytes(rng.integers(97, 100, 700, dtype=np.uint8))
    texts = [data, data[50:400], data[300:] + data[:200]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(repeats.remove_repeats(df, 40, 8)) == plain(list(enumerate(texts)), 40)
    parts = [(i, a, t[a:a + 100 + 39]) for i, t in enumerate(texts) for a in range(0, len(t) - 39, 100)]
    rows = repeats._places(_batch(texts), parts, 40, 8).to_pylist()
    assert sum(len(r["starts"]) * (r["size"] - 39) for r in rows) == sum(len(t) - 39 for t in texts)


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(len(texts))], pa.binary()), pa.array([1] * len(texts), pa.int64())], names=["row", "copies"])


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for trial in range(120):
        letters = (b"\0a", b"ab", b"abc", b"\xff\0x")[trial % 4]
        texts = [bytes(rng.choice(list(letters), size=rng.integers(1, 25)).astype(np.uint8)) * (1 + trial % 3) for _ in range(rng.integers(1, 6))]
        index, want = repeats.RunIndex(texts), []
        places = [t[a:] for t in texts for a in range(len(t))]
        for x, s in enumerate(places):
            want.append(max([next((k for k, (c, d) in enumerate(zip(s, u)) if c != d), min(len(s), len(u))) for y, u in enumerate(places) if y != x], default=0))
        assert index.matching_statistics().tolist() == want


def test_runs_stay_few_in_copies():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(0, 256, 2_000, dtype=np.uint8))
    assert repeats.RunIndex([text] * 50).n_runs < 1.1 * repeats.RunIndex([text]).n_runs + 100
