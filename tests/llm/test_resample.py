"""Resampling against a plain count over split words."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from tidewrack.llm import resample

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest):
    words = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return words, [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, longest, buckets, least, seed=2024):
    s, t = Counter(), Counter()
    for texts, counts in ((docs, s), ([(0, x) for x in target], t)):
        for _, text in texts:
            counts.update(zlib.crc32(f) % buckets for f in plain_features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, features = plain_features(text, longest)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features) // len(features) if features else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(able[:len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 97, 50)])
def test_given_documents(spark, longest, buckets, percent):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, longest, buckets, 20)
    assert got(resample.resample(docs, target, percent, longest, buckets)) == want


def test_odd_rows(spark, odd_docs, odd_texts):
    target = spark.createDataFrame([("Word and line",), (None,), ("",)], "text string")
    assert got(resample.resample(odd_docs, target, 50, 2, 50, 3)) == plain(odd_texts, ["Word and line"], 50, 2, 50, 3)


def test_empty_tables(spark, odd_docs, odd_texts):
    none = odd_docs.where("false")
    assert got(resample.resample(none, odd_docs)) == []
    assert got(resample.resample(odd_docs, none, 100)) == plain(odd_texts, [], 100, 1, 10_000, 20)


def test_spans_are_runs_of_words():
    text = b"Ab,cd--EF\n12 \xc3\xa9t\xc3\xa9."
    line = resample.collapsed(text)
    for n in (1, 2, 3):
        words = line.split()
        assert [line[a:b] for a, b in resample.spans(line, resample.runs(n))] == [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
