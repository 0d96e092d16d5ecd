"""Importance resampling towards a target corpus: hashed n-gram counts, log-ratio weights, Gumbel draws.

Texts are scanned by one regular expression per n-gram length: separators are
collapsed to single blanks, boundary lookarounds tie a match to whole words, and
overlapped matching yields the run of words that starts at each word; its bytes
go straight to CRC-32, whose remainder is the bucket. Buckets are counted over
all documents and all target texts; a document's weight is the floored mean of
its features' gains, and the draw takes the highest weights plus Gumbel noise
derived from the document's id, so it repeats on every run.

A null, empty or wordless text has no features, weight 0 and is not drawn. Rows
without doc_id take noise from the empty id and come last among equal scores;
repeated rows count and compete each. Empty tables give empty tables; without
target texts all gains come from smoothing. Other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WORD_BYTES, durable, slices
from tidewrack.operators.ordering import rank_rows, with_scalars

#: Bytes of text whose buckets are held at once.
SLICE_BYTES = 16_000_000
_BLANKS = re.compile(rb" {2,}")
_GROUP = methodcaller("group")


def collapsed(text: bytes) -> bytes:
    """Words of a text, in lower case, one blank between them."""
    return _BLANKS.sub(b" ", text.translate(WORD_BYTES))


def runs(words: int) -> regex.Pattern:
    """Matches every run of so many words when it is searched with overlaps."""
    more = rb"(?: [^ ]+){%d}" % (words - 1) if words > 1 else b""
    return regex.compile(rb"(?<![^ ])[^ ]+" + more + rb"(?![^ ])")


def spans(text: bytes, pattern: regex.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of the pattern's runs in a collapsed text."""
    return (m.span() for m in pattern.finditer(text, overlapped=True))


def hashed_features(texts: DataFrame, keep: list[str], longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """Columns ``keep``, n_words, n_features and the bucket of every feature (runs of 1 to ``longest`` words)."""
    rows = texts.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"), "n_words long, n_features long, buckets array<int>"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [runs(n + 1) for n in range(longest)]
        for batch in batches:
            column = batch.column("_text")
            sizes = [s.as_py() or 0 for s in pc.binary_length(column)]
            for a, b in slices(sizes, SLICE_BYTES):
                words, found, counts = [], [], []
                for value in column.slice(a, b - a).to_pylist():
                    line = collapsed(value or b"")
                    hashes = [np.fromiter(map(zlib.crc32, map(_GROUP, p.finditer(line, overlapped=True))), dtype=np.uint32) for p in patterns]
                    words.append(len(hashes[0]))
                    found += hashes
                    counts.append(sum(map(len, hashes)))
                flat = (np.concatenate(found) % np.uint32(buckets)).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), lists], names=[*keep, "n_words", "n_features", "buckets"])

    return rows.mapInArrow(scan, schema)


def _bucket_counts(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln) of the smoothed share in the target over that in the source."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_bucket_counts(source, "s"), "bucket", "left").join(_bucket_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return with_scalars(both, totals).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` with ``weight``, the floored mean gain, in place of the buckets. ``gain`` has one entry a bucket."""
    keep = [c for c in features.columns if c != "buckets"]
    schema = ", ".join([*(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep), "weight long"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            stops = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
            n = np.diff(stops)
            weight = np.where(n > 0, (ends[stops[1:]] - ends[stops[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(weight, pa.int64())], names=[*keep, "weight"])

    return features.mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the highest ``percent`` of documents with ``least_words`` have a rank.

    The gains on the driver are one number a bucket, whatever the tables hold.
    """
    features = durable(hashed_features(docs, ["doc_id"], longest, buckets))
    aims = durable(hashed_features(target, [], longest, buckets))
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(features, aims, buckets).collect():
        gain[row.bucket] = row.gain
    able = F.col("n_words") >= least_words
    scored = durable(weights(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("able", able))
    drawn = scored.agg(F.floor(F.count_if("able") * percent / 100).alias("drawn"))
    ranked = rank_rows(scored, [], [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"], "place")
    rank = F.when(F.col("able") & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long")
    return with_scalars(ranked, drawn).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
