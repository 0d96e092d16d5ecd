"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every document becomes a vector of transformed statistics (mean word length,
symbols, capitals, repeated lines, repeated word windows). Per (lang, source) the
minimum-covariance-determinant estimate is found over all documents that pass the
limits: from two starts (mean and covariance of all; medians and quartile
ranges), concentration steps keep the ``SHARE`` of documents nearest to the
centre and estimate anew, until the determinant no longer falls; the smaller
determinant wins and is reweighted once. A document is rejected if its squared
Mahalanobis distance exceeds the chi-square quantile ``REJECT``.

One step is one aggregation: moments per (group, distance class) are combined
before they meet, so a group that holds a third of all rows costs no more than
others; a group's classes (some hundreds at most) go to one small task.
Statistics are on an integer grid and summed as integers, so the result does not
depend on the order of rows. Equal or constant statistics would make a singular
covariance; a fixed variance per statistic (``FLOORS``) is added.

A (lang, source) with fewer than ``LEAST_ROWS`` such documents is pooled with the
other small sources of its language, a small pool with those of other languages;
where even that has fewer, nothing is rejected beyond the limits. Null texts have
no words and fail the limits; null lang or source is a value of its own. Repeated
rows count each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.common import durable

SHARE, REJECT, LEAST_ROWS, MAX_STEPS, WINDOW = 0.75, 1 - 1e-9, 50, 25, 5
GRID = 1024
#: Statistics and the standard deviation added to each.
FLOORS = {"v_length": 0.05, "v_symbols": 0.03, "v_capitals": 0.05, "v_lines": 0.1, "v_windows": 0.03}
VECTOR = list(FLOORS)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict = {}
    code = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.uint64)
    if len(index) == len(words):
        return 0
    code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(31)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h += code[k:k + n] * _ODD[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_statistics(text: str) -> tuple:
    """The five base counts, lines with a word, and capitals."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), dups, repeat_words(words), lines, sum(map(str.isupper, text))


def statistics(text: Column) -> Column:
    """Struct of the base counts, n_lines and n_capitals of a text column."""
    names = [*BASE, "n_lines", "n_capitals"]

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [text_statistics(t) for t in batch.to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return count(F.coalesce(text, F.lit("")))


def with_statistics(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``docs`` with ``_s`` (counts, vector, base_failed) and ``_g`` (language and source)."""
    s = lambda n: F.col(f"_s.{n}")
    chars = F.greatest(s("word_chars"), F.lit(1))
    values = {
        "v_length": F.log(chars / F.greatest(s("n_words"), F.lit(1))),
        "v_symbols": F.sqrt(s("n_symbols") / chars),
        "v_capitals": F.sqrt(s("n_capitals") / chars),
        "v_lines": s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)),
        "v_windows": s("n_repeat_words") / F.greatest(s("n_words"), F.lit(1)),
    }
    failed = (s("n_words") < 10) | (100 * s("n_repeat_words") > 20 * s("n_words"))
    counted = docs.withColumn("_s", statistics(F.col(text)))
    full = F.struct(*[s(n).alias(n) for n in BASE], *[F.round(v * GRID).cast("long").alias(n) for n, v in values.items()], failed.alias("base_failed"))
    return counted.withColumn("_g", F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))).withColumn("_s", full)


# Chi-square distribution

def chi2_cdf(x: float, df: int) -> float:
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * exp(a * log(x) - x - lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def consistency(share: float, df: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, df), df + 2)


# Estimates

def distance(mean: str = "mean", inverse: str = "inverse", prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the vector columns."""
    d = [F.col(prefix + n) / GRID - F.col(mean)[k] for k, n in enumerate(VECTOR)]
    p = len(VECTOR)
    terms = [F.col(inverse)[i * p + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return F.greatest(reduce(lambda x, y: x + y, terms), F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, sums and sums of products per key."""
    pairs = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
    sums = [F.sum(n).alias(f"s{k}") for k, n in enumerate(VECTOR)] + [F.sum((F.col(VECTOR[i]) * F.col(VECTOR[j])).cast("decimal(38,0)")).alias(f"q{i}_{j}") for i, j in pairs]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _estimate(part: pd.DataFrame, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse covariance and log determinant from rows of moments."""
    p = len(VECTOR)
    n = int(part["n"].sum())
    s = [int(part[f"s{k}"].sum()) for k in range(p)]
    cov = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            q = sum(int(x) for x in part[f"q{i}_{j}"])
            cov[i, j] = cov[j, i] = (n * q - s[i] * s[j]) / (n * n) / GRID**2
    cov = cov * factor + np.diag(np.square(list(FLOORS.values())))
    return np.array(s) / n / GRID, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


_EST = "grp long, start int, mean array<double>, inverse array<double>, logdet double, settled boolean"


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, mean, inverse) from rows of ``grp`` and the vector."""
    p = len(VECTOR)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, inverse, logdet = _estimate(pdf, 1.0)
        return pd.DataFrame([(pdf["grp"].iloc[0], 0, mean.tolist(), inverse.ravel().tolist(), np.inf, False)], columns=["grp", "start", "mean", "inverse", "logdet", "settled"])

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Medians and quartile ranges from counts of values."""
        mean, scale = [], []
        for k, n in enumerate(VECTOR):
            part = pdf[pdf["k"] == k].sort_values("v")
            at = part["n"].cumsum().to_numpy()
            low, mid, high = (part["v"].to_numpy()[np.searchsorted(at, q * at[-1])] / GRID for q in (0.25, 0.5, 0.75))
            mean.append(float(mid))
            scale.append(((high - low) / 1.349) ** 2 + FLOORS[n] ** 2)
        return pd.DataFrame([(pdf["grp"].iloc[0], 1, mean, np.diag(1 / np.array(scale)).ravel().tolist(), np.inf, False)], columns=["grp", "start", "mean", "inverse", "logdet", "settled"])

    values = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("v")) for k, n in enumerate(VECTOR)])).alias("x")).groupBy("grp", "x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    starts = [_moments(rows, ["grp"]).groupBy("grp").applyInPandas(first, _EST), values.groupBy("grp").applyInPandas(middle, _EST)]
    current = durable(starts[0].unionAll(starts[1]))
    cls = F.floor(F.log(distance() + 1e-3) * 16).cast("int").alias("class")
    factor = consistency(SHARE, p)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        """Moments of the nearest classes that hold the share; a step that does not lower the determinant ends."""
        old = pdf.iloc[0]
        pdf = pdf.sort_values("class")
        total = pdf["n"].cumsum()
        mean, inverse, logdet = _estimate(pdf[(total - pdf["n"]) < SHARE * total.iloc[-1]], factor)
        better = logdet < old["logdet"] - 1e-9
        row = (mean.tolist(), inverse.ravel().tolist(), logdet) if better else (list(old["mean"]), list(old["inverse"]), old["logdet"])
        return pd.DataFrame([(old["grp"], old["start"], *row, not better)], columns=["grp", "start", "mean", "inverse", "logdet", "settled"])

    for _ in range(MAX_STEPS):
        moving = current.where("NOT settled")
        classed = rows.join(moving, "grp").select("grp", "start", *VECTOR, cls)
        moments = _moments(classed, ["grp", "start", "class"]).join(moving.select("grp", "start", "mean", "inverse", "logdet"), ["grp", "start"])
        current = durable(current.where("settled").unionAll(moments.groupBy("grp", "start").applyInPandas(step, _EST)))
        if current.where("NOT settled").isEmpty():
            break
    best = current.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    # Reweighting: once over all rows within the 0.975 quantile.
    near = rows.join(best, "grp").where(distance() <= chi2_quantile(0.975, p)).select("grp", *VECTOR)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, inverse, _ = _estimate(pdf, consistency(0.975, p))
        return pd.DataFrame([(pdf["grp"].iloc[0], mean.tolist(), inverse.ravel().tolist())], columns=["grp", "mean", "inverse"])

    return durable(_moments(near, ["grp"]).groupBy("grp").applyInPandas(final, "grp long, mean array<double>, inverse array<double>"))


def models(stats: DataFrame) -> DataFrame:
    """(lang, source, mean, inverse): the estimate each language and source is held against; null where there is none.

    ``stats`` holds ``_g`` and ``_s``; it is read several times.
    """
    good = stats.where("NOT _s.base_failed").select("_g.lang", "_g.source", "_s.*")
    sizes = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    # Small sources pool by language, small pools together.
    pool = sizes.where(f"n < {LEAST_ROWS}").groupBy("lang").agg(F.sum("n").alias("pooled"))
    named = sizes.join(pool.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    level = F.when(F.col("n") >= LEAST_ROWS, F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")))
    level = level.when(F.col("pooled") >= LEAST_ROWS, F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")))
    level = level.otherwise(F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    placed = named.withColumn("level", level)
    groups = placed.groupBy("level").agg(F.sum("n").alias("rows")).withColumn("grp", F.monotonically_increasing_id())
    placed = durable(placed.join(groups.withColumnRenamed("level", "_level"), F.col("level").eqNullSafe(F.col("_level"))).select(F.col("lang").alias("l"), F.col("source").alias("s"), "grp", "rows"))
    usable = F.broadcast(placed.where(f"rows >= {LEAST_ROWS}")) if placed.count() <= BROADCAST_GROUPS else placed.where(f"rows >= {LEAST_ROWS}")
    rows = durable(good.join(usable, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).select("grp", *VECTOR))
    return durable(placed.join(estimates(rows), "grp", "left").select(F.col("l").alias("_lang"), F.col("s").alias("_source"), "mean", "inverse"))


#: Tables of groups up to this many rows (some hundred bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """``stats`` with ``distance2`` (null without an estimate) and ``kept``."""
    side = F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found
    both = stats.join(side, F.col("_g.lang").eqNullSafe(F.col("_lang")) & F.col("_g.source").eqNullSafe(F.col("_source")), "left")
    both = both.withColumn("distance2", distance(prefix="_s."))
    good = F.coalesce(F.col("distance2") <= chi2_quantile(REJECT, len(VECTOR)), F.lit(True))
    return both.withColumn("kept", ~F.col("_s.base_failed") & good).drop("_lang", "_source", "mean", "inverse")


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, distance2 and kept of every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = durable(with_statistics(slim, "text", "lang", "source").select("doc_id", "_g", "_s"))
    return judged(stats, models(stats)).select("doc_id", *[f"_s.{n}" for n in BASE], "_s.base_failed", "distance2", "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = durable(with_statistics(packed.drop("_row"), "text", "lang", "source").select("_g", "_s"))
    return judged(with_statistics(packed, "text", "lang", "source"), models(stats)).where("kept").select("_row.*")
