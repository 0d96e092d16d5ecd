"""Background models, anomaly scores and clustering on stored vectors.

Work over rows runs on executors. Only results whose size depends on the vector
length alone (means, d x d covariance) come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrays import squared_distance
from tidewrack.operators.ordering import _attach, exact_percentile, running_totals, with_scalars


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


@dataclass(frozen=True)
class BackgroundModel:
    """Mean and shrunk covariance of empty samples."""

    mean: np.ndarray
    covariance: np.ndarray
    precision: np.ndarray
    shrinkage: float
    rows: int


def fit_background_model(df: DataFrame, vec: str = "px") -> BackgroundModel:
    """Mean and Ledoit-Wolf shrunk covariance in one pass.

    Each partition adds up its own moments (shifted by one sample, so that the
    sums keep their precision); the partial sums are added by element. A partition's sums hold d x d numbers.
    """
    head = df.select(vec).filter(F.col(vec).isNotNull()).head()
    if head is None:
        raise ValueError("no samples")
    shift = np.asarray(head[0], dtype=np.float64)
    d = len(shift)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s1, sxx, sax, scalars = np.zeros(d), np.zeros((d, d)), np.zeros(d), np.zeros(3)
        for b in batches:
            if len(b):
                x = _matrix(b[vec]) - shift
                a = (x * x).sum(axis=1)
                s1 += x.sum(axis=0)
                sxx += x.T @ x
                sax += a @ x
                scalars += (len(x), a.sum(), (a * a).sum())
        if scalars[0]:
            yield pd.DataFrame({"i": np.arange(d + 3), "part": [*sxx, s1, sax, scalars]})

    sums = (
        df.select(vec).filter(F.col(vec).isNotNull()).mapInPandas(partial, "i int, part array<double>")
        .select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    ).toPandas()  # (d + 3) * d numbers
    m = np.zeros((d + 3, max(d, 3)))
    m[sums["i"], sums["j"]] = sums["v"]
    sxx, s1, sax = m[:d, :d], m[d, :d], m[d + 1, :d]
    n, s2, s4 = m[d + 2, :3]
    mu = s1 / n
    cov = sxx / n - np.outer(mu, mu)
    c = mu @ mu
    fourth = s4 + 4 * mu @ sxx @ mu + n * c * c - 4 * mu @ sax + 2 * c * s2 - 4 * c * (mu @ s1)
    scale = np.trace(cov) / d
    frob = (cov**2).sum()
    delta = (frob - 2 * scale * np.trace(cov) + d * scale**2) / d
    beta = min((fourth / n - frob) / (d * n), delta)
    shrink = 0.0 if beta == 0 or delta == 0 else beta / delta
    shrunk = (1 - shrink) * cov + shrink * scale * np.eye(d)
    return BackgroundModel(mu + shift, shrunk, np.linalg.inv(shrunk), float(shrink), int(n))


def score_tiles(df: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], vec: str = "px", out: str = "score") -> DataFrame:
    """Add a score from any function on a (rows, d) matrix, called on Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.asarray(scorer(_matrix(b)), dtype=np.float64)) if len(b) else pd.Series([], dtype="float64")

    return df.withColumn(out, run(F.col(vec)))


def mahalanobis(df: DataFrame, model: BackgroundModel, vec: str = "px", out: str = "distance") -> DataFrame:
    """Distance of each vector to the background model."""
    mean, precision = model.mean, model.precision

    def distance(x: np.ndarray) -> np.ndarray:
        diff = x - mean
        return np.sqrt(np.maximum(((diff @ precision) * diff).sum(axis=1), 0))

    return score_tiles(df, distance, vec, out)


def empirical_rank(df: DataFrame, value: str, calib: DataFrame, calib_value: str, out: str, parts: int | None = None) -> DataFrame:
    """Share of calibration values strictly below each value; null values get null.

    Both sides are counted per distinct value; the counts are cumulated once.
    """
    zero = F.lit(0).cast("long")
    wanted = df.select(F.col(value).cast("double").alias("_v")).distinct().select("_v", zero.alias("_c"))
    known = calib.filter(F.col(calib_value).isNotNull()).groupBy(F.col(calib_value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    table = wanted.filter(F.col("_v").isNotNull()).unionByName(known).groupBy("_v").agg(F.sum("_c").alias("_c"))
    size = known.agg(F.sum("_c").alias("_all"))
    ranks = with_scalars(running_totals(table, [], ["_v"], {"_t": "_c"}, parts), size)
    ranks = ranks.select("_v", ((F.col("_t") - F.col("_c")) / F.col("_all")).alias(out))
    return df.join(ranks, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def anomaly_score(df: DataFrame, calib: DataFrame, distance: str = "distance", recon: str = "recon", alpha: float = 0.5, out: str = "score") -> DataFrame:
    """Weighted mean of the ranks of distance and reconstruction error among held-out empties."""
    d = empirical_rank(df, distance, calib, distance, "_rd")
    d = empirical_rank(d, recon, calib, recon, "_rr")
    return d.withColumn(out, alpha * F.col("_rd") + (1 - alpha) * F.col("_rr")).drop("_rd", "_rr")


def one_class_score(df: DataFrame, centre: Column, vec: str = "px", out: str = "score") -> DataFrame:
    """Squared distance to a centre."""
    return df.withColumn(out, squared_distance(vec, centre))


def one_class_stats(df: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    s = F.col(score)
    out = df.groupBy(*keys).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))
    q99 = exact_percentile(df, keys, score, 0.99, "q99")
    return _attach(out, q99, list(keys)) if keys else with_scalars(out, q99)


def dimension_stats(train: DataFrame, vec: str = "px") -> DataFrame:
    """One row with the mean and population standard deviation of each dimension as arrays."""
    by_dim = train.select(F.posexplode(vec).alias("i", "v")).groupBy("i").agg(
        F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    packed = F.sort_array(F.collect_list(F.struct("i", "m", "s")))
    return by_dim.agg(F.transform(packed, lambda x: x["m"]).alias("mean"), F.transform(packed, lambda x: x["s"]).alias("std"))


def standardise(df: DataFrame, stats: DataFrame, vec: str = "px") -> DataFrame:
    """(x - mean) / std with the training statistics; a constant dimension is only centred."""
    j = with_scalars(df, stats)
    centred = F.zip_with(vec, "mean", lambda v, m: v - m)
    return j.withColumn(vec, F.zip_with(centred, "std", lambda v, s: v / F.when(s == 0, 1.0).otherwise(s))).drop("mean", "std")


def _vectors(df: DataFrame, vec: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, array_to_vector(F.col(vec)).alias("features"))


def kmeans_sweep(df: DataFrame, ks: Sequence[int], vec: str = "px", seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Silhouette (squared Euclidean) and inertia per k; ``best`` marks the first k with the highest silhouette."""
    rows = _vectors(df, vec, []).persist()
    try:
        judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
        found = []
        for k in ks:
            model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(rows)
            found.append((int(k), float(judge.evaluate(model.transform(rows))), float(model.summary.trainingCost)))
    finally:
        rows.unpersist()
    top = max(s for _, s, _ in found)
    first = next(k for k, s, _ in found if s == top)
    return df.sparkSession.createDataFrame([(*f, f[0] == first) for f in found], "k int, silhouette double, inertia double, best boolean")


def kmeans_assign(df: DataFrame, k: int, keep: Sequence[str], vec: str = "px", seed: int = 42) -> DataFrame:
    rows = _vectors(df, vec, keep)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows).select(*keep, "cluster")


def pca_2d(df: DataFrame, keep: Sequence[str], vec: str = "px") -> DataFrame:
    """First two principal components of centred vectors."""
    rows = _vectors(standardise(df.select(*keep, F.transform(vec, lambda v: v.cast("double")).alias(vec)),
                                dimension_stats(df, vec).withColumn("std", F.transform("std", lambda s: F.lit(1.0))), vec), vec, keep)
    out = PCA(k=2, inputCol="features", outputCol="_p").fit(rows).transform(rows)
    xy = vector_to_array("_p")
    return out.select(*keep, xy[0].alias("pc1"), xy[1].alias("pc2"))
