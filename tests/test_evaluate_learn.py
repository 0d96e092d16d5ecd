"""Curves, thresholds, reports, backgrounds and models against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.functions import columns as C
from tidewrack.operators import evaluate as E
from tidewrack.operators import learn as L
from tidewrack.operators import pixels as X
from tidewrack.operators import sampling as P
from tidewrack.operators.joins import attach_metadata, pair_items

RNG = np.random.default_rng(1)
Y = RNG.integers(0, 2, 400)
S_ = np.round(RNG.random(400) * 0.6 + Y * 0.3, 2)


def scores(spark):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(Y, S_)], "label int, score double").repartition(4)


def curve_numpy():
    thr = np.unique(S_)[::-1]
    tp = np.array([((S_ >= t) & (Y == 1)).sum() for t in thr])
    fp = np.array([((S_ >= t) & (Y == 0)).sum() for t in thr])
    return thr, tp, fp


def test_curve_metrics_over_many_partitions(spark):
    thr, tp, fp = curve_numpy()
    p, n = Y.sum(), (1 - Y).sum()
    got = {r.threshold: (r.tpr, r.fpr) for r in E.roc_curve(scores(spark), "score", "label", parts=5).collect()}
    assert len(got) == len(thr) + 1 and got[float("inf")] == (0.0, 0.0)
    assert all(got[t] == (a / p, b / n) for t, a, b in zip(thr, tp, fp))
    both = E.curve_scores(scores(spark), "score", "label", parts=5).first()
    tpr, fpr = np.r_[0, tp / p], np.r_[0, fp / n]
    assert abs(both.auc - ((fpr[1:] - fpr[:-1]) * (tpr[1:] + tpr[:-1]) / 2).sum()) < 1e-12
    assert abs(both.ap - (np.diff(np.r_[0, tp / p]) * tp / (tp + fp)).sum()) < 1e-12
    for r in E.best_thresholds(scores(spark), "score", "label").collect():
        pr, rc, b = tp / (tp + fp), tp / p, r.beta**2
        f = (1 + b) * pr * rc / (b * pr + rc + 1e-8)
        assert r.threshold == thr[::-1][np.argmax(f[::-1])]


def test_one_class_only_gives_no_curve(spark):
    only = scores(spark).filter("label = 1")
    assert E.roc_curve(only, "score", "label").isEmpty() and E.curve_scores(only, "score", "label").filter("auc IS NOT NULL").isEmpty()


def test_youden_prefers_the_highest_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "label int, score double")
    assert E.youden_threshold(df, "score", "label").first().threshold == 0.9


def test_confidence_must_be_above_not_equal(spark):
    df = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.95)], "t string, p string, c double")
    out = {(r.true, r.pred): (r.n, r.pct) for r in E.confusion(df, "t", "p", spark.createDataFrame([("a",), ("b",)], "class string"), "c", 0.9).collect()}
    assert out == {("a", "a"): (0, 0.0), ("a", "b"): (1, 100.0), ("b", "a"): (0, 0.0), ("b", "b"): (0, 0.0)}


def test_report_counts_classes_without_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "t string, p string")
    r = E.classification_report(df, "t", "p").first()
    assert abs(r.precision - (0.5 + 0 + 1) / 3) < 1e-12 and abs(r.recall - 2 / 3) < 1e-12 and abs(r.accuracy - 2 / 3) < 1e-12
    g = E.grouped_report(df, "t", "p", {"g": ["a"], "h": ["c"]}).first()
    assert (g.accuracy, g.dropped) == (1.0, 1)


def ledoit_wolf(x):
    n, d = x.shape
    x = x - x.mean(0)
    emp = x.T @ x / n
    mu = np.trace(emp) / d
    delta_ = (emp**2).sum()
    beta = ((x**2).sum(1) ** 2).sum() / n - delta_
    beta /= d * n
    delta = (delta_ - 2 * mu * np.trace(emp) + d * mu**2) / d
    s = min(beta, delta) / delta
    return (1 - s) * emp + s * mu * np.eye(d), s


def test_background_model_and_distance(spark):
    x = RNG.normal(size=(300, 5)) @ RNG.normal(size=(5, 5)) + 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, px array<double>").repartition(6)
    m = L.fit_background_model(df)
    cov, s = ledoit_wolf(x)
    assert np.allclose(m.covariance, cov) and abs(m.shrinkage - s) < 1e-9 and np.allclose(m.mean, x.mean(0)) and m.rows == 300
    got = {r.id: r.distance for r in L.mahalanobis(df, m).collect()}
    diff = x - x.mean(0)
    assert np.allclose([got[i] for i in range(300)], np.sqrt(((diff @ np.linalg.inv(cov)) * diff).sum(1)))


def test_rank_is_strictly_below(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0), (4, 0.0), (5, None)], "id long, v double")
    calib = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "c double")
    got = {r.id: r.r for r in L.empirical_rank(df, "v", calib, "c", "r", parts=3).collect()}
    assert got == {1: 0.0, 2: 0.25, 3: 1.0, 4: 0.0, 5: None}


@pytest.mark.parametrize("alpha,block", [(0.5, 64), (0.001, 7), (0.25, 1000)])
def test_ema_blocks_equal_the_sequence(spark, alpha, block):
    """Blocks far shorter than the memory of a small alpha: their maps carry the background over all of them."""
    f = RNG.integers(0, 255, size=(400, 3)).astype(float)
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(f)] + [(None, 5, [1.0, 2.0, 3.0])], "site string, frame_id long, px array<double>").repartition(3)
    rows = X.pixel_values(X.ema_background(df, alpha, 80.0, chunk=2, block=block, fan=3), ["site", "frame_id"], ["bg", "corrected"]).collect()
    got = {(r.frame_id, r.i): (r.bg, r.corrected) for r in rows if r.site}
    assert [(r.i, r.bg, r.corrected) for r in sorted(rows, key=lambda r: r.i) if not r.site] == [(0, 1.0, 0), (1, 2.0, 0), (2, 3.0, 0)]
    bg = f[0].copy()
    for n in range(400):
        bg = f[n].copy() if n == 0 else alpha * f[n] + (1 - alpha) * bg
        for i in range(3):
            assert abs(got[(n, i)][0] - bg[i]) < 1e-9 and abs(got[(n, i)][1] - np.clip(f[n][i] - bg[i], 0, 80)) < 1 + 1e-9


def test_moving_medians_over_blocks(spark):
    f = RNG.integers(0, 20, size=(50, 5)).astype(float)
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(f)], "site string, frame_id long, px array<double>").repartition(3)
    got = {(r.frame_id, r.i): (r.bg, r.diff) for r in X.pixel_values(X.sliding_median_background(df, 2, block=7, chunk=2), ["frame_id"], ["bg", "diff"]).collect()}
    assert got == {(n, i): (np.median(f[n - 2:n + 3, i]), f[n, i] - np.median(f[n - 2:n + 3, i])) for n in range(2, 48) for i in range(5)}
    prior = {(r.frame_id, r.i): (r.bg, r.diff) for r in X.pixel_values(X.prior_median_background(df, 6, block=7, chunk=2), ["frame_id"], ["bg", "diff"]).collect()}
    for n in range(50):
        for i in range(5):
            m = np.median(f[n - 5:n + 1, i]) if n >= 5 else None
            assert prior[(n, i)] == (m, int(np.clip(f[n, i] - (m or 0), 0, 255)))


@pytest.mark.parametrize("n", [3, 7, 11, 50])
def test_even_picks(spark, n):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(11)], "path string")
    names = [f"{i:03d}" for i in range(11)]
    want = names if n >= 11 else [names[int(i * 11 / n)] for i in range(n)]
    assert sorted(r.path for r in P.select_uniform(df, ["path"], n, parts=3).collect()) == want
    ends = names if n >= 11 else [names[i] for i in np.linspace(0, 10, n).round().astype(int)]
    assert sorted(r.path for r in P.select_linspace(df, ["path"], n, parts=3).collect()) == sorted(set(ends))


def test_split_sizes_round_half_to_even(spark):
    df = spark.range(5).withColumn("c", F.lit("x"))
    out = {r.split: r["count"] for r in P.stratified_split(df, "c", ["id"], ratios=(0.5, 0.5)).groupBy("split").count().collect()}
    assert out == {"train": 2, "val": 2, "test": 1}


def test_group_split_never_leaks(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 37)
    split = P.group_split(df, "g", parts=4)
    assert P.leaked_groups(split, "g").isEmpty() and split.count() == 500 and split.select("split").distinct().count() == 3


def test_metadata_flag_is_null_when_matched(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(1, "m")], "id long, extra string")
    assert {r.id: r.metadata_missing for r in attach_metadata(a, b, ["id"]).collect()} == {1: None, 2: True}


def test_young_orphans_wait(spark):
    at = lambda rows: spark.createDataFrame(rows, "stem string, s long").withColumn("mtime", F.timestamp_seconds("s"))
    out = {r.stem: (r.outcome, r.missing) for r in pair_items(at([("a", 0), ("b", 0), ("c", 98)]), at([("a", 0), ("d", 10)]), 100_000_000).collect()}
    assert out == {"a": ("complete", None), "b": ("failed", "json"), "c": ("waiting", "json"), "d": ("failed", "image")}


def test_sensor_line_traps(spark):
    lines = ["p:1,h:2,b:3,P:4,d:5,T:6,l:0,t:8", "p:1,h:2,b:3,P:4,d:5,T:6,l:0", "p:1,p:9,h:2,b:3,P:4,d:5,T:6,l:0,t:8,zz,h:x", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "id long, line string")
    got = {r.id: (r.internal_pressure_pa, r.water_pressure_mbar, r.humidity_pct, r.probe_temp_c) for r in C.parse_sensor_line(df).collect()}
    assert got == {0: (1.0, 4.0, 2.0, 8.0), 1: (None,) * 4, 2: (9.0, 4.0, 2.0, 8.0), 3: (None,) * 4}


def test_names_with_decimals_and_strict_area(spark):
    df = spark.createDataFrame([("frame_20260812_132607_00049533_crop_007_area_15.53.png", 100, 50), ("img_20250915_113032_123_small_ctenophore.png", 10, 10), ("x_area_12.png", 1, 1)], "name string, w int, h int")
    r = C.parse_frame_stem(df, "name").collect()
    assert (r[0].date, r[0].counter, r[0].crop_id, r[0].area_mm2, r[0].clean_name) == ("20260812", 49533, 7, 15.53, "frame_20260812_132607_00049533")
    assert r[1].species == "small_ctenophore" and r[1].area_mm2 is None
    sizes = df.select(C.crop_size_mm2("name", "w", "h", strict=True).alias("s"), C.crop_size_mm2("name", "w", "h").alias("l")).collect()
    assert abs(sizes[0].s - 2.0) < 1e-9 and sizes[0].l == 15.53 and sizes[2].s == 12.0
    assert df.filter(C.valid_public_name(F.lit("20260812"), "name")).count() == 1
