"""Ranks, totals, percentiles and slices with one key that holds most rows, over several partitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewrack.operators.joins import asof_latest
from tidewrack.operators.medians import window_medians
from tidewrack.operators.ordering import exact_percentile, rank_rows, running_totals, top_per_key, with_scalars
from tidewrack.operators.series import detrend, leak_streak, leak_trend, rolling_count, system_mode, windowed_rise
from tidewrack.operators.slices import place, running

random.seed(3)
ROWS = [("hot" if random.random() < 0.7 else random.choice(["a", "b", None]), i, random.randint(0, 40)) for i in range(600)]


def table(spark):
    return spark.createDataFrame(ROWS, "k string, id long, v long").repartition(5)


def brute_rank():
    want = {}
    for key in {r[0] for r in ROWS}:
        for n, r in enumerate(sorted((r for r in ROWS if r[0] == key), key=lambda r: (-r[2], r[1])), 1):
            want[r[1]] = n
    return want


def test_rank_of_a_key_that_spans_partitions(spark):
    out = rank_rows(table(spark), ["k"], [F.col("v").desc(), "id"], "n", parts=7)
    assert {r.id: r.n for r in out.collect()} == brute_rank()


def test_rank_without_keys(spark):
    out = rank_rows(table(spark), [], ["v", "id"], "n", parts=6)
    want = {r[1]: n for n, r in enumerate(sorted(ROWS, key=lambda r: (r[2], r[1])), 1)}
    assert {r.id: r.n for r in out.collect()} == want


def test_running_totals_per_key(spark):
    out = running_totals(table(spark), ["k"], ["id"], {"s": "v", "n": F.lit(1)}, parts=7)
    want, seen = {}, {}
    for k, i, v in sorted(ROWS, key=lambda r: r[1]):
        s, n = seen.get(k, (0, 0))
        seen[k] = want[i] = (s + v, n + 1)
    assert {r.id: (r.s, r.n) for r in out.collect()} == want


def test_exact_percentile(spark):
    got = {r.k: r.p for r in exact_percentile(table(spark), ["k"], "v", 0.37, "p", parts=5).collect()}
    for key in got:
        assert abs(got[key] - np.percentile([r[2] for r in ROWS if r[0] == key], 37)) < 1e-9
    assert set(got) == {r[0] for r in ROWS}
    whole = exact_percentile(table(spark), [], "v", 0.99, "p").first().p
    assert abs(whole - np.percentile([r[2] for r in ROWS], 99)) < 1e-9


def test_large_top_n_equals_small_path(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 2)
    assert top_per_key(df, ["k"], ["id"], 1200).count() == 2400
    assert top_per_key(df, ["k"], ["id"], 3).count() == 6


def test_with_scalars(spark):
    df = table(spark)
    assert with_scalars(df, df.agg(F.max("id").alias("top"))).filter("id = top").count() == 1


def series(spark, n=400, seed=5):
    rnd = random.Random(seed)
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += rnd.choice([1, 5, 60, 600, 4000])
        rows.append(("hot" if i % 4 else "b", i, t, float(rnd.randint(0, 50)), rnd.random() < 0.4, None if i % 7 == 0 else 20 + rnd.random() * 5, 40 + rnd.random() * 30, 1000 + rnd.random() * 40))
    df = spark.createDataFrame(rows, "k string, id long, s long, v double, leak boolean, temp_c double, humidity_pct double, pressure_mbar double")
    return rows, df.withColumn("ts", F.timestamp_seconds("s")).repartition(3)


def per_key(rows):
    for key in ("hot", "b"):
        yield key, [r for r in rows if r[0] == key]


def test_running_state_over_small_slices(spark):
    rows, df = series(spark)
    out = running(place(df, ["k"], ["ts", "id"], 23), ["k"], last={"last_odd": F.when(F.col("v") % 2 == 1, F.col("v"))}, total={"n": F.lit(1)})
    got = {r.id: (r.last_odd, r.n) for r in out.collect()}
    for _, part in per_key(rows):
        last = None
        for n, r in enumerate(part, 1):
            last = r[3] if r[3] % 2 == 1 else last
            assert got[r[1]] == (last, n)


def test_rolling_count_includes_left_edge(spark):
    rows, df = series(spark)
    got = {r.id: r.c for r in rolling_count(df, ["k"], window_s=600, out="c", rows=31).collect()}
    for _, part in per_key(rows):
        for r in part:
            assert got[r[1]] == sum(1 for q in part if r[2] - 600 <= q[2] <= r[2])
    edge = spark.createDataFrame([("a", 1, 0), ("a", 2, 600)], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.c for r in rolling_count(edge, ["k"], window_s=600, out="c").collect()} == {1: 1, 2: 2}


def test_detrend_left_edge_is_open(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 50, 1.0), (3, 100, 9.0)], "id long, s long, v double").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    got = {r.id: r.residual for r in detrend(df, ["k"], "ts", "v", 100).collect()}
    # around t=50: the row at 0 is exactly half a window back and left out, the row at 100 counts
    assert got[2] == 1.0 - 5.0 and got[1] == 5.0 - 3.0


def test_windowed_rise_needs_half_a_window(spark):
    rows, df = series(spark)
    got = {r.id: r.rise for r in windowed_rise(df, ["k"], "ts", "v", 1200, rows=31).collect()}
    for _, part in per_key(rows):
        for r in part:
            old = next(q for q in part if q[2] >= r[2] - 1200)
            want = r[3] - old[3] if r[2] - old[2] >= 600 else None
            assert got[r[1]] == want


def test_streak_and_mode(spark):
    rows, df = series(spark)
    got = {r.id: r.streak for r in leak_streak(df, ["k"], "ts", "id", 2, rows=31).collect()}
    mode = {r.id: r.mode for r in system_mode(df, ["k"], "ts", "id", "v", 40, 10).collect()}
    for _, part in per_key(rows):
        n, m = 0, "live"
        for r in part:
            n = n + 1 if r[4] else 0
            if m == "live" and r[3] > 40:
                m = "backlog"
            elif m == "backlog" and r[3] < 10:
                m = "live"
            assert got[r[1]] == n and mode[r[1]] == m


def test_trend_takes_oldest_non_null_of_each_signal(spark):
    df = spark.createDataFrame([(1, 0, None, 50.0, 1000.0), (2, 100, 20.0, 50.0, None), (3, 900, 25.0, 60.0, 1020.0)],
                               "id long, s long, temp_c double, humidity_pct double, pressure_mbar double").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    r = {x.id: x for x in leak_trend(df, ["k"], "ts", 1000).collect()}
    assert r[3].fires and abs(r[3].pressure_shift - 20) < 1e-9 and r[3].dew_rise > 0.6
    assert not r[2].fires and r[2].dew_rise is None


def test_asof_with_age_limit(spark):
    rows, df = series(spark)
    right = df.filter("leak").select("k", "ts", F.col("id").alias("rid"), F.col("v").alias("rv"))
    got = {r.id: r.rid for r in asof_latest(df, right, ["k"], "ts", "id", ["rid", "rv"], "rid", max_age_s=900, rows=23).collect()}
    for _, part in per_key(rows):
        for r in part:
            best = [q for q in part if q[4] and q[2] <= r[2]]
            want = best[-1][1] if best and r[2] - best[-1][2] <= 900 else None
            assert got[r[1]] == want


def test_all_rows_of_a_key_in_one_hour(spark):
    """Slices by row count cut such a key too; every window then spans several slices."""
    rnd = random.Random(8)
    rows = [("hot" if i % 10 else "b", i, rnd.randint(0, 3599), None if rnd.random() < 0.1 else float(rnd.randint(0, 30))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    placed = place(df, ["k"], ["ts", "id"], 25).groupBy("k", "_slice").count().collect()
    assert len(placed) == 15 + 2 and max(r["count"] for r in placed) == 25
    count = {r.id: r.c for r in rolling_count(df, ["k"], window_s=1200, out="c", rows=25).collect()}
    median = {r.id: r.residual for r in detrend(df, ["k"], "ts", "v", 900, rows=25).collect()}
    for key in ("hot", "b"):
        part = [r for r in rows if r[0] == key]
        for _, i, s, v in part:
            assert count[i] == sum(s - 1200 <= q[2] <= s for q in part)
            near = [q[3] for q in part if s - 450 < q[2] <= s + 450 and q[3] is not None]
            assert median[i] is None if v is None else abs(median[i] - (v - np.median(near))) < 1e-9


def test_window_medians():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        values = rng.integers(0, 9, n) / 2
        values = np.where(rng.random(n) < 0.2, np.nan, values)
        lo = np.sort(rng.integers(0, n + 1, 40))
        hi = np.minimum(lo + rng.integers(0, 20, 40), n)
        windows = [values[a:b] for a, b in zip(lo, hi)]
        want = [np.median(w[~np.isnan(w)]) if (~np.isnan(w)).any() else np.nan for w in windows]
        assert np.array_equal(window_medians(values, lo, hi), want, equal_nan=True)
