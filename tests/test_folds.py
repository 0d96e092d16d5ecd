"""Keep rules against a plain loop, with slices small enough that state crosses many of them."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrack.operators.folds import thin
from tidewrack.operators.series import keep_every_nth, leak_alerts, median_ratio, prune_oldest, stage_alerts, thin_by_interval


def events(seed, n=500, gaps=(1, 3, 20, 90, 700)):
    rnd, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice(gaps)
        out.append(("hot" if i % 5 else "b", i, t, i // rnd.choice([3, 4])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("gap", [10, 150, 2000])
def test_thin_equals_loop(spark, seed, gap):
    rows = events(seed)
    df = spark.createDataFrame(rows, "k string, id long, s long, g long").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in ("hot", "b"):
        last = None
        for _, i, t, _ in (r for r in rows if r[0] == key):
            if last is None or t - last >= gap:
                last = t
                want.append(i)
    assert sorted(r.id for r in thin(df, ["k"], "ts", "id", gap, rows=9, fan=3).collect()) == sorted(want)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_thin_once_per_episode(spark, seed):
    rnd = random.Random(seed)
    rows, g, t = [], 0, 0
    for i in range(400):
        t += rnd.choice([1, 4, 30, 200])
        g += rnd.random() < 0.1
        rows.append((1, i, t, g))
    df = spark.createDataFrame(rows, "k long, id long, s long, g long").withColumn("ts", F.timestamp_seconds("s"))
    want, last, done = [], None, None
    for _, i, t, g in rows:
        if g != done and (last is None or t - last >= 25):
            want.append(i)
            last, done = t, g
    assert sorted(r.id for r in thin(df, ["k"], "ts", "id", 25, once_per="g", rows=7, fan=3).collect()) == want


@pytest.mark.parametrize("seed", [7, 8])
def test_stage_alerts_equal_state_machine(spark, seed):
    rnd, t, rows = random.Random(seed), 0, []
    for i in range(400):
        t += rnd.choice([5, 30, 400, 3000])
        rows.append((i % 2, i, t, rnd.choice([1, 10, 29, 30, 45, None, 80])))
    df = spark.createDataFrame(rows, "stage long, id long, s long, age_s long").withColumn("ts", F.timestamp_seconds("s"))
    want = set()
    for stage in (0, 1):
        run, down, last = 0, False, None
        for _, i, t, age in (r for r in rows if r[0] == stage):
            if age is not None and age < 30:
                if down:
                    want.add((i, "up"))
                run, down = 0, False
                continue
            run += 1
            if run >= 2 and not down and (last is None or t - last >= 1800):
                down, last = True, t
                want.add((i, "down"))
    got = {(r.id, r.event) for r in stage_alerts(df, ["stage"], "ts", "id").collect()}
    assert got == want and {"up", "down"} == {e for _, e in want}


def test_critical_held_back_by_cooldown_does_not_silence_the_warning(spark):
    rows = [(1, 0, True, 20.0, 1000.0), (2, 600, True, 20.0, 1000.0), (3, 1200, True, 30.0, 1030.0)]
    df = spark.createDataFrame(rows, "id long, s long, leak boolean, temp_c double, pressure_mbar double").withColumn("ts", F.timestamp_seconds("s"))
    df = df.withColumn("humidity_pct", F.lit(50.0)).withColumn("k", F.lit(1))
    out = {(r.id, r.tier) for r in leak_alerts(df, ["k"], "ts", "id", 2, 1500, 3600).collect()}
    assert out == {(2, "critical"), (3, "warning")}


def test_thin_by_interval_stops_at_target(spark):
    df = spark.range(100).withColumn("ts", F.timestamp_seconds("id")).withColumn("k", F.lit(1))
    assert sorted(r.id for r in thin_by_interval(df, ["k"], "ts", "id", 10, target=3).collect()) == [0, 10, 20]


def test_nth_is_counted_before_incomplete_rows_go(spark):
    df = spark.range(1, 13).withColumn("k", F.lit(1)).withColumn("ok", F.col("id") != 6)
    assert sorted(r.id for r in keep_every_nth(df, ["k"], ["id"], 3, F.col("ok")).collect()) == [3, 9, 12]


def test_prune_deletes_the_file_that_crosses(spark):
    df = spark.createDataFrame([(i, i, 10) for i in range(10)], "id long, mtime long, bytes long")
    assert sorted(r.id for r in prune_oldest(df, "mtime", "id", "bytes", 90, 75, parts=3).collect()) == [0, 1, 2]
    assert prune_oldest(df, "mtime", "id", "bytes", 100, 75).isEmpty()


def test_median_ratio_first_row_and_zero_median(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0), (4, 0.0)], "id long, v double").withColumn("k", F.lit(1))
    got = {r.id: (r.ratio, r.is_obs) for r in median_ratio(df, ["k"], ["id"], "v", 2, 1.5, block_rows=2).collect()}
    assert got == {1: (1.0, False), 2: (1.0, False), 3: (float("inf"), True), 4: (0.0, False)}
    none = {r.id: r.ratio for r in median_ratio(df, ["k"], ["id"], "v", 2, 1.5, first=None).collect()}
    assert none[1] is None


@pytest.mark.parametrize("gap", [1, 40, 4000])
def test_most_rows_on_one_key_in_one_hour(spark, gap):
    """Slices shorter than the gap: a table then spans whole slices, and one gap spans many."""
    rnd = random.Random(9)
    rows = sorted((rnd.randint(0, 3600), i) for i in range(600))
    df = spark.createDataFrame([("hot" if i % 10 else "b", i, t) for t, i in rows], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in (0, 1):
        last = None
        for t, i in rows:
            if bool(i % 10) == bool(key) and (last is None or t - last >= gap):
                last = t
                want.append(i)
    assert sorted(r.id for r in thin(df, ["k"], "ts", "id", gap, rows=11, fan=4).collect()) == sorted(want)


def test_rows_without_time_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, None), (None, 3, 6)], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.id for r in thin(df, ["k"], "ts", "id", 10, rows=1).collect()] == [1]
    assert thin(df.filter("false"), ["k"], "ts", "id", 10).collect() == []
