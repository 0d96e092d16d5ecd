"""Streams fed file by file give what the batch rules give, and survive restarts and replays."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidewrack.operators import pixels as X
from tidewrack.operators import series as S
from tidewrack.operators.grids import detect
from tidewrack.sources.files import stream_files
from tidewrack.streaming import jobs as B


def feed(spark, df, order, path, parts=4):
    """Write ``df`` in time order as single files, oldest first."""
    total = df.count()
    size = -(-total // parts)
    from tidewrack.operators.ordering import rank_rows

    rows = rank_rows(df, [], [order], "_n").persist()
    for i in range(parts):
        rows.filter((F.col("_n") > i * size) & (F.col("_n") <= (i + 1) * size)).drop("_n").coalesce(1).write.mode("append").parquet(path)
    rows.unpersist()
    return stream_files(spark, path, df.schema, max_files=1)


def feed_shuffled(spark, df, path, parts=5, minutes=8):
    """Rows up to ``minutes`` out of order over several files, then one row that moves the watermark past all."""
    rows = df.withColumn("_at", F.unix_timestamp("ts") + F.pmod(F.xxhash64("id"), F.lit(minutes * 60))).orderBy("_at").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = [tuple(r)[:-1] for r in rows[i * size:(i + 1) * size]]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    df.limit(1).withColumn("ts", F.lit("2033-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return stream_files(spark, path, df.schema, max_files=1)


def drain(spark, stream, tmp_path, name):
    B.to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def samples(spark, n=300):
    rnd, t, rows = random.Random(1), 1_700_000_000, []
    for i in range(n):
        t += rnd.choice([10, 30, 300])
        rows.append((i % 2, i, t, None if rnd.random() < 0.1 else rnd.random() < 0.4, None if rnd.random() < 0.1 else 20 + rnd.random() * 8, 40 + rnd.random() * 20, 1000 + rnd.random() * 40))
    df = spark.createDataFrame(rows, "k long, id long, s long, leak boolean, temp_c double, humidity_pct double, pressure_mbar double")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_leak_alerts_over_several_batches(spark, tmp_path):
    df = samples(spark)
    out = drain(spark, B.stream_leak_alerts(feed_shuffled(spark, df, str(tmp_path / "in")), ["k"], "id", 2, 3000, 6000), tmp_path, "out")
    want = S.leak_alerts(df, ["k"], "ts", "id", 2, 3000, 6000)
    got = {(r.k, r.id, r.tier) for r in out.collect()}
    assert got == {(r.k, r.id, r.tier) for r in want.collect()} and {t for _, _, t in got} == {"critical", "warning"}


def test_stage_alerts_over_several_batches(spark, tmp_path):
    df = samples(spark).withColumn("age_s", F.col("id") * 31 % 60)
    out = drain(spark, B.stream_stage_alerts(feed_shuffled(spark, df, str(tmp_path / "in")), ["k"], "id"), tmp_path, "out")
    want = S.stage_alerts(df, ["k"], "ts", "id")
    assert {(r.id, r.event) for r in out.collect()} == {(r.id, r.event) for r in want.collect()}


def test_silent_stage_is_announced_by_a_timer(spark, tmp_path):
    rows = [("record", 1, 0), ("send", 2, 10), ("send", 3, 5000), ("send", 4, 9000)]
    df = spark.createDataFrame([(s, i, 1_700_000_000 + t, 1) for s, i, t in rows], "stage string, id long, s long, age_s long").withColumn("ts", F.timestamp_seconds("s"))
    stream = feed(spark, df.filter("stage = 'record' OR id > 1"), "id", str(tmp_path / "in"), parts=4)
    out = drain(spark, B.stream_stage_alerts(stream, ["stage"], "id", delay="1 second", silence_s=3000), tmp_path, "out")
    assert ("record", None, "down") in {(r.stage, r.id, r.event) for r in out.collect()}


def test_background_state_is_kept_between_batches(spark, tmp_path):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i % 2, i, [float(rnd.randint(0, 200)) for _ in range(6)]) for i in range(40)], "site long, frame_id long, px array<double>")
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("frame_id") * 60 + 1_700_000_000)).withColumn("id", F.col("frame_id"))
    out = drain(spark, B.stream_background(feed_shuffled(spark, timed, str(tmp_path / "in")), ["site"], "frame_id", 0.25, 150.0, ts="ts"), tmp_path, "out")
    got = {(r.frame_id, i): v for r in out.collect() for i, v in enumerate(r.corrected)}
    want = {(r.frame_id, r.i): r.corrected for r in X.pixel_values(X.ema_background(df, 0.25, 150.0, chunk=4), ["frame_id"], ["corrected"]).collect()}
    assert got == want


def test_duplicates_across_restarts(spark, tmp_path):
    df = samples(spark, 40).select("id", "ts")
    source = str(tmp_path / "in")
    stream = feed(spark, df, "id", source, parts=2)
    job = lambda: B.stream_dedup(stream, ["id"], "2 days")
    drain(spark, job(), tmp_path, "out")
    df.coalesce(1).write.mode("append").parquet(source)
    assert drain(spark, job(), tmp_path, "out").count() == 40


def test_catalogue_adds_new_items_only(spark, tmp_path):
    items = spark.createDataFrame([(i, f"s{i % 3}") for i in range(20)], "id long, source string")
    side = spark.createDataFrame([(i, i * 2) for i in range(0, 20, 2)], "id long, extra long")
    source, path, state = (str(tmp_path / n) for n in ("in", "catalogue", "state"))
    stream = feed(spark, items, "id", source, parts=2)
    B.stream_catalogue(stream, side, path, state, ["id"]).awaitTermination()
    items.unionByName(spark.createDataFrame([(99, "s9")], "id long, source string")).coalesce(1).write.mode("append").parquet(source)
    B.stream_catalogue(stream, side, path, state, ["id"]).awaitTermination()
    out = spark.read.parquet(path)
    assert out.count() == 21 and out.filter("metadata_missing").count() == 11 and out.filter("metadata_missing = false").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    base = 1_700_000_400
    rows = [(1, base), (2, base + 5000), (3, base + 9000), (4, base + 10)]
    df = spark.createDataFrame([(1, i, t, 1.0) for i, t in rows], "k long, id long, s long, depth_m double").withColumn("ts", F.timestamp_seconds("s"))
    stream = feed(spark, df, "id", str(tmp_path / "in"), parts=4)
    out = drain(spark, B.stream_environment_rollup(stream, ["k"], "1 minute", width="10 minutes", mean=["depth_m"]), tmp_path, "out").collect()
    assert [r.sample_count for r in out if r.window_start.timestamp() == base] == [1]


def tiles(spark, frames=6, slots=12):
    """Tiles sent over some minutes, frames overlapping, and their arrival order."""
    rnd, rows = random.Random(4), []
    for f in range(frames):
        for k in range(slots):
            rows.append((f, k // 4, k % 4, k, slots, round(rnd.random(), 3), 1_700_000_000 + f * 60 + rnd.randint(0, 300)))
    return spark.createDataFrame(rows, "frame_id long, tile_row long, tile_col long, slot long, slots long, score double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


SPEC = dict(n=2, size=8, peak=0.6, secondary=0.3, upscale=16.0, padding=2, image=128, cap=5)


def replay(spark, parts, path):
    for part in parts:
        rows = part.collect()
        random.Random(len(rows)).shuffle(rows)
        spark.createDataFrame(rows, part.schema).coalesce(1).write.mode("append").parquet(path)
    return stream_files(spark, path, parts[0].schema, max_files=1)


def run_detect(spark, stream, tmp_path, **wait):
    frames = B.assemble_frames(stream, "frame_id", F.col("slot"), F.col("slots"), "ts", "10 minutes", **wait)
    out, late = str(tmp_path / "crops"), str(tmp_path / "late")
    B.stream_detect(frames, out, str(tmp_path / "state"), late=late, **SPEC).awaitTermination()
    return spark.read.parquet(out), spark.read.schema("frame_id long, late_tiles long, batch int").parquet(late)


def crops(df):
    return sorted(tuple(r[c] for c in ("frame_id", "crop_y0", "crop_x0", "crop_y1", "crop_x1", "peak_val", "crop_id")) for r in df.collect())


def test_frames_split_over_files_are_detected_once(spark, tmp_path):
    df = tiles(spark)
    at = F.unix_timestamp("ts") - 1_700_000_000
    parts = [df.filter((at >= a) & (at < a + 150)) for a in range(0, 700, 150)]
    again = df.filter("frame_id = 2 AND slot < 5").withColumn("score", F.lit(0.0))
    out, late = run_detect(spark, replay(spark, [*parts, again], str(tmp_path / "in")), tmp_path, wait_s=1200)
    assert crops(out) == crops(detect(df, **SPEC)) != [] and late.count() == 0
    assert out.groupBy("frame_id").agg(F.count_distinct("batch").alias("n")).filter("n > 1").isEmpty()


def test_frame_with_missing_tiles_is_released_at_its_deadline(spark, tmp_path):
    df = tiles(spark)
    held = "frame_id = 1 AND slot IN (3, 7, 8)"
    late = df.filter(held).withColumn("ts", F.lit("2023-11-15 10:00:00").cast("timestamp"))
    later = df.filter("frame_id = 5").withColumns({"frame_id": F.lit(9).cast("long"), "ts": F.lit("2023-11-15 10:00:00").cast("timestamp")})
    parts = [df.filter(f"NOT ({held}) AND slot < 6"), df.filter(f"NOT ({held}) AND slot >= 6"), later, later.filter("slot < 2"), late, late.filter("slot = 3")]
    out, missed = run_detect(spark, replay(spark, parts, str(tmp_path / "in")), tmp_path, wait_s=900)
    whole = df.filter(f"NOT ({held})").unionByName(later)
    assert crops(out) == crops(detect(whole, **SPEC))
    assert [(r.frame_id, r.late_tiles) for r in missed.groupBy("frame_id").agg(F.sum("late_tiles").alias("late_tiles")).collect()] == [(1, 3)]


class HeldState:
    """State of one key in memory: a value, or a map."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.map))

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class HeldTimers:
    def __init__(self):
        self.timers, self.mark = [], 0

    def getMapState(self, *_):
        return HeldState()

    getValueState = getMapState

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_waiting_rows_are_never_held_together(monkeypatch):
    """A key's rows are stored as they come and taken piece by piece, with the events of taking them at once."""
    monkeypatch.setattr(B, "GATHERED", 500)
    monkeypatch.setattr(B, "TAKEN", 300)
    rnd, n = random.Random(5), 6000
    rows = [(1_700_000_000_000_000 + i * 60_000_000, i, float(rnd.choice([1, 1, 50]))) for i in range(n)]
    table = pd.DataFrame(rows, columns=["t_us", "id", "age_in"])
    job = B.StageAlerts(["k"], "id", "bigint", 20, 2, 600, None)
    whole = job.take(table, None, int(table["t_us"].iloc[-1]))[0]

    timers, taken, packed = HeldTimers(), [], []
    job.init(timers)
    take, pack = job.take, job._pack
    monkeypatch.setattr(job, "take", lambda new, *rest: taken.append(len(new)) or take(new, *rest))
    monkeypatch.setattr(job, "_pack", lambda pdf, part: packed.append(len(pdf)) or pack(pdf, part))
    mixed = table.sample(frac=1, random_state=1)
    out = [*job.handleInputRows(("a",), iter([mixed.iloc[i:i + 100] for i in range(0, n, 100)]), timers)]
    for part in (0.3, 0.301, 2.0):  # the second watermark lies within a packet
        timers.mark = int(rows[0][0] + part * n * 60_000_000) // 1000
        out += job.handleExpiredTimer(("a",), timers, None)
    got = pd.concat(out)
    assert list(zip(got["id"], got["event"])) == list(zip(whole["id"], whole["event"])) and len(got) > 100
    assert sum(taken) == n and max(taken) < 500 and max(packed) < 700
    assert not job.packets.map and not timers.timers
