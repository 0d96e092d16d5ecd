"""Streaming queries and file round trips over the given tables, written to the shared folder first."""

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.slices import us
from tidewrack.plans.grid import CUT, MAP, UP, CAND, NMS_SQL
from tidewrack.plans.pixel import PX, frames
from tidewrack.plans.registry import _SQL, query, with_views
from tidewrack.plans.standins import Tables
from tidewrack.session import durable, scratch_root
from tidewrack.sources import files as S
from tidewrack.streaming import jobs as B

HOUR = 3600


def _dir(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _stream(t: Tables, df: DataFrame) -> DataFrame:
    """A table replayed as a folder stream."""
    path = _dir(t, "source")
    df.write.parquet(path)
    return S.stream_files(t.spark, path, df.schema)


#: Rows of a file of a replayed table.
FILE_ROWS = 250_000


def _shuffled(t: Tables, df: DataFrame, time: str, tie: str, minutes: int = 8, parts: int = 4) -> DataFrame:
    """A table replayed part by part, rows up to ``minutes`` out of order, and behind them one row so late that the watermark passes all.

    Every part is dealt to the same number of files, so that a batch, which takes that many, reads one part.
    """
    moved = us(time) + F.pmod(F.xxhash64(tie), F.lit(minutes * 60_000_000)) - minutes * 30_000_000
    rows = durable(df.withColumn("_at", moved))
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    within = [(F.col("_at") >= a) & (F.col("_at") < b) for a, b in zip(edges, edges[1:])]
    counts = rows.agg(*[F.count_if(w) for w in within]).first()
    files = max(1, min(n for n in counts if n) // FILE_ROWS)
    path = _dir(t, "source")
    for part, n in zip(within, counts):
        if n:
            rows.where(part).drop("_at").repartition(files, F.xxhash64(tie)).sortWithinPartitions(F.xxhash64(tie)).write.mode("append").parquet(path)
    last = rows.drop("_at").orderBy(F.col(time).desc(), tie).limit(1)
    last.withColumn(time, F.col(time) + F.expr("INTERVAL 2 DAYS")).coalesce(1).write.mode("append").parquet(path)
    return S.stream_files(t.spark, path, df.schema, max_files=files)


def _run(t: Tables, stream: DataFrame) -> DataFrame:
    path = _dir(t, "sink")
    B.to_table(stream, path, _dir(t, "state")).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


CLOSED = "epoch_us(time_bucket(INTERVAL '6 hours', ts)) + 21600000000 <= (SELECT MAX(epoch_us(ts)) - 600000000 FROM v_telemetry)"


@query("R1_stream_device_rollup", f"""
SELECT device_id, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts)) AS end_us, COUNT(*) AS sample_count, round(AVG(temp_c), 6) AS temp_c_mean, MAX(temp_c) AS temp_c_peak, MIN(depth_m) AS depth_m_min, bool_or(leak) AS leak_any,
  arg_max(sample_id, (ts, sample_id)) AS sample_id FROM v_telemetry WHERE {CLOSED} GROUP BY device_id, time_bucket(INTERVAL '6 hours', ts)""")
def stream_device_rollup(t: Tables) -> DataFrame:
    out = B.stream_device_rollup(_stream(t, t.v_telemetry), ["device_id"], "10 minutes", width="6 hours", mean=["temp_c"], peak=["temp_c"], low=["depth_m"], any_of=["leak"], last=["sample_id"], tie="sample_id")
    out = _run(t, out).withColumns({"start_us": us("window_start"), "end_us": us("window_end")}).drop("window_start", "window_end")
    return _r(out, "temp_c_mean")


@query("R1_stream_environment_rollup", f"""
SELECT device_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS sample_count, round(AVG(depth_m), 6) AS depth_m_mean, MIN(depth_m) AS depth_m_min, MAX(depth_m) AS depth_m_max
FROM v_telemetry WHERE {CLOSED} GROUP BY device_id, time_bucket(INTERVAL '6 hours', ts)""")
def stream_environment_rollup(t: Tables) -> DataFrame:
    out = _run(t, B.stream_environment_rollup(_stream(t, t.v_telemetry), ["device_id"], "10 minutes", width="6 hours"))
    return _r(out.withColumn("start_us", us("window_start")).select("device_id", "start_us", "sample_count", "depth_m_mean", "depth_m_min", "depth_m_max"), "depth_m_mean")


_SQL["R2_stream_leak_alerts"] = _SQL.get("W4_alert_cooldown", "")


@query("R2_stream_leak_alerts")
def stream_leak_alerts(t: Tables) -> DataFrame:
    return _run(t, B.stream_leak_alerts(_shuffled(t, t.v_telemetry, "ts", "sample_id"), ["device_id"], "sample_id", 2, 6 * HOUR, 12 * HOUR))


_SQL["R3_stream_stage_alerts"] = _SQL.get("W5_stage_alerts", "")


@query("R3_stream_stage_alerts")
def stream_stage_alerts(t: Tables) -> DataFrame:
    return _run(t, B.stream_stage_alerts(_shuffled(t, t.v_heartbeat, "ts", "event_id"), ["stage"], "event_id"))


_SQL["R4_stream_background"] = _SQL["F1_ema_background"].replace("round(bg, 6) AS bg, ", "")


@query("R4_stream_background")
def stream_background(t: Tables) -> DataFrame:
    timed = frames(t).withColumn("ts", F.timestamp_seconds(F.col("frame_id") + 1_700_000_000))
    out = _run(t, B.stream_background(_shuffled(t, timed, "ts", "frame_id"), ["site"], "frame_id", 0.25, 100.0, ts="ts"))
    return out.select("site", "frame_id", F.posexplode("corrected").alias("i", "corrected"))


@query("R5_stream_rolling_24h", """
WITH h AS (SELECT DISTINCT station, unnest(range(floor(epoch(ts) / 3600)::BIGINT + 1, floor(epoch(ts) / 3600)::BIGINT + 25)) AS e FROM v_crop_event)
SELECT h.station, h.e * 3600 AS end_s, COUNT(*) AS crops FROM h JOIN v_crop_event c ON c.station = h.station AND epoch(c.ts) >= (h.e - 24) * 3600 AND epoch(c.ts) < h.e * 3600
WHERE h.e * 3600000000 <= (SELECT MAX(epoch_us(ts)) - 600000000 FROM v_crop_event) GROUP BY 1, 2""")
def stream_rolling_24h(t: Tables) -> DataFrame:
    out = _run(t, B.stream_rolling(_stream(t, t.v_crop_event), ["station"], "10 minutes"))
    return out.select("station", F.unix_timestamp("window_end").alias("end_s"), "crops")


@query("R5_stream_daily", """
SELECT strftime(ts, '%Y-%m-%d') AS date, COUNT(*) AS crops, COUNT(*) FILTER (WHERE class_label = 'purchase') AS of_class FROM v_crop_event
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL '10 minutes' FROM v_crop_event) GROUP BY 1""")
def stream_daily(t: Tables) -> DataFrame:
    return _run(t, B.stream_daily(_stream(t, t.v_crop_event), "purchase", "10 minutes")).withColumn("date", F.col("date").cast("string"))


@query("R6_stream_dedup_crops", "SELECT crop_id, station FROM v_crop_event")
def stream_dedup_crops(t: Tables) -> DataFrame:
    twice = t.v_crop_event.unionByName(t.v_crop_event)
    return _run(t, B.stream_dedup(_stream(t, twice), ["crop_id"], "10 minutes").select("crop_id", "station"))


@query("R7_stream_catalogue", "SELECT f.doc_id, f.source, s.quality, CASE WHEN s.doc_id IS NULL THEN TRUE END AS metadata_missing FROM v_file f LEFT JOIN v_sidecar s ON s.doc_id = f.doc_id")
def stream_catalogue(t: Tables) -> DataFrame:
    path = _dir(t, "catalogue")
    items = t.v_file.unionByName(t.v_file)
    B.stream_catalogue(_stream(t, items), t.v_sidecar, path, _dir(t, "state"), ["doc_id"]).awaitTermination()
    return t.spark.read.parquet(path).select("doc_id", "source", "quality", "metadata_missing")


_SQL["R8_stream_detect"] = with_views(CAND + NMS_SQL.format(iou=0.3, cap=5) + """ SELECT frame_id, crop_y0, crop_x0, crop_y1, crop_x1, round(peak_val, 6) AS peak_val FROM kept""")


@query("R8_stream_detect")
def stream_detect(t: Tables) -> DataFrame:
    """Tiles of a frame sent over eight minutes, in several files, in any order."""
    path, slots = _dir(t, "crops"), F.count(F.lit(1)).over(Window.partitionBy("frame_id"))
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id") * 20)
    rows = t.v_tile_score.withColumn("slot", F.row_number().over(Window.partitionBy("frame_id").orderBy("offset_idx", "grid_row", "grid_col")) - 1)
    rows = rows.withColumns({"slots": slots, "ts": sent + F.make_dt_interval(secs=F.pmod(F.xxhash64("frame_id", "slot"), F.lit(480)))})
    source = _shuffled(t, rows.withColumn("tie", F.xxhash64("frame_id", "slot")), "ts", "tie")
    whole = B.assemble_frames(source, "frame_id", F.col("slot"), F.col("slots"), "ts", "10 minutes", wait_s=3600)
    B.stream_detect(whole, path, _dir(t, "state"), **MAP, **CUT, upscale=UP).awaitTermination()
    return t.spark.read.parquet(path).select("frame_id", "crop_y0", "crop_x0", "crop_y1", "crop_x1", F.round("peak_val", 6).alias("peak_val"))


# ---- sources and sinks ------------------------------------------------------------------------------------------


@query("S1_read_file_index", "SELECT source, folder, 1 AS found FROM v_file GROUP BY ALL")
def read_file_index(t: Tables) -> DataFrame:
    path = _dir(t, "index")
    # one Parquet file per folder: the listing must find every folder once, and skip the markers
    t.v_file.repartition("source", "folder").write.partitionBy("source", "folder").parquet(path)
    files = S.read_file_index(t.spark, path, ["PARQUET"])
    part = lambda n: F.regexp_extract("path", rf"{n}=([^/]+)/", 1)
    return files.groupBy(part("source").alias("source"), part("folder").alias("folder")).agg(F.count(F.lit(1)).cast("int").alias("found"))


@query("S2_read_sidecars", """
SELECT crop_id, class_label, class_confidence, region_size_mm2, 'ok' AS state FROM v_crop_event WHERE crop_id % 20 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, 'unreadable' FROM v_crop_event WHERE crop_id % 20 = 0""")
def read_sidecars(t: Tables) -> DataFrame:
    path = _dir(t, "sidecars")
    doc = F.to_json(F.struct("crop_id", "class_label", "class_confidence", "region_size_mm2"))
    torn = F.when(F.col("crop_id") % 20 == 0, F.expr("substring(doc, 1, length(doc) - 4)")).otherwise(F.col("doc"))
    t.v_crop_event.select(doc.alias("doc"), "crop_id").select(torn.alias("value")).write.text(path)
    good, bad = S.read_sidecars(t.spark, path, multi_line=False)
    rows = good.select(F.col("crop_id").cast("long").alias("crop_id"), "class_label", "class_confidence", "region_size_mm2", F.lit("ok").alias("state"))
    return rows.unionByName(bad.select(F.lit("unreadable").alias("state")), allowMissingColumns=True)


@query("S3_read_labelme", """
SELECT image_id, COUNT(*) AS shapes, CAST(SUM(x0) AS BIGINT) AS x_sum, CAST(SUM(y1) AS BIGINT) AS y_sum FROM v_manual GROUP BY image_id""")
def read_labelme(t: Tables) -> DataFrame:
    path = _dir(t, "annotations")
    point = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    shape = F.struct(F.col("image_id").cast("string").alias("label"), F.lit("rectangle").alias("shape_type"), F.array(point("x0", "y0"), point("x1", "y1")).alias("points"))
    # the reader takes one document per file: one per run of 200 images, in one folder, since a folder each would be listed one by one
    docs = t.v_manual.groupBy(F.floor(F.col("image_id") / 200).alias("d")).agg(F.collect_list(shape).alias("shapes"))
    docs.select(F.to_json(F.struct("shapes")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    shapes = S.read_labelme(t.spark, path)
    return shapes.groupBy(F.col("label").cast("long").alias("image_id")).agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.col("points")[0][0]).cast("long").alias("x_sum"), F.sum(F.col("points")[1][1]).cast("long").alias("y_sum"))


@query("S4_read_sensor_log", """
SELECT device_id, COUNT(*) AS rows, round(SUM(pressure_mbar), 4) AS p, COUNT(temp_c) AS temps FROM v_telemetry WHERE sample_id % 25 <> 0 GROUP BY device_id""")
def read_sensor_log(t: Tables) -> DataFrame:
    path = _dir(t, "sensor")
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    good = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), num("device_id"), num("pressure_mbar"), num("pressure_mbar"), num("temp_c"), num("humidity_pct"), F.lit("0.0"))
    line = F.when(F.col("sample_id") % 25 == 0, F.concat(good, F.lit("x,garbled"))).otherwise(good)
    t.v_telemetry.select(line.alias("value")).write.text(path)
    log = S.read_sensor_log(t.spark, path, header=False)
    return log.groupBy(F.col("t_rel_s").cast("long").alias("device_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("p_int_pa"), 4).alias("p"), F.count("temp_int_c").alias("temps"))


@query("S5_frame_tiles", f"""WITH {PX}, c AS (SELECT *, CASE WHEN frame_id % 3 = 0 THEN 3 WHEN frame_id % 3 = 1 THEN 4 ELSE 1 END AS ch FROM p),
g AS (SELECT frame_id, i // 8 AS r, i % 8 AS c, CASE WHEN ch = 1 THEN v ELSE (255 + floor(v / 2)) / 3.0::DOUBLE END AS v FROM c WHERE frame_id % 17 <> 0)
SELECT CAST(frame_id AS VARCHAR) AS file, CAST(r // 3 AS INT) AS tile_row, CAST(c // 3 AS INT) AS tile_col, CAST(MAX(r) - MIN(r) + 1 AS INT) AS height, CAST(MAX(c) - MIN(c) + 1 AS INT) AS width,
  round(SUM(v * (1 + (r % 3) * 10 + c % 3)), 6) AS weighed FROM g GROUP BY frame_id, r // 3, c // 3
UNION ALL SELECT CAST(frame_id AS VARCHAR), NULL, NULL, -1, -1, NULL FROM (SELECT DISTINCT frame_id FROM p WHERE frame_id % 17 = 0) q""")
def frame_tiles(t: Tables) -> DataFrame:
    """Image structs of one, three and four channels, as the image reader gives them; some that it could not read."""
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    two = F.transform("px", lambda v: F.concat(byte(v), byte(255 - v), byte(F.floor(v / 2))))
    bad, kind = F.col("frame_id") % 17 == 0, F.col("frame_id") % 3
    pixels = F.when(kind == 0, two).when(kind == 1, F.transform(two, lambda x: F.concat(x, F.lit("FF")))).otherwise(F.transform("px", byte))
    side = F.when(bad, -1).otherwise(8)
    images = frames(t).select(F.col("frame_id").cast("string").alias("origin"), side.alias("height"), side.alias("width"), F.when(kind == 0, 3).when(kind == 1, 4).otherwise(1).alias("nChannels"),
                              F.when(~bad, F.unhex(F.array_join(pixels, ""))).alias("data"))
    tiles, unread = S.frame_tiles(images, 3)
    place = F.col("i")
    weight = 1 + F.floor(place / F.col("width")) * 10 + place % F.col("width")
    whole = tiles.select("file", "tile_row", "tile_col", "height", "width", F.posexplode("px").alias("i", "v")).groupBy("file", "tile_row", "tile_col", "height", "width").agg(F.round(F.sum(F.col("v") * weight), 6).alias("weighed"))
    none = F.lit(None)
    return whole.unionByName(unread.select("file", none.cast("int").alias("tile_row"), none.cast("int").alias("tile_col"), F.lit(-1).alias("height"), F.lit(-1).alias("width"), none.cast("double").alias("weighed")))


@query("S7_write_by_date", "SELECT ymd AS date, COUNT(*) AS files FROM v_name GROUP BY ymd")
def write_by_date(t: Tables) -> DataFrame:
    path = _dir(t, "dated")
    S.write_by_date(t.v_name.select("event_id", "name"), path, "crops", "name")
    return t.spark.read.parquet(f"{path}/crops").groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("files"))


@query("S8_read_stream", "SELECT crop_id, station FROM v_crop_event")
def read_stream(t: Tables) -> DataFrame:
    return _run(t, _stream(t, t.v_crop_event.repartition(4)).select("crop_id", "station"))
