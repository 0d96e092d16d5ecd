"""Queries on names, sensor lines, units, status texts and other scalar columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import columns as C
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables

_FIELDS = list(C.SENSOR_KEYS.values())


@query("P1_parse_sensor_line", """
SELECT event_id,
  CASE WHEN whole THEN 90000 + event_id * 37 % 20000 + 0.5::DOUBLE END AS internal_pressure_pa,
  CASE WHEN whole THEN CASE WHEN event_id % 7 = 0 THEN 42.5::DOUBLE ELSE event_id * 13 % 100 + 0.25::DOUBLE END END AS humidity_pct,
  CASE WHEN whole THEN 20 + event_id % 10 + 0.5::DOUBLE END AS internal_temp_c,
  CASE WHEN whole THEN CAST(1000 + event_id * 7 % 100 + 100 - CASE WHEN event_id * 7 % 100 + 100 < 1000 THEN 0 ELSE 0 END AS DOUBLE) END AS water_pressure_mbar,
  CASE WHEN whole THEN 1.5::DOUBLE END AS depth_m, CASE WHEN whole THEN 18.5::DOUBLE END AS water_temp_c,
  CASE WHEN whole THEN CAST(event_id % 2 AS DOUBLE) END AS leak, CASE WHEN whole THEN 17.75::DOUBLE END AS probe_temp_c
FROM (SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AS whole FROM v_line) q""")
def parse_sensor_line(t: Tables) -> DataFrame:
    return C.parse_sensor_line(t.v_line).select("event_id", *_FIELDS)


@query("P1_parse_leak_line", """
SELECT event_id, 90000 + event_id * 37 % 20000 + 0.5::DOUBLE AS p_int_pa, (1000 + event_id * 7 % 100 + 100) * 100.0::DOUBLE AS p_ext_pa FROM v_line""")
def parse_leak_line(t: Tables) -> DataFrame:
    rows = C.parse_sensor_line(t.v_line, required=("p", "P"))
    return rows.select("event_id", F.col("internal_pressure_pa").alias("p_int_pa"),
                       C.convert_units("water_pressure_mbar", "mbar", "Pa").alias("p_ext_pa"))


@query("P2_parse_frame_stem", """
SELECT event_id, ymd AS date, hms AS clock, CAST(floor(epoch(ts)) AS BIGINT) AS captured_s, event_id AS counter,
  CASE WHEN kind IN (0, 1) THEN CAST(event_id % 5 AS INT) END AS crop_id,
  CASE kind WHEN 0 THEN CAST(whole AS DOUBLE) WHEN 1 THEN whole + cents / 100.0::DOUBLE END AS area_mm2,
  CASE WHEN kind = 3 THEN species END AS species, frame_stem || CASE WHEN kind = 3 THEN '_' || species ELSE '' END AS clean_name
FROM v_name""")
def parse_frame_stem(t: Tables) -> DataFrame:
    out = C.parse_frame_stem(t.v_name.select("event_id", "name"), "name")
    return out.select("event_id", "date", "clock", F.unix_timestamp("captured").alias("captured_s"), "counter", "crop_id",
                      "area_mm2", "species", "clean_name")


@query("P3_parse_tile_name", """
SELECT p_partkey, p_partkey % 16 + p_partkey % 5 * 20 / 100.0::DOUBLE AS tile_row, p_size % 16 + p_partkey % 5 * 20 / 100.0::DOUBLE AS tile_col,
  'img_' || lpad(CAST(p_partkey AS STRING), 6, '0') AS original FROM part WHERE p_partkey % 9 <> 0""")
def parse_tile_name(t: Tables) -> DataFrame:
    return C.parse_tile_name(t.v_tile_name, "name").select("p_partkey", "tile_row", "tile_col", "original")


@query("P4_crop_size_mm2", """
SELECT event_id, CASE WHEN kind = 0 THEN CAST(whole AS DOUBLE) ELSE round((whole + 10) * (cents + 10) * 0.0004::DOUBLE, 6) END AS strict_mm2,
  CASE kind WHEN 0 THEN CAST(whole AS DOUBLE) WHEN 1 THEN round(whole + cents / 100.0::DOUBLE, 6)
  ELSE round((whole + 10) * (cents + 10) * 0.0004::DOUBLE, 6) END AS size_mm2 FROM v_name""")
def crop_size(t: Tables) -> DataFrame:
    rows = t.v_name.select("event_id", "name", (F.col("whole") + 10).alias("w"), (F.col("cents") + 10).alias("h"))
    return rows.select("event_id", F.round(C.crop_size_mm2("name", "w", "h", strict=True), 6).alias("strict_mm2"),
                       F.round(C.crop_size_mm2("name", "w", "h"), 6).alias("size_mm2"))


@query("P5_valid_public_name", "SELECT event_id, ymd, name FROM v_name WHERE kind IN (0, 1) AND event_id % 3 <> 0")
def valid_public_name(t: Tables) -> DataFrame:
    folder = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("ymd"), F.lit("/.."))).otherwise(F.col("ymd"))
    return t.v_name.filter(C.valid_public_name(folder, "name")).select("event_id", "ymd", "name")


@query("P6_dew_point_c", """
WITH a AS (SELECT sample_id, temp_c, humidity_pct, ln(humidity_pct / 100) + 17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c) AS alpha FROM v_telemetry),
e AS (SELECT sample_id, ln(greatest(humidity_pct / 100 * 6.112::DOUBLE * exp(17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c)), 0.000001::DOUBLE) / 6.112::DOUBLE) AS l FROM v_telemetry)
SELECT a.sample_id, round(243.12::DOUBLE * alpha / (17.62::DOUBLE - alpha), 6) AS dew_point_c, CASE WHEN temp_c IS NOT NULL THEN round(243.12::DOUBLE * l / (17.62::DOUBLE - l), 6) END AS dew_point_clamped_c
FROM a JOIN e ON a.sample_id = e.sample_id""")
def dew_point(t: Tables) -> DataFrame:
    return t.v_telemetry.select("sample_id", F.round(C.dew_point_c("temp_c", "humidity_pct"), 6).alias("dew_point_c"),
                                F.round(C.dew_point_clamped_c("temp_c", "humidity_pct"), 6).alias("dew_point_clamped_c"))


@query("P7_absolute_humidity", """
SELECT sample_id, round(6.112::DOUBLE * exp(17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c)), 6) AS saturation_hpa,
  round(216.7::DOUBLE * (humidity_pct / 100 * 6.112::DOUBLE * exp(17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c))) / (temp_c + 273.15::DOUBLE), 6) AS g_m3 FROM v_telemetry""")
def absolute_humidity(t: Tables) -> DataFrame:
    return t.v_telemetry.select("sample_id", F.round(C.saturation_vapor_pressure("temp_c"), 6).alias("saturation_hpa"),
                                F.round(C.absolute_humidity("temp_c", "humidity_pct"), 6).alias("g_m3"))


@query("P8_convert_units", """
SELECT sample_id, round(pressure_mbar * 100, 6) AS pa, round(pressure_mbar * 100 / 100, 6) AS mbar, round(pressure_mbar * 100 / 3386.389::DOUBLE, 6) AS inhg,
  round(temp_c + 273.15::DOUBLE, 6) AS kelvin, round(sample_id / 1000.0::DOUBLE, 6) AS celsius, round(humidity_pct / 10, 6) AS pct, round(sample_id * 1000000 / 1e9, 6) AS gb FROM v_telemetry""")
def convert_units(t: Tables) -> DataFrame:
    pa = F.col("pressure_mbar") * 100
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.v_telemetry.select(
        "sample_id", r(C.convert_units("pressure_mbar", "mbar", "Pa"), "pa"), r(C.convert_units(pa, "Pa", "mbar"), "mbar"),
        r(C.convert_units(pa, "Pa", "inHg"), "inhg"), r(C.convert_units("temp_c", "C", "K"), "kelvin"),
        r(C.convert_units("sample_id", "millidegree", "C"), "celsius"), r(C.convert_units("humidity_pct", "permille", "%"), "pct"),
        r(C.convert_units(F.col("sample_id") * 1000000, "B", "GB"), "gb"))


RANGES = {"humidity_pct": (31.0, 75.0), "temp_c": (21.0, 29.5), "pressure_mbar": (985.0, 1040.0)}
_SANE = "coalesce(humidity_pct BETWEEN 31 AND 75 AND temp_c BETWEEN 21 AND 29.5::DOUBLE AND pressure_mbar BETWEEN 985 AND 1040, FALSE)"


@query("P9_sane_filter", f"SELECT sample_id, device_id FROM v_telemetry WHERE {_SANE}")
def sane_filter(t: Tables) -> DataFrame:
    return C.sane_filter(t.v_telemetry, RANGES).select("sample_id", "device_id")


@query("P9_sane_counts", f"SELECT device_id, count(*) FILTER (WHERE {_SANE}) AS kept, count(*) FILTER (WHERE NOT {_SANE}) AS rejected FROM v_telemetry GROUP BY device_id")
def sane_counts(t: Tables) -> DataFrame:
    return C.sane_counts(t.v_telemetry, RANGES, "device_id")


@query("P10_limit_status", """
SELECT sample_id, CASE WHEN temp_c >= lim THEN 'danger' WHEN temp_c >= 0.9::DOUBLE * lim THEN 'warn' END AS status
FROM (SELECT sample_id, temp_c, CASE WHEN sample_id % 23 = 0 THEN NULL ELSE 24 + sample_id % 5 END AS lim FROM v_telemetry) q""")
def limit_status(t: Tables) -> DataFrame:
    limit = F.when(F.col("sample_id") % 23 != 0, 24 + F.col("sample_id") % 5)
    return t.v_telemetry.select("sample_id", C.limit_status("temp_c", limit).alias("status"))


_AGE = "CASE WHEN sample_id % 19 = 0 THEN NULL ELSE (sample_id * 7919 + 3) % 400000 END"
_BYTES = "CASE WHEN sample_id % 17 = 0 THEN NULL WHEN sample_id % 3 = 0 THEN (sample_id * 104729 + 1) % 900000 ELSE (sample_id * 7919003 + 1) % 4000000000 END"
_ETA = "CASE WHEN sample_id % 19 = 0 THEN NULL ELSE CAST((sample_id * 77 + 1) % 700 AS DOUBLE) / 8 + 0.01::DOUBLE END"


@query("P11_status_texts", f"""
WITH v AS (SELECT sample_id, {_AGE} AS s, {_BYTES} AS b, {_ETA} AS h FROM v_telemetry)
SELECT sample_id,
  CASE WHEN s IS NULL THEN 'N/A' WHEN s < 120 THEN printf('%.0f', s::DOUBLE) || 's ago' WHEN s < 7200 THEN printf('%.1f', floor(s / 60.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) || 'm ago'
    WHEN s < 172800 THEN printf('%.1f', floor(s / 3600.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) || 'h ago' ELSE printf('%.1f', floor(s / 86400.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) || 'd ago' END AS age,
  CASE WHEN b IS NULL THEN 'N/A' WHEN b >= 1000000000 THEN printf('%.2f', floor(b / 1e9 * 100 + 0.5::DOUBLE) / 100) || ' GB' WHEN b >= 1000000 THEN printf('%.1f', floor(b / 1e6 * 10 + 0.5::DOUBLE) / 10) || ' MB' ELSE printf('%.0f', b::DOUBLE) || ' B' END AS size,
  CASE WHEN b IS NULL THEN 'N/A' WHEN b >= 1000000 THEN printf('%.2f', floor(b / 1e6 * 100 + 0.5::DOUBLE) / 100) || ' MB/s' WHEN b >= 1000 THEN printf('%.1f', floor(b / 1e3 * 10 + 0.5::DOUBLE) / 10) || ' KB/s' ELSE printf('%.0f', b::DOUBLE) || ' B/s' END AS speed,
  CASE WHEN h IS NULL THEN 'N/A' WHEN h < 48 THEN printf('%.1f', floor(h * 10 + 0.5::DOUBLE) / 10) || 'h' ELSE printf('%.1f', floor(h / 24 * 10 + 0.5::DOUBLE) / 10) || 'd' END AS eta
FROM v""")
def status_texts(t: Tables) -> DataFrame:
    id_ = F.col("sample_id")
    v = t.v_telemetry.select(
        "sample_id",
        F.when(id_ % 19 != 0, (id_ * 7919 + 3) % 400000).alias("s"),
        F.when(id_ % 17 != 0, F.when(id_ % 3 == 0, (id_ * 104729 + 1) % 900000).otherwise((id_ * 7919003 + 1) % 4000000000)).alias("b"),
        F.when(id_ % 19 != 0, ((id_ * 77 + 1) % 700) / 8 + 0.01).alias("h"),
    )
    return v.select("sample_id", C.age_bucket("s").alias("age"), C.human_bytes("b").alias("size"), C.human_speed("b").alias("speed"), C.eta_text("h").alias("eta"))


@query("P12_public_view", """
SELECT e.class_label AS species, e.class_confidence AS confidence, e.region_size_mm2 AS size_mm2, s.ymd || 'T' || s.hms AS time,
  '/crop_image/' || s.ymd || '/' || s.frame_stem || '.png' AS image_url FROM v_crop_event e JOIN v_stem s ON s.event_id = e.crop_id""")
def public_view(t: Tables) -> DataFrame:
    rows = t.v_crop_event.join(t.v_stem.select(F.col("event_id").alias("crop_id"), "ymd", "hms", "frame_stem"), "crop_id")
    rows = rows.select("class_label", "class_confidence", "region_size_mm2", F.concat_ws("T", "ymd", "hms").alias("processed_iso"),
                       F.col("ymd").alias("date"), F.col("frame_stem").alias("stem"), "station")
    return C.public_view(rows)


@query("P13_region_measures", """
SELECT crop_id, round(n * 3180.96::DOUBLE, 6) AS region_size_pixels, round(n * 3180.96::DOUBLE * (91.0::DOUBLE / 4512) * (91.0::DOUBLE / 4512), 6) AS region_size_mm2,
  frame_stem || '_crop_' || lpad(CAST(crop_id % 9 AS STRING), 3, '0') || '_area_' || printf('%.2f', round(n * 3180.96::DOUBLE * (91.0::DOUBLE / 4512) * (91.0::DOUBLE / 4512), 2)) AS stem
FROM (SELECT e.crop_id, e.crop_id * 11 % 97 + 4 AS n, s.frame_stem FROM v_crop_event e JOIN v_stem s ON s.event_id = e.crop_id) q""")
def region_measures(t: Tables) -> DataFrame:
    rows = t.v_crop_event.join(t.v_stem.select(F.col("event_id").alias("crop_id"), "frame_stem"), "crop_id")
    rows = rows.withColumn("region_size_points", F.col("crop_id") * 11 % 97 + 4)
    out = C.region_measures(rows, 56.4, (91 / 4512) ** 2)
    return out.select("crop_id", *[F.round(c, 6).alias(c) for c in ("region_size_pixels", "region_size_mm2")],
                      C.crop_stem("frame_stem", F.col("crop_id") % 9, "region_size_mm2").alias("stem"))


@query("P14_blob_shape", """
SELECT image_id, crop_id, round(2 * sqrt((y1 - y0) * (x1 - x0) / pi()), 6) AS esd, round((y1 - y0) * 7 / ((y1 - y0) * (x1 - x0) + 0.00001::DOUBLE), 6) AS compactness FROM v_pred""")
def blob_shape(t: Tables) -> DataFrame:
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return t.v_pred.select("image_id", "crop_id", F.round(C.equivalent_diameter(h * w), 6).alias("esd"), F.round(C.compactness(h * 7, w, h), 6).alias("compactness"))


@query("P15_position_features", """
WITH p AS (SELECT frame_id, grid_row, grid_col, offset_idx, tile_col / 15.0::DOUBLE AS x, tile_row / 15.0::DOUBLE AS y FROM v_tile_score)
SELECT frame_id, grid_row, grid_col, offset_idx, round(x, 6) AS f0, round(y, 6) AS f1, round(x * x, 6) AS f2, round(y * y, 6) AS f3, round(x * y, 6) AS f4,
  round(sqrt((x - 0.5::DOUBLE) * (x - 0.5::DOUBLE) + (y - 0.5::DOUBLE) * (y - 0.5::DOUBLE)), 6) AS f5, round(sin(x * 2 * pi()), 6) + 0 AS f6, round(cos(x * 2 * pi()), 6) AS f7,
  round(sin(y * 2 * pi()), 6) + 0 AS f8, round(cos(y * 2 * pi()), 6) AS f9 FROM p""")
def position_features(t: Tables) -> DataFrame:
    rows = t.v_tile_score.withColumn("f", C.position_features("tile_row", "tile_col", 16))
    return rows.select("frame_id", "grid_row", "grid_col", "offset_idx", *[(F.round(F.col("f")[i], 6) + 0).alias(f"f{i}") for i in range(10)])


_FILLED = {"Name", "ImageFilename", "Id", "GroupId", "ImageW", "ImageH", "FilledArea", "AbdArea", "Compactness", "EsdDiameter", "AbdDiameter"}
_LC_SQL = {
    "Name": "'s' || CAST(image_id AS STRING)", "ImageFilename": "CAST(crop_id AS STRING) || '.png'", "Id": "crop_id", "GroupId": "crop_id",
    "ImageW": "x1 - x0", "ImageH": "y1 - y0", "FilledArea": "(y1 - y0) * (x1 - x0)", "AbdArea": "(y1 - y0) * (x1 - x0)",
    "Compactness": "round((y1 - y0) * (x1 - x0) / ((y1 - y0) * (x1 - x0) + 0.00001::DOUBLE), 6)",
    "EsdDiameter": "round(2 * sqrt((y1 - y0) * (x1 - x0) / pi()), 6)", "AbdDiameter": "round(2 * sqrt((y1 - y0) * (x1 - x0) / pi()), 6)",
}


@query("P17_to_labelchecker", "SELECT " + ", ".join(f"{_LC_SQL.get(c, 'CAST(NULL AS VARCHAR)')} AS \"{c}\"" for c in C.LABELCHECKER_COLUMNS) + " FROM v_pred")
def to_labelchecker(t: Tables) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    log = t.v_pred.select(
        F.concat(F.lit("s"), F.col("image_id")).alias("folder"), F.concat(F.col("crop_id"), F.lit(".png")).alias("crop_filename"),
        F.col("crop_id").alias("roi_id"), w.alias("w"), h.alias("h"), (w * h).alias("area"),
        F.round(C.compactness(w * h, w, h), 6).alias("compactness"), F.round(C.equivalent_diameter(w * h), 6).alias("esd"))
    return C.to_labelchecker(log, with_uuid=False)


_CROP_LC_SQL = {
    "Name": "'run'", "ImageFilename": "CAST(crop_id AS STRING) || '.png'", "ImageW": "x1 - x0", "ImageH": "y1 - y0", "FilledArea": "(y1 - y0) * 5",
    "AbdArea": "(x1 - x0) * (y1 - y0)", "CircleFit": "round(peak / 2, 6)", "SurfaceAreaMS": "peak",
}


@query("P17_to_labelchecker_crops", "SELECT " + ", ".join(
    f"{_CROP_LC_SQL.get(c, 'CAST(NULL AS VARCHAR)')} AS \"{c}\"" for c in [*C.LABELCHECKER_COLUMNS, "SurfaceAreaMS"]) + " FROM v_pred")
def to_labelchecker_crops(t: Tables) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    log = t.v_pred.select(F.lit("run").alias("folder"), F.concat(F.col("crop_id"), F.lit(".png")).alias("image_name"), w.alias("crop_width"), h.alias("crop_height"),
                          (h * 5).alias("region_size_pixels"), F.round(F.col("peak") / 2, 6).alias("region_mean_intensity"), F.col("peak").alias("region_max_intensity"))
    return C.to_labelchecker(log, C.CROP_LOG_MAPPING, with_uuid=False)


@query("P18_renumber", """
WITH n AS (SELECT p_partkey, p_partkey + 250 AS n FROM part WHERE p_partkey % 9 = 0)
SELECT p_partkey, 'img_' || lpad(CAST(n AS STRING), CAST((SELECT MAX(length(CAST(n AS STRING))) FROM n) AS INT), '0') || '.png' AS new_name FROM n""")
def renumber(t: Tables) -> DataFrame:
    # the view cuts numbers to six digits: longer keys are put back in full
    key = F.col("p_partkey").cast("string")
    full = F.concat(F.lit("img_"), F.lpad(key, F.greatest(F.length(key), F.lit(6)), F.lit("0")), F.substring("name", 11, 100))
    return C.renumber(t.v_tile_name.withColumn("name", full), "name", 250).select("p_partkey", "new_name")


@query("P19_rename_label", "SELECT o_orderkey, CASE WHEN pred_label = '3-MEDIUM' THEN 'medusa' ELSE pred_label END AS pred_label FROM v_pred_class")
def rename_label(t: Tables) -> DataFrame:
    return C.rename_label(t.v_pred_class, "pred_label", "3-MEDIUM", "medusa").select("o_orderkey", "pred_label")


@query("P20_flatten_sample", """
SELECT sample_id, device_id, round(CASE WHEN temp_c IS NULL THEN humidity_pct ELSE (temp_c + humidity_pct) / 2 END, 6) AS thermal_mean_c, greatest(coalesce(temp_c, humidity_pct), humidity_pct) AS thermal_max_c,
  pressure_mbar AS disk_free_gb_0, CASE WHEN sample_id % 2 = 0 THEN depth_m END AS disk_free_gb_1, sample_id * 3 AS record_frames_recorded_total, sample_id % 60 < 30 AS record_alive FROM v_telemetry""")
def flatten_sample(t: Tables) -> DataFrame:
    id_ = F.col("sample_id")
    nested = t.v_telemetry.select(
        "sample_id", "device_id",
        F.create_map(F.lit("cpu"), F.col("temp_c"), F.lit("gpu"), F.col("humidity_pct")).alias("thermal_zones_c"),
        F.map_filter(F.create_map(F.lit("/data"), F.col("pressure_mbar"), F.lit("/backup"), F.when(id_ % 2 == 0, F.col("depth_m"))), lambda k, v: v.isNotNull()).alias("disk_free_gb_by_path"),
        F.struct((id_ * 3).alias("frames_recorded_total"), (id_ % 60 < 30).alias("alive")).alias("record"))
    return C.flatten_sample(nested, ["/data", "/backup"]).withColumn("thermal_mean_c", F.round("thermal_mean_c", 6))


@query("P21_bandwidth_pct", "SELECT sample_id, round(100.0::DOUBLE * nullif(sample_id % 7, 0) / nullif(sample_id % 5, 0), 6) AS pct FROM v_telemetry")
def bandwidth_pct(t: Tables) -> DataFrame:
    return t.v_telemetry.select("sample_id", F.round(C.bandwidth_pct(F.col("sample_id") % 7, F.col("sample_id") % 5), 6).alias("pct"))


@query("S9_label_from_folder", """SELECT doc_id, lang IN ('en') AS label FROM v_file JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')""")
def label_from_folder(t: Tables) -> DataFrame:
    folder = F.when(F.col("folder") == "en", "OBS").when(F.col("folder") == "fr", "no_obs").otherwise(F.col("folder"))
    rows = t.v_file.select("doc_id", F.concat_ws("/", F.col("source"), folder, F.col("name")).alias("path")).filter(~C.phantom_file("path"))
    return rows.withColumn("label", C.file_label("path")).filter(F.col("label").isNotNull()).select("doc_id", "label")
