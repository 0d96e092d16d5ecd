"""Queries on telemetry: roll-ups, alerts, calibration, leak-rate fits, drain and retry rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import joins as J
from tidewrack.operators import rollups as R
from tidewrack.operators import series as S
from tidewrack.operators.slices import us
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables

HOUR = 3600


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("A1_device_rollup", """
SELECT device_id, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts)) AS end_us, COUNT(*) AS sample_count, round(AVG(temp_c), 6) AS temp_c_mean,
  round(AVG(humidity_pct), 6) AS humidity_pct_mean, round(AVG(pressure_mbar), 6) AS pressure_mbar_mean, MAX(temp_c) AS temp_c_peak, MIN(depth_m) AS depth_m_min,
  bool_or(leak) AS leak_any, arg_max(sample_id, (ts, sample_id)) AS sample_id
FROM v_telemetry GROUP BY device_id, time_bucket(INTERVAL '6 hours', ts)""")
def device_rollup(t: Tables) -> DataFrame:
    out = R.device_rollup(t.v_telemetry, ["device_id"], width="6 hours", mean=["temp_c", "humidity_pct", "pressure_mbar"], peak=["temp_c"],
                          low=["depth_m"], any_of=["leak"], last=["sample_id"], tie="sample_id")
    out = out.withColumn("start_us", us("window_start")).withColumn("end_us", us("window_end")).drop("window_start", "window_end")
    return _r(out, "temp_c_mean", "humidity_pct_mean", "pressure_mbar_mean")


@query("A2_environment_rollup", """
SELECT device_id, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts)) AS end_us, COUNT(*) AS sample_count, round(AVG(temp_c), 6) AS temp_c_mean,
  round(AVG(pressure_mbar), 6) AS pressure_mbar_mean, round(AVG(depth_m), 6) AS depth_m_mean, MIN(depth_m) AS depth_m_min, MAX(depth_m) AS depth_m_max
FROM v_telemetry GROUP BY device_id, time_bucket(INTERVAL '6 hours', ts)""")
def environment_rollup(t: Tables) -> DataFrame:
    out = R.environment_rollup(t.v_telemetry, ["device_id"], width="6 hours")
    out = out.withColumn("start_us", us("window_start")).withColumn("end_us", us("window_end")).drop("window_start", "window_end")
    return _r(out, "temp_c_mean", "pressure_mbar_mean", "depth_m_mean")


@query("A3_burst_mean_max", """
SELECT device_id, epoch_us(time_bucket(INTERVAL '2 hours', ts)) AS tick_us, round(AVG(humidity_pct), 6) AS humidity_pct_mean, MAX(humidity_pct) AS humidity_pct_max
FROM v_telemetry GROUP BY ALL""")
def burst_mean_max(t: Tables) -> DataFrame:
    out = R.burst_mean_max(t.v_telemetry, ["device_id"], "humidity_pct", width="2 hours")
    return _r(out.withColumn("tick_us", us("tick_start")).drop("tick_start"), "humidity_pct_mean")


@query("A4_daily_report", """
SELECT strftime(d.d, '%Y-%m-%d') AS date, COUNT(e.crop_id) AS crops, COUNT(*) FILTER (WHERE e.class_label = 'purchase') AS of_class
FROM generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY) d(d) LEFT JOIN v_crop_event e ON date_trunc('day', e.ts) = d.d GROUP BY 1""")
def daily_report(t: Tables) -> DataFrame:
    out = R.daily_report(t.v_crop_event, "purchase", first="2023-12-28", last="2024-02-05")
    return out.withColumn("date", F.col("date").cast("string"))


@query("A4_daily_report_local", """
SELECT strftime(ts + INTERVAL '1 hour', '%Y-%m-%d') AS date, COUNT(*) AS crops, COUNT(*) FILTER (WHERE class_label = 'view') AS of_class FROM v_crop_event GROUP BY 1""")
def daily_report_local(t: Tables) -> DataFrame:
    return R.daily_report(t.v_crop_event, "view", zone="Europe/Stockholm").withColumn("date", F.col("date").cast("string"))


@query("A6_segmentation_summary", """
SELECT o_orderpriority AS q_batch, o_orderstatus AS f_batch, COUNT(*) AS images, COUNT(*) FILTER (WHERE o_custkey % 4 > 0) AS images_with_roi,
  CAST(SUM(o_custkey % 4) AS BIGINT) AS rois, round(AVG(o_custkey % 100 / 8.0::DOUBLE), 6) AS mean_seconds FROM orders GROUP BY 1, 2""")
def segmentation_summary(t: Tables) -> DataFrame:
    log = t.orders.select(F.col("o_orderpriority").alias("q_batch"), F.col("o_orderstatus").alias("f_batch"), (F.col("o_custkey") % 4).alias("num_crops"),
                          (F.col("o_custkey") % 100 / 8).alias("time_per_image"))
    return _r(R.segmentation_summary(log), "mean_seconds")


@query("A7_label_stats", "SELECT station, class_label, COUNT(*) AS n FROM v_crop_event WHERE class_label IS NOT NULL GROUP BY 1, 2")
def label_stats(t: Tables) -> DataFrame:
    return R.label_stats(t.v_crop_event, "class_label", "station")


@query("A8_queue_report", """
SELECT state, COUNT(*) FILTER (WHERE has_json) AS depth, COUNT(*) FILTER (WHERE has_image) AS images, COUNT(*) FILTER (WHERE has_json AND has_image) AS complete,
  CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(*) FILTER (WHERE has_image) - COUNT(*) FILTER (WHERE has_json) AS images_minus_json FROM v_queue_item GROUP BY state""")
def queue_report(t: Tables) -> DataFrame:
    return R.queue_report(t.v_queue_item)


@query("A9_class_weights", """
SELECT true_label, COUNT(*) AS n, round((SELECT COUNT(*) FROM v_pred_class) / ((SELECT COUNT(DISTINCT true_label) FROM v_pred_class) * COUNT(*)), 6) AS weight FROM v_pred_class GROUP BY 1""")
def class_weights(t: Tables) -> DataFrame:
    return _r(R.class_weights(t.v_pred_class, "true_label"), "weight")


@query("A9_binary_class_weight", "SELECT site, round(COUNT(*) FILTER (WHERE label = 1) / CAST(COUNT(*) FILTER (WHERE label = 0) AS DOUBLE), 6) AS weight_0 FROM v_scores GROUP BY site")
def binary_class_weight(t: Tables) -> DataFrame:
    return _r(R.binary_class_weight(t.v_scores, "label", ["site"]), "weight_0")


@query("A10_image_score_max", "SELECT image_id, MAX(score) AS max_score, COUNT(*) FILTER (WHERE score >= 0.8::DOUBLE) AS tiles_over, MAX(label) AS label FROM v_scores GROUP BY image_id")
def image_score_max(t: Tables) -> DataFrame:
    return R.image_score_max(t.v_scores, "image_id", "score", "label", 0.8)


@query("A11_histogram", """
SELECT site, least(CAST(floor((score - 0.1::DOUBLE) / ((0.9::DOUBLE - 0.1::DOUBLE) / 16)) AS BIGINT), 15) AS bin, COUNT(*) AS n,
  round(0.1::DOUBLE + least(CAST(floor((score - 0.1::DOUBLE) / ((0.9::DOUBLE - 0.1::DOUBLE) / 16)) AS BIGINT), 15) * ((0.9::DOUBLE - 0.1::DOUBLE) / 16), 6) AS bin_start
FROM v_scores WHERE score BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE GROUP BY ALL""")
def histogram(t: Tables) -> DataFrame:
    return _r(R.histogram(t.v_scores, "score", 16, 0.1, 0.9, ["site"]), "bin_start")


@query("A12_timing_summary", """
WITH x AS (SELECT o_orderpriority AS batch, o_custkey % 64 / 64.0::DOUBLE AS read_s, o_orderkey % 32 / 16.0::DOUBLE AS segment_s FROM orders)
SELECT batch, COUNT(*) AS images, round(SUM(read_s) + SUM(segment_s), 6) AS total_s, round(SUM(read_s), 6) AS read_s_total, round(SUM(segment_s), 6) AS segment_s_total,
  round(SUM(read_s) / (SUM(read_s) + SUM(segment_s)), 6) AS read_s_share, round(SUM(segment_s) / (SUM(read_s) + SUM(segment_s)), 6) AS segment_s_share,
  round((SUM(read_s) + SUM(segment_s)) / COUNT(*), 6) AS mean_s, round((SUM(read_s) + SUM(segment_s)) / COUNT(*) * greatest(5000 - COUNT(*), 0), 4) AS remaining_s FROM x GROUP BY batch""")
def timing_summary(t: Tables) -> DataFrame:
    log = t.orders.select(F.col("o_orderpriority").alias("batch"), (F.col("o_custkey") % 64 / 64).alias("read_s"), (F.col("o_orderkey") % 32 / 16).alias("segment_s"))
    out = R.timing_summary(log, ["read_s", "segment_s"], ["batch"], 5000)
    return _r(_r(out, *[c for c in out.columns if c not in ("batch", "images", "remaining_s")]), "remaining_s", digits=4)


@query("A14_dataset_audit", """
SELECT site, COUNT(*) FILTER (WHERE label = 1) AS obs, COUNT(*) FILTER (WHERE label = 0) AS empty, COUNT(DISTINCT image_id) AS originals FROM v_scores GROUP BY site""")
def dataset_audit(t: Tables) -> DataFrame:
    return R.dataset_audit(t.v_scores, ["site"], "label", "image_id")


@query("J6_asof_latest", """
WITH rd AS (SELECT device_id, ts, sample_id, temp_c FROM v_telemetry WHERE leak)
SELECT e.station, e.crop_id, epoch_us(e.ts) AS left_us, CASE WHEN epoch_us(e.ts) - epoch_us(r.ts) <= 7200000000 THEN epoch_us(r.ts) END AS right_us,
  CASE WHEN epoch_us(e.ts) - epoch_us(r.ts) <= 7200000000 THEN r.sample_id END AS sample_id, CASE WHEN epoch_us(e.ts) - epoch_us(r.ts) <= 7200000000 THEN r.temp_c END AS temp_c
FROM v_crop_event e ASOF LEFT JOIN rd r ON e.station = r.device_id AND e.ts >= r.ts""")
def asof_latest(t: Tables) -> DataFrame:
    readings = t.v_telemetry.filter("leak").withColumnRenamed("device_id", "station")
    return J.asof_latest(t.v_crop_event, readings, ["station"], "ts", "crop_id", ["sample_id", "temp_c"], "sample_id", max_age_s=2 * HOUR)


@query("W1_rolling_24h", """
SELECT crop_id, station, COUNT(*) OVER (PARTITION BY station ORDER BY ts RANGE BETWEEN INTERVAL '24 hours' PRECEDING AND CURRENT ROW) AS crops_24h FROM v_crop_event""")
def rolling_24h(t: Tables) -> DataFrame:
    return S.rolling_count(t.v_crop_event, ["station"]).select("crop_id", "station", "crops_24h")


STREAK = """
isl AS (SELECT *, SUM(CASE WHEN coalesce(leak, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY ts, sample_id) AS island FROM v_telemetry),
streak AS (SELECT *, SUM(CASE WHEN coalesce(leak, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, island ORDER BY ts, sample_id) AS streak FROM isl)"""


@query("W2_leak_tier1", f"WITH {STREAK} SELECT sample_id, device_id, CAST(streak AS BIGINT) AS streak, streak >= 2 AS fires FROM streak")
def leak_tier1(t: Tables) -> DataFrame:
    return S.leak_streak(t.v_telemetry, ["device_id"], "ts", "sample_id", 2).select("sample_id", "device_id", "streak", "fires")


TREND = """
dew AS (SELECT *, ln(humidity_pct / 100) + 17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c) AS alpha FROM v_telemetry),
dewp AS (SELECT *, 243.12::DOUBLE * alpha / (17.62::DOUBLE - alpha) AS dp FROM dew),
hist AS (SELECT *, epoch_us(ts) - MIN(epoch_us(ts)) OVER w AS span, dp - first_value(dp IGNORE NULLS) OVER w AS rise,
  abs(pressure_mbar - first_value(pressure_mbar IGNORE NULLS) OVER w) AS shift FROM dewp
  WINDOW w AS (PARTITION BY device_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)),
trend AS (SELECT *, coalesce(span >= 10800000000 AND rise >= 0.6::DOUBLE AND shift >= 9.74::DOUBLE, FALSE) AS fires FROM hist)"""


@query("W3_leak_tier2", f"""WITH {TREND} SELECT sample_id, CASE WHEN span >= 10800000000 THEN round(rise, 6) END AS dew_rise,
  CASE WHEN span >= 10800000000 THEN round(shift, 6) END AS pressure_shift, fires FROM trend""")
def leak_tier2(t: Tables) -> DataFrame:
    out = S.leak_trend(t.v_telemetry, ["device_id"], "ts", 6 * HOUR).select("sample_id", "dew_rise", "pressure_shift", "fires")
    return _r(out, "dew_rise", "pressure_shift")


@query("W4_alert_cooldown", f"""
WITH RECURSIVE {STREAK}, {TREND},
ticks AS (SELECT s.device_id, s.sample_id, epoch_us(s.ts) AS t, s.streak >= 2 AS crit, t.fires AS warn,
  row_number() OVER (PARTITION BY s.device_id ORDER BY s.ts, s.sample_id) AS n FROM streak s JOIN trend t ON t.sample_id = s.sample_id WHERE s.streak >= 2 OR t.fires),
walk AS (SELECT DISTINCT device_id, CAST(NULL AS BIGINT) AS sample_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lc, CAST(NULL AS BIGINT) AS lw, CAST(NULL AS VARCHAR) AS tier FROM ticks
 UNION ALL
 SELECT w.device_id, k.sample_id, k.n, CASE WHEN k.crit AND (w.lc IS NULL OR k.t - w.lc >= 43200000000) THEN k.t ELSE w.lc END,
   CASE WHEN NOT (k.crit AND (w.lc IS NULL OR k.t - w.lc >= 43200000000)) AND k.warn AND (w.lw IS NULL OR k.t - w.lw >= 43200000000) THEN k.t ELSE w.lw END,
   CASE WHEN k.crit AND (w.lc IS NULL OR k.t - w.lc >= 43200000000) THEN 'critical' WHEN k.warn AND (w.lw IS NULL OR k.t - w.lw >= 43200000000) THEN 'warning' END
 FROM walk w JOIN ticks k ON k.device_id = w.device_id AND k.n = w.n + 1)
SELECT device_id, sample_id, tier FROM walk WHERE tier IS NOT NULL""")
def alert_cooldown(t: Tables) -> DataFrame:
    return S.leak_alerts(t.v_telemetry, ["device_id"], "ts", "sample_id", 2, 6 * HOUR, 12 * HOUR)


@query("W5_stage_alerts", """
WITH RECURSIVE b AS (SELECT stage, event_id, epoch_us(ts) AS t, age_s >= 30 AS stale, row_number() OVER (PARTITION BY stage ORDER BY ts, event_id) AS n FROM v_heartbeat),
walk AS (SELECT DISTINCT stage, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, 0 AS run, FALSE AS down, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS event FROM b
 UNION ALL
 SELECT w.stage, b.event_id, b.n, CASE WHEN b.stale THEN w.run + 1 ELSE 0 END,
  CASE WHEN NOT b.stale THEN FALSE WHEN w.down THEN TRUE ELSE w.run + 1 >= 2 AND (w.last IS NULL OR b.t - w.last >= 1800000000) END,
  CASE WHEN b.stale AND NOT w.down AND w.run + 1 >= 2 AND (w.last IS NULL OR b.t - w.last >= 1800000000) THEN b.t ELSE w.last END,
  CASE WHEN NOT b.stale AND w.down THEN 'up' WHEN b.stale AND NOT w.down AND w.run + 1 >= 2 AND (w.last IS NULL OR b.t - w.last >= 1800000000) THEN 'down' END
 FROM walk w JOIN b ON b.stage = w.stage AND b.n = w.n + 1)
SELECT stage, event_id, event FROM walk WHERE event IS NOT NULL""")
def stage_alerts(t: Tables) -> DataFrame:
    return S.stage_alerts(t.v_heartbeat, ["stage"], "ts", "event_id")


@query("W6_system_mode", """
SELECT sample_id, coalesce(last_value(CASE WHEN sample_id * 7919 % 1000 > 900 THEN 'backlog' WHEN sample_id * 7919 % 1000 < 100 THEN 'live' END IGNORE NULLS)
  OVER (PARTITION BY device_id ORDER BY ts, sample_id), 'live') AS mode FROM v_telemetry""")
def system_mode(t: Tables) -> DataFrame:
    rows = t.v_telemetry.withColumn("backlog", F.col("sample_id") * 7919 % 1000)
    return S.system_mode(rows, ["device_id"], "ts", "sample_id", "backlog", 900, 100).select("sample_id", "mode")


def _ratio_sql(feature: str, priors: int, threshold: float, prime: int, first: str) -> str:
    return f"""
WITH m AS (SELECT sample_id, CAST({feature} AS DOUBLE) AS v, row_number() OVER (PARTITION BY device_id ORDER BY ts, sample_id) AS n,
  median(CAST({feature} AS DOUBLE)) OVER (PARTITION BY device_id ORDER BY ts, sample_id ROWS BETWEEN {priors} PRECEDING AND 1 PRECEDING) AS med FROM v_telemetry),
r AS (SELECT *, CASE WHEN med IS NULL THEN {first} WHEN med = 0 THEN CASE WHEN v > 0 THEN 'Infinity'::DOUBLE ELSE 1 END ELSE v / med END AS ratio FROM m)
SELECT sample_id, round(ratio, 6) AS ratio, coalesce(ratio > {threshold}::DOUBLE AND n > {prime}, FALSE) AS is_obs FROM r"""


def _ratio(t: Tables, feature: str, priors: int, threshold: float, prime: int = 0, first: float | None = 1.0) -> DataFrame:
    out = S.median_ratio(t.v_telemetry, ["device_id"], ["ts", "sample_id"], feature, priors, threshold, prime, first, block_rows=400)
    return _r(out.select("sample_id", "ratio", "is_obs"), "ratio")


@query("W7_median_ratio_20", _ratio_sql("humidity_pct", 19, 1.021, 0, "NULL"))
def median_ratio_20(t: Tables) -> DataFrame:
    return _ratio(t, "humidity_pct", 19, 1.021, first=None)


@query("W7_median_ratio_100", _ratio_sql("humidity_pct", 99, 1.014, 0, "1"))
def median_ratio_100(t: Tables) -> DataFrame:
    return _ratio(t, "humidity_pct", 99, 1.014)


@query("W7_median_ratio_primed", _ratio_sql("depth_m", 100, 1.3, 100, "1"))
def median_ratio_primed(t: Tables) -> DataFrame:
    return _ratio(t, "depth_m", 100, 1.3, prime=100)


@query("W7_median_ratio_two", """
WITH m AS (SELECT sample_id, humidity_pct, pressure_mbar, median(humidity_pct) OVER w AS a, median(pressure_mbar) OVER w AS b FROM v_telemetry
  WINDOW w AS (PARTITION BY device_id ORDER BY ts, sample_id ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING))
SELECT sample_id, coalesce(humidity_pct / a > 1.014::DOUBLE AND pressure_mbar / b > 1.001::DOUBLE, FALSE) AS is_obs FROM m""")
def median_ratio_two(t: Tables) -> DataFrame:
    from tidewrack.operators.ordering import rank_rows

    rows = rank_rows(t.v_telemetry, ["device_id"], ["ts", "sample_id"], "_row")
    a = S.median_ratio(rows, ["device_id"], [], "humidity_pct", 99, 1.014, block_rows=400, name="ra", rank="_row").withColumnRenamed("is_obs", "oa")
    b = S.median_ratio(a, ["device_id"], [], "pressure_mbar", 99, 1.001, block_rows=400, name="rb", rank="_row")
    return b.select("sample_id", (F.col("oa") & F.col("is_obs")).alias("is_obs"))


DETRENDED = """
SELECT sample_id, round(humidity_pct - median(humidity_pct) OVER (PARTITION BY device_id ORDER BY ts
  RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND INTERVAL '6 hours' FOLLOWING), 6) AS residual FROM v_telemetry"""


@query("W8_detrend", DETRENDED)
def detrend(t: Tables) -> DataFrame:
    return _r(S.detrend(t.v_telemetry, ["device_id"], "ts", "humidity_pct", 12 * HOUR).select("sample_id", "residual"), "residual")


@query("W9_windowed_rise", """
SELECT sample_id, CASE WHEN epoch_us(ts) - MIN(epoch_us(ts)) OVER w >= 10800000000 THEN round(pressure_mbar - first_value(pressure_mbar) OVER w, 6) END AS rise
FROM v_telemetry WINDOW w AS (PARTITION BY device_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)""")
def windowed_rise(t: Tables) -> DataFrame:
    return _r(S.windowed_rise(t.v_telemetry, ["device_id"], "ts", "pressure_mbar", 6 * HOUR).select("sample_id", "rise"), "rise")


RANGES = {"humidity_pct": (0.0, 100.0), "temp_c": (-10.0, 60.0), "pressure_mbar": (300.0, 1100.0)}


@query("W10_calibrate_thresholds", """
WITH d AS (SELECT device_id, ts, temp_c, humidity_pct, pressure_mbar, ln(humidity_pct / 100) + 17.62::DOUBLE * temp_c / (243.12::DOUBLE + temp_c) AS alpha FROM v_telemetry
  WHERE humidity_pct BETWEEN 0 AND 100 AND temp_c BETWEEN -10 AND 60 AND pressure_mbar BETWEEN 300 AND 1100),
s AS (SELECT device_id, ts, 'pressure' AS signal, pressure_mbar AS v FROM d UNION ALL SELECT device_id, ts, 'temperature', temp_c FROM d
  UNION ALL SELECT device_id, ts, 'dew_point', 243.12::DOUBLE * alpha / (17.62::DOUBLE - alpha) FROM d),
m AS (SELECT *, v - median(v) OVER (PARTITION BY device_id, signal ORDER BY ts RANGE BETWEEN INTERVAL '43199999999 microseconds' PRECEDING AND INTERVAL '12 hours' FOLLOWING) AS res FROM s),
r AS (SELECT *, epoch_us(ts) - MIN(epoch_us(ts)) OVER w >= 10800000000 AS ok, res - first_value(res) OVER w AS rise, v - first_value(v) OVER w AS raw FROM m
  WINDOW w AS (PARTITION BY device_id, signal ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW))
SELECT device_id, signal, COUNT(*) AS rows, round((MAX(epoch_us(ts)) - MIN(epoch_us(ts))) / 3.6e9, 6) AS hours,
  round(quantile_cont(abs(CASE WHEN ok THEN rise END), 0.995) * 2, 6) AS threshold, round(quantile_cont(abs(CASE WHEN ok THEN raw END), 0.995) * 2, 6) AS threshold_raw,
  COUNT(*) >= 100 AS enough_rows, (MAX(epoch_us(ts)) - MIN(epoch_us(ts))) / 3.6e9 >= 4 AS enough_hours FROM r GROUP BY device_id, signal""")
def calibrate_thresholds(t: Tables) -> DataFrame:
    return _r(S.calibrate_thresholds(t.v_telemetry, ["device_id"], "ts", RANGES, 6 * HOUR), "hours", "threshold", "threshold_raw")


LEAK_LOG = """
lg AS (SELECT device_id, epoch_us(ts) / 1e6 - 1704067200 AS t, CASE WHEN device_id % 4 = 3 THEN 100500 + sample_id * 13 % 900 - (epoch_us(ts) / 1e6 - 1704067200) * 0.008::DOUBLE
    ELSE 60000 + (epoch_us(ts) / 1e6 - 1704067200) * 0.015::DOUBLE * (1 + device_id) / 4 + sample_id * 13 % 100 END AS p_int,
  101325 + sample_id * 7 % 50 AS p_ext, temp_c, CASE WHEN device_id % 4 = 2 THEN NULL WHEN device_id = 5 THEN 9000000 ELSE 86400 * device_id END AS mark FROM v_telemetry)"""


@query("W11_leak_rate_fit", f"""
WITH {LEAK_LOG},
fl AS (SELECT *, coalesce(t >= mark + 300, FALSE) AND temp_c IS NOT NULL AS settled,
  coalesce(t >= mark + 300 AND temp_c BETWEEN -10 AND 60 AND p_int BETWEEN 30000 AND 110000 AND p_ext BETWEEN 80000 AND 120000, FALSE) AS ok FROM lg),
hd AS (SELECT device_id, COUNT(*) FILTER (WHERE ok) AS n_points, COUNT(*) FILTER (WHERE settled AND NOT ok) AS n_rejected, MAX(mark) AS mark, MAX(t) FILTER (WHERE ok) AS t_end,
  arg_min(temp_c, t) FILTER (WHERE ok) + 273.15::DOUBLE AS k0, arg_min(p_ext - p_int, t) FILTER (WHERE ok) AS d0, MIN(t) FILTER (WHERE ok) AS t0 FROM fl GROUP BY device_id),
pt AS (SELECT f.device_id, f.t - h.t0 AS x, f.p_int * (h.k0 / (f.temp_c + 273.15::DOUBLE)) AS pc, f.p_ext, h.d0 FROM fl f JOIN hd h ON h.device_id = f.device_id WHERE f.ok AND h.n_points >= 5),
ft AS (SELECT device_id, COUNT(*) AS n_in_fit, regr_slope(CASE WHEN d0 > 0 THEN ln(p_ext - pc) END, x) AS b, regr_intercept(CASE WHEN d0 > 0 THEN ln(p_ext - pc) END, x) AS a,
  regr_slope(pc, x) AS lin FROM pt WHERE d0 <= 0 OR p_ext - pc >= 0.3::DOUBLE * d0 GROUP BY device_id),
sl AS (SELECT h.*, f.n_in_fit, coalesce(d0 > 0 AND n_in_fit >= 5 AND b < 0, FALSE) AS expo, CASE WHEN coalesce(d0 > 0 AND n_in_fit >= 5 AND b < 0, FALSE) THEN exp(a) * -b ELSE lin END * 60 AS slope
  FROM hd h LEFT JOIN ft f ON f.device_id = h.device_id)
SELECT device_id, CASE WHEN mark IS NULL THEN 'NOT_STARTED' WHEN n_points < 5 THEN 'COLLECTING' WHEN abs(slope / 3386.389::DOUBLE) <= 1.0::DOUBLE / 15 THEN 'PASS' ELSE 'FAIL' END AS verdict,
  n_points, n_rejected, n_in_fit, CASE WHEN n_points >= 5 THEN CASE WHEN expo THEN 'exponential' ELSE 'linear' END END AS fit_kind, round(CASE WHEN n_points >= 5 THEN (t_end - mark) / 3600 END, 4) AS test_hours,
  round(slope, 6) AS pa_per_min, round(slope / 3386.389::DOUBLE, 9) AS inhg_per_min, round(0.02::DOUBLE / (8.314462618::DOUBLE * k0) * slope, 9) AS mol_per_min,
  round(0.02::DOUBLE / (8.314462618::DOUBLE * k0) * slope * 8.314462618::DOUBLE * 293.15::DOUBLE / 101325 * 1e6, 4) AS cm3_per_min FROM sl""")
def leak_rate_fit(t: Tables) -> DataFrame:
    d, sec = F.col("device_id"), us("ts") / 1e6 - 1704067200
    log = t.v_telemetry.select(
        "device_id", sec.alias("t"),
        F.when(d % 4 == 3, 100500 + F.col("sample_id") * 13 % 900 - sec * 0.008)
        .otherwise(60000 + sec * 0.015 * (1 + d) / 4 + F.col("sample_id") * 13 % 100).alias("p_int"),
        (101325 + F.col("sample_id") * 7 % 50).alias("p_ext"), "temp_c",
        F.when(d % 4 == 2, None).when(d == 5, 9000000).otherwise(86400 * d).alias("mark"))
    out = S.leak_rate_fit(log, ["device_id"], "t", "p_int", "p_ext", "temp_c", "mark", 300.0, 20.0)
    out = _r(_r(out, "test_hours", "cm3_per_min", digits=4), "inhg_per_min", "mol_per_min", digits=9)
    return _r(out, "pa_per_min")


@query("W12_catch_up_eta", """
WITH a AS (SELECT o_orderpriority AS k, SUM(o_custkey % 5) / 36000.0::DOUBLE AS a FROM orders GROUP BY 1),
r AS (SELECT o_orderpriority AS k, SUM(o_orderkey % 5) / 36000.0::DOUBLE AS r FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
b AS (SELECT o_orderpriority AS k, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS backlog FROM orders GROUP BY 1)
SELECT a.k AS station, CASE WHEN r IS NOT NULL AND a > 0 THEN round(a * 3600, 6) END AS analyse_rate_per_hour, CASE WHEN a > 0 THEN round(r * 3600, 6) END AS record_rate_per_hour,
  CASE WHEN r IS NOT NULL AND a > 0 THEN a - r > 0 END AS catching_up, CASE WHEN a > 0 AND a - r > 0 THEN round(backlog / (a - r) / 3600, 6) END AS eta_hours
FROM a LEFT JOIN r ON r.k = a.k LEFT JOIN b ON b.k = a.k""")
def catch_up_eta(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_orderpriority", "station").withColumn("elapsed_s", F.lit(36000.0))
    analyse = o.withColumn("done", F.col("o_custkey") % 5)
    record = o.filter(F.col("station") != "5-LOW").withColumn("done", F.col("o_orderkey") % 5)
    backlog = o.groupBy("station").agg(F.count_if(F.col("o_orderstatus") == "O").alias("backlog"))
    return _r(R.catch_up(record, analyse, backlog, "station"), "analyse_rate_per_hour", "record_rate_per_hour", "eta_hours")


@query("W12_drain_status", """
WITH x AS (SELECT state, COUNT(*) FILTER (WHERE upload_attempts < 20) AS sent, COUNT(*) FILTER (WHERE upload_attempts BETWEEN 20 AND 24) AS archived,
  COUNT(*) FILTER (WHERE upload_attempts BETWEEN 25 AND 29) AS failed FROM v_queue_item GROUP BY state)
SELECT state, 4000 AS total_initial, sent, archived, failed, greatest(4000 - sent - archived - failed, 0) AS remaining, round((sent + archived) / 7200.0::DOUBLE * 3600, 6) AS rate_per_hour,
  round(greatest(4000 - sent - archived - failed, 0) / nullif((sent + archived) / 7200.0::DOUBLE * 3600, 0), 6) AS eta_hours FROM x""")
def drain_status(t: Tables) -> DataFrame:
    n = F.col("upload_attempts")
    items = t.v_queue_item.withColumns({
        "outcome": F.when(n < 20, "sent").when(n < 25, "archived").when(n < 30, "failed"), "total": F.lit(4000), "elapsed": F.lit(7200.0)})
    return _r(R.drain_status(items, ["state"], "total", "elapsed"), "rate_per_hour", "eta_hours")


@query("W12_backlog_stages", """
WITH q AS (SELECT o_orderpriority AS station, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS position, length(o_orderpriority) % 3 AS active, COUNT(*) AS waiting, CAST(SUM(o_custkey % 3) AS BIGINT) AS processed FROM orders GROUP BY 1, 2, 3)
SELECT station, position, CASE WHEN position < active THEN 'done' WHEN position = active THEN 'active' ELSE 'pending' END AS status, CASE WHEN position < active THEN 0 WHEN position = active THEN waiting END AS remaining,
  CASE WHEN position = active THEN round(processed / 7200.0::DOUBLE * 3600, 6) END AS rate_per_hour, CASE WHEN position = active THEN round(waiting / (processed / 7200.0::DOUBLE * 3600), 6) END AS eta_hours FROM q""")
def backlog_stages(t: Tables) -> DataFrame:
    place = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    stages = t.orders.groupBy(F.col("o_orderpriority").alias("station"), place.alias("position"), (F.length("o_orderpriority") % 3).alias("active")).agg(
        F.count(F.lit(1)).alias("waiting"), F.sum(F.col("o_custkey") % 3).alias("processed")).withColumn("elapsed_s", F.lit(7200.0))
    out = R.backlog_stages(stages).select("station", "position", "status", "remaining", "rate_per_hour", "eta_hours")
    return _r(out, "rate_per_hour", "eta_hours")


@query("W13_upload_health", """
WITH a AS (SELECT station, crop_id, epoch_us(ts) AS t, crop_id % 5 < 2 AS ok, crop_id * 17 % 9000 AS bytes, CASE WHEN crop_id % 10 = 0 THEN 0.0::DOUBLE ELSE crop_id % 9 + 0.5::DOUBLE END AS seconds FROM v_crop_event),
g AS (SELECT station, arg_max(ok, (t, crop_id)) AS last_ok, MAX(t) AS last_attempt_us, MAX(t) FILTER (WHERE ok) AS last_success_us,
  round(arg_max(bytes / seconds, (t, crop_id)) FILTER (WHERE ok AND seconds > 0), 6) AS last_speed_bps FROM a GROUP BY station)
SELECT g.*, (SELECT COUNT(*) FROM a WHERE a.station = g.station AND NOT a.ok AND (g.last_success_us IS NULL OR a.t > g.last_success_us)) AS consecutive_failures FROM g""")
def upload_health(t: Tables) -> DataFrame:
    n = F.col("crop_id")
    a = t.v_crop_event.select("station", "crop_id", "ts", (n % 5 < 2).alias("ok"), (n * 17 % 9000).alias("bytes"),
                              F.when(n % 10 == 0, 0.0).otherwise(n % 9 + 0.5).alias("seconds"))
    return _r(R.upload_health(a, ["station"], "ts", "crop_id"), "last_speed_bps")


@query("W14_batch_number", """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY path) - 1 AS i FROM v_file), q AS (SELECT doc_id, i, i // 64 AS q_batch FROM n), c AS (SELECT q_batch, COUNT(*) AS len FROM q GROUP BY 1)
SELECT doc_id, q.q_batch, (i - q.q_batch * 64) // greatest(CAST(floor(len * 0.1::DOUBLE) AS BIGINT), 1) AS f_batch FROM q JOIN c ON c.q_batch = q.q_batch""")
def batch_number(t: Tables) -> DataFrame:
    return S.batch_numbers(t.v_file, ["path"], 64).select("doc_id", "q_batch", "f_batch")


@query("W15_config_changes", """
WITH c AS (SELECT station, snapshot_no, k, MAX(v) AS v FROM v_config GROUP BY 1, 2, 3),
s AS (SELECT station, snapshot_no, row_number() OVER (PARTITION BY station ORDER BY snapshot_no) AS n FROM (SELECT DISTINCT station, snapshot_no FROM c) q)
SELECT c.station, c.snapshot_no, c.k, CASE WHEN s.n = 1 THEN 'baseline' ELSE 'change' END AS kind, p.v AS old, c.v AS new
FROM c JOIN s ON s.station = c.station AND s.snapshot_no = c.snapshot_no LEFT JOIN s sp ON sp.station = s.station AND sp.n = s.n - 1
LEFT JOIN c p ON p.station = c.station AND p.snapshot_no = sp.snapshot_no AND p.k = c.k WHERE s.n = 1 OR c.v IS DISTINCT FROM p.v""")
def config_changes(t: Tables) -> DataFrame:
    snaps = t.v_config.groupBy("station", "snapshot_no", "k").agg(F.max("v").alias("v"))
    return S.config_changes(snaps, "station", "snapshot_no", "k", "v")


@query("W16_thin_by_interval", """
WITH RECURSIVE e AS (SELECT device_id, MIN(epoch_us(ts)) AS t FROM v_telemetry GROUP BY device_id
  UNION ALL SELECT w.device_id, (SELECT MIN(epoch_us(v.ts)) FROM v_telemetry v WHERE v.device_id = w.device_id AND epoch_us(v.ts) >= w.t + 7200000000) FROM e w WHERE w.t IS NOT NULL)
SELECT device_id, sample_id FROM (SELECT v.device_id, v.sample_id, row_number() OVER (PARTITION BY v.device_id ORDER BY v.ts) AS n FROM v_telemetry v JOIN e ON e.device_id = v.device_id AND e.t = epoch_us(v.ts)) q WHERE n <= 100""")
def thin_by_interval(t: Tables) -> DataFrame:
    return S.thin_by_interval(t.v_telemetry, ["device_id"], "ts", "sample_id", 2 * HOUR, target=100).select("device_id", "sample_id")


@query("W17_keep_every_nth", """
SELECT sample_id FROM (SELECT sample_id, temp_c, row_number() OVER (PARTITION BY device_id ORDER BY ts, sample_id) AS n FROM v_telemetry) q WHERE n % 3 = 0 AND temp_c IS NOT NULL""")
def keep_every_nth(t: Tables) -> DataFrame:
    return S.keep_every_nth(t.v_telemetry, ["device_id"], ["ts", "sample_id"], 3, F.col("temp_c").isNotNull()).select("sample_id")


@query("W18_prune_oldest", """
WITH c AS (SELECT stem, bytes, SUM(bytes) OVER (ORDER BY mtime, stem) - bytes AS before, SUM(bytes) OVER () AS total FROM v_queue_item)
SELECT stem, bytes FROM c WHERE total > 100000000 AND before < total - 50000000""")
def prune_oldest(t: Tables) -> DataFrame:
    return S.prune_oldest(t.v_queue_item, "mtime", "stem", "bytes", 100_000_000, 50_000_000).select("stem", "bytes")


@query("W19_retry_policy", """
SELECT stem, CASE WHEN bytes > 300000 THEN 'archived' WHEN NOT has_json THEN 'failed' WHEN upload_attempts + 1 >= 50 THEN 'failed' ELSE 'requeued' END AS action,
  CASE WHEN bytes <= 300000 AND has_json AND upload_attempts + 1 < 50 THEN upload_attempts + 1 END AS next_attempts FROM v_queue_item""")
def retry_policy(t: Tables) -> DataFrame:
    return S.retry_policy(t.v_queue_item, "bytes", F.col("has_json"), "upload_attempts", 300_000).select("stem", "action", "next_attempts")


@query("W20_live_snapshot", """
WITH d AS (SELECT device_id, MAX(epoch_us(ts)) AS t, arg_max(temp_c, (ts, sample_id)) AS temp_c, arg_max(leak, (ts, sample_id)) AS leak FROM (SELECT * FROM v_telemetry WHERE temp_c IS NOT NULL AND leak IS NOT NULL) q GROUP BY 1),
e AS (SELECT device_id, MAX(epoch_us(ts)) AS t, arg_max(pressure_mbar, (ts, sample_id)) AS pressure_mbar, arg_max(depth_m, (ts, sample_id)) AS depth_m FROM v_telemetry WHERE depth_m > 20 GROUP BY 1)
SELECT coalesce(d.device_id, e.device_id) AS device_id, temp_c, leak, pressure_mbar, depth_m, greatest(d.t, e.t) AS updated_us FROM d FULL JOIN e ON e.device_id = d.device_id""")
def live_snapshot(t: Tables) -> DataFrame:
    v = t.v_telemetry
    return R.live_snapshot(v.filter("temp_c IS NOT NULL AND leak IS NOT NULL"), v.filter("depth_m > 20"), ["device_id"], "ts", ["temp_c", "leak"], ["pressure_mbar", "depth_m"], "sample_id")
