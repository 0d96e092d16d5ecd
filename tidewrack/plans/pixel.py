"""Queries on frames: backgrounds, tone, thresholds, features and errors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import arrays as A
from tidewrack.operators import pixels as X
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables

# grey values 0..255 of the stand-in frames, one row per pixel
PX = """p AS (SELECT frame_id, site, i, greatest(0, least(255, floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 200))) AS v
  FROM (SELECT frame_id, site, unnest(px) AS e, generate_subscripts(px, 1) - 1 AS i FROM v_frame) u)"""
SIDE = 8


def frames(t: Tables) -> DataFrame:
    grey = F.transform("px", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") + 0.6) * 200).cast("double"))))
    return t.v_frame.select("frame_id", "site", grey.alias("px"))


def _pixels(df: DataFrame, col: str, *keep: str, digits: int | None = None) -> DataFrame:
    out = df.select(*(keep or ("frame_id",)), F.posexplode(col).alias("i", "v"))
    return out if digits is None else out.withColumn("v", F.round("v", digits))


def _bg(t: Tables) -> DataFrame:
    """Mean background of each frame's site as an array."""
    return X.arrays_from_rows(X.mean_background(frames(t)), ["site"], "bg", "bg")


@query("F1_ema_background", f"""
WITH RECURSIVE {PX}, o AS (SELECT *, row_number() OVER (PARTITION BY site, i ORDER BY frame_id) AS n FROM p),
w AS (SELECT site, i, frame_id, n, v, v AS bg FROM o WHERE n = 1
  UNION ALL SELECT o.site, o.i, o.frame_id, o.n, o.v, 0.25::DOUBLE * o.v + 0.75::DOUBLE * w.bg FROM w JOIN o ON o.site = w.site AND o.i = w.i AND o.n = w.n + 1)
SELECT site, frame_id, i, round(bg, 6) AS bg, CAST(floor(least(greatest(v - bg, 0), 100)) AS BIGINT) AS corrected FROM w""")
def ema_background(t: Tables) -> DataFrame:
    found = X.ema_background(frames(t), 0.25, 100.0, chunk=48)
    return X.pixel_values(found, ["site", "frame_id"], ["bg", "corrected"]).withColumn("bg", F.round("bg", 6))


@query("F2_median_background", f"WITH {PX} SELECT site, i, CAST(floor(median(v)) AS INT) AS bg FROM p GROUP BY site, i")
def median_background(t: Tables) -> DataFrame:
    return X.median_background(frames(t), "site")


@query("F3_sliding_median_background", f"""WITH {PX}, m AS (SELECT *, median(v) OVER w AS bg, COUNT(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY site, i ORDER BY frame_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT site, frame_id, i, bg, v - bg AS diff FROM m WHERE k = 5""")
def sliding_median_background(t: Tables) -> DataFrame:
    return X.pixel_values(X.sliding_median_background(frames(t), 2, block=64), ["site", "frame_id"], ["bg", "diff"])


@query("F4_mean_background", f"WITH {PX} SELECT site, i, CAST(floor(AVG(v)) AS INT) AS bg FROM p GROUP BY site, i")
def mean_background(t: Tables) -> DataFrame:
    return X.mean_background(frames(t))


@query("F5_prior_median_background", f"""WITH {PX}, m AS (SELECT *, median(v) OVER w AS m, COUNT(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY site, i ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT site, frame_id, i, CASE WHEN k = 10 THEN m END AS bg, CAST(floor(least(greatest(v - CASE WHEN k = 10 THEN m ELSE 0 END, 0), 255)) AS INT) AS diff FROM m""")
def prior_median_background(t: Tables) -> DataFrame:
    return X.pixel_values(X.prior_median_background(frames(t), 10, block=64), ["site", "frame_id"], ["bg", "diff"])


BG = f"""{PX}, b AS (SELECT site, i, floor(AVG(v)) AS bg FROM p GROUP BY site, i)"""
_MODES = {"subtract": "v - bg", "divide": "v / (bg + 0.000001::DOUBLE)", "hybrid": "(v - bg) / (bg + 0.000001::DOUBLE)"}


@query("F6_subtract", f"WITH {BG}," + ", ".join(f"""
raw_{m} AS (SELECT p.frame_id, p.i, {e} AS x FROM p JOIN b ON b.site = p.site AND b.i = p.i),
fin_{m} AS (SELECT frame_id, i, x, MIN(x) OVER (PARTITION BY frame_id) AS lo, MAX(x) OVER (PARTITION BY frame_id) AS hi FROM raw_{m})""" for m, e in _MODES.items()) + " UNION ALL ".join(
    f"\nSELECT '{m}' AS mode, frame_id, i, CAST(floor((x - lo) * (255.0::DOUBLE / (hi - lo))) AS INT) AS v FROM fin_{m}" for m in _MODES))
def subtract(t: Tables) -> DataFrame:
    rows = frames(t).join(_bg(t), "site")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), A.subtract("px", "bg", m).alias("v")) for m in _MODES])
    return rows.select("frame_id", F.explode(modes).alias("_m")).select("frame_id", "_m.mode", F.posexplode("_m.v").alias("i", "v"))


@query("F7_tone", f"""WITH {BG} SELECT p.frame_id, p.i, CAST(round_even(least(greatest(pow(least(greatest(v - floor(bg / 2), 1), 200) / 200.0::DOUBLE, 0.7::DOUBLE) * 1.2::DOUBLE, 0), 1) * 255, 0) AS INT) AS v
FROM p JOIN b ON b.site = p.site AND b.i = p.i""")
def tone(t: Tables) -> DataFrame:
    rows = frames(t).join(_bg(t), "site").withColumn("dark", F.transform("bg", lambda b: F.floor(b / 2).cast("double")))
    return _pixels(rows.withColumn("v", A.tone("px", "dark", 200.0, 0.7, 1.2)), "v")


@query("F8_to_u8", f"WITH {PX} SELECT frame_id, i, CAST(floor(least(greatest(v / 180.0::DOUBLE * 255, 0), 255)) AS INT) AS v FROM p")
def to_u8(t: Tables) -> DataFrame:
    return _pixels(frames(t).withColumn("v", A.to_u8("px", 180.0)), "v")


@query("F9_mean_std_threshold", f"WITH {PX}, s AS (SELECT frame_id, AVG(v) + stddev_pop(v) AS bar FROM p GROUP BY frame_id) SELECT p.frame_id, i, CASE WHEN v > bar THEN 255 ELSE 0 END AS v FROM p JOIN s ON s.frame_id = p.frame_id")
def mean_std_threshold(t: Tables) -> DataFrame:
    return _pixels(frames(t).withColumn("v", A.mean_std_threshold("px")), "v")


@query("F10_frame_features", f"""WITH {PX}, c AS (SELECT frame_id, v, COUNT(*) AS n FROM p GROUP BY frame_id, v), t AS (SELECT frame_id, SUM(n) AS total FROM c GROUP BY frame_id)
SELECT c.frame_id, round(SUM((floor(v / 4) + 0.5::DOUBLE) * 4 * n) / MAX(total), 6) AS hist_mean, round(-SUM(n / total::DOUBLE * log2(n / total::DOUBLE)), 6) + 0 AS entropy, round(SUM(v * n) / MAX(total), 6) AS brightness
FROM c JOIN t ON t.frame_id = c.frame_id GROUP BY c.frame_id""")
def frame_features(t: Tables) -> DataFrame:
    out = X.frame_features(frames(t), ["frame_id"])
    return out.select("frame_id", *[F.round(c, 6).alias(c) for c in ("hist_mean", "entropy", "brightness")])


@query("F10_fft_ring_mean")
def fft_ring_mean(t: Tables) -> DataFrame:
    return frames(t).select("frame_id", F.round(A.fft_ring_mean(SIDE, SIDE, 1.0, 3.5)("px"), 6).alias("fft_mean"))


@query("F11_recon_error", f"""WITH {BG}, d AS (SELECT p.frame_id, p.i // 8 AS r, p.i % 8 AS c, v - bg AS e, v FROM p JOIN b ON b.site = p.site AND b.i = p.i), m AS (SELECT frame_id, AVG(v) AS mv, AVG(e * e) AS mse FROM d GROUP BY frame_id),
w AS (SELECT a.frame_id, a.r, a.c, SUM(x.v * x.v) / 25 AS k, SUM((x.v - m.mv) * (x.v - m.mv)) / 25 AS km FROM d a JOIN m ON m.frame_id = a.frame_id JOIN d x ON x.frame_id = a.frame_id AND x.r BETWEEN a.r - 4 AND a.r AND x.c BETWEEN a.c - 4 AND a.c
  WHERE a.r >= 4 AND a.c >= 4 GROUP BY a.frame_id, a.r, a.c)
SELECT w.frame_id, round(MAX(m.mse), 6) AS recon_error, round(MAX(k), 4) AS peak_error, round(MAX(km), 4) AS peak_error_centred FROM w JOIN m ON m.frame_id = w.frame_id GROUP BY w.frame_id""")
def recon_error(t: Tables) -> DataFrame:
    f = frames(t)
    base = f.join(_bg(t), "site").select("frame_id", F.round(A.recon_error("px", F.transform("bg", lambda b: b.cast("double"))), 6).alias("recon_error"))
    peak = X.peak_error(f, ["frame_id"], SIDE).select("frame_id", F.round("peak_error", 4).alias("peak_error"))
    centred = X.peak_error(f, ["frame_id"], SIDE, remove_mean=True).select("frame_id", F.round("peak_error", 4).alias("peak_error_centred"))
    return base.join(peak, "frame_id").join(centred, "frame_id")


@query("F12_percentile_markers", f"""WITH {PX}, c AS (SELECT frame_id, v, SUM(COUNT(*)) OVER (PARTITION BY frame_id ORDER BY v) / CAST(SUM(COUNT(*)) OVER (PARTITION BY frame_id) AS DOUBLE) AS s FROM p GROUP BY frame_id, v),
l AS (SELECT frame_id, MIN(v) FILTER (WHERE s >= 0.05::DOUBLE) AS lo, MIN(v) FILTER (WHERE s >= 0.95::DOUBLE) AS hi FROM c GROUP BY frame_id)
SELECT p.frame_id, p.i, CASE WHEN v < lo THEN 1 WHEN v > hi THEN 2 ELSE 0 END AS marker FROM p JOIN l ON l.frame_id = p.frame_id""")
def percentile_markers(t: Tables) -> DataFrame:
    return X.percentile_markers(frames(t), ["frame_id"], 0.05, 0.95)


@query("F13_softmax_top1", """WITH e AS (SELECT frame_id, unnest(px)::DOUBLE AS v, generate_subscripts(px, 1) - 1 AS i FROM v_frame),
s AS (SELECT frame_id, MAX(v) AS m FROM e GROUP BY frame_id), q AS (SELECT e.frame_id, SUM(exp(v - m)) AS z, MIN(i) FILTER (WHERE v = m) AS class_idx FROM e JOIN s ON s.frame_id = e.frame_id GROUP BY e.frame_id)
SELECT frame_id, CAST(class_idx AS INT) AS class_idx, round(1 / z, 6) AS confidence, 1 / z >= 0.02::DOUBLE AS shown FROM q""")
def softmax_top1(t: Tables) -> DataFrame:
    rows = t.v_frame.select("frame_id", A.top1(F.transform("px", lambda e: e.cast("double"))).alias("_t"))
    return rows.select("frame_id", "_t.class_idx", F.round("_t.confidence", 6).alias("confidence"), (F.col("_t.confidence") >= 0.02).alias("shown"))
