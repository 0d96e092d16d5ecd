"""Time-series rules of the stations: rolling counts, leak and outage alerts, calibration, leak-rate fits, drain rules.

All windows run on slices of a key that hold equally many rows, so a station that
holds most of the rows, or all of them in one hour, is still many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.columns import KELVIN, PA_PER_INHG, dew_point_c, sane_filter
from tidewrack.operators.folds import in_order, mark_kept, thin
from tidewrack.operators.medians import window_medians
from tidewrack.operators.ordering import exact_percentile, rank_rows, running_totals, with_scalars
from tidewrack.operators.slices import micros, oldest_since, place, running, time_halo, us, with_halo
from tidewrack.session import durable

# Alert thresholds.
DEW_RISE_C, PRESSURE_SHIFT_MBAR = 0.60, 9.74
STALE_S, STALE_READS, DOWN_COOLDOWN_S = 30, 2, 1800


def rolling_count(crops: DataFrame, keys: Sequence[str], ts: str = "ts", window_s: float = 86_400, out: str = "crops_24h", rows: int | None = None) -> DataFrame:
    """Rows of the key in the trailing window up to each row's time; the left edge counts.

    A row enters the count at its time and leaves it a window later, behind the rows of that time. Rows without a time count nothing.
    """
    t = us(ts)
    step = lambda at, order, change: [at.alias("_at"), F.lit(order).alias("_order"), F.lit(change).alias("_change")]
    enter, leave = (crops.select(*keys, *step(*x)).filter("_at IS NOT NULL") for x in ((t, 0, 1), (t + micros(window_s), 2, -1)))
    every = crops.select("*", *step(t, 1, 0)).unionByName(enter.unionByName(leave), allowMissingColumns=True)
    counted = running(place(every, keys, ["_at", "_order"], rows), keys, total={out: F.col("_change")})
    return counted.filter("_order = 1").select(*crops.columns, out)


def leak_streak(samples: DataFrame, keys: Sequence[str], ts: str, tie: str, k: int, leak: str = "leak", rows: int | None = None) -> DataFrame:
    """Tier 1: consecutive positive reads so far (a missing read counts as negative) and whether they reach ``k``."""
    yes = F.coalesce(F.col(leak), F.lit(False))
    reset = running(place(samples, keys, [ts, tie], rows), keys, last={"_reset": F.when(~yes, F.col("_n"))})
    streak = F.col("_n") - F.coalesce("_reset", F.lit(0))
    return reset.withColumn("streak", streak).withColumn("fires", streak >= k).drop("_n", "_slice", "_reset")


def leak_trend(samples: DataFrame, keys: Sequence[str], ts: str, window_s: float, dew_rise: float = DEW_RISE_C, pressure_shift: float = PRESSURE_SHIFT_MBAR,
               temp: str = "temp_c", humidity: str = "humidity_pct", pressure: str = "pressure_mbar", rows: int | None = None) -> DataFrame:
    """Tier 2: dew point rise and pressure shift against the oldest value in the trailing window.

    Oldest non-null dew point and pressure are picked independently; at least half
    the window of history is needed, and both shifts must reach their threshold.
    """
    t = us(ts)
    d = samples.withColumn("_dew", dew_point_c(temp, humidity))
    d = oldest_since(d, keys, t, t - micros(window_s), {"_dew0": F.col("_dew"), "_p0": F.col(pressure), "_t0": t}, rows)
    # the oldest value since the left edge lies inside the window wherever the row's own value is known
    ready = (t - F.col("_t0")) >= micros(window_s) * 0.5
    d = d.withColumns({"dew_rise": F.when(ready, F.col("_dew") - F.col("_dew0")), "pressure_shift": F.when(ready, F.abs(F.col(pressure) - F.col("_p0")))})
    fires = F.coalesce((F.col("dew_rise") >= dew_rise) & (F.col("pressure_shift") >= pressure_shift), F.lit(False))
    return d.withColumn("fires", fires).drop("_dew", "_dew0", "_p0", "_t0")


def leak_alerts(samples: DataFrame, keys: Sequence[str], ts: str, tie: str, k: int, window_s: float, cooldown_s: float, leak: str = "leak",
                rows: int | None = None, **limits) -> DataFrame:
    """Alerts of both tiers with cooldown: keys, tie, ``tier``. Samples without a time give none.

    A critical alert that is sent silences the warning of the same sample; one
    held back by its own cooldown does not. Samples at which a tier fires are put in order once for both tiers.
    """
    ids, yes, no = [*keys, tie, ts], F.lit(True), F.lit(False)
    samples = samples.filter(F.col(ts).isNotNull())
    critical = leak_streak(samples.select(*ids, leak), keys, ts, tie, k, leak, rows).filter("fires").select(*ids, yes.alias("_critical"), no.alias("_warning"))
    warning = leak_trend(samples, keys, ts, window_s, rows=rows, **limits).filter("fires").select(*ids, no.alias("_critical"), yes.alias("_warning"))
    due = critical.unionByName(warning).groupBy(*ids).agg(F.max("_critical").alias("_critical"), F.max("_warning").alias("_warning"))
    # ordering reads its input twice, once to find the ranges
    events = in_order(durable(due), keys, ts, tie, rows)
    events = mark_kept(events, keys, cooldown_s, F.col("_critical"), "_sent")
    events = mark_kept(events, keys, cooldown_s, F.col("_warning") & ~F.col("_sent"), "_warned")
    tier = F.when(F.col("_sent"), "critical").when(F.col("_warned"), "warning")
    return events.select(*keys, tie, tier.alias("tier")).filter("tier IS NOT NULL")


def stage_alerts(beats: DataFrame, keys: Sequence[str], ts: str, tie: str, age: str = "age_s", stale_s: float = STALE_S,
                 reads: int = STALE_READS, cooldown_s: float = DOWN_COOLDOWN_S) -> DataFrame:
    """Down after ``reads`` consecutive stale reads, once per outage and not within the cooldown of the last
    down; up at the first fresh read, only if down was announced. Returns keys, tie, ``event``."""
    stale = ~F.coalesce(F.col(age) < stale_s, F.lit(False))
    d = beats.select(*keys, tie, ts, stale.alias("_stale"))
    d = place(d, keys, [ts, tie])
    d = running(d, keys, last={"_fresh": F.when(~F.col("_stale"), F.col("_n"))}, total={"_outage": F.when(F.col("_stale"), 0).otherwise(1)})
    due = d.filter(F.col("_stale") & (F.col("_n") - F.coalesce("_fresh", F.lit(0)) >= reads))
    down = durable(thin(durable(due.select(*keys, tie, ts, "_outage")), keys, ts, tie, cooldown_s, once_per="_outage"))
    # the fresh read that ends outage k is the (k+1)-th fresh read of its key
    ends = d.filter(~F.col("_stale")).select(*keys, tie, (F.col("_outage") - 1).alias("_outage"))
    up = ends.join(down.select(*keys, "_outage"), [*keys, "_outage"], "left_semi")
    return down.select(*keys, tie, F.lit("down").alias("event")).unionByName(up.select(*keys, tie, F.lit("up").alias("event")))


def system_mode(df: DataFrame, keys: Sequence[str], ts: str, tie: str, backlog: str, enter: float, leave: float) -> DataFrame:
    """Hysteresis: backlog mode above ``enter``, live mode below ``leave``, unchanged in between; starts live."""
    crossing = F.when(F.col(backlog) > enter, "backlog").when(F.col(backlog) < leave, "live")
    d = running(place(df, keys, [ts, tie]), keys, last={"mode": crossing}).drop("_n", "_slice")
    return d.withColumn("mode", F.coalesce("mode", F.lit("live")))


def _own_medians(halo: DataFrame, by: Sequence[str], own: Sequence[str], order: str, value: str, out: str, bounds) -> DataFrame:
    """Own rows of each group with the median of their window; ``bounds`` gives windows as places from the ordered ``order`` column."""

    def medians(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at, mine = table.column(order).to_numpy(), np.flatnonzero(table.column("_own").to_numpy())
        values = table.column("_value").to_numpy().astype(np.float64)
        lo, hi = bounds(at, mine)
        found = window_medians(values, lo, hi)
        return table.take(pa.array(mine)).select(list(own)).append_column(out, pa.array(found, pa.float64(), mask=np.isnan(found)))

    rows = halo.withColumn("_value", F.col(value).cast("double"))
    schema = T.StructType([*(halo.schema[c] for c in own), T.StructField(out, T.DoubleType())])
    return rows.groupBy(*by).applyInArrow(medians, schema)


def median_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], feature: str, priors: int, threshold: float, prime: int = 0,
                 first: float | None = 1.0, block_rows: int = 100_000, name: str = "ratio", rank: str | None = None) -> DataFrame:
    """Value over the median of the ``priors`` rows before it; above ``threshold`` is an observation.

    ``prime`` rows at the start only fill the history. The first row has ratio
    ``first`` (None: no ratio, never an observation). A zero median gives
    infinity for a positive value and 1 otherwise.
    """
    number = rank or "_row"
    d = df if rank else rank_rows(df, keys, order, number)
    d = with_halo(d, F.col(number) - 1, block_rows, before=priors)
    own = [c for c in d.columns if c not in ("_slice", "_own")]
    d = _own_medians(d, [*keys, "_slice"], own, number, feature, "_med", lambda at, mine: (np.maximum(mine - priors, 0), mine))
    v, med = F.col(feature), F.col("_med")
    zero = F.when(v > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    ratio = F.when(med.isNull(), F.lit(first).cast("double")).when(med == 0, zero).otherwise(v / F.when(med != 0, med))
    d = d.withColumn(name, ratio).withColumn(f"{name}_median", med)
    seen = F.coalesce((F.col(name) > threshold) & (F.col(number) > prime), F.lit(False))
    d = d.withColumn("is_obs", seen).drop("_med")
    return d if rank else d.drop(number)


def detrend(df: DataFrame, keys: Sequence[str], ts: str, value: str, window_s: float, out: str = "residual", rows: int | None = None) -> DataFrame:
    """Value minus its centred rolling median over (t - w/2, t + w/2]; the left edge is open. Rows without a time are left out."""
    half = micros(window_s / 2)
    d = place(df.withColumn("_t", us(ts)).filter("_t IS NOT NULL"), keys, ["_t"], rows)
    halo = time_halo(d, keys, "_t", half - 1, half)

    def bounds(at: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(at, at[mine] - half, side="right"), np.searchsorted(at, at[mine] + half, side="right")

    found = _own_medians(halo, [*keys, "_to"], df.columns, "_t", value, "_med", bounds)
    return found.withColumn(out, F.col(value) - F.col("_med")).drop("_med")


def windowed_rise(df: DataFrame, keys: Sequence[str], ts: str, value: str, window_s: float, out: str = "rise", rows: int | None = None) -> DataFrame:
    """Value minus the oldest value with time >= t - w; null unless that one is at least half a window back."""
    t = us(ts)
    d = oldest_since(df, keys, t, t - micros(window_s), {"_old": F.struct(t.alias("t"), F.col(value).cast("double").alias("v"))}, rows)
    rise = F.when(t - F.col("_old.t") >= 0.5 * micros(window_s), F.col(value) - F.col("_old.v"))
    return d.withColumn(out, rise).drop("_old")


def calibrate_thresholds(samples: DataFrame, keys: Sequence[str], ts: str, ranges: dict, window_s: float, percentile: float = 0.995,
                         margin: float = 2.0, detrend_factor: float = 4.0, min_rows: int = 100, min_hours: float = 4.0,
                         temp: str = "temp_c", humidity: str = "humidity_pct", pressure: str = "pressure_mbar") -> DataFrame:
    """Suggested alert threshold per key and signal from a quiet log.

    Sane rows, dew point, residual against a long rolling median, rise over the
    alert window, a high percentile of its size, times a margin; also without
    detrending. ``enough_rows``/``enough_hours`` say whether the log is long enough.
    """
    d = sane_filter(samples, ranges).withColumn("_dew", dew_point_c(temp, humidity))
    named = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(c).alias("value")) for n, c in (("pressure", pressure), ("dew_point", "_dew"), ("temperature", temp))])
    rows = d.select(*keys, ts, F.explode(named).alias("_s")).select(*keys, ts, "_s.signal", "_s.value")
    by = [*keys, "signal"]
    rows = windowed_rise(detrend(rows, by, ts, "value", window_s * detrend_factor), by, ts, "residual", window_s, "_rise")
    rows = windowed_rise(rows, by, ts, "value", window_s, "_raw")
    rows = durable(rows.select(*by, ts, "_rise", "_raw"))
    level = lambda c, n: exact_percentile(rows, by, F.abs(F.col(c)), percentile, n).withColumn(n, F.col(n) * margin)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), ((F.max(us(ts)) - F.min(us(ts))) / 3.6e9).alias("hours"))
    out = out.join(level("_rise", "threshold"), by, "left").join(level("_raw", "threshold_raw"), by, "left")
    return out.withColumn("enough_rows", F.col("rows") >= min_rows).withColumn("enough_hours", F.col("hours") >= min_hours)


# Physical constants and the leak limit.
GAS_R, STD_PA, STD_C = 8.314462618, 101325.0, 20.0
LEAK_LIMIT_INHG_PER_MIN = 1 / 15


def leak_rate_fit(log: DataFrame, keys: Sequence[str], t: str, p_int: str, p_ext: str, temp: str, mark: str, settle_s: float,
                  volume_l: float, temp_range: tuple[float, float] = (-10.0, 60.0), int_range: tuple[float, float] = (30_000.0, 110_000.0),
                  ext_range: tuple[float, float] = (80_000.0, 120_000.0), cutoff: float = 0.3, min_rows: int = 5) -> DataFrame:
    """Leak rate and verdict of each pressure test.

    Rows after ``mark`` (null: not started) plus the settling time, in sane
    ranges; pressure is corrected to the first row's temperature; rows whose
    deficit is at least ``cutoff`` of the first one are fitted, exponentially if
    the logarithm of the deficit falls, else linearly. With a first deficit of
    zero or less every row is kept and the fit is linear.
    """
    k = F.col(temp) + KELVIN
    settled = F.coalesce(F.col(t) >= F.col(mark) + settle_s, F.lit(False)) & F.col(temp).isNotNull()
    sane = F.coalesce(settled & F.col(temp).between(*temp_range) & F.col(p_int).between(*int_range) & F.col(p_ext).between(*ext_range), F.lit(False))
    rows = log.select(*keys, F.col(t).alias("_t"), F.col(p_int).alias("_p"), F.col(p_ext).alias("_e"), k.alias("_k"), F.col(mark).alias("_m"),
                      settled.alias("_settled"), sane.alias("_ok"))
    first = F.min_by(F.struct("_t", "_p", "_e", "_k"), F.when(F.col("_ok"), F.col("_t")))
    head = rows.groupBy(*keys).agg(
        first.alias("_f"), F.count_if("_ok").alias("n_points"), F.count_if(F.col("_settled") & ~F.col("_ok")).alias("n_rejected"),
        F.max("_m").alias("_mark"), F.max(F.when(F.col("_ok"), F.col("_t"))).alias("_end"))
    d = rows.filter("_ok").join(head.filter(F.col("n_points") >= min_rows).select(*keys, "_f"), list(keys))
    d0 = F.col("_f._e") - F.col("_f._p")
    p_ref = F.col("_p") * (F.col("_f._k") / F.col("_k"))
    d = d.withColumns({"_x": F.col("_t") - F.col("_f._t"), "_pc": p_ref, "_def": F.col("_e") - p_ref, "_d0": d0})
    fit = d.filter((F.col("_d0") <= 0) | (F.col("_def") >= cutoff * F.col("_d0")))
    ln = F.when((F.col("_d0") > 0) & (F.col("_def") > 0), F.ln(F.when(F.col("_def") > 0, F.col("_def"))))
    fits = fit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in_fit"), F.regr_slope(ln, F.col("_x")).alias("_b"), F.regr_intercept(ln, F.col("_x")).alias("_a"),
        F.regr_slope("_pc", "_x").alias("_lin"), F.max("_d0").alias("_d0"))
    out = head.join(fits, list(keys), "left")
    expo = F.coalesce((F.col("_d0") > 0) & (F.col("n_in_fit") >= min_rows) & (F.col("_b") < 0), F.lit(False))
    slope = F.when(expo, F.exp("_a") * -F.col("_b")).otherwise(F.col("_lin")) * 60.0
    inhg = slope / PA_PER_INHG
    mol = volume_l / 1000.0 / (GAS_R * F.col("_f._k")) * slope
    ready = F.col("n_points") >= min_rows
    verdict = F.when(F.col("_mark").isNull(), "NOT_STARTED").when(~ready, "COLLECTING").when(F.abs(inhg) <= LEAK_LIMIT_INHG_PER_MIN, "PASS").otherwise("FAIL")
    return out.select(
        *keys, verdict.alias("verdict"), "n_points", "n_rejected", F.when(ready, F.col("n_in_fit")).alias("n_in_fit"),
        F.when(ready, F.when(expo, "exponential").otherwise("linear")).alias("fit_kind"),
        F.when(ready, (F.col("_end") - F.col("_mark")) / 3600.0).alias("test_hours"),
        F.when(ready, slope).alias("pa_per_min"), F.when(ready, inhg).alias("inhg_per_min"), F.when(ready, mol).alias("mol_per_min"),
        F.when(ready, mol * GAS_R * (STD_C + KELVIN) / STD_PA * 1.0e6).alias("cm3_per_min"))


def batch_numbers(files: DataFrame, order: Sequence[str], size: int, fraction: float = 0.1, parts: int | None = None) -> DataFrame:
    """Ordinal batches of a sorted list (``q_batch``) and sub-batches of a share of each batch (``f_batch``)."""
    d = rank_rows(files, [], order, "_n", parts).withColumn("q_batch", F.floor((F.col("_n") - 1) / size))
    total = d.groupBy("q_batch").agg(F.count(F.lit(1)).alias("_len"))
    step = F.greatest(F.floor(F.col("_len") * fraction), F.lit(1).cast("long"))
    inside = F.col("_n") - 1 - F.col("q_batch") * size
    return d.join(total, "q_batch").withColumn("f_batch", F.floor(inside / step)).drop("_n", "_len")


def config_changes(snapshots: DataFrame, station: str, number: str, k: str, v: str) -> DataFrame:
    """Changed settings of each snapshot against the one before it; the first snapshot is the baseline.

    Only keys of the current snapshot are looked at. One value per key and snapshot.
    """
    steps = rank_rows(snapshots.select(station, number).distinct(), [station], [number], "_n")
    rows = snapshots.join(steps, [station, number])
    before = rows.select(station, (F.col("_n") + 1).alias("_n"), k, F.col(v).alias("old"))
    j = rows.withColumnRenamed(v, "new").join(before, [station, "_n", k], "left")
    kind = F.when(F.col("_n") == 1, "baseline").otherwise("change")
    return j.filter((F.col("_n") == 1) | ~F.col("new").eqNullSafe(F.col("old"))).select(station, number, k, kind.alias("kind"), "old", "new")


def thin_by_interval(df: DataFrame, keys: Sequence[str], ts: str, tie: str, min_gap_s: float, target: int | None = None) -> DataFrame:
    """Rows at least ``min_gap_s`` after the last kept one; with ``target``, only the first so many per key."""
    kept = thin(df, keys, ts, tie, min_gap_s)
    if target is None:
        return kept
    return rank_rows(kept, keys, [ts, tie], "_n").filter(F.col("_n") <= target).drop("_n")


def keep_every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, complete: Column) -> DataFrame:
    """Every n-th row of each key, and only then the incomplete ones are dropped."""
    return rank_rows(df, keys, order, "_n").filter((F.pmod("_n", F.lit(n)) == 0) & complete).drop("_n")


def prune_oldest(files: DataFrame, mtime: str, tie: str, bytes_: str, max_bytes: int | Column, target_bytes: int | Column, parts: int | None = None) -> DataFrame:
    """Files to delete, oldest first, until enough is freed; nothing unless the total is over the limit.

    The file that reaches the goal is deleted too.
    """
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    total = files.agg(F.sum(bytes_).alias("_total"))
    over = with_scalars(running_totals(files, [], [mtime, tie], {"_cum": bytes_}, parts), total)
    freed_before = F.col("_cum") - F.col(bytes_)
    return over.filter((F.col("_total") > lit(max_bytes)) & (freed_before < F.col("_total") - lit(target_bytes))).drop("_cum", "_total")


def retry_policy(items: DataFrame, bytes_: str, readable: Column, attempts: str, max_bytes: int = 2_000_000, max_attempts: int = 50) -> DataFrame:
    """What happens to each item after a failed upload: archived (too big), failed, or requeued with one more attempt."""
    tries = F.coalesce(F.col(attempts), F.lit(0)) + 1
    action = F.when(F.col(bytes_) > max_bytes, "archived").when(~readable, "failed").when(tries >= max_attempts, "failed").otherwise("requeued")
    return items.withColumn("action", action).withColumn("next_attempts", F.when(F.col("action") == "requeued", tries))
