"""Aggregations over samples, crops, files, logs and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ordering import with_scalars
from tidewrack.operators.slices import us


def device_rollup(samples: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "60 seconds", mean: Sequence[str] = (),
                  peak: Sequence[str] = (), low: Sequence[str] = (), any_of: Sequence[str] = (), last: Sequence[str] = (),
                  tie: str | None = None) -> DataFrame:
    """One row per key and window: first and last sample time, count, means (nulls skipped), maxima, minima,
    "any" flags (null without a reading) and the last sample's point-in-time fields."""
    place = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    newest = F.max_by(F.struct(*last), place).alias("_last") if last else None
    out = samples.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in mean], *[F.max(c).alias(f"{c}_peak") for c in peak],
        *[F.min(c).alias(f"{c}_min") for c in low], *[F.bool_or(c).alias(f"{c}_any") for c in any_of],
        *([newest] if last else []),
    )
    return out.select(*[c for c in out.columns if c not in ("_w", "_last")], *[F.col(f"_last.{c}").alias(c) for c in last])


def environment_rollup(samples: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "60 seconds",
                       mean: Sequence[str] = ("pressure_mbar", "temp_c", "depth_m"), depth: str = "depth_m") -> DataFrame:
    """Means per window plus the smallest and largest depth."""
    return samples.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in mean], F.min(depth).alias(f"{depth}_min"), F.max(depth).alias(f"{depth}_max"),
    ).drop("_w")


def burst_mean_max(ticks: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", width: str = "10 seconds") -> DataFrame:
    """Fast ticks reduced to mean and maximum per slow tick."""
    out = ticks.groupBy(*keys, F.window(ts, width).alias("_w")).agg(F.avg(value).alias(f"{value}_mean"), F.max(value).alias(f"{value}_max"))
    return out.withColumn("tick_start", F.col("_w.start")).drop("_w")


def daily_report(crops: DataFrame, species: str, ts: str = "ts", label: str = "class_label", zone: str = "UTC",
                 first: str | None = None, last: str | None = None) -> DataFrame:
    """Crops per local day and how many are of one class (exact case). Given ``first`` and ``last``, days without crops count zero."""
    day = F.to_date(F.from_utc_timestamp(ts, zone)) if zone != "UTC" else F.to_date(ts)
    found = crops.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("crops"), F.count_if(F.col(label) == species).alias("of_class"))
    if first is None or last is None:
        return found
    days = crops.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    zero = F.lit(0).cast("long")
    return days.join(found, "date", "left").select("date", F.coalesce("crops", zero).alias("crops"), F.coalesce("of_class", zero).alias("of_class"))


def folder_counts(files: DataFrame, *levels: str) -> DataFrame:
    """Files per folder with subtotals and the grand total (null levels)."""
    return files.rollup(*levels).agg(F.count(F.lit(1)).alias("files"))


def segmentation_summary(log: DataFrame, keys: Sequence[str] = ("q_batch", "f_batch"), crops: str = "num_crops", seconds: str = "time_per_image") -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col(crops) > 0).alias("images_with_roi"),
                                  F.sum(crops).alias("rois"), F.avg(seconds).alias("mean_seconds"))


def label_stats(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Counts per label value; missing labels are left out."""
    return df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def queue_report(items: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Per queue state: depth (sidecars only), images, complete items, bytes, and the difference of images and sidecars."""
    return items.groupBy(*keys).agg(
        F.count_if("has_json").alias("depth"), F.count_if("has_image").alias("images"),
        F.count_if(F.col("has_json") & F.col("has_image")).alias("complete"), F.sum("bytes").alias("bytes"),
        (F.count_if("has_image") - F.count_if("has_json")).alias("images_minus_json"))


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """n / (k * count) per present class, n rows and k classes."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    j = counts.join(totals, list(keys)) if keys else with_scalars(counts, totals)
    return j.withColumn("weight", F.col("_all") / (F.col("_k") * F.col("n"))).drop("_all", "_k")


def binary_class_weight(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weight of the empty class so that both classes count the same: positives / negatives."""
    return df.groupBy(*keys).agg((F.count_if(F.col(label) == 1) / F.nullif(F.count_if(F.col(label) == 0), F.lit(0))).alias("weight_0"))


def image_score_max(tiles: DataFrame, image: str, score: str, label: str, threshold: float) -> DataFrame:
    """Largest tile score per image, tiles at or above the threshold, and the image label (any labelled tile)."""
    return tiles.groupBy(image).agg(F.max(score).alias("max_score"), F.count_if(F.col(score) >= threshold).alias("tiles_over"), F.max(label).alias("label"))


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bin; values outside are left out and the last bin includes its right edge."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1).cast("long"))
    return df.filter(F.col(col).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin_start", low + F.col("bin") * width)


def timing_summary(log: DataFrame, steps: Sequence[str], keys: Sequence[str], total_images: int | Column) -> DataFrame:
    """Total and share of each step, mean seconds per image, and the time the remaining images need."""
    whole = sum((F.sum(s) for s in steps[1:]), F.sum(steps[0]))
    n = F.count(F.lit(1))
    left = F.greatest((F.lit(total_images) if isinstance(total_images, int) else total_images) - n, F.lit(0).cast("long"))
    return log.groupBy(*keys).agg(
        n.alias("images"), whole.alias("total_s"), *[F.sum(s).alias(f"{s}_total") for s in steps],
        *[(F.sum(s) / F.nullif(whole, F.lit(0.0))).alias(f"{s}_share") for s in steps], (whole / n).alias("mean_s"), (whole / n * left).alias("remaining_s"))


def catalogue_summary(items: DataFrame, source: str = "source", date: str = "date", missing: str = "metadata_missing") -> DataFrame:
    """Totals, items without metadata and date range, per source and overall (null source)."""
    return items.rollup(source).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(missing), F.lit(False))).alias("missing"),
                                    F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def dataset_audit(df: DataFrame, keys: Sequence[str], label: str, original: str) -> DataFrame:
    """Observations, empties and distinct originals per split or site."""
    return df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("obs"), F.count_if(F.col(label) == 0).alias("empty"), F.countDistinct(original).alias("originals"))


def live_snapshot(device: DataFrame, environment: DataFrame, keys: Sequence[str], ts: str, device_cols: Sequence[str],
                  env_cols: Sequence[str], tie: str) -> DataFrame:
    """Newest device half and newest environmental half of each station in one row."""
    newest = lambda df, cols, name: df.groupBy(*keys).agg(F.max_by(F.struct(F.col(ts), *cols), F.struct(ts, tie)).alias(name))
    j = newest(device, device_cols, "_d").join(newest(environment, env_cols, "_e"), list(keys), "full")
    return j.select(*keys, *[F.col(f"_d.{c}").alias(c) for c in device_cols], *[F.col(f"_e.{c}").alias(c) for c in env_cols],
                    F.greatest(us(F.col(f"_d.{ts}")), us(F.col(f"_e.{ts}"))).alias("updated_us"))


def catch_up(record: DataFrame, analyse: DataFrame, backlog: DataFrame, key: str) -> DataFrame:
    """Analyse and record rates per hour (lifetime averages) and hours until the backlog is gone.

    ``record``/``analyse`` carry ``done`` and ``elapsed_s``; ``backlog`` carries ``backlog``. No
    estimate without both rates, and none when recording is at least as fast.
    """
    rate = lambda d, n: d.groupBy(key).agg((F.sum("done") / F.nullif(F.max("elapsed_s"), F.lit(0.0))).alias(n))
    j = rate(analyse, "_a").join(rate(record, "_r"), key, "left").join(backlog, key, "left")
    known = F.col("_a").isNotNull() & (F.col("_a") > 0) & F.col("_r").isNotNull()
    net = F.col("_a") - F.col("_r")
    return j.select(
        key, F.when(known, F.col("_a") * 3600).alias("analyse_rate_per_hour"), F.when(known, F.col("_r") * 3600).alias("record_rate_per_hour"),
        F.when(known, net > 0).alias("catching_up"), F.when(known & (net > 0), F.col("backlog") / F.when(net > 0, net) / 3600).alias("eta_hours"))


def drain_status(items: DataFrame, keys: Sequence[str], total: str, elapsed_s: str) -> DataFrame:
    """Remaining items, rate per hour and hours left of a draining queue; ``outcome`` is sent, archived or failed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    agg = items.groupBy(*keys).agg(F.max(total).alias("total_initial"), n("sent").alias("sent"), n("archived").alias("archived"),
                                   n("failed").alias("failed"), F.max(elapsed_s).alias("_e"))
    remaining = F.greatest(F.col("total_initial") - F.col("sent") - F.col("archived") - F.col("failed"), F.lit(0).cast("long"))
    rate = (F.col("sent") + F.col("archived")) / F.when(F.col("_e") > 0, F.col("_e")) * 3600
    return agg.withColumn("remaining", remaining).withColumn("rate_per_hour", rate).withColumn(
        "eta_hours", F.col("remaining") / F.nullif(F.col("rate_per_hour"), F.lit(0.0))).drop("_e")


def backlog_stages(stages: DataFrame, position: str = "position", active: str = "active", waiting: str = "waiting",
                   processed: str = "processed", elapsed_s: str = "elapsed_s") -> DataFrame:
    """Status, remaining items, rate per hour and hours left of ordered backlog stages.

    Only the active stage has a rate: items processed since it began. Stages before
    it are done, later ones pending with unknown remainder.
    """
    now = F.col(position) == F.col(active)
    status = F.when(F.col(position) < F.col(active), "done").when(now, "active").otherwise("pending")
    left = F.when(F.col(position) < F.col(active), F.lit(0).cast("long")).when(now, F.col(waiting))
    rate = F.when(now & (F.col(processed) > 0), F.col(processed) / F.when(F.col(elapsed_s) > 0, F.col(elapsed_s)) * 3600)
    return stages.withColumns({"status": status, "remaining": left, "rate_per_hour": rate}).withColumn(
        "eta_hours", F.when(now, F.col(waiting) / F.col("rate_per_hour")))


def upload_health(attempts: DataFrame, keys: Sequence[str], ts: str, tie: str, ok: str = "ok", bytes_: str = "bytes", seconds: str = "seconds") -> DataFrame:
    """Last attempt, last success, speed of the last successful batch, failures since then."""
    place = F.struct(us(ts).alias("t"), F.col(tie).alias("k"))
    speed = F.when(F.col(ok) & (F.col(seconds) > 0), F.col(bytes_) / F.when(F.col(seconds) > 0, F.col(seconds)))
    rows = attempts.select(*keys, place.alias("_p"), F.col(ok).alias("_ok"), speed.alias("_speed"))
    top = rows.groupBy(*keys).agg(F.max_by("_ok", "_p").alias("last_ok"), F.max("_p").alias("_last"), F.max(F.when(F.col("_ok"), F.col("_p"))).alias("_good"),
                                  F.max_by("_speed", F.when(F.col("_speed").isNotNull(), F.col("_p"))).alias("last_speed_bps"))
    late = rows.join(top.select(*keys, "_good"), list(keys)).filter(~F.col("_ok") & (F.col("_good").isNull() | (F.col("_p") > F.col("_good"))))
    fails = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return top.join(fails, list(keys), "left").select(
        *keys, "last_ok", F.col("_last.t").alias("last_attempt_us"), F.col("_good.t").alias("last_success_us"), "last_speed_bps",
        F.coalesce("_n", F.lit(0).cast("long")).alias("consecutive_failures"))
