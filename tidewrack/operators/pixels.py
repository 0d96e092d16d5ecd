"""Background models and per-pixel statistics on frames stored as arrays.

Frames are tiled before they come here, so an array is one tile. Backgrounds that move
with the frames are computed on chunks of arrays, a block of frames at a time; totals over
all frames work on (key, pixel) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.operators.medians import window_medians
from tidewrack.operators.ordering import _attach, rank_rows
from tidewrack.operators.slices import with_halo
from tidewrack.session import durable


def pixel_rows(frames: DataFrame, keep: Sequence[str], px: str = "px") -> DataFrame:
    return frames.select(*keep, F.posexplode(px).alias("i", "v"))


def numbered(frames: DataFrame, site: str, order: str, px: str) -> DataFrame:
    """Frame number ``_n`` from 1 inside each site; only the keys are put in order. One frame per site and order."""
    ranks = rank_rows(frames.select(site, order), [site], [order], "_n")
    return _attach(frames.select(site, order, F.col(px).alias("_px")), ranks, [site, order])


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """A row for every ``chunk`` values of ``_px``: ``first`` is the place of its first value, ``part`` the values."""
    firsts = F.sequence(F.lit(0), F.size("_px") - 1, F.lit(chunk))
    cut = rows.filter(F.size("_px") > 0).withColumn("first", F.explode(firsts))
    return cut.withColumn("part", F.slice("_px", F.col("first") + 1, F.lit(chunk)).cast("array<double>")).drop("_px")


def _stack(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows in frame order and their values, a line per frame."""
    table = table.sort_by("_n")
    return table, table.column("part").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _lines(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values.ravel(), kind, from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def pixel_values(chunks: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Array chunks as a row per pixel: ``keep``, i and the values."""
    each = chunks.select(*keep, "first", F.posexplode(F.arrays_zip(*columns)).alias("_at", "_v"))
    return each.select(*keep, (F.col("first") + F.col("_at")).cast("long").alias("i"), *[F.col(f"_v.{c}").alias(c) for c in columns])


def _entering(maps: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """(keys, _slice, bg): the background before each block, from the blocks' maps bg -> a * bg + b.

    Maps of ``fan`` blocks in a row are composed, those again, until one is left per key; going back down, each gets what is before it.
    """
    ddl = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)

    def lists(table: pa.Table, name: str) -> list:
        return [None if not x.is_valid else x.values.to_numpy() for x in table.column(name).combine_chunks()]

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        a, b = 1.0, 0.0
        for x, y in zip(table.column("a").to_pylist(), lists(table, "b")):
            a, b = a * x, x * b + y
        head = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table(head | {"_slice": table.column("_group").slice(0, 1), "a": pa.array([a]), "b": _lines(b[None], pa.float64())})

    def hand_down(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        bg, out = lists(table, "bg")[0], []
        for x, y in zip(table.column("a").to_pylist(), lists(table, "b")):
            out.append(bg)
            bg = y if bg is None else x * bg + y
        return pa.table({k: table.column(k) for k in keys} | {"_slice": table.column("_slice"), "bg": pa.array(out, pa.list_(pa.float64()))})

    group = F.floor(F.col("_slice") / fan).cast("long")
    levels = [durable(maps)]
    while not levels[-1].filter("_slice > 0").isEmpty():
        levels.append(durable(levels[-1].withColumn("_group", group).groupBy(*keys, "_group").applyInArrow(compose, f"{ddl}, _slice long, a double, b array<double>")))
    state = levels[-1].select(*keys, "_slice", F.lit(None).cast("array<double>").alias("bg"))
    for level in reversed(levels[:-1]):
        told = _attach(level.withColumn("_group", group), state.withColumnRenamed("_slice", "_group"), [*keys, "_group"])
        state = told.groupBy(*keys, "_group").applyInArrow(hand_down, f"{ddl}, _slice long, bg array<double>")
    return durable(state)


def ema_background(frames: DataFrame, alpha: float, top: float, site: str = "site", order: str = "frame_id", px: str = "px",
                   chunk: int = 256, block: int = 4096, fan: int = 64) -> DataFrame:
    """Running background bg = alpha*f + (1-alpha)*bg per pixel, seeded by the first frame, and the frame minus the
    updated background, clipped to [0, top] and cut to whole numbers. Returns site, order, first, and the arrays bg and corrected.

    A block of frames maps the background before it to a * bg + b, with one b per pixel. Those maps are composed over the
    blocks of a site, so every block starts from its exact background and all blocks are computed side by side.
    """
    rows = durable(_chunks(numbered(frames, site, order, px).withColumn("_slice", F.floor((F.col("_n") - 1) / block).cast("long")), chunk))
    site_type, order_type = (frames.schema[c].dataType.simpleString() for c in (site, order))

    def block_map(table: pa.Table) -> pa.Table:
        table, f = _stack(table)
        first = table.column("_n")[0].as_py() == 1
        bg = f[0].copy() if first else alpha * f[0]
        for frame in f[1:]:
            bg = alpha * frame + (1 - alpha) * bg
        head = {k: table.column(k).slice(0, 1) for k in (site, "first", "_slice")}
        return pa.table(head | {"a": pa.array([0.0 if first else (1 - alpha) ** len(f)]), "b": _lines(bg[None], pa.float64())})

    def replay(table: pa.Table) -> pa.Table:
        table, f = _stack(table)
        before = table.column("bg")[0]
        bg, after = before.values.to_numpy() if before.is_valid else None, np.empty_like(f)
        for n, frame in enumerate(f):
            bg = frame.copy() if bg is None else alpha * frame + (1 - alpha) * bg
            after[n] = bg
        corrected = np.clip(f - after, 0, top).astype(np.int64)
        return table.select([site, order, "first"]).append_column("bg", _lines(after, pa.float64())).append_column("corrected", _lines(corrected, pa.int64()))

    keys = [site, "first"]
    maps = rows.groupBy(*keys, "_slice").applyInArrow(block_map, f"`{site}` {site_type}, first int, _slice long, a double, b array<double>")
    entered = _attach(rows, _entering(maps, keys, fan), [*keys, "_slice"])
    return entered.groupBy(*keys, "_slice").applyInArrow(replay, f"`{site}` {site_type}, `{order}` {order_type}, first int, bg array<double>, corrected array<long>")


def _moving_medians(frames: DataFrame, before: int, after: int, site: str, order: str, px: str, block: int, chunk: int) -> DataFrame:
    """Per frame and chunk the values (part) and the median of each over ``before`` frames, this one and ``after``; null where one of them is missing."""
    rows = _chunks(with_halo(numbered(frames, site, order, px), F.col("_n") - 1, block, before=before, after=after), chunk)
    schema = T.StructType([*(rows.schema[c] for c in (site, order, "first")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("part", "bg"))])

    def medians(table: pa.Table) -> pa.Table:
        table, f = _stack(table)
        mine = np.flatnonzero(table.column("_own").to_numpy())
        lo, hi = mine - before, mine + after + 1
        whole = (lo >= 0) & (hi <= len(f))
        out = np.full((len(mine), f.shape[1]), np.nan)
        for c in range(f.shape[1]):
            out[whole, c] = window_medians(np.ascontiguousarray(f[:, c]), lo[whole], hi[whole])
        return table.take(pa.array(mine)).select([site, order, "first"]).append_column("part", _lines(f[mine], pa.float64())).append_column("bg", _lines(out, pa.float64()))

    return rows.groupBy(site, "_slice", "first").applyInArrow(medians, schema)


def median_background(frames: DataFrame, bucket: str, px: str = "px") -> DataFrame:
    """Pixel-wise median of a bucket, cut to whole numbers: bucket, i, bg.

    The percentile keeps value counts, so pixels with few grey levels combine before the shuffle.
    """
    return pixel_rows(frames, [bucket], px).groupBy(bucket, "i").agg(F.floor(F.percentile("v", F.lit(0.5))).cast("int").alias("bg"))


def sliding_median_background(frames: DataFrame, radius: int = 2, site: str = "site", order: str = "frame_id", px: str = "px", block: int = 4096, chunk: int = 256) -> DataFrame:
    """Centred median over 2r+1 frames and the frame minus it, only where the whole window exists: site, order, first, and arrays bg and diff."""
    found = _moving_medians(frames, radius, radius, site, order, px, block, chunk).filter(F.col("bg")[0].isNotNull())
    return found.select(site, order, "first", "bg", F.zip_with("part", "bg", lambda v, b: v - b).alias("diff"))


def mean_background(frames: DataFrame, site: str = "site", px: str = "px") -> DataFrame:
    """Mean image per site, cut to whole numbers."""
    return pixel_rows(frames, [site], px).groupBy(site, "i").agg(F.floor(F.avg("v")).cast("int").alias("bg"))


def prior_median_background(frames: DataFrame, n: int, site: str = "site", order: str = "frame_id", px: str = "px", block: int = 4096, chunk: int = 256) -> DataFrame:
    """Median of the last ``n`` frames with the current one (null until n exist) and the clipped difference, before that
    the frame itself: site, order, first, and arrays bg and diff."""
    clipped = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))
    found = _moving_medians(frames, n - 1, 0, site, order, px, block, chunk)
    found = found.withColumn("bg", F.transform("bg", lambda b: F.when(b.isNotNull(), clipped(b))))
    diff = F.zip_with("part", "bg", lambda v, b: F.floor(clipped(v - F.coalesce(b, F.lit(0.0)))).cast("int"))
    return found.select(site, order, "first", "bg", diff.alias("diff"))


def arrays_from_rows(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Pixel rows back to one array per key; the array length is the tile size."""
    packed = F.sort_array(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda x: x["v"]).alias(name))


def frame_features(frames: DataFrame, keep: Sequence[str], px: str = "px", bins: int = 64, top: float = 256.0) -> DataFrame:
    """Mean from histogram bin centres, Shannon entropy of grey values in bits, and mean brightness per frame.

    All three come from the frame's own value counts, gathered in its array.
    """
    width = top / bins
    rows = pixel_rows(frames, keep, px)
    counts = rows.groupBy(*keep, "v").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    centre = (F.least(F.floor(F.col("v") / width), F.lit(bins - 1)) + 0.5) * width
    inside = F.col("v").between(0, top)
    return counts.groupBy(*keep).agg(
        (F.sum(F.when(inside, centre * F.col("_n"))) / F.sum(F.when(inside, F.col("_n")))).alias("hist_mean"),
        (F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("entropy"),
        (F.sum(F.col("v") * F.col("_n")) / n).alias("brightness"),
    )


def peak_error(frames: DataFrame, keep: Sequence[str], width: int, k: int = 5, remove_mean: bool = False, px: str = "px") -> DataFrame:
    """Largest mean of squares over any k x k window of the frame (row-major array of ``width`` columns)."""
    d = pixel_rows(frames, keep, px).withColumns({"r": F.floor(F.col("i") / width), "c": F.col("i") % width})
    if remove_mean:
        d = d.join(d.groupBy(*keep).agg(F.avg("v").alias("_m")), list(keep)).withColumn("v", F.col("v") - F.col("_m")).drop("_m")
    rows_of = Window.partitionBy(*keep, "r").orderBy("c").rowsBetween(-(k - 1), 0)
    d = d.withColumns({"_row": F.sum(F.col("v") * F.col("v")).over(rows_of)})
    cols_of = Window.partitionBy(*keep, "c").orderBy("r").rowsBetween(-(k - 1), 0)
    d = d.withColumn("_win", F.sum("_row").over(cols_of)).filter((F.col("r") >= k - 1) & (F.col("c") >= k - 1))
    return d.groupBy(*keep).agg((F.max("_win") / (k * k)).alias("peak_error"))


def percentile_markers(frames: DataFrame, keep: Sequence[str], low: float = 0.01, high: float = 0.99, px: str = "px") -> DataFrame:
    """Marker image per frame: 1 below the grey value that reaches the low share, 2 above the one that reaches the
    high share, else 0. Counts are cumulated over the frame's distinct grey values."""
    rows = pixel_rows(frames, keep, px)
    counts = rows.groupBy(*keep, "v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keep)
    share = F.sum("_n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(w)
    limits = counts.withColumn("_s", share).groupBy(*keep).agg(
        F.min(F.when(F.col("_s") >= low, F.col("v"))).alias("_lo"), F.min(F.when(F.col("_s") >= high, F.col("v"))).alias("_hi"))
    j = rows.join(limits, list(keep))
    return j.select(*keep, "i", F.when(F.col("v") < F.col("_lo"), 1).when(F.col("v") > F.col("_hi"), 2).otherwise(0).alias("marker"))
