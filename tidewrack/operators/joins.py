"""Joins: metadata, anti joins, pairing, as-of, and overlap of boxes, tiles and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.components import as_slabs, cut_to_grid
from tidewrack.operators.slices import block, micros, place, running, us


def attach_metadata(crops: DataFrame, sidecars: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; ``metadata_missing`` is true for unmatched rows and null (not false) for matched ones."""
    side = sidecars.withColumn("_found", F.lit(True))
    return crops.join(side, list(on), "left").withColumn("metadata_missing", F.when(F.col("_found").isNull(), True)).drop("_found")


def new_only(df: DataFrame, seen: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the ``seen`` tables."""
    for other in seen:
        df = df.join(other.select(*on), list(on), "left_anti")
    return df


def pair_items(images: DataFrame, jsons: DataFrame, now_us: int | Column, grace_s: float = 5.0, stem: str = "stem", mtime: str = "mtime") -> DataFrame:
    """Pair images with sidecars by stem: complete, failed (orphan older than grace) or waiting (younger)."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    a = images.select(stem, us(mtime).alias("_i"))
    b = jsons.select(stem, us(mtime).alias("_j"))
    old = (now - F.coalesce("_i", "_j")) > micros(grace_s)
    state = F.when(F.col("_i").isNotNull() & F.col("_j").isNotNull(), "complete").when(old, "failed").otherwise("waiting")
    missing = F.when(F.col("_i").isNull(), "image").when(F.col("_j").isNull(), "json")
    return a.join(b, stem, "full").select(stem, state.alias("outcome"), missing.alias("missing"))


def find_originals(crops: DataFrame, originals: DataFrame, name: str = "stem", species: str = "species", suffix: int = 11) -> DataFrame:
    """Originals that crops point to (stem without its last ``suffix`` characters), with one species each (the smallest name)."""
    wanted = crops.select(F.expr(f"left({name}, length({name}) - {suffix})").alias("original"), F.col(species).alias("species"))
    return wanted.join(originals.select("original"), "original", "left_semi").groupBy("original").agg(F.min("species").alias("species"))


def transfer_plan(local: DataFrame, remote: DataFrame, key: str = "path", size: str = "bytes") -> DataFrame:
    """Local files the remote lacks or holds with another size. Nothing is ever deleted."""
    there = remote.select(key, F.col(size).alias("_remote"))
    reason = F.when(F.col("_remote").isNull(), "missing").otherwise("size")
    return local.join(there, key, "left").filter(~F.col(size).eqNullSafe(F.col("_remote"))).withColumn("reason", reason).drop("_remote")


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, left_id: str, values: Sequence[str],
                right_id: str, max_age_s: float | None = None, rows: int | None = None) -> DataFrame:
    """Newest right reading at or before each left row, per key; older than ``max_age_s`` counts as none.

    One pass over the union of both sides: the last right row so far, carried
    over slices. Right rows of equal time precede left rows; among them the
    larger ``right_id`` wins.
    """
    reading = F.struct(us(ts).alias("t"), *[F.col(v).alias(v) for v in values])
    rights = right.select(*keys, us(ts).alias("_us"), reading.alias("_read"), F.lit(0).alias("_side"), F.col(right_id).alias("_tie"))
    lefts = left.select(*keys, us(ts).alias("_us"), F.lit(1).alias("_side"), F.col(left_id).alias("_tie"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    seen = running(place(both, keys, ["_us", "_side", "_tie"], rows), keys, last={"_last": F.col("_read")}).filter("_side = 1")
    fresh = F.col("_last")
    if max_age_s is not None:
        fresh = F.when(F.col("_us") - F.col("_last.t") <= micros(max_age_s), F.col("_last"))
    return seen.select(
        *keys, F.col("_tie").alias(left_id), F.col("_us").alias("left_us"), fresh["t"].alias("right_us"),
        *[fresh[v].alias(v) for v in values],
    )


def box_overlap(a: DataFrame, b: DataFrame, image: str = "image_id", a_id: str = "crop_id", b_id: str = "manual_id", cell: int = 256,
                extra_left: Sequence[str] = (), extra_right: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes of one image with positive intersection: intersection, union, IoU and covered fractions.

    Boxes are filed under the ``cell``-sized squares they touch, so a crowded
    image is many join keys; a pair is reported only in the square that holds the
    upper left corner of its intersection, hence once.
    """
    spans = lambda d, lo, hi: d.withColumn("_gy", F.explode(F.sequence(block(F.col(f"{lo}y0"), cell), block(F.col(f"{hi}y1") - 1, cell)))).withColumn(
        "_gx", F.explode(F.sequence(block(F.col(f"{lo}x0"), cell), block(F.col(f"{hi}x1") - 1, cell))))
    side = lambda d, p, i, extra: spans(
        d.filter((F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))).select(
            image, F.col(i).alias(f"{p}id"), *[F.col(c).cast("long").alias(f"{p}{c}") for c in ("y0", "x0", "y1", "x1")],
            *[F.col(e).alias(f"{p}{e}") for e in extra],
        ), p, p)
    j = side(a, "a_", a_id, extra_left).join(side(b, "b_", b_id, extra_right), [image, "_gy", "_gx"])
    top, left = F.greatest("a_y0", "b_y0"), F.greatest("a_x0", "b_x0")
    bottom, right = F.least("a_y1", "b_y1"), F.least("a_x1", "b_x1")
    j = j.filter((bottom > top) & (right > left) & (block(top, cell) == F.col("_gy")) & (block(left, cell) == F.col("_gx")))
    area = lambda p: (F.col(f"{p}y1") - F.col(f"{p}y0")) * (F.col(f"{p}x1") - F.col(f"{p}x0"))
    inter = (bottom - top) * (right - left)
    union = area("a_") + area("b_") - inter
    return j.select(
        image, "a_id", "b_id", inter.alias("inter_px"), union.alias("union_px"), (inter / union).alias("iou"),
        (inter / area("a_")).alias("a_covered"), (inter / area("b_")).alias("b_covered"),
        area("a_").alias("a_area"), area("b_").alias("b_area"),
        *[f"a_{e}" for e in extra_left], *[f"b_{e}" for e in extra_right],
    )


def crop_matches(pred: DataFrame, manual: DataFrame, image: str = "image_id", pred_id: str = "crop_id", manual_id: str = "manual_id",
                 larger: float = 0.70, smaller: float = 0.90) -> DataFrame:
    """Overlapping pairs where one box covers enough of the other; the bar is lower when the prediction is larger."""
    pairs = box_overlap(pred, manual, image, pred_id, manual_id)
    bar = F.when(F.col("a_area") > F.col("b_area"), F.lit(larger)).otherwise(F.lit(smaller))
    return pairs.filter((F.col("b_covered") >= bar) | (F.col("a_covered") >= bar))


def tile_mask_overlap(tiles: DataFrame, runs: DataFrame, image: str, tile_id: str, band: int = 256, min_fraction: float | None = None) -> DataFrame:
    """Mask pixels inside each tile, their share of the tile, and its label.

    ``runs`` is a mask of runs (y, x0, x1) or rectangles (y0, y1, x0, x1), disjoint;
    they meet tiles in the cells of a grid of ``band`` px. A tile is an observation
    if it has any mask pixel, or a share of at least ``min_fraction``.
    """
    span = lambda a, b: F.explode_outer(F.sequence(block(F.col(a).cast("long"), band), block(F.col(b).cast("long") - 1, band)))
    t = tiles.withColumn("_by", span("y0", "y1")).withColumn("_bx", span("x0", "x1"))
    sides = ("y0", "x0", "y1", "x1")
    r = cut_to_grid(as_slabs(runs, [image]), band, band, "_by", "_bx").select(image, "_by", "_bx", *[F.col(c).alias(f"_m_{c}") for c in sides])
    side = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(hi, f"_m_{hi}") - F.greatest(lo, f"_m_{lo}"))
    px = F.coalesce(F.sum(F.when(F.col("_m_y0").isNotNull(), side("y0", "y1") * side("x0", "x1"))), F.lit(0).cast("long"))
    out = t.join(r, [image, "_by", "_bx"], "left").groupBy(*tiles.columns).agg(px.alias("mask_px"))
    size = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    out = out.withColumn("mask_fraction", F.col("mask_px") / size)
    yes = F.col("mask_px") > 0 if min_fraction is None else F.col("mask_fraction") >= min_fraction
    return out.withColumn("label", F.when(yes, "obs").otherwise("no_obs"))


def label_progress(total: DataFrame, done: DataFrame, species: str = "species") -> DataFrame:
    """Per species: how many exist, how many are labelled, how many remain (never negative)."""
    t = total.groupBy(species).agg(F.count(F.lit(1)).alias("total"))
    d = done.groupBy(species).agg(F.count(F.lit(1)).alias("labelled"))
    return t.join(d, species, "left").withColumn("labelled", F.coalesce("labelled", F.lit(0).cast("long"))).withColumn(
        "remaining", F.greatest(F.col("total") - F.col("labelled"), F.lit(0).cast("long")))


def background_for_tile(tiles: DataFrame, background: DataFrame, keys: Sequence[str], pixels: str = "px", bg: str = "bg") -> DataFrame:
    """Tile minus the background of its own site and position; without one the tile stays as it is."""
    j = tiles.join(background.select(*keys, bg), list(keys), "left")
    diff = F.zip_with(pixels, bg, lambda v, b: v - b)
    return j.withColumn(pixels, F.when(F.col(bg).isNull(), F.col(pixels)).otherwise(diff)).drop(bg)
