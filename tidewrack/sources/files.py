"""Readers and writers: file lists, sidecars, annotations, sensor logs, image folders, dated layouts, folder streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.columns import phantom_file, stem_date
from tidewrack.operators.components import merge_runs

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")

ANNOTATION = "shapes array<struct<label string, shape_type string, points array<array<double>>>>"
SENSOR_LOG = (
    "iso_time timestamp, t_rel_s double, p_int_pa double, p_ext_pa double, temp_int_c double, humidity_pct double, leak_flag double")
FRAME_SIDECAR = (
    "frame_id long, timestamp_unix double, capture_iso string, width int, height int, hdr_max int, gain_db double, camera_serial string")
CROP_SIDECAR = (
    "source_frame_id long, source_timestamp_unix double, image_name string, crop_id int, crop_y0 int, crop_x0 int, crop_y1 int, crop_x1 int, "
    "region_size_pixels double, region_size_mm2 double, peak_val double, mean_val double, class_label string, class_confidence double, "
    "class_idx int, classifier_checkpoint string, processed_iso string, upload_attempts int")


def read_file_index(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files below ``path`` with one of the extensions (any case), sorted by path. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(F.substring_index("path", ".", -1)).isin([e.lower() for e in extensions])
    return files.filter(known).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")).orderBy("path")


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType | str = CROP_SIDECAR, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Readable sidecars and unreadable ones (torn or corrupt JSON), each with the file they came from."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=multi_line)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = text.select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("_j"))
    torn = F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
    good = rows.filter(~torn).select(*[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields], "file")
    return good, rows.filter(torn).select("file", F.col("value").alias("raw"))


def read_labelme(spark: SparkSession, path: str, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per annotated shape: file, shape number, label, shape type, points."""
    docs = (
        spark.read.schema(ANNOTATION).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
        .select(F.col("_metadata.file_path").alias("file"), "shapes")
    )
    shapes = docs.select("file", F.posexplode("shapes").alias("shape_no", "s")).select(
        "file", "shape_no", "s.label", F.coalesce("s.shape_type", F.lit("polygon")).alias("shape_type"), "s.points")
    return shapes if labels is None else shapes.filter(F.col("label").isin(list(labels)))


def read_sensor_log(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Leak-test CSV with declared types; lines that do not fit are skipped.

    All columns are parsed even if few are used, else the same line would count as
    malformed in one query and as good in another.
    """
    reader = spark.read.schema(SENSOR_LOG).option("header", header).option("mode", "DROPMALFORMED").option("columnPruning", "false")
    return reader.csv(path)


def frame_tiles(images: DataFrame, tile: int = 282) -> tuple[DataFrame, DataFrame]:
    """Tiles of image structs as Spark's reader gives them (origin, height, width, nChannels, data), and the list of unreadable ones.

    A tile row holds file, row, col, height, width and ``px`` (grey values, mean of channels) in row-major order, so no
    row grows with the image.
    """
    bad = images.filter(F.col("height") < 0).select(F.col("origin").alias("file"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, h, w, ch, data in zip(b["origin"], b["height"], b["width"], b["nChannels"], b["data"]):
                grey = np.frombuffer(data, dtype=np.uint8).reshape(h, w, ch)[:, :, : min(ch, 3)].mean(axis=2)
                rows = []
                for r in range(0, h, tile):
                    for c in range(0, w, tile):
                        part = grey[r : r + tile, c : c + tile]
                        rows.append((file, r // tile, c // tile, part.shape[0], part.shape[1], part.ravel()))
                yield pd.DataFrame(rows, columns=["file", "tile_row", "tile_col", "height", "width", "px"])

    good = images.filter(F.col("height") > 0).select("origin", "height", "width", "nChannels", "data")
    return good.mapInPandas(cut, "file string, tile_row int, tile_col int, height int, width int, px array<double>"), bad


def read_frames(spark: SparkSession, path: str, tile: int = 282) -> tuple[DataFrame, DataFrame]:
    """``frame_tiles`` of all 8-bit images below a folder. 12-bit frames enter as Parquet arrays instead."""
    return frame_tiles(spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*"), tile)


def label_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Class-folder labels of real image files; companions such as ``._x.png`` and odd extensions are left out."""
    return files.filter(~phantom_file(path)).withColumn("class", F.try_element_at(F.split(path, "/"), F.lit(-2)))


def write_by_date(df: DataFrame, path: str, kind: str, stem: str | None = "stem", today: str | None = None) -> None:
    """Append below ``<path>/<kind>/date=<yyyyMMdd>``.

    The date comes from the stem (backlog) or, with ``today``, is that day for all
    rows (live). Rows of one date are spread over tasks, so a busy day is several files.
    """
    date = F.lit(today) if today is not None else stem_date(stem)
    df.withColumn("date", date).write.mode("append").partitionBy("date").parquet(f"{path}/{kind}")


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false").option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


# ---- annotated shapes as pixel runs -----------------------------------------------------------------------------


def _edge_runs(p: np.ndarray, closed: bool) -> list[tuple[int, int, int]]:
    """Pixels of the outline: one per row on steep edges, one per column on flat ones."""
    q = np.roll(p, -1, axis=0) if closed else p[1:]
    out = []
    for (xa, ya), (xb, yb) in zip(p[: len(q)].tolist(), q.tolist()):
        steps = max(abs(xb - xa), abs(yb - ya), 1)
        at = np.arange(steps + 1) / steps
        xs, ys = np.floor(xa + at * (xb - xa) + 0.5).astype(int), np.floor(ya + at * (yb - ya) + 0.5).astype(int)
        out += [(y, x, x + 1) for y, x in zip(ys.tolist(), xs.tolist())]
    return out


def _fill_runs(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Even-odd inside of a polygon, outline included."""
    out = _edge_runs(p, True)
    xa, ya = p[:, 0].astype(float), p[:, 1].astype(float)
    xb, yb = np.roll(xa, -1), np.roll(ya, -1)
    for y in range(int(ya.min()), int(ya.max()) + 1):
        cross = (np.minimum(ya, yb) <= y) & (y < np.maximum(ya, yb))
        xs = np.sort(xa[cross] + (y - ya[cross]) * (xb[cross] - xa[cross]) / (yb[cross] - ya[cross]))
        out += [(y, int(np.ceil(a)), int(np.floor(b)) + 1) for a, b in zip(xs[::2], xs[1::2])]
    return out


def _disc_runs(x: int, y: int, r: int) -> list[tuple[int, int, int]]:
    ys = np.arange(-r, r + 1)
    half = np.floor(np.sqrt(np.maximum(r * r - ys * ys, 0))).astype(int)
    return list(zip((y + ys).tolist(), (x - half).tolist(), (x + half + 1).tolist()))


def shape_runs(kind: str, points: Sequence[Sequence[float]], rules: str) -> list[tuple[int, int, int]]:
    """Runs (y, x0, x1) of one shape.

    ``crops`` rules: rectangles, and polygons, freehand and linestrips filled; other
    kinds are ignored. ``tiles`` rules: also circles and points (radius 3), and
    lines drawn 3 px wide.
    """
    p = np.asarray([list(q) for q in points], dtype=float)
    if not len(p):
        return []
    whole = np.rint(p).astype(int)
    if kind == "rectangle" and len(p) >= 2:
        (xa, ya), (xb, yb) = whole[0], whole[1]
        return [(y, min(xa, xb), max(xa, xb) + 1) for y in range(min(ya, yb), max(ya, yb) + 1)]
    if kind == "polygon" or (rules == "crops" and kind in ("freehand", "linestrip")):
        return _fill_runs(whole)
    if rules == "tiles":
        if kind == "circle" and len(p) >= 2:
            return _disc_runs(int(whole[0, 0]), int(whole[0, 1]), int(round(float(np.linalg.norm(p[1] - p[0])))))
        if kind == "point":
            return _disc_runs(int(whole[0, 0]), int(whole[0, 1]), 3)
        if kind in ("line", "linestrip"):
            thin = _edge_runs(whole, False)
            return [(y + d, a - 1, b + 1) for y, a, b in thin for d in (-1, 0, 1)]
    return []


def annotation_runs(shapes: DataFrame, image: str, height: int, width: int, rules: str = "crops", labels: Sequence[str] | None = None) -> DataFrame:
    """Union of all shapes of an image as pixel runs, clipped to the image."""
    if labels is not None:
        shapes = shapes.filter(F.col("label").isin(list(labels)))
    ddl = f"`{image}` {shapes.schema[image].dataType.simpleString()}, y long, x0 long, x1 long"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, kind, points in zip(b[image], b["shape_type"], b["points"]):
                runs = [(y, max(a, 0), min(z, width)) for y, a, z in shape_runs(kind, points, rules) if 0 <= y < height]
                out = pd.DataFrame(runs, columns=["y", "x0", "x1"])
                yield out[out["x1"] > out["x0"]].assign(**{image: name})[[image, "y", "x0", "x1"]]

    return merge_runs(shapes.select(image, "shape_type", "points").mapInPandas(draw, ddl), [image])
