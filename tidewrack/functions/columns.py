"""Scalar columns: text parsing, unit and humidity maths, status texts, crop measures."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensor line keys and the column each one becomes (names differ in case only, so long names are used).
SENSOR_KEYS = {
    "p": "internal_pressure_pa",
    "h": "humidity_pct",
    "b": "internal_temp_c",
    "P": "water_pressure_mbar",
    "d": "depth_m",
    "T": "water_temp_c",
    "l": "leak",
    "t": "probe_temp_c",
}
PA_PER_INHG = 3386.389
KELVIN = 273.15
MAGNUS_B, MAGNUS_C = 17.62, 243.12


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- sensor lines -----------------------------------------------------------------------------------------------


def sensor_fields(line: str | Column) -> Column:
    """Map of key -> double of a ``k:v,k:v`` line. Bad floats are skipped; the last value of a key wins."""
    parts = F.filter(F.split(_c(line), ","), lambda p: p.contains(":"))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("k"),
            F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).try_cast("double").alias("v"),
        ),
    )
    good = F.filter(pairs, lambda e: e["v"].isNotNull())
    wanted = F.array(*[F.lit(k) for k in SENSOR_KEYS])
    none = F.lit(None).cast("double")
    values = lambda found: F.transform(wanted, lambda k: F.aggregate(found, none, lambda v, e: F.when(e["k"] == k, e["v"]).otherwise(v)))
    # a list of one: the line is split once, not once per key
    return F.map_from_arrays(wanted, F.element_at(F.transform(F.array(good), values), 1))


def parse_sensor_line(df: DataFrame, line: str = "line", required: Sequence[str] = tuple(SENSOR_KEYS)) -> DataFrame:
    """Add one column per sensor key. All are null unless every ``required`` key is present."""
    df = df.withColumn("_f", sensor_fields(line))
    value = lambda k: F.col("_f")[k]
    complete = F.lit(True)
    for k in required:
        complete = complete & value(k).isNotNull()
    return df.select("*", *[F.when(complete, value(k)).alias(n) for k, n in SENSOR_KEYS.items()]).drop("_f")


# ---- file names -------------------------------------------------------------------------------------------------

# Name patterns.
FRAME_STEM = r"^(?:frame|img)_(\d{8})_(\d{6})_(\d+)"
CROP_TAIL = r"_crop_(\d+)_area_(\d+(?:\.\d+)?)"
SPECIES_TAIL = r"^img_\d{8}_\d{6}_\d+_([A-Za-z][A-Za-z0-9_ -]*)$"
TILE_NAME = r"_r(\d+)_c(\d+)_o(\d+)"
DATE_DIR = r"^\d{8}$"
CROP_FILE = r"^frame_\d{8}_\d{6}_\d+_crop_\d+_area_[\d.]+\.png$"


def _blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def stem_of(name: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(_c(name), "/"), -1), r"\.(png|tiff?|json|jpe?g)$", "")


def stem_date(name: str | Column) -> Column:
    """Capture date (yyyyMMdd) taken from the stem, not from today's clock."""
    return _blank(F.regexp_extract(stem_of(name), FRAME_STEM, 1))


def parse_frame_stem(df: DataFrame, name: str) -> DataFrame:
    """Add date, time, capture instant, counter, crop id, area, species and the clean name of a stem."""
    s = stem_of(name)
    date, clock = stem_date(name), _blank(F.regexp_extract(s, FRAME_STEM, 2))
    return df.select(
        "*",
        date.alias("date"), clock.alias("clock"),
        F.try_to_timestamp(F.concat(date, clock), F.lit("yyyyMMddHHmmss")).alias("captured"),
        _blank(F.regexp_extract(s, FRAME_STEM, 3)).try_cast("long").alias("counter"),
        _blank(F.regexp_extract(s, CROP_TAIL, 1)).try_cast("int").alias("crop_id"),
        _blank(F.regexp_extract(s, CROP_TAIL, 2)).try_cast("double").alias("area_mm2"),
        _blank(F.regexp_extract(s, SPECIES_TAIL, 1)).alias("species"),
        F.regexp_replace(s, CROP_TAIL + "$", "").alias("clean_name"),
    )


def parse_tile_name(df: DataFrame, name: str) -> DataFrame:
    """Add row, col (with fractional offset) and original image stem; names without a tile suffix are dropped."""
    n = F.col(name)
    part = lambda i: _blank(F.regexp_extract(n, TILE_NAME, i)).cast("double")
    return (
        df.filter(n.rlike(TILE_NAME))
        .withColumn("tile_row", part(1) + part(3) / 100.0)
        .withColumn("tile_col", part(2) + part(3) / 100.0)
        .withColumn("original", F.regexp_replace(stem_of(name), r"_r\d+_c\d+(_o\d+)?$", ""))
    )


def crop_size_mm2(name: str, width: str, height: str, strict: bool = False, mm_per_px: float = 0.02) -> Column:
    """Area from the file name, else width * height in mm².

    ``strict`` accepts whole numbers only (then names such as ``area_15.53.png``
    fall back to the box); the default reads decimals too.
    """
    pattern = r"_area_(\d+)\.png$" if strict else r"_area_(\d+(?:\.\d+)?)\.png$"
    named = _blank(F.regexp_extract(F.col(name), pattern, 1)).cast("double")
    return F.coalesce(named, F.col(width) * F.col(height) * F.lit(mm_per_px**2))


def valid_public_name(date_dir: str | Column, file: str | Column) -> Column:
    return _c(date_dir).rlike(DATE_DIR) & _c(file).rlike(CROP_FILE)


def file_label(path: str | Column, yes: str = "obs", no: str = "no_obs") -> Column:
    """True/false from the parent folder's name (any case); null for other folders."""
    folder = F.lower(F.try_element_at(F.split(_c(path), "/"), F.lit(-2)))
    return F.when(folder == yes, True).when(folder == no, False)


def phantom_file(path: str | Column, extensions: Sequence[str] = ("png", "jpg", "jpeg", "tif", "tiff")) -> Column:
    """True for ``._*`` companions and for unknown extensions."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    known = F.lower(F.substring_index(name, ".", -1)).isin(*extensions) & name.contains(".")
    return name.startswith("._") | ~known


def renumber(df: DataFrame, name: str, offset: int = 0, prefix: str = "img_") -> DataFrame:
    """``img_<n>.png`` -> n + offset, zero-padded to the longest number of the whole set."""
    number = _blank(F.regexp_extract(F.col(name), rf"^{prefix}(\d+)\.png$", 1)).try_cast("long") + offset
    rows = df.withColumn("_n", number).filter(F.col("_n").isNotNull())
    width = rows.agg(F.max(F.length(F.col("_n").cast("string"))).alias("_w"))
    padded = F.lpad(F.col("_n").cast("string"), width.scalar(), F.lit("0"))
    return rows.withColumn("new_name", F.concat(F.lit(prefix), padded, F.lit(".png"))).drop("_n")


def rename_label(df: DataFrame, col: str, old: str, new: str) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == old, F.lit(new)).otherwise(F.col(col)))


# ---- humidity and units -----------------------------------------------------------------------------------------


def saturation_vapor_pressure(t: str | Column) -> Column:
    """hPa, Magnus formula."""
    return 6.112 * F.exp((MAGNUS_B * _c(t)) / (MAGNUS_C + _c(t)))


def dew_point_c(t: str | Column, rh: str | Column) -> Column:
    """Null when an input is null or humidity is not positive."""
    t, rh = _c(t), _c(rh)
    alpha = F.ln(F.when(rh > 0, rh) / 100.0) + (MAGNUS_B * t) / (MAGNUS_C + t)
    return F.when(t.isNotNull() & (rh > 0), (MAGNUS_C * alpha) / (MAGNUS_B - alpha))


def dew_point_clamped_c(t: str | Column, rh: str | Column) -> Column:
    """Variant that clamps vapour pressure at 1e-6 hPa instead of returning null."""
    e = F.greatest((_c(rh) / 100.0) * saturation_vapor_pressure(t), F.lit(1e-6))
    ln = F.ln(e / 6.112)
    return F.when(_c(t).isNotNull() & _c(rh).isNotNull(), (MAGNUS_C * ln) / (MAGNUS_B - ln))


def absolute_humidity(t: str | Column, rh: str | Column) -> Column:
    """g/m³."""
    return 216.7 * ((_c(rh) / 100.0) * saturation_vapor_pressure(t)) / (_c(t) + KELVIN)


# Unit factors.
UNIT_FACTORS = {
    ("Pa", "mbar"): 1 / 100,
    ("mbar", "Pa"): 100.0,
    ("Pa", "inHg"): 1 / PA_PER_INHG,
    ("millidegree", "C"): 1 / 1000,
    ("permille", "%"): 1 / 10,
    ("B", "GB"): 1 / 1e9,
    ("B", "MB"): 1 / 1e6,
}


def convert_units(value: str | Column, source: str, target: str) -> Column:
    if (source, target) == ("C", "K"):
        return _c(value) + KELVIN
    return _c(value) * UNIT_FACTORS[(source, target)]


def sane_filter(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose ranged columns are all present and inside their inclusive range."""
    keep = F.lit(True)
    for name, (lo, hi) in ranges.items():
        keep = keep & F.col(name).between(lo, hi)
    return df.filter(keep)


def sane_counts(df: DataFrame, ranges: Mapping[str, tuple[float, float]], *keys: str) -> DataFrame:
    """Kept and rejected row counts of :func:`sane_filter`, per key."""
    keep = F.lit(True)
    for name, (lo, hi) in ranges.items():
        keep = keep & F.coalesce(F.col(name).between(lo, hi), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"))


# ---- status texts -----------------------------------------------------------------------------------------------


def limit_status(value: str | Column, limit: str | Column) -> Column:
    v, m = _c(value), _c(limit)
    return F.when(v >= m, "danger").when(v >= 0.9 * m, "warn")


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text; halves of ``value * 10^digits``, taken in doubles, round up."""
    unit = 10.0**digits
    steps = value.cast("double") * unit + 0.5
    # from 2^53 on a double is whole, and a long would not hold it
    rounded = F.when(F.abs(steps) < 2.0**53, F.floor(steps) / unit).otherwise(value.cast("double"))
    return F.format_string(f"%.{digits}f", rounded)


def age_bucket(seconds: str | Column) -> Column:
    s = _c(seconds)
    return (
        F.when(s.isNull(), "N/A").when(s < 120, F.concat(fixed(s, 0), F.lit("s ago")))
        .when(s < 7200, F.concat(fixed(s / 60, 1), F.lit("m ago")))
        .when(s < 172800, F.concat(fixed(s / 3600, 1), F.lit("h ago")))
        .otherwise(F.concat(fixed(s / 86400, 1), F.lit("d ago")))
    )


def human_bytes(value: str | Column) -> Column:
    b = _c(value)
    return (
        F.when(b.isNull(), "N/A").when(b >= 1e9, F.concat(fixed(b / 1e9, 2), F.lit(" GB")))
        .when(b >= 1e6, F.concat(fixed(b / 1e6, 1), F.lit(" MB"))).otherwise(F.concat(fixed(b, 0), F.lit(" B")))
    )


def human_speed(value: str | Column) -> Column:
    b = _c(value)
    return (
        F.when(b.isNull(), "N/A").when(b >= 1e6, F.concat(fixed(b / 1e6, 2), F.lit(" MB/s")))
        .when(b >= 1e3, F.concat(fixed(b / 1e3, 1), F.lit(" KB/s"))).otherwise(F.concat(fixed(b, 0), F.lit(" B/s")))
    )


def eta_text(hours: str | Column) -> Column:
    h = _c(hours)
    return F.when(h.isNull(), "N/A").when(h < 48, F.concat(fixed(h, 1), F.lit("h"))).otherwise(F.concat(fixed(h / 24, 1), F.lit("d")))


def bandwidth_pct(upload: str | Column, link: str | Column) -> Column:
    """Upload speed as a share of link speed; null when either is missing or zero."""
    return F.nullif(_c(upload), F.lit(0)) / F.nullif(_c(link), F.lit(0)) * 100


# ---- crops ------------------------------------------------------------------------------------------------------

# Public name of each published crop field.
PUBLIC_FIELDS = {"species": "class_label", "confidence": "class_confidence", "size_mm2": "region_size_mm2", "time": "processed_iso"}


def public_view(df: DataFrame, date: str = "date", stem: str = "stem") -> DataFrame:
    """Whitelisted columns and the image address; nothing else gets through."""
    url = F.concat(F.lit("/crop_image/"), F.col(date), F.lit("/"), F.col(stem), F.lit(".png"))
    return df.select(*[F.col(s).alias(p) for p, s in PUBLIC_FIELDS.items()], url.alias("image_url"))


def region_measures(df: DataFrame, upscale: float, mm2_per_px: float, points: str = "region_size_points") -> DataFrame:
    px = F.col(points) * (upscale**2)
    return df.withColumn("region_size_pixels", px).withColumn("region_size_mm2", px * mm2_per_px)


def crop_stem(frame_stem: str | Column, crop_id: str | Column, mm2: str | Column) -> Column:
    return F.format_string("%s_crop_%03d_area_%.2f", _c(frame_stem), _c(crop_id), _c(mm2))


def equivalent_diameter(area: str | Column) -> Column:
    return 2 * F.sqrt(_c(area) / math.pi)


def compactness(area: str | Column, w: str | Column, h: str | Column) -> Column:
    return _c(area) / (_c(w) * _c(h) + 1e-5)


def position_features(row: str | Column, col: str | Column, grid: int = 16) -> Column:
    """x, y, x², y², xy, distance from the centre, sin/cos of 2πx, sin/cos of 2πy."""
    y, x = _c(row) / float(grid - 1), _c(col) / float(grid - 1)
    turn = 2 * math.pi
    return F.array(
        x, y, x * x, y * y, x * y, F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)),
        F.sin(x * turn), F.cos(x * turn), F.sin(y * turn), F.cos(y * turn),
    )


def scale_boxes(df: DataFrame, factor: float, cols: Sequence[str] = ("y0", "x0", "y1", "x1")) -> DataFrame:
    """Box coordinates at another resolution, cut to whole pixels."""
    return df.withColumns({c: (F.col(c) * factor).cast("int") for c in cols})


# Column order of the label tool's import format.
LABELCHECKER_COLUMNS = (
    "Name,Date,Time,CollageFile,ImageFilename,Id,GroupId,Uuid,SrcImage,SrcX,SrcY,ImageX,ImageY,ImageW,ImageH,Timestamp,"
    "ElapsedTime,CalConst,CalImage,AbdArea,AbdDiameter,AbdVolume,AspectRatio,AvgBlue,AvgGreen,AvgRed,BiovolumeCylinder,"
    "BiovolumePSpheroid,BiovolumeSphere,Ch1Area,Ch1Peak,Ch1Width,Ch2Area,Ch2Ch1Ratio,Ch2Peak,Ch2Width,Ch3Area,Ch3Peak,"
    "Ch3Width,CircleFit,Circularity,CircularityHu,Compactness,ConvexPerimeter,Convexity,EdgeGradient,Elongation,EsdDiameter,"
    "EsdVolume,FdDiameter,FeretMaxAngle,FeretMinAngle,FiberCurl,FiberStraightness,FilledArea,FilterScore,GeodesicAspectRatio,"
    "GeodesicLength,GeodesicThickness,Intensity,Length,Perimeter,Ppc,RatioBlueGreen,RatioRedBlue,RatioRedGreen,Roughness,"
    "ScatterArea,ScatterPeak,SigmaIntensity,SphereComplement,SphereCount,SphereUnknown,SphereVolume,SumIntensity,Symmetry,"
    "Transparency,Width,Preprocessing,PreprocessingTrue,LabelPredicted,ProbabilityScore,LabelTrue"
).split(",")

# Which blob-log column fills which import column.
BLOB_LOG_MAPPING = {
    "Name": "folder", "ImageFilename": "crop_filename", "Id": "roi_id", "GroupId": "roi_id", "ImageW": "w", "ImageH": "h",
    "FilledArea": "area", "AbdArea": "area", "Compactness": "compactness", "EsdDiameter": "esd", "AbdDiameter": "esd",
}


# The same for the crop log of an evaluation run; SurfaceAreaMS comes after the format's own columns.
CROP_LOG_MAPPING = {
    "Name": "folder", "ImageFilename": "image_name", "ImageW": "crop_width", "ImageH": "crop_height", "FilledArea": "region_size_pixels",
    "AbdArea": "crop_width * crop_height", "CircleFit": "region_mean_intensity", "SurfaceAreaMS": "region_max_intensity",
}


def to_labelchecker(df: DataFrame, mapping: Mapping[str, str] | None = None, with_uuid: bool = True) -> DataFrame:
    """Wide import table for the label tool; ``mapping`` gives the expression of each filled column, the others are null."""
    mapping = BLOB_LOG_MAPPING if mapping is None else mapping
    uid = F.upper(F.regexp_replace(F.uuid(), "-", "")) if with_uuid else F.lit(None).cast("string")
    extra = [c for c in mapping if c not in LABELCHECKER_COLUMNS]
    return df.select(*[
        F.expr(mapping[c]).alias(c) if c in mapping else uid.alias(c) if c == "Uuid" else F.lit(None).cast("string").alias(c)
        for c in [*LABELCHECKER_COLUMNS, *extra]
    ])


# ---- nested samples ---------------------------------------------------------------------------------------------


def flatten_sample(df: DataFrame, disk_paths: Sequence[str], thermal: str = "thermal_zones_c", disks: str = "disk_free_gb_by_path",
                   stages: Sequence[str] = ("record", "analyse", "send")) -> DataFrame:
    """Map and struct fields of a device sample as plain columns.

    Thermal zones become mean and maximum, disks one column per path, and stage
    structs ``<stage>_<field>``.
    """
    temps = F.filter(F.map_values(thermal), lambda v: v.isNotNull())
    total = F.aggregate(temps, F.lit(0.0), lambda a, v: a + v)
    nested = [s for s in stages if s in df.columns]
    plain = [c for c in df.columns if c not in {thermal, disks, *nested}]
    return df.select(
        *plain,
        (total / F.nullif(F.size(temps), F.lit(0))).alias("thermal_mean_c"),
        F.array_max(temps).alias("thermal_max_c"),
        *[F.try_element_at(disks, F.lit(p)).alias(f"disk_free_gb_{i}") for i, p in enumerate(disk_paths)],
        *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in nested for f in df.schema[s].dataType.fieldNames()],
    )
