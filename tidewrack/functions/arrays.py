"""Columns on pixel and vector arrays (``ARRAY<DOUBLE>``), all evaluated in the JVM unless named otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row.

    A lambda body is evaluated per element, so anything that depends on the whole
    array has to be bound outside of it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def total(px: str | Column) -> Column:
    return F.aggregate(_c(px), F.lit(0.0), lambda a, v: a + v)


def mean(px: str | Column) -> Column:
    return total(px) / F.size(_c(px))


def subtract(px: str | Column, bg: str | Column, mode: str = "subtract", eps: float = 1e-6) -> Column:
    """Frame against background (subtract, divide or hybrid), then min-max scaled to whole numbers 0..255."""
    rule = {
        "subtract": lambda v, b: v - b,
        "divide": lambda v, b: v / (b + eps),
        "hybrid": lambda v, b: (v - b) / (b + eps),
    }[mode]
    scaled = lambda raw, lo, span: F.transform(
        raw, lambda v: F.coalesce(F.floor((v - lo) * (255.0 / F.nullif(span, F.lit(0.0)))), F.lit(0).cast("long")).cast("int"))
    return let(F.zip_with(_c(px), _c(bg), rule), lambda raw: let(
        F.array_min(raw), lambda lo: let(F.array_max(raw) - lo, lambda span: scaled(raw, lo, span))))


def tone(px: str | Column, dark: str | Column | None, hdr_max: float, gamma: float, gain: float) -> Column:
    """Dark frame off, clipped to [1, hdr_max], scaled, gamma and gain, then 0..255 with half-even rounding."""
    base = _c(px) if dark is None else F.zip_with(_c(px), _c(dark), lambda v, d: v - d)
    return F.transform(base, lambda v: F.bround(clip(F.pow(clip(v, 1.0, hdr_max) / hdr_max, F.lit(gamma)) * gain, 0.0, 1.0) * 255, 0).cast("int"))


def to_u8(px: str | Column, top: float) -> Column:
    return F.transform(_c(px), lambda v: F.floor(clip(v / top * 255, 0.0, 255.0)).cast("int"))


def mean_std_threshold(px: str | Column) -> Column:
    """255 where a pixel exceeds mean + population standard deviation of its frame, else 0."""
    px = _c(px)
    spread = lambda m: F.sqrt(F.aggregate(px, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(px))
    bar = let(mean(px), lambda m: m + spread(m))
    return let(bar, lambda b: F.transform(px, lambda v: F.when(v > b, 255).otherwise(0)))


def recon_error(x: str | Column, y: str | Column) -> Column:
    """Mean squared difference of two arrays."""
    return mean(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def squared_distance(x: str | Column, y: str | Column) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def softmax(logits: str | Column) -> Column:
    logits = _c(logits)
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return let(powers, lambda e: let(total(e), lambda z: F.transform(e, lambda v: v / z)))


def top1(logits: str | Column) -> Column:
    """Struct of the first largest class index and its softmax probability."""
    return let(softmax(logits), lambda p: let(F.array_max(p), lambda best: F.struct(
        (F.array_position(p, best) - 1).cast("int").alias("class_idx"), best.alias("confidence"))))


def fft_ring_mean(height: int, width: int, r_in: float, r_out: float):
    """Pandas UDF: mean of the non-zero FFT magnitudes with r_in < radius < r_out around the centre."""
    y, x = np.ogrid[:height, :width]
    d = (x - width // 2) ** 2 + (y - height // 2) ** 2
    ring = (d > r_in**2) & (d < r_out**2)

    @F.pandas_udf("double")
    def ring_mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            out = []
            for f in frames:
                mag = np.abs(np.fft.fftshift(np.fft.fft2(np.asarray(f, dtype=float).reshape(height, width))))[ring]
                mag = mag[mag != 0]
                out.append(float(mag.mean()) if mag.size else 0.0)
            yield pd.Series(out)

    return ring_mean
