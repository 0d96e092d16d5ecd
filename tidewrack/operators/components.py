"""Connected components of cells or pixel runs.

A mask is a table of runs: one row per (image, y) interval ``[x0, x1)``. Runs are
labelled inside bands of rows (one task handles many small images, a large
image is split into bands), then labels that touch across a band border are
merged per image. The border table grows with the image's width only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.slices import block
from tidewrack.session import durable


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node number of each node's component, for edges ``a``-``b``."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            break
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def run_edges(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of touching runs. Input is sorted by (row, x0) and disjoint inside a row.

    ``reach`` is 1 when diagonal neighbours touch (8-connected), else 0.
    """
    n = len(row)
    flat = np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] <= x1[:-1]))
    wide = int(x1.max()) + 4 if n else 4
    lo = np.searchsorted(row * wide + x1, (row + 1) * wide + x0 - reach, side="right")
    hi = np.searchsorted(row * wide + x0, (row + 1) * wide + x1 + reach, side="left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return np.concatenate([flat, a]), np.concatenate([flat + 1, b])


def whole_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable, schema: str, fold: bool = False) -> DataFrame:
    """Run ``fn`` on Arrow batches that hold complete key groups.

    Cheaper than one Python call per group when groups are small: a batch
    carries many of them, and only the last group of a batch waits for the next.
    ``fold``: ``fn`` returns its input's columns and may run on its own results,
    so a group of many batches is condensed batch by batch.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            tail = batch[names].iloc[-1]
            open_rows = (batch[names] == tail).all(axis=1).to_numpy()
            start = len(batch) - int(np.argmin(open_rows[::-1])) if not open_rows.all() else 0
            if start == 0:
                if held and not (held[-1][names].iloc[-1] == tail).all():
                    yield fn(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch)
                if fold and len(held) > 1:
                    held = [fn(pd.concat(held, ignore_index=True))[list(batch.columns)]]
                continue
            held.append(batch.iloc[:start])
            yield fn(pd.concat(held, ignore_index=True))
            held = [batch.iloc[start:]]
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def merge_runs(df: DataFrame, keys: Sequence[str], y: str = "y", x0: str = "x0", x1: str = "x1", tile: int = 4096) -> DataFrame:
    """Union of intervals per (keys, y): overlapping or touching ones become one run.

    Intervals are cut at multiples of ``tile`` columns first, so one row of a very
    wide or heavily overlapped image is still many groups.
    """
    cut = (
        df.filter(F.col(x1) > F.col(x0))
        .withColumn("_tx", F.explode(F.sequence(block(F.col(x0), tile), block(F.col(x1) - 1, tile))))
        .select(
            *keys,
            F.col(y).cast("long").alias("y"),
            "_tx",
            F.greatest(F.col(x0).cast("long"), F.col("_tx") * tile).alias("x0"),
            F.least(F.col(x1).cast("long"), (F.col("_tx") + 1) * tile).alias("x1"),
        )
        .groupBy(*keys, "y", "_tx", "x0")
        .agg(F.max("x1").alias("x1"))
    )
    w = Window.partitionBy(*keys, "y", "_tx").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)
    return (
        cut.withColumn("_new", fresh)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "_tx", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_tx", "_run")
    )


def rect_slabs(boxes: DataFrame, keys: Sequence[str], inclusive: bool = False, band: int = 64, tile: int = 4096) -> DataFrame:
    """Union of boxes per key as disjoint rectangles y0, y1, x0, x1 (``inclusive``: the far border belongs to the shape).

    Only boxes are shuffled, cut at ``band`` rows and ``tile`` columns; the rows of
    pixels exist inside a batch alone. Equal runs of consecutive rows are one rectangle.
    """
    names = list(keys)
    extra = 1 if inclusive else 0
    at = lambda c: F.col(c).cast("long")
    ends = boxes.select(*names, at("y0").alias("y0"), (at("y1") + extra).alias("y1"), at("x0").alias("x0"), (at("x1") + extra).alias("x1"))
    cut = cut_to_grid(ends.filter((F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))), band, tile, "_band", "_tx")

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby([*names, "_band", "_tx"], sort=False, dropna=False).ngroup().to_numpy()
        base = pdf["_tx"].to_numpy(np.int64) * tile
        y, src = _rows_of(pdf["y0"].to_numpy(np.int64), pdf["y1"].to_numpy(np.int64))
        # one number per pixel of a batch: rows of all groups one after the other
        wide = tile + 2
        line = (group[src] * band + y - pdf["_band"].to_numpy(np.int64)[src] * band) * wide
        start, end = line + (pdf["x0"].to_numpy(np.int64) - base)[src], line + (pdf["x1"].to_numpy(np.int64) - base)[src]
        order = np.argsort(start, kind="stable")
        start, end, src, y = start[order], np.maximum.accumulate(end[order]), src[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        last = np.concatenate([first[1:], [len(start)]]) - 1
        src, y = src[first], y[first]
        a, b, g = start[first] % wide, end[last] % wide, group[src]
        order = np.lexsort((y, b, a, g))
        a, b, g, y, src = a[order], b[order], g[order], y[order], src[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (y[1:] != y[:-1] + 1)])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(y)]]) - 1
        out = pdf.iloc[src[head]].reset_index(drop=True)
        return out.assign(y0=y[head], y1=y[tail] + 1, x0=base[src[head]] + a[head], x1=base[src[head]] + b[head])

    return whole_groups(cut, [*names, "_band", "_tx"], [], unite, _ddl(cut, cut.columns), fold=True).drop("_band", "_tx")


def cut_to_grid(rects: DataFrame, height: int, width: int, row: str, col: str) -> DataFrame:
    """Rectangles cut at the lines of a grid; ``row`` and ``col`` number the cell of each part."""
    span = lambda a, b, size: F.explode(F.sequence(block(F.col(a), size), block(F.col(b) - 1, size)))
    rest = [c for c in rects.columns if c not in ("y0", "y1", "x0", "x1")]
    return rects.withColumn(row, span("y0", "y1", height)).withColumn(col, span("x0", "x1", width)).select(
        *rest, row, col,
        F.greatest("y0", F.col(row) * height).alias("y0"), F.least("y1", (F.col(row) + 1) * height).alias("y1"),
        F.greatest("x0", F.col(col) * width).alias("x0"), F.least("x1", (F.col(col) + 1) * width).alias("x1"))


def as_slabs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A mask of runs (y, x0, x1) or of rectangles (y0, y1, x0, x1) as rectangles."""
    y0, y1 = ("y0", F.col("y1")) if "y0" in mask.columns else ("y", F.col("y") + 1)
    return mask.select(*keys, F.col(y0).cast("long").alias("y0"), y1.cast("long").alias("y1"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))


def _rows_of(y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row of every rectangle, and the rectangle's number."""
    count = y1 - y0
    src = np.repeat(np.arange(len(y0)), count)
    return y0[src] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), src


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _border_roots(top: DataFrame, low: DataFrame, names: list[str], reach: int) -> DataFrame:
    """Roots of regions that touch across band borders: ``top`` holds the first rows of bands, ``low`` the last ones."""
    top = top.select(*names, (F.col("y") - 1).alias("y"), F.col("x0").alias("_u0"), F.col("x1").alias("_u1"), F.col("region").alias("_lower"))
    step = 1024
    cells = lambda d, a, b, pad: d.withColumn("_cx", F.explode(F.sequence(block(F.col(a) - pad, step), block(F.col(b) - 1 + pad, step))))
    edges = (
        cells(low, "x0", "x1", reach)
        .join(cells(top, "_u0", "_u1", 0), [*names, "y", "_cx"])
        .filter((F.col("x0") < F.col("_u1") + reach) & (F.col("_u0") < F.col("x1") + reach))
        .select(*names, F.col("region").alias("a"), F.col("_lower").alias("b"))
        .distinct()
    )

    def join_labels(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = pdf.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        pairs = pd.MultiIndex.from_arrays([np.tile(gid, 2), np.concatenate([pdf["a"], pdf["b"]])])
        codes, uniques = pd.factorize(pairs, sort=True)
        ids = uniques.get_level_values(1).to_numpy()
        root = min_labels(len(uniques), codes[: len(pdf)], codes[len(pdf) :])
        firsts = np.unique(codes, return_index=True)[1] % len(pdf)
        out = pdf[names].iloc[firsts].reset_index(drop=True)
        return out.assign(region=ids, _root=ids[root])

    return whole_groups(edges, names, ["a"], join_labels, f"{_ddl(edges, names)}, region long, _root long")


def label_runs(
    runs: DataFrame,
    keys: Sequence[str],
    connectivity: int = 8,
    band: int = 256,
) -> DataFrame:
    """Add ``region``: the smallest ``y * 2^32 + x0`` of the run's component.

    ``runs`` has the key columns plus y, x0, x1 (half-open, disjoint per row).
    Runs are labelled inside bands of ``band`` rows and stored; labels that touch
    across a band border are merged, if there are any.
    """
    reach = 1 if connectivity == 8 else 0
    names = list(keys)
    banded = runs.withColumn("_band", block(F.col("y"), band))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(np.int64)
        x0, x1 = pdf["x0"].to_numpy(np.int64), pdf["x1"].to_numpy(np.int64)
        change = np.zeros(len(pdf), dtype=bool)
        for k in [*names, "_band"]:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        row = np.cumsum(change) * (int(y.max()) + 2) + y
        first = min_labels(len(pdf), *run_edges(row, x0, x1, reach))
        return pdf.assign(region=(y << 32)[first] + x0[first])

    labelled = durable(
        whole_groups(banded, [*names, "_band"], ["y", "x0"], label, f"{_ddl(banded, banded.columns)}, region long")
    )
    if labelled.filter(F.col("_band") != 0).isEmpty():
        return labelled.drop("_band")

    top = labelled.filter(F.pmod("y", F.lit(band)) == 0)
    low = labelled.filter(F.pmod("y", F.lit(band)) == band - 1)
    roots = _border_roots(top, low, names, reach)
    return (
        labelled.join(roots, [*names, "region"], "left")
        .withColumn("region", F.coalesce("_root", "region"))
        .select(*runs.columns, "region")
    )


def region_stats(mask: DataFrame, keys: Sequence[str], connectivity: int = 8, band: int = 256) -> DataFrame:
    """Components of a mask (runs or disjoint rectangles): keys, region, area and box y0, x0, y1, x1 (half-open).

    ``region`` as in :func:`label_runs`. Stored are one row per component of a band
    and the runs at band borders, not the labelled runs.
    """
    reach = 1 if connectivity == 8 else 0
    names = list(keys)
    banded = cut_to_grid(as_slabs(mask, names), band, 1 << 31, "_band", "_col").drop("_col")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby([*names, "_band"], sort=False, dropna=False).ngroup().to_numpy()
        y, src = _rows_of(pdf["y0"].to_numpy(np.int64), pdf["y1"].to_numpy(np.int64))
        low = int(y.min())
        row = group[src] * (int(y.max()) - low + 3) + y - low
        x0, x1 = pdf["x0"].to_numpy(np.int64)[src], pdf["x1"].to_numpy(np.int64)[src]
        order = np.lexsort((x0, row))
        row, y, x0, x1, src = row[order], y[order], x0[order], x1[order], src[order]
        shift = int(x0.min())
        root = min_labels(len(row), *run_edges(row, x0 - shift, x1 - shift, reach))
        region = (y << 32)[root] + x0[root]
        runs = pd.DataFrame({"root": root, "area": x1 - x0, "y0": y, "x0": x0, "y1": y + 1, "x1": x1})
        found = runs.groupby("root", sort=True).agg({"area": "sum", "y0": "min", "x0": "min", "y1": "max", "x1": "max"})
        at = found.index.to_numpy()
        edge = np.flatnonzero((y % band == 0) | (y % band == band - 1))
        part = lambda rows, i, is_edge: pdf[names].iloc[src[i]].reset_index(drop=True).assign(
            region=region[i], _edge=is_edge, **{c: rows[c].to_numpy() for c in ("area", "y0", "x0", "y1", "x1")})
        return pd.concat([part(found, at, False), part(runs.iloc[edge], edge, True)], ignore_index=True)

    kept = "region long, _edge boolean, area long, y0 long, x0 long, y1 long, x1 long"
    stored = durable(whole_groups(banded, [*names, "_band"], ["y0", "x0"], measure, f"{_ddl(banded, names)}, {kept}"))
    parts, edges = stored.filter(~F.col("_edge")).drop("_edge"), stored.filter("_edge").withColumn("y", F.col("y0"))
    low = edges.filter(F.pmod("y", F.lit(band)) == band - 1)
    if low.isEmpty():
        return parts
    roots = _border_roots(edges.filter(F.pmod("y", F.lit(band)) == 0), low, names, reach)
    return (
        parts.join(roots, [*names, "region"], "left").groupBy(*names, F.coalesce("_root", "region").alias("region"))
        .agg(F.sum("area").alias("area"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))
    )


def label_cells(cells: DataFrame, keys: Sequence[str], r: str = "r", c: str = "c", connectivity: int = 8,
                band: int = 256) -> DataFrame:
    """Components of single grid cells; adds ``region`` (see :func:`label_runs`)."""
    runs = cells.withColumn("y", F.col(r)).withColumn("x0", F.col(c)).withColumn("x1", F.col(c) + 1)
    out = label_runs(runs, keys, connectivity, band)
    return out.select(*cells.columns, "region")
