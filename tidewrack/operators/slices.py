"""Slices of equal row count: windows and running state split by place, so one busy key is many tasks.

Rows are ranked inside their key (range partitions, no key in one task) and cut
every so many rows, so a key whose rows all fall into one hour is cut like any
other. Running state (last and next value, sums) is summed up per slice, carried
over slices, and enters each slice as one extra row. What a trailing window holds
is read off by extra rows at its edges, so no window's rows are copied. Where
they are needed themselves, a slice fetches them from the slices its span
overlaps (a halo).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.ordering import rank_rows

SECOND = 1_000_000
#: Rows of a slice.
ROWS = 200_000


def micros(seconds: float) -> int:
    return int(round(seconds * SECOND))


def us(ts: str | Column) -> Column:
    """Epoch microseconds of an instant."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def block(value: Column, size: int) -> Column:
    """Whole number of ``size`` steps below ``value``, also right for negative values."""
    return F.floor((value - F.pmod(value, F.lit(size))) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, t: Column, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row to every block of ``size`` places that can see it; ``_own`` marks the row's own block.

    ``t`` is a row number from 0; ``before``/``after`` say how many rows a row's window looks back and ahead.
    """
    spans = F.sequence(block(t - F.lit(after), size), block(t + F.lit(before), size))
    return df.withColumn("_slice", F.explode_outer(spans)).withColumn("_own", F.col("_slice").eqNullSafe(block(t, size)))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_slice")


def place(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int | None = None) -> DataFrame:
    """``df`` (stored) with ``_n``, the row number inside the key by ``order``, and ``_slice``, which holds ``rows`` rows of a key."""
    return rank_rows(df, keys, order, "_n").withColumn("_slice", F.floor((F.col("_n") - 1) / (rows or ROWS)).cast("long"))


def running(placed: DataFrame, keys: Sequence[str], last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
            following: Mapping[str, Column] | None = None) -> DataFrame:
    """Add to the rows of ``place``, per key in their order, the last non-null value so far, running sums so far, and the next non-null value.

    All include the current row.
    """
    last, total, following = dict(last or {}), dict(total or {}), dict(following or {})
    named = {**{f"_l_{n}": c for n, c in last.items()}, **{f"_s_{n}": c for n, c in total.items()}, **{f"_f_{n}": c for n, c in following.items()}}
    rows = placed.select("*", *[c.alias(n) for n, c in named.items()])
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("_n"))
    summary = rows.groupBy(*keys, "_slice").agg(
        *[F.max_by(f"_l_{n}", at(f"_l_{n}")).alias(f"_l_{n}") for n in last],
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in total],
        *[F.min_by(f"_f_{n}", at(f"_f_{n}")).alias(f"_f_{n}") for n in following],
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    # the state around a slice enters its windows as an extra first and last row
    both = rows.withColumn("_real", F.lit(1))
    if last or total:
        both = both.unionByName(summary.select(
            *keys, "_slice", F.lit(0).alias("_real"),
            *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in last],
            *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in total]), allowMissingColumns=True)
    if following:
        both = both.unionByName(summary.select(
            *keys, "_slice", F.lit(2).alias("_real"), *[F.last(f"_f_{n}", ignorenulls=True).over(later).alias(f"_f_{n}") for n in following]), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_real", "_n").rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_real"), F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(
        *placed.columns,
        "_real",
        *[F.last(f"_l_{n}", ignorenulls=True).over(so_far).alias(n) for n in last],
        *[F.sum(f"_s_{n}").over(so_far).alias(n) for n in total],
        *[F.last(f"_f_{n}", ignorenulls=True).over(from_end).alias(n) for n in following],
    ).filter(F.col("_real") == 1).drop("_real")


def oldest_since(df: DataFrame, keys: Sequence[str], t: Column, at: Column, values: Mapping[str, Column], rows: int | None = None) -> DataFrame:
    """``df`` with the first non-null of each of ``values`` among the key's rows whose time is ``at`` or later. ``t`` is a row's time."""
    events = df.filter(t.isNotNull()).select(*keys, t.alias("_at"), F.lit(1).alias("_event"), *[c.alias(f"_v_{n}") for n, c in values.items()])
    probes = df.select("*", at.alias("_at"), F.lit(0).alias("_event"))
    placed = place(probes.unionByName(events, allowMissingColumns=True), keys, [F.asc_nulls_last("_at"), "_event"], rows)
    return running(placed, keys, following={n: F.col(f"_v_{n}") for n in values}).filter("_event = 0").select(*df.columns, *values)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Join condition on keys of ``a`` and prefixed ones of ``b``, nulls equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in keys], F.lit(True))


def time_halo(placed: DataFrame, keys: Sequence[str], t: str, before: int, after: int) -> DataFrame:
    """Rows of ``place`` (by ``t``) sent to each slice that sees them: ``_to`` is that slice, ``_own`` marks the row's own."""
    spans = placed.groupBy(*keys, "_slice").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    near = spans.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col("_slice").alias("_to"), (F.col("_lo") - before).alias("_from"), (F.col("_hi") + after).alias("_until"))
    meets = same_keys(spans, near, keys, "_d_") & ((F.col("_slice") == F.col("_to")) | ((F.col("_hi") >= F.col("_from")) & (F.col("_lo") <= F.col("_until"))))
    sent = spans.join(near, meets).select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_slice").alias("_out"), "_to", "_from", "_until")
    rows = placed.join(sent, same_keys(placed, sent, keys, "_s_") & (placed["_slice"] == sent["_out"]))
    rows = rows.withColumn("_own", F.col("_slice") == F.col("_to")).filter(F.col("_own") | F.col(t).between(F.col("_from"), F.col("_until")))
    return rows.drop("_out", "_from", "_until", "_slice", *[f"_s_{k}" for k in keys])
