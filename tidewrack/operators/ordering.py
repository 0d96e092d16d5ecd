"""Exact ranks and running totals that no single task has to sort.

A window without a key, or with one very large key, ends up in one task. Here
the rows are range-partitioned on (keys, order) instead, so a large key spans
many partitions; per-partition counts then give each partition its start.
The carried table has at most one row per (partition, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import durable

_LOW33 = (1 << 33) - 1
# largest n for which Spark pushes a rank limit below the shuffle by default
_TRIMMED = 1000


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def spread(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Sort ``df`` over range partitions; adds ``_part`` and ``_idx`` (place inside the partition).

    The result is stored, because range bounds come from sampling and every
    later pass must see the same partitions. Without ``parts`` adaptive
    execution sizes the partitions.
    """
    cols = _cols(order)
    ranged = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    placed = ranged.sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id())
    return durable(
        placed.withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
        .drop("_mid")
    )


def _attach(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on ``on``, nulls matching nulls; ``side`` columns other than ``on`` are added."""
    other = side.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in side.columns])
    cond = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"_r_{c}"]) for c in on])
    return rows.join(other, cond, "left").drop(*[f"_r_{c}" for c in on])


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rank",
    parts: int | None = None,
) -> DataFrame:
    """Row number from 1 inside each key by ``order`` (no keys: over the whole table)."""
    rows = spread(df, [*keys, *order], parts)
    heads = rows.groupBy("_part", *keys).agg(F.min("_idx").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    starts = heads.withColumn("_start", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)) - F.col("_lo") + 1)
    joined = _attach(rows, starts.select("_part", *keys, "_start"), ["_part", *keys])
    return joined.withColumn(name, F.col("_idx") + F.col("_start")).drop("_part", "_idx", "_start")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, str | Column],
    parts: int | None = None,
) -> DataFrame:
    """Running sums up to and including each row, by ``order`` inside each key.

    ``totals`` maps new column names to the summed columns.
    """
    sources = {n: (F.col(c) if isinstance(c, str) else c) for n, c in totals.items()}
    df = df.select("*", *[c.alias(f"_v_{n}") for n, c in sources.items()])
    rows = spread(df, [*keys, *order], parts)
    heads = rows.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sources])
    starts = heads.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_s_{n}").over(_before(keys)), F.lit(0)).alias(f"_b_{n}") for n in sources]
    )
    inner = Window.partitionBy("_part", *keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = _attach(rows, starts, ["_part", *keys])
    out = joined.select(
        "*", *[(F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in sources]
    )
    return out.drop("_part", "_idx", *[f"_v_{n}" for n in sources], *[f"_b_{n}" for n in sources])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    return df.withColumn("_s", one_row.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str | Column, q: float, name: str, parts: int | None = None) -> DataFrame:
    """Linear-interpolated percentile per key, from cumulated counts of distinct values.

    The built-in percentile keeps all distinct values of a group in one task;
    here a large group stays spread over range partitions. Nulls are skipped.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, keys, ["_v"], {"_cum": "_c"}, parts)
    sizes = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = _attach(ranked, sizes, list(keys)) if keys else with_scalars(ranked, sizes)
    pos = (F.col("_n") - 1) * q
    at = lambda p: F.min(F.when(F.col("_cum") > p, F.col("_v")))
    ends = ranked.withColumns({"_lo": F.floor(pos), "_hi": F.ceil(pos), "_f": pos - F.floor(pos)}).groupBy(*keys).agg(
        at(F.col("_lo")).alias("_a"), at(F.col("_hi")).alias("_b"), F.max("_f").alias("_f"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key.

    For a small ``n`` the rank filter lets Spark trim every input partition to ``n``
    per key before the shuffle; a large ``n`` ranks over range partitions.
    """
    if n > _TRIMMED:
        return rank_rows(df, keys, order, name).filter(F.col(name) <= n)
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def md5_order(seed: str | int, *key: str) -> Column:
    """A repeatable shuffle order: MD5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def py_round(value: Column) -> Column:
    """Round half to even, as Python does, to a whole number."""
    return F.bround(value, 0).cast("long")
