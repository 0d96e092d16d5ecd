"""Top lists, evenly spaced picks, splits and balanced samples.

Shuffles are MD5 orders of a seed and the row key: repeatable on any cluster.
Ranks inside a class come from range partitions (see ordering), so a class
that holds most rows is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.columns import valid_public_name
from tidewrack.operators.ordering import md5_order, py_round, rank_rows, top_per_key, with_scalars


def recent_crops(files: DataFrame, sidecars: DataFrame, n: int, date: str = "date", name: str = "name") -> DataFrame:
    """Newest ``n`` valid crop files over all date folders, then joined to their sidecars; files without one are skipped."""
    valid = files.filter(valid_public_name(date, name))
    return valid.orderBy(F.col(date).desc(), F.col(name).desc()).limit(n).join(sidecars, [date, name])


def select_uniform(df: DataFrame, order: Sequence[str], n: int, parts: int | None = None) -> DataFrame:
    """Rows number int(i * len / n) of the sorted list; all rows if there are no more than ``n``."""
    ranked = rank_rows(df, [], order, "_n", parts)
    total = ranked.agg(F.count(F.lit(1)).alias("_len"))
    d = with_scalars(ranked, total)
    row, size = F.col("_n") - 1, F.col("_len")
    # row j is picked when some i has floor(i * len / n) = j, i.e. the first i with i * len >= j * n still falls on j
    i = F.ceil(row * n / size)
    return d.filter((size <= n) | ((i < n) & (F.floor(i * size / n) == row))).drop("_n", "_len")


def select_linspace(df: DataFrame, order: Sequence[str], n: int, parts: int | None = None) -> DataFrame:
    """``n`` evenly spaced rows including both ends; positions round half to even."""
    ranked = rank_rows(df, [], order, "_n", parts)
    size = ranked.agg(F.count(F.lit(1)).alias("_len"))
    picks = size.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "_len", (py_round(F.col("_i") * ((F.col("_len") - 1) / F.lit(max(n - 1, 1)))) + 1).alias("_p")).filter(F.col("_len") > n)
    wanted = picks.select(F.col("_p").alias("_n")).distinct()
    all_rows = ranked.join(size.filter(F.col("_len") <= n), F.lit(True), "left_semi")
    return ranked.join(wanted, "_n", "left_semi").unionByName(all_rows).drop("_n")


def balanced_take(df: DataFrame, label: str, order: Sequence[str], n: int) -> DataFrame:
    """First n//2 of each class, then topped up from the leftovers, positives first."""
    half = n // 2
    first = top_per_key(df.filter(F.col(label).isNotNull()), [label], order, n)
    place = F.when(F.col("rank") <= half, F.lit(0)).when(F.col(label), F.lit(1)).otherwise(F.lit(2))
    return first.withColumn("_p", place).orderBy("_p", "rank", F.col(label).desc()).limit(n).drop("_p", "rank")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], seed: int | str = 42, ratios: tuple[float, float] = (0.8, 0.2),
                     parts: int | None = None) -> DataFrame:
    """train/val/test per class: round(r0 * n), round(r1 * n), the rest; shuffled by seed."""
    d = rank_rows(df.withColumn("_h", md5_order(seed, *key)), [label], ["_h", *key], "_n", parts)
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_len"))
    j = d.join(sizes, d[label].eqNullSafe(sizes["_l"]))
    a, b = py_round(F.col("_len") * ratios[0]), py_round(F.col("_len") * ratios[1])
    split = F.when(F.col("_n") <= a, "train").when(F.col("_n") <= a + b, "val").otherwise("test")
    return j.withColumn("split", split).drop("_h", "_n", "_l", "_len")


def balanced_split(df: DataFrame, label: str, key: Sequence[str], min_count: int, seed: int | str = 42,
                   ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), parts: int | None = None) -> DataFrame:
    """Classes with too few rows are dropped; every other class gives int(ratio * smallest class) rows to each split."""
    big = df.groupBy(label).agg(F.count(F.lit(1)).alias("_len")).filter((F.col("_len") >= min_count) & F.col(label).isNotNull())
    least = big.agg(F.min("_len").alias("_min"))
    d = rank_rows(df.join(big.select(label), label, "left_semi").withColumn("_h", md5_order(seed, *key)), [label], ["_h", *key], "_n", parts)
    d = with_scalars(d, least)
    a, b, c = (F.floor(F.col("_min") * r) for r in ratios)
    split = F.when(F.col("_n") <= a, "train").when(F.col("_n") <= a + b, "val").when(F.col("_n") <= a + b + c, "test")
    return d.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_h", "_n", "_min")


def _cut(n: Column, train: Column, val: Column) -> Column:
    return F.when(n <= train, "train").when(n <= train + val, "val").otherwise("test")


def group_split(df: DataFrame, group: str, seed: int | str = 42, train: float = 0.7, val_of_rest: float = 0.5, parts: int | None = None) -> DataFrame:
    """Whole groups go to one split, cut by the number of groups: a share for training, then the rest is halved."""
    groups = df.select(group).distinct().withColumn("_h", md5_order(seed, group))
    ranked = rank_rows(groups, [], ["_h", group], "_n", parts)
    total = ranked.agg(F.count(F.lit(1)).alias("_len"))
    a = F.floor(F.col("_len") * train)
    b = F.floor((F.col("_len") - a) * val_of_rest)
    cut = with_scalars(ranked, total).select(group, _cut(F.col("_n"), a, b).alias("split"))
    return df.join(cut, group)


def leaked_groups(split: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one split; empty for a clean split."""
    return split.groupBy(group).agg(F.countDistinct("split").alias("splits")).filter(F.col("splits") > 1)


def random_split(df: DataFrame, key: Sequence[str], seed: int | str = 42, ratios: tuple[float, float] = (0.7, 0.15), parts: int | None = None) -> DataFrame:
    """Split of single rows without groups. (0.75, 0.25) gives train and val only."""
    ranked = rank_rows(df.withColumn("_h", md5_order(seed, *key)), [], ["_h", *key], "_n", parts)
    total = ranked.agg(F.count(F.lit(1)).alias("_len"))
    return with_scalars(ranked, total).withColumn(
        "split", _cut(F.col("_n"), F.floor(F.col("_len") * ratios[0]), F.floor(F.col("_len") * ratios[1]))).drop("_h", "_n", "_len")


def balance_classes(df: DataFrame, label: str, key: Sequence[str], seed: int | str = 42, parts: int | None = None) -> DataFrame:
    """Negatives (label 0) cut to the number of positives if there are more of them; without positives all stay."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("_pos"))
    neg = rank_rows(df.filter(F.col(label) == 0).withColumn("_h", md5_order(seed, *key)), [], ["_h", *key], "_n", parts)
    neg = with_scalars(neg, counts).filter((F.col("_pos") == 0) | (F.col("_n") <= F.col("_pos")))
    return df.filter(F.col(label) == 1).unionByName(neg.drop("_h", "_n", "_pos"))


def mine_hard_negatives(df: DataFrame, label: str, score: str, key: Sequence[str], seed: int | str = 42, parts: int | None = None) -> DataFrame:
    """All positives, the k highest scoring negatives and k random others; k = min(positives, negatives). Adds ``kind``."""
    counts = df.agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("_k"))
    neg = with_scalars(rank_rows(df.filter(F.col(label) == 0), [], [F.col(score).desc(), *key], "_n", parts), counts)
    hard = neg.filter(F.col("_n") <= F.col("_k")).drop("_n", "_k").withColumn("kind", F.lit("hard"))
    rest = neg.filter(F.col("_n") > F.col("_k")).drop("_n", "_k")
    easy = with_scalars(rank_rows(rest.withColumn("_h", md5_order(seed, *key)), [], ["_h", *key], "_n", parts), counts)
    easy = easy.filter(F.col("_n") <= F.col("_k")).drop("_h", "_n", "_k").withColumn("kind", F.lit("easy"))
    return df.filter(F.col(label) == 1).withColumn("kind", F.lit("positive")).unionByName(hard).unionByName(easy)


def filter_rare_classes(df: DataFrame, label: str, min_count: int = 40, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the remaining classes, with ``class_idx`` numbering them alphabetically from 0."""
    counts = df.filter(F.col(label).isNotNull() & ~F.col(label).isin(*exclude)).groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    kept = rank_rows(counts.filter(F.col("_c") >= min_count).select(label), [], [label], "_n").select(label, (F.col("_n") - 1).alias("class_idx"))
    return df.join(kept, label)


def label_queue(items: DataFrame, done: DataFrame, cache: DataFrame, key: str, order: Sequence[str], fingerprint: Sequence[str], fresh_score: str) -> DataFrame:
    """Unlabelled items, brightest first; unreadable ones (null score) count -1 and come last.

    A cached ``score`` is used while the item's fingerprint is unchanged; ``from_cache`` tells.
    """
    todo = items.join(done.select(key), key, "left_anti")
    known = cache.select(key, *fingerprint, F.col("score").alias("_cached"))
    d = todo.join(known, [key, *fingerprint], "left")
    d = d.withColumn("from_cache", F.col("_cached").isNotNull()).withColumn("score", F.coalesce("_cached", fresh_score, F.lit(-1.0))).drop("_cached")
    return d.orderBy(F.col("score").desc(), *order)


def most_borderline(df: DataFrame, kind: str, score: str, threshold: float, tie: str, n: int, kinds: Sequence[str] = ("FP", "FN")) -> DataFrame:
    """Errors closest to the threshold, first ``n`` of each kind."""
    d = df.filter(F.col(kind).isin(*kinds)).withColumn("distance", F.abs(F.col(score) - threshold))
    return top_per_key(d, [kind], ["distance", tie], n)


def newest_first(df: DataFrame, date: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(date).desc(), tie)


def cluster_examples(df: DataFrame, cluster: str, key: str, k: int = 10, seed: int | str = 42) -> DataFrame:
    """Up to ``k`` random members of each cluster."""
    return top_per_key(df.withColumn("_h", md5_order(seed, key)), [cluster], ["_h", key], k).drop("_h", "rank")
