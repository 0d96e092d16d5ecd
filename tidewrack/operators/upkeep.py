"""Catalogue upkeep: upserts, appends, renames, routing and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ordering import rank_rows


def replace_by_key(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows of the keys in ``new`` give way to the new rows; columns are the sorted union of both."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti")
    merged = kept.unionByName(new, allowMissingColumns=True)
    return merged.select(*sorted(merged.columns))


def replace_partitions(new: DataFrame, path: str, by: str) -> None:
    """Upsert on storage: only the partitions present in ``new`` are rewritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_log(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def rename_source(items: DataFrame, old_dir: str, new_dir: str, name: str, path: str = "path", source: str = "source", sep: str = "/") -> DataFrame:
    """Rows already re-imported under ``new_dir`` are dropped; rows under ``old_dir`` move there and take the source name."""
    old, new = old_dir.rstrip("\\/"), new_dir.rstrip("\\/")
    under_old = F.col(path).startswith(old + sep)
    moved = F.concat(F.lit(new), F.expr(f"substring({path}, {len(old) + 1})"))
    return items.filter(~F.coalesce(F.col(path).startswith(new + sep), F.lit(False))).withColumns(
        {source: F.when(under_old, F.lit(name)).otherwise(F.col(source)), path: F.when(under_old, moved).otherwise(F.col(path))})


def rename_source_counts(items: DataFrame, old_dir: str, new_dir: str, path: str = "path", sep: str = "/") -> DataFrame:
    """Dry run: how many rows would move and how many would be deleted."""
    hit = lambda d: F.count_if(F.col(path).startswith(d.rstrip("\\/") + sep))
    return items.agg(hit(old_dir).alias("to_move"), hit(new_dir).alias("to_delete"))


def backfill_source(items: DataFrame, prefix: str, name: str, path: str = "path", source: str = "source") -> DataFrame:
    fill = F.col(source).isNull() & F.col(path).startswith(prefix)
    return items.withColumn(source, F.when(fill, F.lit(name)).otherwise(F.col(source)))


def route_by_date(files: DataFrame, ts: str, date: str, name: str, tie: str, parts: int | None = None) -> DataFrame:
    """Files of one calendar day with their target name; clashing names get ``_1``, ``_2`` … before the extension."""
    day = files.filter((F.col(ts) >= F.lit(date).cast("timestamp")) & (F.col(ts) < F.expr(f"timestamp'{date}' + interval 1 day")))
    d = rank_rows(day, [name], [tie], "_n", parts)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    target = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n") - 1, ext))
    return d.withColumn("target", target).drop("_n")


def materialise_labels(labels: DataFrame, existing: DataFrame, label: str, name: str) -> DataFrame:
    """Copy plan for labelled files whose name is not in the output yet: target is label/name."""
    todo = labels.filter(F.col(label).isNotNull()).join(existing.select(name), name, "left_anti")
    return todo.withColumn("target", F.concat_ws("/", label, name))


def move_overflow(items: DataFrame, limit: int, stem: str = "stem", mtime: str = "mtime") -> DataFrame:
    """Complete waiting items beyond the newest ``limit``, oldest first: the ones to move to the backlog queue."""
    waiting = items.filter((F.col("state") == "incoming") & F.col("has_image") & F.col("has_json"))
    return rank_rows(waiting, [], [F.col(mtime).desc(), F.col(stem).desc()], "_n").filter(F.col("_n") > limit).drop("_n")


def set_difference(everything: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct rows of ``everything`` that are not in ``valid``."""
    return everything.subtract(valid)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def invalid_files(everything: DataFrame, valid: DataFrame, key: str = "path") -> DataFrame:
    """Files the quality check left out."""
    return everything.select(key).subtract(valid.select(key))
