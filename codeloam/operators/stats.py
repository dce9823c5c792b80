"""Distributions and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def distribution(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: n, median (mean of the two middles, truncated), a value per share at sorted place max(floor(share * n) - 1, 0), and max.

    Works on counts of equal values, so a group costs its different values and not its rows; nulls do not count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("w"))
    by = Window.partitionBy(*keys)
    c = counts.withColumn("upto", F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    places = [at(F.greatest(F.floor(F.col("n") * F.lit(s).cast("decimal(4,2)")) - 1, F.lit(0))).alias(k) for k, s in shares.items()]
    return c.groupBy(*keys).agg(F.max("n").alias("n"), ((low + high) / 2).cast("long").alias("median"), *places, F.max("v").alias("max"))


def total(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in order, and one row with the number of all."""
    return df.orderBy(*order).limit(limit), df.agg(F.count("*").alias("total"))


def children(df: DataFrame, path: str, base: str) -> DataFrame:
    """Adds `child`: the first part of the path below base, with a slash if it is a folder; rows elsewhere go."""
    prefix = base.rstrip("/") + "/" if base not in ("", ".") else ""
    inside = df.where(F.col(path).startswith(prefix)) if prefix else df
    rest = F.substring(F.col(path), F.lit(len(prefix) + 1), F.length(path))
    return inside.withColumn("child", F.regexp_extract(rest, "^[^/]*/?", 0))


def folders(df: DataFrame, path: str) -> DataFrame:
    """All folders above the paths, each once per group of the other columns: column `folder`."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    others = [c for c in df.columns if c != path]
    return df.where(F.size(parts) > 1).select(*others, F.explode(up).alias("folder")).distinct()


def first_mode(df: DataFrame, keys: list[str], value: str, place: str, top: int = 1) -> DataFrame:
    """The most frequent values of each group with their counts; of equally frequent ones that with the least place comes first (column `rank`)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(place).alias("_at"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_at", value)))
    return ranked.where(F.col("rank") <= top).drop("_at")
