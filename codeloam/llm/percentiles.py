"""Percentiles of very large numeric columns with mergeable centroid digests.

A digest of a group is a set of centroids (mean, weight, least, greatest). Sorted values are clustered under the size
function k(q) = delta * (asin(2q - 1) / pi + 1/2): values whose middle rank falls into one unit of k form a centroid, so
centroids are small near the ends. Digests of parts (partitions, days) are merged by clustering their centroids again.
A second pass over the data counts how many values lie below and at an estimate, which certifies its rank error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import stored

#: Centroids per digest, about. The share of ranks in one is at most pi / (2 * DELTA), in the middle.
DELTA = 400
#: Rows that one clustering window holds at most, about; larger groups are digested in parts first.
PART_ROWS = 200_000
#: Digests that are merged at once.
MERGED = 256


def _cluster(weighted: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """Clusters (keys, mean, weight, low, high) within each group of keys."""
    by = Window.partitionBy(*keys)
    upto = by.orderBy("mean", "low", "high", "weight").rowsBetween(Window.unboundedPreceding, 0)
    q = (F.col("_upto") - F.col("weight") / 2) / F.col("_all")
    k = F.floor(F.lit(float(delta)) * (F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * q - 1))) / F.lit(3.141592653589793) + 0.5))
    ranked = weighted.withColumn("_upto", F.sum("weight").over(upto)).withColumn("_all", F.sum("weight").over(by.orderBy("mean").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return (
        ranked.withColumn("_k", k)
        .groupBy(*keys, "_k")
        .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("_k")
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, weight): how often each value comes in each group, kept in the shared folder for several readers. Nulls and NaN are dropped."""
    v = F.col(f"`{value}`").cast("double")
    return stored(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias(value)).agg(F.count("*").cast("double").alias("weight")))


def digest(df: DataFrame, keys: list[str], value: str, delta: int = DELTA, part_rows: int = PART_ROWS, weight: str | None = None) -> DataFrame:
    """Centroids (keys, mean, weight, low, high) of each group.

    Equal values are counted first (partial aggregation before the shuffle). A group with more distinct values than
    part_rows is digested in parts by a hash of the value, and the parts are merged; so no task holds a group whole.
    Null and NaN values are dropped; null keys are a value like any other; groups without values have no centroids.
    weight names a column of value_counts(), whose rows need no counting.
    """
    v = F.col(f"`{value}`").cast("double")
    one = F.count("*").cast("double") if weight is None else F.sum(weight)
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("mean")).agg(one.alias("weight"))
    counted = counted.withColumn("low", F.col("mean")).withColumn("high", F.col("mean"))
    n = _parts(counted, keys, part_rows)
    parts = _cluster(counted.withColumn("_part", F.pmod(F.xxhash64("mean"), F.lit(n)).cast("long")), [*keys, "_part"], delta)
    while n > MERGED:  # parts are merged in rounds, so that no task holds the digests of very many
        n = -(-n // MERGED)
        parts = _cluster(parts.withColumn("_part", F.floor(F.col("_part") / MERGED)), [*keys, "_part"], delta)
    return merge(parts.drop("_part"), keys, delta)


def _parts(counted: DataFrame, keys: list[str], part_rows: int) -> int:
    """Parts that the largest group needs: one number to the driver."""
    most = counted.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return 1 + most // part_rows


def merge(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """One digest per group from any number of digests of its parts, by clustering their centroids again."""
    return _cluster(digests, keys, delta)


def quantiles(digests: DataFrame, keys: list[str], ranks: dict[str, object]) -> DataFrame:
    """Per group: n, and for each name the value at a rank. ranks: name -> Column of n, a rank 0 .. n - 1.

    A rank within a centroid takes a place between its least and greatest value in proportion, in the lower half up to the
    mean and in the upper from it; a centroid of one value gives that value itself.
    """
    by = Window.partitionBy(*keys).orderBy("mean", "low", "high", "weight")
    placed = digests.withColumn("_upto", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    from_ = F.col("_upto") - F.col("weight")
    out = []
    for name, rank in ranks.items():
        t = (rank - from_) / F.greatest(F.col("weight") - 1, F.lit(1.0))
        inside = F.when(F.col("low") == F.col("high"), F.col("low")).when(t < 0.5, F.col("low") + (F.col("mean") - F.col("low")) * 2 * t).otherwise(F.col("mean") + (F.col("high") - F.col("mean")) * F.least(F.lit(1.0), 2 * t - 1))
        out.append(F.max(F.when((rank >= from_) & (rank < F.col("_upto")), inside)).alias(name))
    return placed.groupBy(*keys).agg(F.max("n").cast("long").alias("n"), *out)


def certified(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, ranks: dict[str, object], weight: str | None = None) -> DataFrame:
    """Adds name_error to each estimate: the distance, as a share of n, from the wanted rank to the ranks the estimate has in the data.

    Counts over equal values first; the estimates are one row per group.
    """
    v = F.col(f"`{value}`").cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    e = estimates
    for i, k in enumerate(keys):
        e = e.withColumnRenamed(k, f"_k{i}")
    met = counted.join(e, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    sums = [F.sum(F.when(F.col("_v") < F.col(x), F.col("_w")).otherwise(0)).alias(f"_{x}_below") for x in ranks] + [F.sum(F.when(F.col("_v") <= F.col(x), F.col("_w")).otherwise(0)).alias(f"_{x}_upto") for x in ranks]
    out = met.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(x).alias(x) for x in ranks], *sums)
    for x, rank in ranks.items():
        below, upto = F.col(f"_{x}_below"), F.col(f"_{x}_upto")
        off = F.greatest(below - rank, rank - F.greatest(upto - 1, below), F.lit(0))
        out = out.withColumn(f"{x}_error", off / F.col("n"))
    return out.drop(*(f"_{x}_{w}" for x in ranks for w in ("below", "upto")))
