"""Differences between two states of keyed rows, and what was shown before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keyed_diff(base: DataFrame, head: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, state: added, removed, changed or same, by whether any of the values differs (two nulls are the same)."""
    one = lambda df, p: df.select(*keys, F.struct(*values).alias(f"_{p}"), F.lit(1).alias(f"_in_{p}"))
    j = one(base, "a").join(one(head, "b"), keys, "full_outer")
    return j.select(*keys, F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed").alias("state"))


def surface_delta(base: DataFrame, head: DataFrame, keys: list[str], values: list[str], places: list[str]) -> DataFrame:
    """keys, state: as keyed_diff(), with `moved` for rows of which only the places differ."""
    one = lambda df, p: df.select(*keys, F.struct(*values).alias(f"_{p}"), F.struct(*places).alias(f"_at_{p}"), F.lit(1).alias(f"_in_{p}"))
    j = one(base, "a").join(one(head, "b"), keys, "full_outer")
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(*keys, state.when(~F.col("_at_a").eqNullSafe(F.col("_at_b")), "moved").otherwise("same").alias("state"))


def bodies(rows: DataFrame, content: str, first: str, last: str) -> DataFrame:
    """Adds `body`, the lines from first to last of each row's text."""
    n = F.greatest(F.col(last) - F.col(first) + 1, F.lit(0))
    return rows.withColumn("body", F.array_join(F.slice(F.split(content, "\n", -1), F.col(first), n), "\n"))


def changed_bodies(base: DataFrame, head: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Keys of both sides whose bodies differ."""
    return base.join(head.withColumnRenamed(body, "_other"), keys).where(F.col(body) != F.col("_other")).select(*keys)


def new_side(rows: DataFrame, status: str, hunk: str) -> DataFrame:
    """Adds first and last, the changed lines on the new side; an added file is changed from 1 to the end."""
    from ..functions.scalars import hunk_range

    h = hunk_range(hunk)
    added = F.col(status) == "A"
    return rows.withColumn("first", F.when(added, 1).otherwise(h["first"])).withColumn("last", F.when(added, 2147483647).otherwise(h["last"]))


def with_ordinal(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Numbers rows of equal keys from 0 in a total order: column `ordinal`."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def last_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per key its first place and its last value."""
    return df.groupBy(*keys).agg(F.min(order).alias("place"), F.max_by(value, order).alias(value))


def shown(rows: DataFrame, keys: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """Adds `offer`: New, Same or Changed against what was last shown for the key."""
    before = F.lag(fingerprint).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumn("_b", before).withColumn("_f", first).withColumn("offer", F.when(F.col("_f"), "New").when(F.col("_b").eqNullSafe(F.col(fingerprint)), "Same").otherwise("Changed")).drop("_b", "_f")


def epochs(rows: DataFrame, keys: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """Adds `epoch`, which rises whenever the fingerprint changes; what was gathered in an earlier epoch no longer counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = F.when(~F.lag(fingerprint).over(w).eqNullSafe(F.col(fingerprint)) & (F.row_number().over(w) > 1), 1).otherwise(0)
    return rows.withColumn("_m", moved).withColumn("epoch", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_m")


def baseline_delta(rows: DataFrame, keys: list[str], order: list[str], items: str) -> DataFrame:
    """Against the first row of each key: items gained and lost, as sorted arrays."""
    base = F.first(items).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_base", base).withColumn("gained", F.array_sort(F.array_except(items, "_base"))).withColumn("lost", F.array_sort(F.array_except("_base", items))).drop("_base")


def unmatched(sent: DataFrame, now: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `now` that are not among those sent; each sent row matches one equal row, in order."""
    a, b = with_ordinal(sent, keys, [order]), with_ordinal(now, keys, [order])
    return b.join(a.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti").drop("ordinal")


def affected(rows: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """The keys of rows that name anything changed: what has to be resolved anew. names: name."""
    return rows.join(names.select("name").distinct(), "name", "left_semi").select(*keys).distinct()
