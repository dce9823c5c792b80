"""Spans of lines: what holds a line, what overlaps, and how lines move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lines per bin. Spans and points meet in bins, so a long file is not compared line by declaration as a whole.
BIN = 64


def _bins(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_first: str, a_last: str, b_first: str, b_last: str) -> DataFrame:
    """Pairs of spans of the same key that share a line, each once. Names besides the keys must differ; spans with a null or reversed bound meet nothing."""
    left, right = _bins(a, a_first, a_last), _bins(b, b_first, b_last)
    # the pair belongs to the bin where its overlap begins
    met = (F.col(a_first) <= F.col(b_last)) & (F.col(b_first) <= F.col(a_last)) & (F.col("_bin") == F.floor(F.greatest(a_first, b_first) / BIN))
    return left.join(right, [*keys, "_bin"]).where(met).drop("_bin")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], line: str, first: str, last: str, order: str, id_: list[str], how: str = "inner") -> DataFrame:
    """For each point (id_ names it) the shortest span that holds its line; of several the greatest `order`. how='left' keeps the others."""
    held = points.withColumn("_bin", F.floor(F.col(line) / BIN)).join(_bins(spans, first, last), [*keys, "_bin"]).where(F.col(line).between(F.col(first), F.col(last)))
    best = F.row_number().over(Window.partitionBy(*id_).orderBy(F.col(last) - F.col(first), F.col(order).desc()))
    found = held.withColumn("_r", best).where("_r = 1").drop("_r", "_bin")
    if how == "inner":
        return found
    new = [c for c in spans.columns if c not in keys]
    return points.join(found.select(*id_, *[c for c in new if c not in id_]), id_, "left")


def with_ancestors(rows: DataFrame, tree: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, id) of the rows and of everything above them; tree is the result of hierarchy()."""
    return rows.select(*keys, F.col(id_).alias("id")).join(tree.select(*keys, "id", "path_ids"), [*keys, "id"]).select(*keys, F.explode(F.coalesce("path_ids", F.array("id"))).alias("id")).distinct()


def moved_line(lines: DataFrame, hunks: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Where a line lies after edits: `moved`, null if it is inside a changed range. hunks: keys, old_first, old_last, new_first, new_last (an empty range ends before it starts).

    Each hunk that ends before the line moves it by the lines it adds less those it takes.
    Lines and hunks go through one running sum per key in order of lines; nothing is compared pair by pair.
    """
    none = [F.lit(0).alias(c) for c in ("_delta", "_in")]
    at = lines.select(*keys, F.col(line).alias("_at"), F.lit(1).alias("_kind"), *none).distinct()
    opens = hunks.select(*keys, F.col("old_first").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_delta"), F.lit(1).alias("_in"))
    change = (F.col("new_last") - F.col("new_first")) - (F.col("old_last") - F.col("old_first"))
    closes = hunks.select(*keys, (F.col("old_last") + 1).alias("_at"), F.lit(0).alias("_kind"), change.alias("_delta"), F.lit(-1).alias("_in"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = at.unionByName(opens).unionByName(closes).withColumn("_d", F.sum("_delta").over(w)).withColumn("_i", F.sum("_in").over(w)).where("_kind = 1")
    got = got.select(*keys, F.col("_at").alias(line), "_d", "_i")
    return lines.join(got, [*keys, line], "left").withColumn("moved", F.when(F.col("_i") == 0, F.col(line) + F.col("_d"))).drop("_i", "_d")


def inferred_ends(rows: DataFrame, keys: list[str], line: str, order: str, depth: str, deepest: int, lines: str) -> DataFrame:
    """Adds `last`: where a row without an end stops, the line before the next row that lies no deeper, else the last line of its file.

    Depths are 0 .. deepest; for each a window over the file finds the next row up to it.
    """
    w = Window.partitionBy(*keys).orderBy(line, order).rowsBetween(1, Window.unboundedFollowing)
    after = F.lit(None)
    for d in range(deepest, -1, -1):
        after = F.when(F.col(depth) == d, F.first(F.when(F.col(depth) <= d, F.col(line)), ignorenulls=True).over(w)).otherwise(after)
    return rows.withColumn("_next", after).withColumn("last", F.greatest(F.col(line), F.coalesce(F.col("_next") - 1, F.col(lines)))).drop("_next")


def coverage(merged: DataFrame, totals: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Lines read and their share, from the result of periods(); a file of 0 lines is wholly read, one never read is not at all."""
    got = merged.groupBy(*keys).agg(F.sum(F.col("period_end") - F.col("period_start") + 1).alias("lines_read"))
    out = totals.join(got, keys, "left").withColumn("lines_read", F.coalesce("lines_read", F.lit(0)))
    return out.withColumn("fraction", F.when(F.col(total) == 0, F.lit(1.0)).otherwise(F.col("lines_read") / F.col(total)))


def holds(first: Column, last: Column, wanted_first: int, wanted_last: int) -> Column:
    """Does one range hold all wanted lines?"""
    return (first <= wanted_first) & (last >= wanted_last)


def nest(spans: DataFrame, keys: list[str], id_: str, first: str, last: str) -> DataFrame:
    """Adds `inside`: the smallest other span of the key that holds the span, of equal ones the one with the least id before it; null for the outermost."""
    outer = spans.select(*keys, F.col(id_).alias("_id"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    at = spans.where(F.col(first) <= F.col(last)).withColumn("_bin", F.floor(F.col(first) / BIN))
    held = at.join(_bins(outer, "_first", "_last"), [*keys, "_bin"]).where(F.expr(f"_first <= {first} and _last >= {last} and _id <> {id_} and (_last - _first > {last} - {first} or _id < {id_})"))
    best = held.groupBy(*keys, id_).agg(F.min_by("_id", F.struct(F.col("_last") - F.col("_first"), -F.col("_id"))).alias("inside"))
    return spans.join(best, [*keys, id_], "left")
