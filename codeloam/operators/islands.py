"""Runs in ordered rows: log entries, regions, hunks, and the entries around matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stored


def entries(lines: DataFrame, keys: list[str], stamp: str, probe: int = 200, opens: Column | None = None) -> DataFrame:
    """Log entries: keys, entry, line_no (of the first line), stamp, text, n_lines.

    A line without a time joins the entry above; lines before the first time make one entry. A file without any time in
    its first `probe` lines has an entry per line. `opens` tells of lines that open an entry without a time. The window
    holds the lines of one file.
    """
    starts = F.col(stamp).isNotNull() if opens is None else F.col(stamp).isNotNull() | opens
    w = Window.partitionBy(*keys).orderBy("line_no")
    framed = F.max(F.when((F.col("line_no") <= probe) & starts, 1).otherwise(0)).over(Window.partitionBy(*keys))
    first = F.when((F.col("_framed") == 0) | starts | (F.row_number().over(w) == 1), 1).otherwise(0)
    marked = lines.withColumn("_framed", framed).withColumn("_opens", first).withColumn("entry", F.sum("_opens").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(*keys, "entry").agg(F.min("line_no").alias("line_no"), F.max(stamp).alias("stamp"), text.alias("text"), F.count("*").alias("n_lines"))


def carried_year(rows: DataFrame, keys: list[str], order: str, year: str) -> Column:
    """The last year known at or before the row."""
    return F.last(year, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def around(rows: DataFrame, keys: list[str], order: str, hit: Column, n: int) -> DataFrame:
    """Rows at most n places from a matching row of the same key, each once, with `hit`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("hit", hit).withColumn("_near", F.max(F.col("hit").cast("int")).over(w.rowsBetween(-n, n))).where("_near = 1").drop("_near")


def newest(near: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Of the rows around matches those of the `limit` newest matches. What precedes the last dropped match goes with it; what follows it stays.

    order: total order, oldest first. The rows are kept in the shared folder, so that what frames them runs once; the
    place of the last match that stays is one row, met by a key of its own.
    """
    near = stored(near)
    place = F.struct(*order)
    hits = near.where("hit").orderBy(*[F.col(c).desc() for c in order]).select(*order).limit(limit + 1)
    bound = hits.agg(F.min(place).alias("_bound"), F.count("*").alias("_hits")).withColumn("_one", F.lit(1))
    met = near.withColumn("_one", F.lit(1)).join(F.broadcast(bound), "_one")  # one row
    return met.where((F.col("_hits") <= limit) | (place > F.col("_bound"))).drop("_one", "_bound", "_hits")


def regions(rows: DataFrame, keys: list[str], line: str, same: list[str]) -> DataFrame:
    """Maximal runs of consecutive lines with equal `same` columns: keys, same, first_line, last_line."""
    place = F.col(line) - F.row_number().over(Window.partitionBy(*keys, *same).orderBy(line))
    return rows.withColumn("_run", place).groupBy(*keys, *same, "_run").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line")).drop("_run")


def runs(rows: DataFrame, keys: list[str], order: list[str], changed: Column) -> DataFrame:
    """Numbers the runs that begin where `changed` holds, from 1 in each key: column `run`."""
    return rows.withColumn("run", F.sum(F.when(changed, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def without_repeats(rows: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Drops a row that equals the row above it in the `same` columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    equal, first = F.lit(True), F.row_number().over(w) == 1
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_drop", equal & ~first).where("not _drop").drop("_drop")
