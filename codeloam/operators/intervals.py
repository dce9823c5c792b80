"""Overlapping and gapped intervals: continuous periods and the gaps between them.

The rows are range-sorted by entity and start over all partitions, so that an entity with any share of the rows is
spread over many tasks. Each partition is summed up by the state at its end; the summaries, one row per partition, are
combined in order on the driver; and a second scan carries each partition's opening state through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import changed, pinned, stored


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers the entities of sorted rows 0, 1, ..."""
    out = np.zeros(table.num_rows, dtype=np.int64)
    if table.num_rows > 1:
        out[1:] = np.cumsum(changed(table, keys).to_numpy(zero_copy_only=False))
    return out


def _prior_end(run: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the greatest end so far in its run (with the row), and that before the row; the latter is valid only where the run is not new."""
    values, rank = np.unique(end, return_inverse=True)
    top = np.maximum.accumulate(run * (len(values) + 1) + rank.reshape(-1))
    upto = values[top - run * (len(values) + 1)]
    before = np.empty_like(upto)
    before[1:] = upto[:-1]
    before[:1] = 0
    return upto, before


def _key(table: pa.Table, keys: list[str], row: int) -> tuple:
    return tuple(table.column(k)[row].as_py() for k in keys)


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Table]]]:
    """The rows of a task by the partition they were sorted in: its number and its tables. Each part is read to its end before the next."""

    def pieces() -> Iterator[tuple[int, pa.Table]]:
        for batch in batches:
            if batch.num_rows:
                table, parts = pa.Table.from_batches([batch]), batch.column("_part").to_numpy()
                cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
                for a, b in zip(cuts, cuts[1:]):
                    yield int(parts[a]), table.slice(a, b - a)

    for part, group in groupby(pieces(), key=lambda x: x[0]):
        yield part, (t for _, t in group)


class _Carry:
    """What is known of the entity above: its key, greatest end and the start of its last island."""

    def __init__(self, key: tuple | None = None, end: int = 0, island: int = 0):
        self.key, self.end, self.island = key, end, island

    def scan(self, table: pa.Table, keys: list[str], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Island start and previous end (and whether there is one) of each row; moves on to the last row."""
        start, end = (table.column(c).to_numpy().astype(np.int64) for c in ("_start", "_end"))
        run = _runs(table, keys)
        carried = self.key is not None and _key(table, keys, 0) == self.key
        if carried:  # the state enters as a row of its own above the first
            run, start, end = np.r_[run[:1], run], np.r_[self.island, start], np.r_[self.end, end]
        upto, before = _prior_end(run, end)
        opens = np.r_[True, run[1:] != run[:-1]]
        new = opens | (start > before + step)
        island = start[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        self.key, self.end, self.island = _key(table, keys, table.num_rows - 1), int(upto[-1]), int(island[-1])
        cut = 1 if carried else 0
        return island[cut:], before[cut:], ~opens[cut:]


def _swept(df: DataFrame, keys: list[str], start: str, end: str, step: int) -> DataFrame:
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{start}`").cast("long").alias("_start"), F.col(f"`{end}`").cast("long").alias("_end")).where("_start <= _end")  # also drops nulls
    order = [*(F.col(f"`{k}`") for k in keys), "_start", "_end"]
    # equal rows meet in one range, so they fold there without a shuffle of their own; the number of its partition goes
    # with each row, since a task may read several or another than its own number says
    rows = pinned(rows.repartitionByRange(*order).distinct().sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    kinds = {f.name: f for f in rows.schema.fields}
    key_ddl = ", ".join(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tables in _partitions(batches):
            state, first, single = _Carry(), None, True
            for table in tables:
                first = _key(table, keys, 0) if first is None else first
                state.scan(table, keys, step)
                single = single and state.key == first
            arrays = [pa.array([v], table.schema.field(k).type) for k, v in zip(keys, state.key)]
            arrays += [pa.array([part], pa.int32()), pa.array([state.end], pa.int64()), pa.array([state.island], pa.int64()), pa.array([single])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "_part", "_end", "_island", "_single"])

    carries: dict[int, tuple] = {}
    last: tuple | None = None
    for r in sorted(rows.mapInArrow(summary, f"{key_ddl}, _part int, _end long, _island long, _single boolean").collect(), key=lambda r: r["_part"]):
        if last is not None:
            carries[r["_part"]] = last
        key, top, island = tuple(r[k] for k in keys), r["_end"], r["_island"]
        if r["_single"] and last is not None and last[0] == key:
            island = last[2] if island <= last[1] + step else island
            top = max(top, last[1])
        last = (key, top, island)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tables in _partitions(batches):
            state = _Carry(*carries.get(part, ()))
            for table in tables:
                island, before, has = state.scan(table, keys, step)
                out = table.select([*keys, "_start", "_end"]).append_column("_island", pa.array(island)).append_column("_prior", pa.array(before, mask=~has))
                yield from out.to_batches()

    return rows.mapInArrow(rescan, f"{key_ddl}, _start long, _end long, _island long, _prior long")


def periods(df: DataFrame, keys: list[str], start: str, end: str, step: int = 1) -> DataFrame:
    """Continuous periods: keys, period_start, period_end, intervals (distinct ones merged).

    Bounds are whole numbers and both included; intervals that overlap, nest or lie `step` apart at most are one period
    (step 1: adjacent lines; 0: only shared points). Intervals with a null bound or start > end are dropped; repeated
    intervals count once; null keys are a value like any other; other columns are ignored; no rows give no rows.
    """
    swept = _swept(df, keys, start, end, step)
    return swept.groupBy(*[F.col(f"`{k}`") for k in keys], F.col("_island").alias("period_start")).agg(F.max("_end").alias("period_end"), F.count("*").alias("intervals"))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, step: int = 1) -> DataFrame:
    """Maximal uncovered runs between an entity's first and last interval: keys, gap_start, gap_end; cases as in periods()."""
    swept = _swept(df, keys, start, end, step)
    return swept.where(F.col("_start") > F.col("_prior") + step).select(*[F.col(f"`{k}`") for k in keys], (F.col("_prior") + 1).alias("gap_start"), (F.col("_start") - 1).alias("gap_end"))


def gaps_within(df: DataFrame, keys: list[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """Uncovered runs within each entity's own bounds [first, last], two columns that are equal in all its rows.

    Rows outside are dropped, rows across a bound are cut. Entities with a null bound or first > last give nothing.
    """
    names = [F.col(f"`{k}`") for k in keys]
    cut = df.where(F.col(first) <= F.col(last)).select(*names, F.greatest(start, first).alias("_s"), F.least(end, last).alias("_e"), F.col(first).alias("_f"), F.col(last).alias("_l"))
    bounds = cut.select(*names, "_f", "_l").distinct()
    fence = bounds.select(*names, F.explode(F.array(F.col("_f") - 1, F.col("_l") + 1)).alias("_s")).withColumn("_e", F.col("_s"))
    # kept, since sorting by range reads its input twice
    return gaps(stored(cut.where("_s <= _e").select(*names, "_s", "_e").unionByName(fence)), keys, "_s", "_e")
