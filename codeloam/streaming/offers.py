"""Keyed state over streams: what was shown before, read coverage, and log entries as they grow.

An extension: the batch forms are in operators.snapshot, operators.intervals and operators.islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def offers(stream: DataFrame, keys: list[str], fingerprint: str, order: str) -> DataFrame:
    """Adds `offer` (New, Same, Changed) to a stream, against the fingerprint last seen for the key. The state of a key is one fingerprint."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = [*keys, order, fingerprint]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (True, state.get[0]) if state.exists else (False, None)
        for frame in frames:
            frame = frame[columns].sort_values([order, fingerprint])
            out = []
            for v in frame[fingerprint].astype("string").fillna(""):
                out.append("Same" if known and v == last else "Changed" if known else "New")
                known, last = True, v
            yield frame.assign(offer=out)
        state.update((last,))

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", offer string"
    return stream.groupBy(*keys).applyInPandasWithState(update, ddl, "last string", "append", GroupStateTimeout.NoTimeout)


def entry_counts(stream: DataFrame, stamp: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Log entries per window of time; entries later than `late` are dropped by the watermark."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width)).agg(F.count("*").alias("entries")).select("window.start", "window.end", "entries")


def new_rows(stream: DataFrame, keys: list[str], stamp: str, late: str = "1 hour") -> DataFrame:
    """Rows not seen before within the watermark."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)
