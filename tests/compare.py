"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def database(data: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.6g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(zip(*[[text(v) for v in df[c].astype(object)] for c in sorted(df.columns)])) if len(df.columns) else []


def same(spark, query, sql: str, data: str = DATA) -> None:
    a, b = query(spark, data).toPandas(), database(data).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
