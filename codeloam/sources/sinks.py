"""What leaves the engine: documents, plain text, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def document(query: str, results: DataFrame, facts: DataFrame | None = None, path: str = "path") -> DataFrame:
    """A row per result as JSON, with the query and the facts of its path beside it."""
    rows = results.select(F.col(path).alias("_p"), F.struct(*results.columns).alias("result"))
    if facts is not None:
        rows = rows.join(facts.select(F.col(path).alias("_p"), F.struct(*facts.columns).alias("context")), "_p", "left")
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), *[c for c in rows.columns if c != "_p"])).alias("document"))


def named_context(results: DataFrame, facts: DataFrame, path: str = "path") -> DataFrame:
    """The facts of the paths that results still name after a filter."""
    return facts.join(results.select(path).distinct(), path, "left_semi")


def plain_text(lines: DataFrame, where: str, column: str = "line") -> None:
    lines.select(column).write.mode("overwrite").text(where)


def versioned(df: DataFrame, root: str, version: str) -> str:
    """Writes under the version's own folder; a reader of another version never sees half a table."""
    where = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(where)
    return where
