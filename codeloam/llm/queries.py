"""The queries of the problems on training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .cooccurrence import cooccurrence
from .funcdoc import function_pairs
from .generated import not_by_hand
from .leakage import leaks
from .packing import pack
from .percentiles import certified, digest, merge, quantiles, value_counts
from .spam import spam_pages

def _ranks() -> dict:
    """The project's rules: the median is the truncated mean of the two middle values, p90 stands at max(floor(0.9 n) - 1, 0)."""
    n = F.col("n")
    return {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "p90": F.greatest(F.floor(n * F.lit(0.9)) - 1, F.lit(0))}


_GROUP = ["repo", "language"]


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """The measurement loaded last for each (repo, path, day), if it did not fail; of several loaded at once, the greatest."""
    last = F.max(F.struct("loaded_at", "complexity", "language")).alias("v")
    rows = table(spark, d, "metrics").groupBy("repo", "path", "measured_on").agg(last)
    return rows.select("repo", "measured_on", F.col("v.language").alias("language"), F.col("v.complexity").alias("complexity")).where("complexity >= 0")




def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_by_hand(table(spark, d, "files")).select("repo", "path")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """With what each file is: generated, minified, vendored or blob."""
    return not_by_hand(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = value_counts(_measured(spark, d), _GROUP, "complexity")
    estimated = quantiles(digest(counts, _GROUP, "complexity", weight="weight"), _GROUP, _ranks())
    e = certified(counts, _GROUP, "complexity", estimated, _ranks(), "weight")
    sure = F.greatest("lower_error", "upper_error", "p90_error") <= 0.02
    median = F.floor((F.col("lower") + F.col("upper")) / 2)
    held = F.when(sure, F.col("p90") >= 8 * median).otherwise(F.raise_error(F.lit("a rank is off by more than 2%")).cast("boolean"))
    return e.where(F.col("n") >= 50).where(held).select("repo", "language")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and p90 of each group from digests of single days put together, with certified rank errors."""
    counts = value_counts(_measured(spark, d), [*_GROUP, "measured_on"], "complexity")
    days = digest(counts, [*_GROUP, "measured_on"], "complexity", weight="weight")
    e = certified(counts, _GROUP, "complexity", quantiles(merge(days.drop("measured_on"), _GROUP), _GROUP, _ranks()), _ranks(), "weight")
    return e.select(*_GROUP, "n", F.floor((F.col("lower") + F.col("upper")) / 2).alias("median"), F.floor("p90").alias("p90"), F.greatest("lower_error", "upper_error").alias("median_error"), "p90_error")


def _together(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.translate("path", "\\", "/"), "^\\./", "")
    return cooccurrence(table(spark, d, "file_changes").withColumn("path", path), ["repo"], "commit_id", "path", 100, 6)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = _together(spark, d).where("n_ab * records >= 4 * n_a * n_b")
    return found.select("repo", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs seen together at least six times, with count, lift and odds ratio."""
    return _together(spark, d).select("repo", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", "records", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return function_pairs(table(spark, d, "files"), table(spark, d, "declarations"), columns=["repo", "path", "idx"])


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs themselves: documentation and code."""
    return function_pairs(table(spark, d, "files"), table(spark, d, "declarations"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the code of every function that stands where the table says, with or without documentation."""
    files, declared = table(spark, d, "files"), table(spark, d, "declarations")
    code = function_pairs(files, declared, 0, ["repo", "path", "idx", "code"])
    lines = code.select("repo", "path", "idx", (F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    text = files.where("content is not null").groupBy("repo", "path").agg(F.replace(F.max("content"), F.lit("\r\n"), F.lit("\n")).alias("t"))
    first = F.trim(F.substring_index("header", "\n", 1))
    at = declared.groupBy("repo", "path", "idx").agg(F.max("header").alias("header"), F.max("line").alias("line")).where("line >= 1")
    there = at.join(text, ["repo", "path"]).where(F.trim(F.get(F.split("t", "\n", -1), F.col("line") - 1)) == first)
    return lines.join(there.select("repo", "path", "idx"), ["repo", "path", "idx"])


def p7_containers(spark: SparkSession, d: str, capacity: int = 2048) -> DataFrame:
    """The container of every text, or of every piece of a text that is larger than one."""
    return pack(table(spark, d, "documents"), capacity)


def p7_fill(spark: SparkSession, d: str, capacity: int = 2048) -> DataFrame:
    """How full the containers are: their number, the tokens in them, and the share of space left over."""
    held = pack(table(spark, d, "documents"), capacity).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts"))
    return held.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.max("texts").alias("most_texts"), F.round(1 - F.sum("n") / (F.count("*") * capacity), 4).alias("left_over"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).where("spam").select("doc_id")


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    """What the verdict rests on, for every document."""
    return spam_pages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_bodies, p2_found, p2_reasons, p3_found, p3_percentiles, p4_found, p4_pairs, p7_containers, p7_fill, p8_found, p9_found, p9_shapes)}

_PAIRS = """
WITH c AS (SELECT DISTINCT repo, commit_id, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') AS path FROM file_changes WHERE path IS NOT NULL AND commit_id IS NOT NULL),
k AS (SELECT repo, commit_id FROM c GROUP BY repo, commit_id HAVING count(*) <= 100),
u AS (SELECT c.* FROM c JOIN k USING (repo, commit_id)),
n AS (SELECT repo, count(*) AS records FROM k GROUP BY repo),
i AS (SELECT repo, path, count(*) AS n FROM u GROUP BY repo, path),
p AS (SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS n_ab FROM u a JOIN u b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY 1, 2, 3 HAVING count(*) >= 6),
r AS (SELECT p.*, x.n AS n_a, y.n AS n_b, records FROM p JOIN n USING (repo) JOIN i x ON x.repo = p.repo AND x.path = path_a JOIN i y ON y.repo = p.repo AND y.path = path_b)
"""

SQL = {
    "p3_found": """
WITH r AS (SELECT repo, path, measured_on, language, complexity, row_number() OVER (PARTITION BY repo, path, measured_on ORDER BY loaded_at DESC, complexity DESC NULLS LAST, language DESC NULLS LAST) AS k FROM metrics),
v AS (SELECT repo, language, complexity AS c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY repo, language) AS n FROM r WHERE k = 1 AND complexity >= 0 WINDOW w AS (PARTITION BY repo, language ORDER BY complexity)),
s AS (SELECT repo, language, n, (max(CASE WHEN i = (n - 1) // 2 THEN c END) + max(CASE WHEN i = n // 2 THEN c END)) // 2 AS median, max(CASE WHEN i = greatest(CAST(floor(n * 0.9) AS BIGINT) - 1, 0) THEN c END) AS p90 FROM v GROUP BY repo, language, n)
SELECT repo, language FROM s WHERE n >= 50 AND p90 >= 8 * median""",
    "p1_bodies": """
WITH f AS (SELECT repo, path, replace(max(content), chr(13) || chr(10), chr(10)) AS t FROM files WHERE content IS NOT NULL GROUP BY repo, path),
d AS (SELECT repo, path, idx, max(header) AS header, max(line) AS line, max(end_line) AS end_line FROM declarations WHERE kind IN ('function', 'method') GROUP BY repo, path, idx)
SELECT d.repo, d.path, d.idx, len(string_split(rtrim(array_to_string(list_slice(string_split(t, chr(10)), line, end_line), chr(10)), ' ' || chr(9) || chr(10)), chr(10))) AS lines FROM d JOIN f USING (repo, path) WHERE line >= 1 AND trim(string_split(t, chr(10))[line]) = trim(string_split(header, chr(10))[1])""",
    "p4_found": _PAIRS + "SELECT repo, path_a, path_b FROM r WHERE n_ab * records >= 4 * n_a * n_b",
    "p4_pairs": _PAIRS + """SELECT repo, path_a, path_b, n_ab, n_a, n_b, records, round(n_ab * records / CAST(n_a * n_b AS DOUBLE), 6) AS lift,
  round((n_ab + 0.5) * (records - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 6) AS odds_ratio FROM r""",
}
