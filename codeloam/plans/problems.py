"""The two general problems: hierarchies of declarations (p5) and line periods with gaps (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.hierarchy import descendants, hierarchy
from ..operators.intervals import gaps, gaps_within, periods
from ..sources.tables import table

_FILE = ["repo", "path"]


def _declared(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return hierarchy(table(spark, d, "declarations"), _FILE, "idx", "parent", "name", "container", columns=columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _declared(spark, d, ["root_id", "depth", "status"]).where("status != 'root'").select(*_FILE, F.col("id").cast("int").alias("idx"), F.col("root_id").cast("int").alias("root_idx"), "depth")


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    """Full names, roots and the number of descendants; loops with their members."""
    tree = _declared(spark, d, ["names", "depth", "n_descendants", "status", "cycle"])
    return tree.select(*_FILE, F.col("id").cast("int").alias("idx"), F.concat_ws("/", "names").alias("full_name"), "depth", "n_descendants", "status", F.concat_ws(",", "cycle").alias("loop_members"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_declared(spark, d, ["status", "path_ids"]), _FILE).select(*_FILE, F.col("id").cast("int").alias("idx"), F.col("descendant").cast("int").alias("descendant_idx"), "steps")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Read ranges with usable bounds: agent, repo, file, first (1), total, s, e. Reads whose file has no known size are dropped."""
    rows = table(spark, d, "read_ranges").select("agent", "repo", "file", "line_start", "line_end", "total_lines")
    who = ["agent", "repo", "file"]
    totals = rows.groupBy(*who).agg(F.max("total_lines").alias("total"))
    used = rows.where("line_start is not null or line_end is not null").select(*who, "line_start", "line_end")
    both = used.join(totals, who).select(*who, F.lit(1).alias("first"), "total", F.coalesce("line_start", F.lit(1)).alias("a"), F.coalesce("line_end", "total").alias("b"))
    return both.select(*who, "first", "total", F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e"))


def blamed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blame_regions").where("author is not null").select("repo", "path", "author", F.least("line_start", "line_end").alias("s"), F.greatest("line_start", "line_end").alias("e"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    bounds = [F.col("gap_start").cast("int").alias("gap_start"), F.col("gap_end").cast("int").alias("gap_end")]
    read = gaps_within(reads(spark, d), ["agent", "repo", "file"], "s", "e", "first", "total").select(F.lit("read").alias("relation"), "repo", F.col("file").alias("path"), F.col("agent").alias("holder"), *bounds)
    blame = gaps(blamed(spark, d), ["repo", "path", "author"], "s", "e").select(F.lit("blame").alias("relation"), "repo", "path", F.col("author").alias("holder"), *bounds)
    return read.unionByName(blame)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    """The continuous periods of the blame regions of each author."""
    return periods(blamed(spark, d), ["repo", "path", "author"], "s", "e").select("repo", "path", "author", F.col("period_start").cast("int").alias("period_start"), F.col("period_end").cast("int").alias("period_end"))


QUERIES = {f.__name__: f for f in (p5_found, p5_tree, p5_descendants, p6_found, p6_periods)}

_LINKS = """
WITH RECURSIVE d AS (
  SELECT repo, path, idx, max(name) AS name, max(parent) AS parent, max(container) AS container FROM declarations GROUP BY repo, path, idx),
by_name AS (SELECT repo, path, name, min(idx) AS idx FROM d WHERE name IS NOT NULL GROUP BY repo, path, name),
l AS (SELECT d.repo, d.path, d.idx, d.name, t.idx AS parent FROM d
  LEFT JOIN by_name b ON d.parent IS NULL AND d.container = b.name AND d.repo = b.repo AND d.path = b.path
  LEFT JOIN d t ON t.repo = d.repo AND t.path = d.path AND t.idx = coalesce(d.parent, b.idx)),
w AS (SELECT repo, path, idx, idx AS root_idx, 0 AS depth, name AS full_name FROM l WHERE parent IS NULL
  UNION ALL SELECT l.repo, l.path, l.idx, w.root_idx, w.depth + 1, w.full_name || '/' || l.name FROM l JOIN w ON l.repo = w.repo AND l.path = w.path AND l.parent = w.idx)
"""

SQL = {
    "p5_found": _LINKS + """
SELECT l.repo, l.path, l.idx, coalesce(w.root_idx, -1) AS root_idx, coalesce(w.depth, -1) AS depth
FROM l LEFT JOIN w ON w.repo = l.repo AND w.path = l.path AND w.idx = l.idx WHERE l.parent IS NOT NULL""",
    "p5_tree": _LINKS + """,
cl AS (SELECT l.repo, l.path, l.idx, l.parent AS above FROM l LEFT JOIN w ON w.repo = l.repo AND w.path = l.path AND w.idx = l.idx WHERE w.idx IS NULL
  UNION SELECT cl.repo, cl.path, cl.idx, l.parent FROM cl JOIN l ON l.repo = cl.repo AND l.path = cl.path AND l.idx = cl.above),
ring AS (SELECT repo, path, idx FROM cl WHERE idx = above),
mem AS (SELECT cl.repo, cl.path, cl.idx, string_agg(CAST(cl.above AS VARCHAR), ',' ORDER BY cl.above) AS members FROM cl JOIN ring r ON r.repo = cl.repo AND r.path = cl.path AND r.idx = cl.idx GROUP BY cl.repo, cl.path, cl.idx),
c AS (SELECT l.repo, l.path, l.parent AS idx, l.idx AS d FROM l JOIN w ON w.repo = l.repo AND w.path = l.path AND w.idx = l.idx WHERE l.parent IS NOT NULL
  UNION ALL SELECT c.repo, c.path, l.parent, c.d FROM c JOIN l ON l.repo = c.repo AND l.path = c.path AND l.idx = c.idx WHERE l.parent IS NOT NULL),
n AS (SELECT repo, path, idx, count(*) AS n FROM c GROUP BY repo, path, idx)
SELECT l.repo, l.path, l.idx, coalesce(w.full_name, '') AS full_name, coalesce(w.depth, -1) AS depth, coalesce(n.n, 0) AS n_descendants,
 CASE WHEN w.depth = 0 THEN 'root' WHEN w.depth > 0 THEN 'node' WHEN mem.members IS NOT NULL THEN 'loop' ELSE 'below_loop' END AS status, coalesce(mem.members, '') AS loop_members
FROM l LEFT JOIN w ON w.repo = l.repo AND w.path = l.path AND w.idx = l.idx LEFT JOIN n ON n.repo = l.repo AND n.path = l.path AND n.idx = l.idx LEFT JOIN mem ON mem.repo = l.repo AND mem.path = l.path AND mem.idx = l.idx""",
    "p5_descendants": _LINKS + """,
c AS (SELECT l.repo, l.path, l.parent AS idx, l.idx AS descendant_idx, 1 AS steps FROM l JOIN w ON w.repo = l.repo AND w.path = l.path AND w.idx = l.idx WHERE l.parent IS NOT NULL
  UNION ALL SELECT c.repo, c.path, l.parent, c.descendant_idx, c.steps + 1 FROM c JOIN l ON l.repo = c.repo AND l.path = c.path AND l.idx = c.idx WHERE l.parent IS NOT NULL)
SELECT repo, path, idx, descendant_idx, steps FROM c""",
    "p6_found": """
WITH t AS (SELECT agent, repo, file, max(total_lines) AS total FROM read_ranges GROUP BY agent, repo, file),
r AS (SELECT DISTINCT r.agent, r.repo, r.file, total, greatest(least(coalesce(line_start, 1), coalesce(line_end, total)), 1) AS s, least(greatest(coalesce(line_start, 1), coalesce(line_end, total)), total) AS e
  FROM read_ranges r JOIN t USING (agent, repo, file) WHERE (line_start IS NOT NULL OR line_end IS NOT NULL) AND total >= 1),
x AS (SELECT 'read' AS relation, repo, file AS path, agent AS holder, s, e FROM r WHERE s <= e
  UNION SELECT 'read', repo, file, agent, 0, 0 FROM r UNION SELECT 'read', repo, file, agent, total + 1, total + 1 FROM r
  UNION SELECT 'blame', repo, path, author, line_start, line_end FROM blame_regions WHERE author IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY relation, repo, path, holder ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
SELECT relation, repo, path, holder, CAST(before + 1 AS INTEGER) AS gap_start, CAST(s - 1 AS INTEGER) AS gap_end FROM y WHERE s > before + 1""",
    "p6_periods": """
WITH x AS (SELECT DISTINCT repo, path, author, line_start AS s, line_end AS e FROM blame_regions WHERE author IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY repo, path, author ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path, author ORDER BY s, e) AS n FROM y)
SELECT repo, path, author, min(s) AS period_start, max(e) AS period_end FROM z GROUP BY repo, path, author, n""",
}
