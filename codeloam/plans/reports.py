"""Whole reports: what one command tells of files, put together from the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import history as H, spans as P, text as T
from . import code as C, commands as M, history as Y, more as O
from .code import _D, _F, _KEY, declared, filed
from .history import _H, changes
from .registry import Registry
from .text import _SOURCE, source_lines

query = Registry()
_SQL = {**C.SQL, **Y.SQL, **M.SQL, **O.SQL}


def _by_node(df: DataFrame, path: str = "path") -> DataFrame:
    """repo and path of rows that name a file as repo:path."""
    return df.withColumn("repo", F.regexp_extract(path, "^([^:]*):", 1)).withColumn(path, F.regexp_extract(path, "^[^:]*:(.*)$", 1))


def _importers(spark: SparkSession, d: str) -> DataFrame:
    return _by_node(C.importer_counts(spark, d)).select(*_KEY, "imported_by")


_IMPORTERS = f"(SELECT regexp_extract(path, '^([^:]*):', 1) AS repo, regexp_extract(path, '^[^:]*:(.*)$', 1) AS path, imported_by FROM ({_SQL['importer_counts']}))"


@query(f"""SELECT a.repo, a.path, a.commits, a.recent, a.first_seen, a.last_modified, b.author AS top_author, c.other AS changed_with, c.n AS together FROM ({_SQL['file_lifecycle']}) a LEFT JOIN ({_SQL['top_authors']}) b USING (repo, path) LEFT JOIN (SELECT * FROM ({_SQL['co_changed_files']}) WHERE rank = 1) c USING (repo, path)""")
def history_of_files(spark, d):
    """The life of each path, who works most on it, and what most often changes with it."""
    top = Y.top_authors(spark, d).select(*_KEY, F.col("author").alias("top_author"))
    co = Y.co_changed_files(spark, d).where("rank = 1").select(*_KEY, F.col("other").alias("changed_with"), F.col("n").alias("together"))
    return Y.file_lifecycle(spark, d).drop("last_subject").join(top, _KEY, "left").join(co, _KEY, "left")


@query(f"""SELECT i.*, coalesce(n.imported_by, 0) AS imported_by, coalesce(m.imports, 0) AS imports FROM ({_SQL['info_files']}) i LEFT JOIN {_IMPORTERS} n USING (repo, path) LEFT JOIN (SELECT regexp_extract(path, '^([^:]*):', 1) AS repo, regexp_extract(path, '^[^:]*:(.*)$', 1) AS path, imports FROM ({_SQL['imports_per_file']})) m USING (repo, path)""")
def info_of_files(spark, d):
    """The facts of each file, what it declares, and how it stands among the imports."""
    m = _by_node(C.imports_per_file(spark, d)).select(*_KEY, "imports")
    j = M.info_files(spark, d).join(_importers(spark, d), _KEY, "left").join(m, _KEY, "left")
    return j.withColumn("imported_by", F.coalesce("imported_by", F.lit(0))).withColumn("imports", F.coalesce("imports", F.lit(0)))


@query(f"""SELECT c.repo, c.path, c.language, c.rank, c.top_author, l.commits, l.last_modified, n.imported_by, f.functions, f.longest FROM ({_SQL['context_files']}) c LEFT JOIN ({_SQL['file_lifecycle']}) l USING (repo, path) LEFT JOIN {_IMPORTERS} n USING (repo, path) LEFT JOIN ({_SQL['file_functions']}) f USING (repo, path)""")
def context_of_files(spark, d):
    """What one wants to know of a file before changing it, with its history, importers and functions."""
    life = Y.file_lifecycle(spark, d).select(*_KEY, "commits", "last_modified")
    f = C.file_functions(spark, d).select(*_KEY, "functions", "longest")
    return M.context_files(spark, d).select(*_KEY, "language", "rank", "top_author").join(life, _KEY, "left").join(_importers(spark, d), _KEY, "left").join(f, _KEY, "left")


@query(f"""SELECT coalesce(a.language, b.language) AS language, a.n AS measured, a.code, a.complexity, b.n AS files, b.median, b.p90, b.max FROM ({_SQL['stats_languages']}) a FULL JOIN ({_SQL['stats_complexity']}) b ON a.language = b.language WHERE coalesce(a.language, b.language) IS NOT NULL""")
def stats_report(spark, d):
    """Languages with their measurements and the distribution of complexity over their files."""
    a = C.stats_languages(spark, d).withColumnRenamed("n", "measured")
    b = C.stats_complexity(spark, d).select("language", F.col("n").alias("files"), "median", "p90", "max")
    return a.where("language is not null").join(b.where("language is not null"), "language", "full_outer")


@query(f"""WITH {_H}, {_F}, w AS (SELECT repo, path, min(substring(status, 1, 1)) AS s FROM x WHERE pos = 0 GROUP BY repo, path) SELECT w.repo, w.path, CASE s WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' WHEN 'M' THEN 'modified' WHEN 'T' THEN 'type changed' ELSE 'unknown' END AS state, f.cc AS complexity, coalesce(n.imported_by, 0) AS imported_by, count(*) OVER (PARTITION BY w.repo) AS total FROM w LEFT JOIN f USING (repo, path) LEFT JOIN {_IMPORTERS} n USING (repo, path)""")
def status_report(spark, d):
    """What the newest commit of each repository changed, as a working tree, with what depends on it and how many there are."""
    w = changes(spark, d).where("pos = 0").groupBy(*_KEY).agg(F.min(F.substring("status", 1, 1)).alias("s"))
    total = w.groupBy("repo").agg(F.count("*").alias("total"))
    j = w.join(filed(spark, d).select(*_KEY, F.col("cc").alias("complexity")), _KEY, "left").join(_importers(spark, d), _KEY, "left").join(total, "repo")
    return j.select(*_KEY, S.status_label("s").alias("state"), "complexity", F.coalesce("imported_by", F.lit(0)).alias("imported_by"), "total")


@query(f"""WITH r AS (SELECT repo, symbol, max(reach) AS reach FROM ({_SQL['symbol_reach']}) GROUP BY repo, symbol) SELECT s.repo, s.name, s.kind, s.state, coalesce(r.reach, 0) AS direct FROM ({_SQL['surface_delta']}) s LEFT JOIN r ON r.repo = s.repo AND r.symbol = lower(s.name) WHERE s.state <> 'same' ORDER BY direct DESC, CASE s.state WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, s.repo, s.name, s.kind LIMIT 200""")
def diff_report(spark, d):
    """Declarations that differ between two trees, those used most elsewhere first, removed before added before changed."""
    reach = O.symbol_reach(spark, d).groupBy("repo", "symbol").agg(F.max("reach").alias("reach"))
    s = O.surface_delta(spark, d).where("state <> 'same'").withColumn("symbol", F.lower("name")).join(reach, ["repo", "symbol"], "left")
    place = F.when(F.col("state") == "removed", 0).when(F.col("state") == "added", 1).otherwise(2)
    return s.select("repo", "name", "kind", "state", F.coalesce("reach", F.lit(0)).alias("direct")).orderBy(F.desc("direct"), place, "repo", "name", "kind").limit(200)


@query(f"""SELECT g.*, s.definitions, s.kinds, s.mentioned_in FROM ({_SQL['grep_enriched']}) g LEFT JOIN ({_SQL['signposts']}) s ON s.repo = g.repo AND s.symbol = lower(g.enclosing) WHERE ends_with(g.path, '.rb') OR ends_with(g.path, '.go')""")
def grep_report(spark, d):
    """Matches below a glob with the facts of their file, the declaration around them and what is known of its name."""
    hits = M.grep_enriched(spark, d).where(T.glob_match("path", "*.{rb,go}")).withColumn("symbol", F.lower("enclosing"))
    return hits.join(C.signposts(spark, d), ["repo", "symbol"], "left").drop("symbol")


@query(f"""WITH {_F}, {_D}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL), m AS (SELECT repo, path, line_no, unnest(regexp_extract_all(line, 'if\\s*\\(\\s*[A-Za-z0-9_$]+\\s*>\\s*[A-Za-z0-9_$]+\\s*\\)')) AS match FROM l),
e AS (SELECT m.repo, m.path, m.line_no, d.name, row_number() OVER (PARTITION BY m.repo, m.path, m.line_no ORDER BY d.end_line - d.line, d.idx DESC) AS r FROM (SELECT DISTINCT repo, path, line_no FROM m) m JOIN d ON d.repo = m.repo AND d.path = m.path AND m.line_no BETWEEN d.line AND d.end_line)
SELECT m.repo, m.path, m.line_no, m.match, e.name AS enclosing, f.cc FROM m JOIN f ON f.repo = m.repo AND f.path = m.path LEFT JOIN e ON e.repo = m.repo AND e.path = m.path AND e.line_no = m.line_no AND e.r = 1""")
def pattern_report(spark, d):
    """Matches of a pattern of code with their line, the declaration around them and the facts of their file."""
    hits = T.structural(filed(spark, d), _KEY, "content", "if ( $A > $B )")
    spans = declared(spark, d).select(*_KEY, "idx", "name", F.col("line").alias("first"), "end_line")
    held = P.innermost(hits.select(*_KEY, "line_no").distinct(), spans, _KEY, "line_no", "first", "end_line", "idx", [*_KEY, "line_no"], "left")
    return hits.join(held.select(*_KEY, "line_no", F.col("name").alias("enclosing")), [*_KEY, "line_no"]).join(filed(spark, d).select(*_KEY, "cc"), _KEY)


@query(f"""WITH {_F} SELECT f.repo, f.path, len(string_split(f.path, '/')) AS depth, regexp_extract(f.path, '[^/]*$') AS name, CASE WHEN cc < 10 THEN '·' WHEN cc < 30 THEN '•' WHEN cc < 80 THEN '●' WHEN cc IS NOT NULL THEN '⚠' ELSE '?' END AS marker, coalesce(n.imported_by, 0) AS imported_by FROM f LEFT JOIN {_IMPORTERS} n USING (repo, path) WHERE len(string_split(f.path, '/')) <= 3""")
def tree_report(spark, d):
    """The tree to three levels, with the sign of each file's rank and its importers."""
    f = filed(spark, d).withColumn("depth", S.depth("path")).where("depth <= 3")
    return f.join(_importers(spark, d), _KEY, "left").select(*_KEY, "depth", S.base_name("path").alias("name"), S.rank_marker(S.rank_bucket("cc")).alias("marker"), F.coalesce("imported_by", F.lit(0)).alias("imported_by"))


@query(f"""WITH RECURSIVE {_H}, b AS (SELECT repo, path, arg_min(status, (pos, seq)) AS status FROM x WHERE pos >= 50 GROUP BY repo, path), ex AS ({_SQL['exported_visibility']}) SELECT ex.repo, ex.path, ex.idx, ex.exported FROM ex JOIN b USING (repo, path) WHERE b.status NOT LIKE 'D%' AND ex.exported >= 3""")
def api_of_revision(spark, d):
    """What the files of an older commit offer to others, by the least visibility of all that holds it."""
    there = H.blobs_at(changes(spark, d), 50).select(*_KEY)
    return C.exported_visibility(spark, d).where("exported >= 3").join(there, _KEY, "left_semi").select(*_KEY, "idx", "exported")


@query(f"""WITH {_F}, {_D}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL) SELECT l.repo, l.path, d.idx, l.line_no, regexp_replace(l.line, chr(13) || '+$', '') AS line FROM l JOIN d ON d.repo = l.repo AND d.path = l.path AND l.line_no BETWEEN d.header_line AND d.end_line WHERE d.kind IN ('function', 'method') AND starts_with(lower(d.name), 'merge')""")
def read_functions(spark, d, name: str = "merge"):
    """The lines of functions whose names begin so, with their annotations."""
    f = declared(spark, d).where(F.col("kind").isin("function", "method") & F.lower("name").startswith(name)).select(*_KEY, "idx", F.col("header_line").alias("first"), F.col("end_line").alias("last"))
    lines = source_lines(spark, d).withColumn("line_end", F.col("line_no"))
    return P.overlapping(lines, f, _KEY, "line_no", "line_end", "first", "last").select(*_KEY, "idx", "line_no", "line")


@query(f"""WITH {_SOURCE}, s AS (SELECT repo, path, min(line_no) AS stop FROM l WHERE NOT regexp_matches(line, '^\\s*(?://|#|/\\*|\\*|--|<!--)') AND trim(line) <> '' GROUP BY repo, path)
SELECT l.repo, l.path, count(*) AS n, max(CASE WHEN regexp_matches(line, '(?i)licen[sc]e|copyright|spdx') THEN 1 ELSE 0 END) AS licensed, max(CASE WHEN regexp_matches(line, '(?i)@generated|generated by|do not edit') THEN 1 ELSE 0 END) AS "generated" FROM l LEFT JOIN s USING (repo, path) WHERE (stop IS NULL OR line_no < stop) AND trim(line) <> '' GROUP BY l.repo, l.path""")
def licence_heads(spark, d):
    """The comments that files open with, and what they say: a licence, or that the file is output."""
    block = T.leading_block(source_lines(spark, d), _KEY)
    says = lambda p: F.max(F.col("line").rlike(p).cast("int"))
    return block.groupBy(*_KEY).agg(F.count("*").alias("n"), says("(?i)licen[sc]e|copyright|spdx").alias("licensed"), says("(?i)@generated|generated by|do not edit").alias("generated"))


QUERIES, SQL = query.queries, query.sql
