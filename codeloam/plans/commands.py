"""Whole commands: results with the facts of their files, in the order and with the totals a reader expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import graph as G, resolve as R, snapshot as N, spans as P, stats as A, text as T
from ..sources.tables import table
from .code import _D, _EDGES, _F, _KEY, _SITES, _SRC, declared, filed, import_edges, sites
from .history import _H, changes
from .registry import Registry
from .text import source_lines

query = Registry()

_LINES = f"{_SRC}, {_D}, n AS (SELECT repo, path, line_no, regexp_replace(line, chr(13) || '+$', '') AS line FROM l)"


@query(f"""WITH {_F}, {_D}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL),
m AS (SELECT repo, path, line_no FROM l WHERE regexp_matches(line, 'return')), e AS (SELECT m.*, d.idx, d.name, row_number() OVER (PARTITION BY m.repo, m.path, m.line_no ORDER BY d.end_line - d.line, d.idx DESC) AS r FROM m JOIN d ON d.repo = m.repo AND d.path = m.path AND m.line_no BETWEEN d.line AND d.end_line)
SELECT m.repo, m.path, m.line_no, f.language, f.cc, e.name AS enclosing FROM m JOIN f ON f.repo = m.repo AND f.path = m.path LEFT JOIN e ON e.repo = m.repo AND e.path = m.path AND e.line_no = m.line_no AND e.r = 1""")
def grep_enriched(spark, d):
    """Matches with the facts of their file and the declaration around them."""
    hits = source_lines(spark, d).where(T.matches("line", "return")).select(*_KEY, "line_no").distinct()
    held = P.innermost(hits, declared(spark, d).select(*_KEY, "idx", "name", F.col("line").alias("first"), "end_line"), _KEY, "line_no", "first", "end_line", "idx", [*_KEY, "line_no"], "left")
    return held.join(filed(spark, d).select(*_KEY, "language", "cc"), _KEY).select(*_KEY, "line_no", "language", "cc", F.col("name").alias("enclosing"))


@query(f"""WITH {_F}, {_H}, h AS (SELECT repo, path, max(commit_date) AS last FROM x GROUP BY repo, path) SELECT f.repo, f.path, CAST(last AS VARCHAR) AS last_modified FROM f JOIN h ON h.repo = f.repo AND h.path = f.path ORDER BY last DESC, f.path DESC, f.repo DESC LIMIT 200""")
def find_recent(spark, d):
    """The 200 files changed last; equal dates in falling order of path."""
    h = changes(spark, d).groupBy(*_KEY).agg(F.max("commit_date").alias("last"))
    first, _ = A.total(filed(spark, d).select(*_KEY).join(h, _KEY), [F.desc("last"), F.desc("path"), F.desc("repo")], 200)
    return first.select(*_KEY, F.col("last").cast("string").alias("last_modified"))


@query(f"""WITH {_F} SELECT count(*) AS total, count(*) FILTER (cc >= 10) AS complex, count(*) FILTER (content IS NULL) AS unread FROM f WHERE ends_with(path, '.go') OR ends_with(path, '.rs')""")
def find_totals(spark, d):
    hit = filed(spark, d).where(T.glob_match("path", "*.{go,rs}"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return hit.agg(F.count("*").alias("total"), n(F.col("cc") >= 10).alias("complex"), n(F.col("content").isNull()).alias("unread"))


@query(f"""WITH {_EDGES}, {_H}, cg AS (SELECT repo, path, min(status) AS status FROM x WHERE pos < 20 GROUP BY repo, path), n AS (SELECT target, count(*) AS importers FROM edges WHERE confidence < 2 GROUP BY target),
r AS (SELECT cg.repo, cg.path, substring(status, 1, 1) AS state, coalesce(importers, 0) AS importers, coalesce(f.cc, 0) AS complexity FROM cg LEFT JOIN n ON n.target = cg.repo || ':' || cg.path LEFT JOIN f ON f.repo = cg.repo AND f.path = cg.path)
SELECT repo, path, state, importers, complexity FROM r ORDER BY importers DESC, complexity DESC, CASE state WHEN 'D' THEN 0 WHEN 'R' THEN 1 WHEN 'M' THEN 2 ELSE 3 END, path, repo LIMIT 100""")
def blast_radius(spark, d):
    """What the newest 20 commits of each repository changed, the most depended on first."""
    c = changes(spark, d).where("pos < 20").groupBy(*_KEY).agg(F.min("status").alias("status"))
    n = G.importers(import_edges(spark, d), c.select(F.concat_ws(":", "repo", "path").alias("path"))).withColumnRenamed("path", "node")
    j = c.withColumn("node", F.concat_ws(":", "repo", "path")).join(n, "node", "left").join(filed(spark, d).select(*_KEY, "cc"), _KEY, "left")
    rows = j.select(*_KEY, F.substring("status", 1, 1).alias("state"), F.coalesce(F.col("imported_by"), F.lit(0)).alias("importers"), F.coalesce("cc", F.lit(0)).alias("complexity"))
    place = F.when(F.col("state") == "D", 0).when(F.col("state") == "R", 1).when(F.col("state") == "M", 2).otherwise(3)
    return rows.orderBy(F.desc("importers"), F.desc("complexity"), place, "path", "repo").limit(100)


@query(f"""WITH {_SITES}, b AS (SELECT repo, path, line, name, target_path, target_line, min(confidence) AS confidence FROM sites WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT repo, name, path, line, target_path, confidence FROM b ORDER BY confidence, path, line, name, repo, target_path, target_line LIMIT 200""")
def callers_ranked(spark, d):
    """Use sites, the surest first."""
    u = R.unique_sites(sites(spark, d))
    return u.orderBy("confidence", "path", "line", "name", "repo", "target_path", "target_line").limit(200).select("repo", "name", "path", "line", "target_path", "confidence")


@query(f"""WITH {_F}, {_D}, s AS (SELECT repo, path, count(*) AS declarations, count(*) FILTER (kind IN ('function', 'method')) AS functions, max(end_line - line + 1) FILTER (kind IN ('function', 'method')) AS longest, count(*) FILTER (visibility >= 3 AND parent IS NULL) AS exported FROM d GROUP BY repo, path)
SELECT f.repo, f.path, f.language, f.lines, f.cc, coalesce(s.declarations, 0) AS declarations, coalesce(s.functions, 0) AS functions, s.longest, coalesce(s.exported, 0) AS exported FROM f LEFT JOIN s ON s.repo = f.repo AND s.path = f.path""")
def info_files(spark, d):
    """The facts of every file with what it declares."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fn = F.col("kind").isin("function", "method")
    s = declared(spark, d).groupBy(*_KEY).agg(F.count("*").alias("declarations"), n(fn).alias("functions"), F.max(F.when(fn, F.col("end_line") - F.col("line") + 1)).alias("longest"), n((F.col("visibility") >= 3) & F.col("parent").isNull()).alias("exported"))
    none = F.lit(0)
    return filed(spark, d).join(s, _KEY, "left").select(*_KEY, "language", "lines", "cc", F.coalesce("declarations", none).alias("declarations"), F.coalesce("functions", none).alias("functions"), "longest", F.coalesce("exported", none).alias("exported"))


@query(f"""WITH {_F}, {_H}, a AS (SELECT repo, path, commit_date FROM x), t AS (SELECT f.repo, regexp_extract(f.path, '^[^/]*') AS folder, f.path, f.cc, max(a.commit_date) AS last FROM f LEFT JOIN a ON a.repo = f.repo AND a.path = f.path GROUP BY ALL)
SELECT repo, folder, count(*) AS files, sum(cc) AS complexity, CAST(max(last) AS VARCHAR) AS last_modified, row_number() OVER (PARTITION BY repo ORDER BY max(last) DESC NULLS LAST, folder) AS place FROM t GROUP BY repo, folder""")
def list_recent(spark, d):
    """The folders at the top of each repository, the one changed last first."""
    a = changes(spark, d).groupBy(*_KEY).agg(F.max("commit_date").alias("last"))
    t = filed(spark, d).join(a, _KEY, "left").groupBy("repo", F.regexp_extract("path", "^[^/]*", 0).alias("folder")).agg(F.count("*").alias("files"), F.sum("cc").alias("complexity"), F.max("last").alias("last"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc_nulls_last("last"), "folder"))
    return t.withColumn("place", place).select("repo", "folder", "files", "complexity", F.col("last").cast("string").alias("last_modified"), "place")


@query(f"""WITH {_D}, a AS (SELECT repo, name, kind, min(idx) AS i, 1 AS x FROM d WHERE visibility >= 3 AND starts_with(path, 'src/') GROUP BY ALL), b AS (SELECT repo, name, kind, min(idx) AS i, 1 AS x FROM d WHERE visibility >= 3 AND starts_with(path, 'lib/') GROUP BY ALL)
SELECT repo, name, kind, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.i = b.i THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (repo, name, kind)""")
def diff_symbols(spark, d):
    """Exported names of two trees against each other."""
    side = lambda p: declared(spark, d).where((F.col("visibility") >= 3) & F.col("path").startswith(p)).groupBy("repo", "name", "kind").agg(F.min("idx").alias("i"))
    return N.keyed_diff(side("src/"), side("lib/"), ["repo", "name", "kind"], ["i"])


@query(f"""WITH {_D}, r AS (SELECT d.repo, d.path, d.idx, d.name, count(DISTINCT c.commit_id) AS commits FROM d JOIN (SELECT DISTINCT repo, commit_id, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') AS path FROM file_changes WHERE path IS NOT NULL) c ON c.repo = d.repo AND c.path = d.path WHERE d.kind = 'class' GROUP BY ALL) SELECT * FROM r""")
def class_churn(spark, d):
    """How many commits touched the file of each class."""
    c = changes(spark, d).groupBy(*_KEY).agg(F.countDistinct("commit_id").alias("commits"))
    return declared(spark, d).where("kind = 'class'").join(c, _KEY).select(*_KEY, "idx", "name", "commits")


@query(f"""WITH {_F}, {_D}, {_H}, t AS (SELECT repo, path, author, n FROM (SELECT repo, path, author, count(*) AS n, row_number() OVER (PARTITION BY repo, path ORDER BY count(*) DESC, min(pos), author) AS r FROM (SELECT DISTINCT repo, path, commit_id, author, pos FROM x) WHERE author IS NOT NULL GROUP BY repo, path, author) WHERE r = 1)
SELECT f.repo, f.path, f.language, f.cc, CASE WHEN f.cc < 10 THEN 'low' WHEN f.cc < 30 THEN 'medium' WHEN f.cc < 80 THEN 'high' WHEN f.cc IS NOT NULL THEN 'critical' END AS rank, t.author AS top_author, t.n AS commits_of_author FROM f LEFT JOIN t ON t.repo = f.repo AND t.path = f.path""")
def context_files(spark, d):
    """What one wants to know of a file before changing it."""
    from ..operators.history import top_authors

    t = top_authors(changes(spark, d), "path").select(*_KEY, F.col("author").alias("top_author"), F.col("n").alias("commits_of_author"))
    return filed(spark, d).join(t, _KEY, "left").select(*_KEY, "language", "cc", S.rank_bucket("cc").alias("rank"), "top_author", "commits_of_author")


@query("""WITH r AS (SELECT agent, repo, file, count(*) AS reads, max(total_lines) AS lines FROM read_ranges GROUP BY ALL), w AS (SELECT *, sum(coalesce(lines, 0)) OVER (PARTITION BY agent ORDER BY reads DESC, repo, file ROWS UNBOUNDED PRECEDING) AS upto FROM r) SELECT agent, repo, file, CASE WHEN upto <= 2000 THEN 'whole' WHEN upto - coalesce(lines, 0) < 2000 THEN 'cut' ELSE 'queued' END AS state FROM w""")
def reading_budget(spark, d):
    """Which files fit 2,000 lines for each agent, the most read first."""
    from ..operators.docs import fit

    r = table(spark, d, "read_ranges").groupBy("agent", "repo", "file").agg(F.count("*").alias("reads"), F.coalesce(F.max("total_lines"), F.lit(0)).alias("lines"))
    return fit(r.withColumn("less", -F.col("reads")), ["agent"], ["less", "repo", "file"], "lines", 2000).select("agent", "repo", "file", "state")


@query(f"""WITH {_H}, w AS (SELECT repo, commit_id, pos, count(*) AS n, count(DISTINCT regexp_extract(path, '^[^/]*')) AS folders, count(*) FILTER (substring(status, 1, 1) = 'A') AS added, count(*) FILTER (substring(status, 1, 1) = 'D') AS deleted, count(*) FILTER (substring(status, 1, 1) IN ('R', 'C')) AS moved FROM x GROUP BY repo, commit_id, pos) SELECT repo, commit_id, n, folders, added, deleted, moved FROM w""")
def commit_summaries(spark, d):
    s = F.substring("status", 1, 1)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return changes(spark, d).groupBy("repo", "commit_id").agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("path", "^[^/]*", 0)).alias("folders"), n(s == "A").alias("added"), n(s == "D").alias("deleted"), n(s.isin("R", "C")).alias("moved"))


@query(f"""WITH {_H}, f AS (SELECT repo, commit_id, pos FROM c WHERE contains(lower(subject), 'fix')), p AS (SELECT x.repo, x.path, count(DISTINCT x.commit_id) AS fixes, count(DISTINCT x.commit_id) FILTER (x.pos < 100) AS lately FROM x JOIN f USING (repo, commit_id) GROUP BY ALL) SELECT * FROM p""")
def fix_hotspots(spark, d):
    """How often each path was part of a fix, ever and within the newest 100 commits."""
    x = changes(spark, d).where(F.lower("subject").contains("fix"))
    return x.groupBy(*_KEY).agg(F.countDistinct("commit_id").alias("fixes"), F.countDistinct(F.when(F.col("pos") < 100, F.col("commit_id"))).alias("lately"))


QUERIES, SQL = query.queries, query.sql
