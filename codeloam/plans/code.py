"""Declarations, references, dependencies, metrics and snapshots of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import graph as G, resolve as R, snapshot as N, spans as P, stats as A
from ..operators.hierarchy import hierarchy
from ..operators.intervals import periods
from ..runtime import stored
from ..sources.tables import table
from .problems import reads
from .registry import Registry
from .text import source_lines

query = Registry()

_KEY = ["repo", "path"]
_D = "d AS (SELECT repo, path, idx, max(name) AS name, max(kind) AS kind, max(header_line) AS header_line, max(line) AS line, max(end_line) AS end_line, max(container) AS container, max(parent) AS parent, max(header) AS header, max(visibility) AS visibility FROM declarations GROUP BY repo, path, idx)"
_F = "f AS (SELECT repo, path, max(language) AS language, max(lines) AS lines, max(cyclomatic_complexity) AS cc, max(content) AS content FROM files GROUP BY repo, path)"


def declared(spark: SparkSession, d: str) -> DataFrame:
    """One row per declaration: repeated rows fold to their greatest values, so a null gives way."""
    columns = ["name", "kind", "header_line", "line", "end_line", "container", "parent", "header", "visibility"]
    return table(spark, d, "declarations").groupBy("repo", "path", "idx").agg(*[F.max(c).alias(c) for c in columns])


def filed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").groupBy("repo", "path").agg(F.max("language").alias("language"), F.max("lines").alias("lines"), F.max("cyclomatic_complexity").alias("cc"), F.max("content").alias("content"))


# metrics and rollups

_M = "m AS (SELECT DISTINCT repo, path, language, code, lines, complexity, measured_on, loaded_at FROM metrics)"


@query(f"WITH {_M} SELECT language, count(*) AS n, sum(code) AS code, sum(complexity) AS complexity FROM m GROUP BY language")
def stats_languages(spark, d):
    return table(spark, d, "metrics").distinct().groupBy("language").agg(F.count("*").alias("n"), F.sum("code").alias("code"), F.sum("complexity").alias("complexity"))


@query(f"""WITH {_F}, v AS (SELECT language, cc, row_number() OVER (PARTITION BY language ORDER BY cc) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM f WHERE cc IS NOT NULL)
SELECT language, n, (max(cc) FILTER (i = (n - 1) // 2) + max(cc) FILTER (i = n // 2)) // 2 AS median, max(cc) FILTER (i = greatest(n * 75 // 100 - 1, 0)) AS p75, max(cc) FILTER (i = greatest(n * 90 // 100 - 1, 0)) AS p90,
 max(cc) FILTER (i = greatest(n * 95 // 100 - 1, 0)) AS p95, max(cc) AS max FROM v GROUP BY language, n""")
def stats_complexity(spark, d):
    return A.distribution(filed(spark, d), ["language"], "cc", {"p75": 0.75, "p90": 0.90, "p95": 0.95})


@query(f"WITH {_F} SELECT repo, path, cc FROM f WHERE cc IS NOT NULL ORDER BY cc DESC, path, repo LIMIT 10")
def stats_top_complex(spark, d):
    first, _ = A.total(filed(spark, d).where("cc is not null"), [F.desc("cc"), F.col("path"), F.col("repo")], 10)
    return first.select("repo", "path", "cc")


@query(f"WITH {_F} SELECT repo, CASE WHEN cc < 10 THEN 'low' WHEN cc < 30 THEN 'medium' WHEN cc < 80 THEN 'high' ELSE 'critical' END AS rank, count(*) AS n FROM f WHERE cc IS NOT NULL GROUP BY ALL")
def stats_ranks(spark, d):
    return filed(spark, d).where("cc is not null").groupBy("repo", S.rank_bucket("cc").alias("rank")).agg(F.count("*").alias("n"))


@query(f"""WITH {_F}, c AS (SELECT repo, regexp_extract(substring(path, 5), '^[^/]*/?') AS child, cc, lines FROM f WHERE starts_with(path, 'src/'))
SELECT repo, child, count(*) AS files, sum(cc) AS complexity, sum(lines) AS lines, max(cc) AS most FROM c GROUP BY repo, child""")
def list_children(spark, d):
    return A.children(filed(spark, d), "path", "src").groupBy("repo", "child").agg(F.count("*").alias("files"), F.sum("cc").alias("complexity"), F.sum("lines").alias("lines"), F.max("cc").alias("most"))


@query(f"""WITH {_F} SELECT repo, count(*) AS file_count, sum(cc) AS complexity, sum(lines) AS lines, count(content) AS with_content FROM f GROUP BY repo""")
def info_repository(spark, d):
    return filed(spark, d).groupBy("repo").agg(F.count("*").alias("file_count"), F.sum("cc").alias("complexity"), F.sum("lines").alias("lines"), F.count("content").alias("with_content"))


@query(f"""WITH {_F}, p AS (SELECT repo, string_split(path, '/') AS s FROM f), x AS (SELECT DISTINCT repo, array_to_string(list_slice(s, 1, k), '/') AS folder FROM (SELECT repo, s, unnest(range(1, len(s))) AS k FROM p))
SELECT repo, folder FROM x""")
def parent_folders(spark, d):
    return A.folders(filed(spark, d).select("repo", "path"), "path")


@query(f"""WITH {_F} SELECT repo, path, len(string_split(path, '/')) AS depth FROM f WHERE len(string_split(path, '/')) <= 2""")
def tree_to_depth(spark, d):
    return filed(spark, d).select("repo", "path", S.depth("path").alias("depth")).where("depth <= 2")


@query(f"""WITH {_F}, x AS (SELECT repo, regexp_extract(path, '^[^/]*') AS folder, count(*) AS n, count(*) FILTER (regexp_matches(path, '(?i)test')) AS tests, count(*) FILTER (regexp_matches(path, '\\.(ts|tsx|js|jsx|css)$')) AS front FROM f GROUP BY ALL)
SELECT repo, folder, CASE WHEN front >= 3 AND 2 * front > n THEN 'frontend' WHEN tests >= 2 AND 2 * tests > n THEN 'tests' ELSE 'code' END AS class FROM x""")
def folder_classes(spark, d):
    n = lambda p: F.sum(F.col("path").rlike(p).cast("int"))
    x = filed(spark, d).groupBy("repo", F.regexp_extract("path", "^[^/]*", 0).alias("folder")).agg(F.count("*").alias("n"), n("(?i)test").alias("tests"), n("\\.(ts|tsx|js|jsx|css)$").alias("front"))
    return x.select("repo", "folder", F.when((F.col("front") >= 3) & (2 * F.col("front") > F.col("n")), "frontend").when((F.col("tests") >= 2) & (2 * F.col("tests") > F.col("n")), "tests").otherwise("code").alias("class"))


@query(f"""WITH a AS (SELECT DISTINCT repo, path, idx, unnest(annotations) AS a FROM declarations) SELECT repo, regexp_extract(a, '[A-Za-z_]+') AS annotation, count(*) AS n FROM a GROUP BY ALL""")
def annotation_counts(spark, d):
    a = table(spark, d, "declarations").select("repo", "path", "idx", F.explode("annotations").alias("a")).distinct()
    return a.groupBy("repo", F.regexp_extract("a", "[A-Za-z_]+", 0).alias("annotation")).agg(F.count("*").alias("n"))


@query(f"WITH {_D} SELECT repo, path, count(*) AS functions, sum(end_line - line + 1) AS lines, max(end_line - line + 1) AS longest FROM d WHERE kind IN ('function', 'method') GROUP BY repo, path")
def file_functions(spark, d):
    n = F.col("end_line") - F.col("line") + 1
    return declared(spark, d).where("kind in ('function', 'method')").groupBy("repo", "path").agg(F.count("*").alias("functions"), F.sum(n).alias("lines"), F.max(n).alias("longest"))


# declarations

@query(f"WITH {_D} SELECT repo, path, idx, name, kind FROM d WHERE visibility >= 3")
def api_public(spark, d):
    return declared(spark, d).where("visibility >= 3").select("repo", "path", "idx", "name", "kind")


@query(f"WITH {_D} SELECT repo, path, idx, name FROM d WHERE visibility >= 3 AND parent IS NULL AND container IS NULL")
def exports(spark, d):
    return declared(spark, d).where("visibility >= 3 and parent is null and container is null").select("repo", "path", "idx", "name")


@query(f"WITH {_D} SELECT repo, path, kind, count(*) AS n, min(line) AS first_line FROM d GROUP BY repo, path, kind")
def structure_kinds(spark, d):
    return declared(spark, d).groupBy("repo", "path", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


_TREE = """
by_name AS (SELECT repo, path, name, min(idx) AS idx FROM d WHERE name IS NOT NULL GROUP BY repo, path, name),
k AS (SELECT d.repo, d.path, d.idx, d.visibility, t.idx AS parent FROM d LEFT JOIN by_name b ON d.parent IS NULL AND d.container = b.name AND d.repo = b.repo AND d.path = b.path LEFT JOIN d t ON t.repo = d.repo AND t.path = d.path AND t.idx = coalesce(d.parent, b.idx)),
w AS (SELECT repo, path, idx, idx AS root, visibility AS exported, 0 AS depth FROM k WHERE parent IS NULL UNION ALL SELECT k.repo, k.path, k.idx, w.root, least(w.exported, k.visibility), w.depth + 1 FROM k JOIN w ON k.repo = w.repo AND k.path = w.path AND k.parent = w.idx)"""


def tree_of(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "declarations"), _KEY, "idx", "parent", "name", "container")


@query(f"WITH RECURSIVE {_D}, {_TREE} SELECT repo, path, idx, exported FROM w")
def exported_visibility(spark, d):
    """The least visibility of a declaration and all that holds it."""
    up = tree_of(spark, d).where("path_ids is not null").select(*_KEY, F.col("id").alias("idx"), F.explode("path_ids").alias("above"))
    v = declared(spark, d).select(*_KEY, F.col("idx").alias("above"), "visibility")
    return up.join(v, [*_KEY, "above"]).groupBy(*_KEY, "idx").agg(F.min("visibility").alias("exported"))


@query(f"""WITH RECURSIVE {_D}, {_TREE}, c AS (SELECT k.repo, k.path, k.idx FROM k JOIN d USING (repo, path, idx) WHERE d.line <= 40 AND d.end_line >= 10 UNION SELECT k.repo, k.path, k.parent FROM k JOIN c USING (repo, path, idx) JOIN w USING (repo, path, idx) WHERE k.parent IS NOT NULL)
SELECT repo, path, idx FROM c""")
def window_rows(spark, d):
    """What lies in lines 10 to 40 of each file, with everything around it."""
    hit = declared(spark, d).where("line <= 40 and end_line >= 10")
    return P.with_ancestors(hit, tree_of(spark, d), _KEY, "idx").withColumnRenamed("id", "idx")


@query(f"WITH {_D}, k AS (SELECT repo, path, idx, kind || '/' || name AS key, row_number() OVER (PARTITION BY repo, path, kind, name ORDER BY idx) - 1 AS ordinal FROM d) SELECT * FROM k")
def declaration_keys(spark, d):
    k = N.with_ordinal(declared(spark, d), [*_KEY, "kind", "name"], ["idx"])
    return k.select(*_KEY, "idx", F.concat("kind", F.lit("/"), "name").alias("key"), "ordinal")


@query(f"WITH {_D}, k AS (SELECT repo, path, line, header, idx, lag(line) OVER w AS pl, lag(header) OVER w AS ph FROM d WINDOW w AS (PARTITION BY repo, path ORDER BY line, idx)) SELECT repo, path, idx FROM k WHERE NOT (line IS NOT DISTINCT FROM pl AND header IS NOT DISTINCT FROM ph)")
def surface_without_repeats(spark, d):
    from ..operators.islands import without_repeats

    return without_repeats(declared(spark, d), _KEY, ["line", "idx"], ["line", "header"]).select(*_KEY, "idx")


# spans

@query(f"""WITH {_D}, b AS (SELECT DISTINCT repo, path, line_start, line_end FROM blame_regions),
j AS (SELECT b.repo, b.path, b.line_start, b.line_end, d.idx, row_number() OVER (PARTITION BY b.repo, b.path, b.line_start, b.line_end ORDER BY d.end_line - d.line, d.idx DESC) AS r FROM b JOIN d ON d.repo = b.repo AND d.path = b.path AND b.line_start BETWEEN d.line AND d.end_line)
SELECT repo, path, line_start, line_end, idx FROM j WHERE r = 1""")
def enclosing_declaration(spark, d):
    b = table(spark, d, "blame_regions").select("repo", "path", "line_start", "line_end").distinct()
    spans = declared(spark, d).select(*_KEY, "idx", "line", "end_line")
    return P.innermost(b, spans, _KEY, "line_start", "line", "end_line", "idx", ["repo", "path", "line_start", "line_end"]).select(*_KEY, "line_start", "line_end", "idx")


@query(f"""WITH {_D}, b AS (SELECT DISTINCT repo, path, sha, line_start, line_end FROM blame_regions)
SELECT DISTINCT b.repo, b.path, b.sha, d.idx FROM b JOIN d ON d.repo = b.repo AND d.path = b.path AND d.line <= b.line_end AND b.line_start <= d.end_line""")
def touched_declarations(spark, d):
    b = table(spark, d, "blame_regions").select("repo", "path", "sha", "line_start", "line_end").distinct()
    return P.overlapping(b, declared(spark, d).select(*_KEY, "idx", "line", "end_line"), _KEY, "line_start", "line_end", "line", "end_line").select(*_KEY, "sha", "idx").distinct()


@query(f"""WITH {_D}, n AS (SELECT repo, path, line AS start_line, coalesce(container || '.', '') || name AS name FROM d WHERE kind IN ('function', 'method')),
j AS (SELECT n.repo, n.path, n.start_line, n.name, d.idx, row_number() OVER (PARTITION BY n.repo, n.path, n.start_line, n.name ORDER BY d.end_line - d.line, d.idx DESC) AS r FROM n JOIN d ON d.repo = n.repo AND d.path = n.path AND n.start_line BETWEEN d.line AND d.end_line AND (n.name = d.name OR ends_with(n.name, '.' || d.name)))
SELECT repo, path, start_line, name, idx FROM j WHERE r = 1""")
def function_of_declaration(spark, d):
    """Joins measured functions, known by qualified name and line, to their declarations."""
    decl = declared(spark, d)
    n = decl.where("kind in ('function', 'method')").select(*_KEY, F.col("line").alias("start_line"), F.concat(F.coalesce(F.concat("container", F.lit(".")), F.lit("")), "name").alias("qualified")).distinct()
    met = P.overlapping(n.withColumn("start_end", F.col("start_line")), decl.select(*_KEY, "idx", "name", "line", "end_line"), _KEY, "start_line", "start_end", "line", "end_line")
    met = met.where(F.expr("qualified = name or endswith(qualified, concat('.', name))"))
    best = F.row_number().over(Window.partitionBy(*_KEY, "start_line", "qualified").orderBy(F.col("end_line") - F.col("line"), F.desc("idx")))
    return met.withColumn("r", best).where("r = 1").select(*_KEY, "start_line", F.col("qualified").alias("name"), "idx")


@query(f"""WITH {_D}, h AS (SELECT DISTINCT repo, path, line_start AS a, line_end AS b FROM blame_regions WHERE author IS NULL)
SELECT d.repo, d.path, d.idx, CASE WHEN max(CASE WHEN d.line BETWEEN a AND b THEN 1 ELSE 0 END) = 0 THEN d.line + coalesce(sum(CASE WHEN b < d.line THEN a - b - 1 ELSE 0 END), 0) END AS moved FROM d LEFT JOIN h ON h.repo = d.repo AND h.path = d.path GROUP BY d.repo, d.path, d.idx, d.line""")
def moved_lines(spark, d):
    """Where declarations lie if the regions without an author are taken out."""
    h = table(spark, d, "blame_regions").where("author is null").select("repo", "path", F.col("line_start").alias("old_first"), F.col("line_end").alias("old_last")).distinct()
    h = h.withColumn("new_first", F.col("old_first")).withColumn("new_last", F.col("old_first") - 1)
    return P.moved_line(declared(spark, d).select(*_KEY, "idx", "line"), h, _KEY, "line").select(*_KEY, "idx", "moved")


_R = """r AS (SELECT DISTINCT r.agent, r.repo, r.file, total, greatest(least(coalesce(line_start, 1), coalesce(line_end, total)), 1) AS s, least(greatest(coalesce(line_start, 1), coalesce(line_end, total)), total) AS e
  FROM read_ranges r JOIN (SELECT agent, repo, file, max(total_lines) AS total FROM read_ranges GROUP BY agent, repo, file) USING (agent, repo, file) WHERE line_start IS NOT NULL OR line_end IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY agent, repo, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE s <= e)"""
_WHO = ["agent", "repo", "file"]


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select(*_WHO, "total", F.greatest("s", F.lit(1)).alias("s"), F.least("e", "total").alias("e")).where("s <= e")


@query(f"WITH {_R} SELECT agent, repo, file, max(total) AS total, sum(e - greatest(s, coalesce(before + 1, s)) + 1) FILTER (before IS NULL OR e > before) AS lines_read, round(sum(e - greatest(s, coalesce(before + 1, s)) + 1) FILTER (before IS NULL OR e > before) / max(total), 6) AS fraction FROM y GROUP BY agent, repo, file")
def read_coverage(spark, d):
    cut = _cut(spark, d)
    out = P.coverage(periods(cut, _WHO, "s", "e"), cut.select(*_WHO, "total").distinct(), _WHO, "total")
    return out.withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {_R}, g AS (SELECT agent, repo, file, min(s) AS first, min(before + 1) FILTER (s > before + 1) AS gap, max(e) AS last, max(total) AS total FROM y GROUP BY agent, repo, file) SELECT agent, repo, file, CASE WHEN first > 1 THEN 1 WHEN gap IS NOT NULL THEN gap WHEN last < total THEN last + 1 END AS first_unread FROM g")
def first_unread_line(spark, d):
    cut = _cut(spark, d)
    first = periods(cut, _WHO, "s", "e").groupBy(*_WHO).agg(F.min(F.struct("period_start", "period_end")).alias("p"))
    return first.join(cut.select(*_WHO, "total").distinct(), _WHO).select(*_WHO, F.when(F.col("p.period_start") > 1, F.lit(1)).when(F.col("p.period_end") < F.col("total"), F.col("p.period_end") + 1).alias("first_unread"))


@query(f"WITH {_R} SELECT DISTINCT agent, repo, file FROM y WHERE s <= 10 AND e >= 40")
def has_read(spark, d):
    return _cut(spark, d).where(P.holds(F.col("s"), F.col("e"), 10, 40)).select(*_WHO).distinct()


# references and dependencies

_FREE, _MEMBER = r"(?:^|[^A-Za-z0-9_.>:$])([A-Za-z_][A-Za-z0-9_]*)\(", r"([A-Za-z_][A-Za-z0-9_]*)(?:\.|->)([A-Za-z_][A-Za-z0-9_]*)\("
_SRC = f"{_F}, l AS (SELECT repo, path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL AND language IS NOT NULL)"
_REF = _SRC + f""", x AS (SELECT repo, path, language, line_no AS line, unnest(regexp_extract_all(line, '{_FREE}', 1)) AS name, 'Free' AS shape, CAST(NULL AS VARCHAR) AS receiver FROM l
 UNION ALL SELECT repo, path, language, line_no, unnest(regexp_extract_all(line, '{_MEMBER}', 2)), 'Member', unnest(regexp_extract_all(line, '{_MEMBER}', 1)) FROM l), ref AS (SELECT DISTINCT * FROM x)"""


def references(spark: SparkSession, d: str) -> DataFrame:
    """Calls in the source lines: of a bare name, or of a member with its receiver."""
    from ..operators.text import lines

    files = filed(spark, d).where("language is not null")
    rows = lines(files, ["repo", "path", "language"], "content").select("repo", "path", "language", F.col("line_no").alias("line"), F.col("line").alias("t"))
    free = rows.select("repo", "path", "language", "line", F.explode(F.regexp_extract_all("t", F.lit(_FREE), F.lit(1))).alias("name"), F.lit("Free").alias("shape"), F.lit(None).cast("string").alias("receiver"))
    pair = F.explode(F.arrays_zip(F.regexp_extract_all("t", F.lit(_MEMBER), F.lit(2)).alias("name"), F.regexp_extract_all("t", F.lit(_MEMBER), F.lit(1)).alias("receiver"))).alias("m")
    member = rows.select("repo", "path", "language", "line", pair).select("repo", "path", "language", "line", "m.name", F.lit("Member").alias("shape"), "m.receiver")
    return free.unionByName(member).distinct()


def located(spark: SparkSession, d: str) -> DataFrame:
    return declared(spark, d).join(filed(spark, d).select("repo", "path", "language"), _KEY).where("language is not null")


@query(f"WITH {_REF} SELECT repo, path, shape, count(*) AS n, count(DISTINCT name) AS names FROM ref GROUP BY repo, path, shape")
def reference_counts(spark, d):
    return references(spark, d).groupBy("repo", "path", "shape").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query(f"""WITH {_REF}, {_D}, a AS (SELECT repo, lower(name) AS symbol, count(DISTINCT path) AS n FROM d JOIN (SELECT repo, path FROM f WHERE language IS NOT NULL) USING (repo, path) GROUP BY ALL), u AS (SELECT repo, lower(name) AS symbol, count(DISTINCT path) AS n FROM ref GROUP BY ALL)
SELECT repo, symbol, coalesce(a.n, 0) AS defined_in, coalesce(u.n, 0) AS used_in FROM a FULL JOIN u USING (repo, symbol)""")
def symbol_index(spark, d):
    return R.symbol_counts(located(spark, d), references(spark, d))


_TYPES = "('class', 'struct', 'interface', 'enum', 'module', 'impl', 'trait', 'type')"
_CAND = f"""{_REF}, {_D}, dl AS (SELECT d.*, f.language AS lang FROM d JOIN f USING (repo, path) WHERE f.language IS NOT NULL),
cand AS (SELECT r.*, t.path AS target_path, t.idx AS target_idx, t.line AS target_line, r.path = t.path AS local FROM ref r JOIN dl t ON t.repo = r.repo AND lower(t.lang) = lower(r.language) AND lower(t.name) = lower(r.name)
 WHERE (CASE WHEN lower(r.language) = 'php' THEN true ELSE t.name = r.name END) AND t.kind <> 'property' AND (r.path = t.path OR coalesce(t.visibility > 0, true))
 AND CASE WHEN shape = 'Free' THEN t.kind <> 'method' AND (t.kind NOT IN {_TYPES} OR lower(r.language) IN ('python', 'ruby')) ELSE coalesce(t.kind = 'method' AND (lower(r.language) NOT IN ('php', 'rust') OR r.receiver IS NULL OR t.container = r.receiver), false) END)"""
_SITES = f"""{_CAND}, lo AS (SELECT *, sum(CAST(local AS INTEGER)) OVER w AS locals FROM cand WINDOW w AS (PARTITION BY repo, path, line, name, shape, receiver)),
ra AS (SELECT *, count(*) OVER (PARTITION BY repo, path, line, name, shape, receiver) AS n FROM lo WHERE shape <> 'Free' OR locals <> 1 OR local),
sites AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN local AND receiver IS NULL THEN 0 WHEN shape = 'Member' THEN 2 ELSE 1 END WHEN shape = 'Member' THEN 2 END AS confidence FROM ra)"""
_REFKEY = ["repo", "path", "line", "name", "shape", "receiver"]


@query(f"WITH {_CAND} SELECT repo, path, line, name, shape, receiver, target_path, target_idx FROM cand")
def reference_candidates(spark, d):
    return R.candidates(references(spark, d), located(spark, d)).select(*_REFKEY, "target_path", "target_idx")


def sites(spark: SparkSession, d: str) -> DataFrame:
    # kept: free names, members and the rest read the references once each
    return R.resolve_plain(stored(references(spark, d)), located(spark, d))


@query(f"WITH {_SITES} SELECT DISTINCT repo, path, line, name, target_path, target_line, min(confidence) AS confidence FROM sites WHERE confidence IS NOT NULL GROUP BY ALL")
def use_sites(spark, d):
    return R.unique_sites(sites(spark, d)).select("repo", "path", "line", "name", "target_path", "target_line", "confidence")


@query(f"WITH {_SITES} SELECT repo, target_path, target_idx, count(*) FILTER (confidence < 2) AS resolved, count(*) FILTER (confidence = 2) AS ambiguous FROM sites WHERE confidence IS NOT NULL GROUP BY ALL")
def caller_counts(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return sites(spark, d).groupBy("repo", "target_path", "target_idx").agg(n(F.col("confidence") < 2).alias("resolved"), n(F.col("confidence") == 2).alias("ambiguous"))


@query(f"WITH {_D} SELECT repo, path, idx, name, container FROM d WHERE lower(name) LIKE 'plan%' AND container IS NOT NULL")
def defines_symbol(spark, d):
    return declared(spark, d).where("lower(name) like 'plan%' and container is not null").select(*_KEY, "idx", "name", "container")


@query(f"WITH {_D}, q AS (SELECT DISTINCT coalesce(container || '::', '') || name AS q FROM d) SELECT q, CASE WHEN contains(q, '::') THEN regexp_extract(q, '^(.*)::', 1) ELSE regexp_extract(q, '^(.*)\\.', 1) END AS qualifier, regexp_extract(q, '[^.:]*$') AS name FROM q")
def qualified_names(spark, d):
    q = declared(spark, d).select(F.concat(F.coalesce(F.concat("container", F.lit("::")), F.lit("")), "name").alias("q")).distinct()
    return q.select("q", S.qualifier("q").alias("qualifier"), S.unqualified("q").alias("name"))


_IMPORT = r"^(?:require|import|from|use|const [A-Za-z0-9_]+ = require)[ (]+[''\"]?([A-Za-z0-9_./:\\]+)"
_EDGES = _SRC + f""", i AS (SELECT DISTINCT repo, path, ltrim(regexp_replace(regexp_extract(line, '{_IMPORT}', 1), '[.:/\\\\]+', '/', 'g'), '/') AS module FROM l WHERE regexp_matches(line, '{_IMPORT}')),
st AS (SELECT repo, path AS target, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) AS stem FROM f),
mt AS (SELECT i.repo, i.path, i.module, target, count(*) OVER (PARTITION BY i.repo, i.path, i.module) AS n FROM i JOIN st ON st.repo = i.repo AND st.stem = lower(regexp_extract(module, '[^/]*$')) WHERE target <> i.path),
edges AS (SELECT repo || ':' || target AS target, repo || ':' || path AS importer, min(CASE WHEN n = 1 THEN 1 ELSE 2 END) AS confidence, min(module) AS symbol FROM mt GROUP BY ALL)"""


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.text import lines

    pattern = _IMPORT.replace("''", "'")
    rows = lines(filed(spark, d).where("language is not null"), ["repo", "path"], "content").where(F.col("line").rlike(pattern))
    module = F.ltrim(F.regexp_replace(F.regexp_extract("line", pattern, 1), "[.:/\\\\]+", "/"), F.lit("/"))
    return rows.select("repo", "path", module.alias("module")).distinct()


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of imports to the files whose stem is the last part of the module: inferred if there is one such file, else ambiguous."""
    stems = filed(spark, d).select("repo", F.col("path").alias("to"), F.lower(S.stem("path")).alias("stem"))
    met = import_rows(spark, d).withColumn("stem", F.lower(S.tail("module"))).join(stems, ["repo", "stem"]).where("to <> path")
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("repo", "path", "module")))
    name = lambda c: F.concat_ws(":", "repo", c)
    return met.groupBy(name("to").alias("target"), name("path").alias("importer")).agg(F.min(F.when(F.col("n") == 1, 1).otherwise(2)).alias("confidence"), F.min("module").alias("symbol"))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def imports_resolved(spark, d):
    return import_edges(spark, d)


@query(f"WITH {_EDGES}, nodes AS (SELECT repo || ':' || path AS path FROM f) SELECT path, count(importer) AS imported_by FROM nodes LEFT JOIN (SELECT * FROM edges WHERE confidence < 2) e ON e.target = path GROUP BY path")
def importer_counts(spark, d):
    return G.importers(import_edges(spark, d), filed(spark, d).select(F.concat_ws(":", "repo", "path").alias("path")))


@query(f"WITH {_EDGES} SELECT importer AS path, count(*) AS imports FROM edges WHERE confidence < 2 GROUP BY importer")
def imports_per_file(spark, d):
    return G.imports(import_edges(spark, d))


@query(f"""WITH {_EDGES}, x AS (SELECT regexp_extract(target, '^(.*/)', 1) AS tf, regexp_extract(importer, '^(.*/)', 1) AS im, target, importer FROM edges WHERE confidence < 2), y AS (SELECT * FROM x WHERE tf <> im),
a AS (SELECT tf AS folder, count(DISTINCT importer) AS imported_by FROM y GROUP BY tf), b AS (SELECT im AS folder, count(DISTINCT target) AS imports, string_agg(DISTINCT tf, ',' ORDER BY tf) AS imported_folders FROM y GROUP BY im)
SELECT folder, coalesce(imported_by, 0) AS imported_by, coalesce(imports, 0) AS imports, coalesce(imported_folders, '') AS imported_folders FROM a FULL JOIN b USING (folder)""")
def folder_metrics(spark, d):
    e = import_edges(spark, d)
    nodes = e.select(F.explode(F.array("target", "importer")).alias("path")).distinct().withColumn("folder", F.regexp_extract("path", "^(.*/)", 1))
    return G.folder_edges(e, nodes).withColumn("imported_folders", F.array_join("imported_folders", ","))


_REACH = """, step AS (SELECT DISTINCT target AS a, importer AS b FROM edges {where}), s AS (SELECT a AS start, b AS node, 1 AS depth FROM step WHERE a <> b UNION SELECT s.start, step.b, s.depth + 1 FROM s JOIN step ON s.node = step.a WHERE s.depth < 3 AND step.b <> s.start),
reach AS (SELECT start, node, min(depth) AS depth FROM s GROUP BY start, node)"""


@query(f"WITH RECURSIVE {_EDGES}{_REACH.format(where='')} SELECT start, node, CAST(depth AS INTEGER) AS depth FROM reach")
def usages(spark, d):
    """Files that each imported file reaches against the direction of imports, within three steps."""
    e = import_edges(spark, d)
    return G.reachable(e, e.select("target").distinct(), 3)


@query(f"WITH RECURSIVE {_EDGES}{_REACH.format(where='').replace('target AS a, importer AS b', 'importer AS a, target AS b')} SELECT start, node, CAST(depth AS INTEGER) AS depth FROM reach")
def dependencies(spark, d):
    e = import_edges(spark, d)
    return G.reachable(e, e.select("importer").distinct(), 3, reverse=False)


@query(f"WITH RECURSIVE {_EDGES}{_REACH.format(where='WHERE confidence < 2')} SELECT start AS subject, count(*) FILTER (depth = 1) AS direct, count(*) AS transitive FROM reach GROUP BY start ORDER BY transitive DESC, direct DESC, subject DESC LIMIT 20")
def reach_ranking(spark, d):
    return G.ranked_by_reach(import_edges(spark, d), 3, 20)


_TREE_EDGES = f"{_D}, {_TREE.split(chr(10) + 'w AS')[0].rstrip(',')}, edges AS (SELECT repo || ':' || path || '#' || parent AS target, repo || ':' || path || '#' || idx AS importer, 0 AS confidence FROM k WHERE parent IS NOT NULL)"


@query(f"WITH RECURSIVE {_TREE_EDGES}{_REACH.format(where='')} SELECT start AS subject, count(*) FILTER (depth = 1) AS direct, count(*) AS transitive FROM reach GROUP BY start ORDER BY transitive DESC, direct DESC, subject DESC LIMIT 50")
def nesting_ranking(spark, d):
    """Declarations by how many others they hold, within three levels; loops never bring a declaration back to itself."""
    from ..operators.hierarchy import resolve_links

    k = resolve_links(table(spark, d, "declarations"), _KEY, "idx", "parent", "name", "container").where("_parent is not null")
    name = lambda c: F.concat(F.concat_ws(":", "repo", "path"), F.lit("#"), F.col(c))
    edges = k.select(name("_parent").alias("target"), name("_id").alias("importer"), F.lit(0).alias("confidence"), F.lit(None).cast("string").alias("symbol"))
    return G.ranked_by_reach(edges, 3, 50)


@query("""WITH x AS (SELECT repo || ':' || file AS target, agent AS importer, CASE WHEN line_start IS NULL THEN 2 WHEN line_end IS NULL THEN 1 ELSE 0 END AS confidence, CAST(total_lines AS VARCHAR) AS symbol, read_at FROM read_ranges),
o AS (SELECT *, row_number() OVER (PARTITION BY target, importer ORDER BY read_at, confidence, symbol NULLS FIRST) AS k FROM x), m AS (SELECT target, importer, min(confidence) AS confidence FROM o GROUP BY ALL),
b AS (SELECT m.target, m.importer, m.confidence, min(k) AS k FROM o JOIN m USING (target, importer, confidence) GROUP BY ALL)
SELECT b.target, b.importer, b.confidence, arg_min(o.symbol, o.k) FILTER (o.symbol IS NOT NULL) AS symbol FROM b JOIN o ON o.target = b.target AND o.importer = b.importer AND o.k >= b.k GROUP BY ALL""")
def strongest_edges(spark, d):
    r = table(spark, d, "read_ranges")
    rows = r.select(F.concat_ws(":", "repo", "file").alias("target"), F.col("agent").alias("importer"), F.when(F.col("line_start").isNull(), 2).when(F.col("line_end").isNull(), 1).otherwise(0).alias("confidence"), F.col("total_lines").cast("string").alias("symbol"), "read_at")
    return G.strongest(rows, "read_at")


@query(f"WITH {_EDGES}, n AS (SELECT target AS importer, count(*) AS their FROM edges WHERE confidence < 2 GROUP BY target) SELECT e.target, e.importer, coalesce(their, 0) AS their_importers FROM edges e LEFT JOIN n USING (importer)")
def importers_by_importance(spark, d):
    e = import_edges(spark, d)
    n = e.where("confidence < 2").groupBy(F.col("target").alias("importer")).agg(F.count("*").alias("their_importers"))
    return e.select("target", "importer").join(n, "importer", "left").withColumn("their_importers", F.coalesce("their_importers", F.lit(0)))


@query(f"WITH {_REF}, {_D} SELECT repo, lower(d.name) AS symbol, count(*) AS definitions, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(u.n) AS mentioned_in FROM d LEFT JOIN (SELECT repo, lower(name) AS s, count(DISTINCT path) AS n FROM ref GROUP BY ALL) u ON u.s = lower(d.name) AND u.repo = d.repo GROUP BY d.repo, repo, symbol".replace("SELECT repo, lower(d.name)", "SELECT d.repo, lower(d.name)").replace("GROUP BY d.repo, repo, symbol", "GROUP BY d.repo, symbol"))
def signposts(spark, d):
    """What is known of every declared name: definitions, kinds and the number of files that mention it."""
    u = references(spark, d).groupBy("repo", F.lower("name").alias("symbol")).agg(F.countDistinct("path").alias("mentioned_in"))
    a = declared(spark, d).groupBy("repo", F.lower("name").alias("symbol")).agg(F.count("*").alias("definitions"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return a.join(u, ["repo", "symbol"], "left")


@query(f"WITH {_F}, p AS (SELECT * FROM (VALUES ('src', 1), ('src/util', 2), ('lib', 3), ('app/compat', 4)) p(prefix, root)), j AS (SELECT f.repo, f.path, prefix, root, row_number() OVER (PARTITION BY f.repo, f.path ORDER BY length(prefix) DESC) AS r FROM f JOIN p ON starts_with(f.path, prefix || '/')) SELECT f.repo, f.path, j.prefix, j.root FROM f LEFT JOIN j ON j.repo = f.repo AND j.path = f.path AND r = 1")
def longest_prefix_roots(spark, d):
    p = spark.createDataFrame([("src", 1), ("src/util", 2), ("lib", 3), ("app/compat", 4)], "prefix string, root int")
    files = filed(spark, d).select("repo", "path")
    return R.longest_prefix(files.withColumn("dir", F.regexp_extract("path", "^(.*)/", 1)), "dir", p).select("repo", "path", "prefix", "root")


@query(f"WITH {_EDGES}, md AS (SELECT repo, regexp_replace(path, '\\.[^./]*$', '') AS long, path AS target_path FROM f), s AS (SELECT i.repo, i.path, i.module, target_path FROM i JOIN md ON md.repo = i.repo AND ends_with(long, '/' || module)) SELECT repo, path, module, target_path, CASE WHEN count(*) OVER (PARTITION BY repo, path, module) = 1 THEN 1 ELSE 2 END AS confidence FROM s")
def imports_by_suffix(spark, d):
    m = filed(spark, d).select("repo", F.regexp_replace("path", "\\.[^./]*$", "").alias("module"), F.col("path").alias("target_path"))
    return R.named_imports(import_rows(spark, d), m)


# snapshots

@query(f"WITH {_M}, l AS (SELECT repo, path, measured_on, max(complexity) AS c FROM m GROUP BY ALL), a AS (SELECT repo, path, arg_max(c, measured_on) AS c, 1 AS x FROM l WHERE measured_on < DATE '2024-07-01' GROUP BY ALL), b AS (SELECT repo, path, arg_max(c, measured_on) AS c, 1 AS x FROM l WHERE measured_on >= DATE '2024-07-01' GROUP BY ALL) SELECT repo, path, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.c IS NOT DISTINCT FROM b.c THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (repo, path)".replace("arg_max(c, measured_on)", "arg_max_null(c, measured_on)"))
def snapshot_diff(spark, d):
    l = table(spark, d, "metrics").groupBy("repo", "path", "measured_on").agg(F.max("complexity").alias("c"))  # noqa: E741
    side = lambda x: l.where(x).groupBy("repo", "path").agg(F.max_by("c", "measured_on").alias("c"))
    return N.keyed_diff(side("measured_on < date'2024-07-01'"), side("measured_on >= date'2024-07-01'"), _KEY, ["c"])


_LI = "l_shipdate, l_linenumber, l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax"


@query(f"WITH o AS (SELECT l_partkey, l_suppkey, l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_linestatus ORDER BY {_LI}) - 1 AS ordinal FROM lineitem), a AS (SELECT *, 1 AS x FROM o WHERE l_linestatus = 'F'), b AS (SELECT *, 1 AS x FROM o WHERE l_linestatus = 'O') SELECT l_partkey, l_suppkey, ordinal, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.l_quantity = b.l_quantity THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (l_partkey, l_suppkey, ordinal)")
def ordinal_diff(spark, d):
    """Rows without a key of their own, matched by place among equal keys."""
    k = ["l_partkey", "l_suppkey"]
    o = N.with_ordinal(table(spark, d, "lineitem"), [*k, "l_linestatus"], _LI.split(", "))
    return N.keyed_diff(o.where("l_linestatus = 'F'"), o.where("l_linestatus = 'O'"), [*k, "ordinal"], ["l_quantity"])


@query(f"WITH {_D}, a AS (SELECT DISTINCT name, kind FROM d WHERE visibility >= 3 AND starts_with(path, 'src/')), b AS (SELECT DISTINCT name, kind FROM d WHERE visibility >= 3 AND NOT starts_with(path, 'src/')) SELECT 'only_src' AS side, name, kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'shared', name, kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def export_sets(spark, d):
    x = declared(spark, d).where("visibility >= 3")
    a, b = x.where(F.col("path").startswith("src/")).select("name", "kind").distinct(), x.where(~F.col("path").startswith("src/")).select("name", "kind").distinct()
    side = lambda df, s: df.select(F.lit(s).alias("side"), "name", "kind")
    return side(a.subtract(b), "only_src").unionByName(side(a.intersect(b), "shared"))


@query(f"WITH {_D} SELECT repo, path, name, kind, min(idx) AS place, arg_max(line, idx) AS line FROM d GROUP BY repo, path, name, kind")
def duplicate_names(spark, d):
    return N.last_of(declared(spark, d), [*_KEY, "name", "kind"], "idx", "line")


_OFFER = "agent, repo, file, read_at, loaded_at, line_start, line_end, total_lines"


@query(f"WITH r AS (SELECT DISTINCT {_OFFER} FROM read_ranges), w AS (SELECT *, lag(total_lines) OVER o AS b, row_number() OVER o AS k FROM r WINDOW o AS (PARTITION BY agent, repo, file ORDER BY read_at, loaded_at, line_start NULLS FIRST, line_end NULLS FIRST, total_lines NULLS FIRST)) SELECT agent, repo, file, CASE WHEN k = 1 THEN 'New' WHEN b IS NOT DISTINCT FROM total_lines THEN 'Same' ELSE 'Changed' END AS offer, count(*) AS n FROM w GROUP BY ALL")
def shown_before(spark, d):
    r = table(spark, d, "read_ranges").select(*_OFFER.split(", ")).distinct()
    return N.shown(r, _WHO, _OFFER.split(", ")[3:], "total_lines").groupBy(*_WHO, "offer").agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT DISTINCT {_OFFER} FROM read_ranges), w AS (SELECT *, CASE WHEN row_number() OVER o > 1 AND lag(total_lines) OVER o IS DISTINCT FROM total_lines THEN 1 ELSE 0 END AS m FROM r WINDOW o AS (PARTITION BY agent, repo, file ORDER BY read_at, loaded_at, line_start NULLS FIRST, line_end NULLS FIRST, total_lines NULLS FIRST)) SELECT agent, repo, file, sum(m) + 1 AS epochs FROM w GROUP BY ALL")
def coverage_epochs(spark, d):
    r = table(spark, d, "read_ranges").select(*_OFFER.split(", ")).distinct()
    return N.epochs(r, _WHO, _OFFER.split(", ")[3:], "total_lines").groupBy(*_WHO).agg((F.max("epoch") + 1).alias("epochs"))


@query("WITH c AS (SELECT repo, commit_date AS day, list_sort(list(DISTINCT author) FILTER (author IS NOT NULL)) AS who FROM commits GROUP BY ALL), b AS (SELECT *, first_value(who) OVER (PARTITION BY repo ORDER BY day) AS base FROM c) SELECT repo, CAST(day AS VARCHAR) AS day, array_to_string(list_sort([x FOR x IN coalesce(who, []) IF NOT list_contains(coalesce(base, []), x)]), ',') AS gained, array_to_string(list_sort([x FOR x IN coalesce(base, []) IF NOT list_contains(coalesce(who, []), x)]), ',') AS lost FROM b")
def baseline_delta(spark, d):
    """Authors of each day against those of the repository's first day."""
    c = table(spark, d, "commits").groupBy("repo", F.col("commit_date").alias("day")).agg(F.array_sort(F.collect_set("author")).alias("who"))
    return N.baseline_delta(c, ["repo"], ["day"], "who").select("repo", F.col("day").cast("string").alias("day"), F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


@query(f"WITH {_D}, a AS (SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY repo, path, idx) - 1 AS k FROM d WHERE kind = 'class'), b AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY repo, path, idx) - 1 AS k FROM d WHERE kind <> 'class') SELECT b.name, count(*) AS left_over FROM b LEFT JOIN a ON a.name = b.name AND a.k = b.k WHERE a.name IS NULL GROUP BY b.name")
def unmatched_rows(spark, d):
    x = declared(spark, d).withColumn("place", F.concat_ws("/", "repo", "path", F.lpad(F.col("idx"), 9, "0")))
    return N.unmatched(x.where("kind = 'class'").select("name", "place"), x.where("kind <> 'class'").select("name", "place"), ["name"], "place").groupBy("name").agg(F.count("*").alias("left_over"))


@query(f"WITH {_REF}, {_D} SELECT DISTINCT ref.repo, ref.path FROM ref WHERE name IN (SELECT name FROM d WHERE visibility = 0)")
def affected_files(spark, d):
    """Files that mention a name of those that are local to some file: what a change of these names touches."""
    return N.affected(references(spark, d), _KEY, declared(spark, d).where("visibility = 0"))


@query(f"WITH {_D}, j AS (SELECT a.repo, a.path, a.idx, b.idx AS inside, row_number() OVER (PARTITION BY a.repo, a.path, a.idx ORDER BY b.end_line - b.line, b.idx DESC) AS r FROM d a JOIN d b ON a.repo = b.repo AND a.path = b.path AND b.idx <> a.idx AND b.line <= a.line AND b.end_line >= a.end_line AND a.line <= a.end_line AND (b.end_line - b.line > a.end_line - a.line OR b.idx < a.idx)) SELECT d.repo, d.path, d.idx, j.inside FROM d LEFT JOIN j ON j.repo = d.repo AND j.path = d.path AND j.idx = d.idx AND r = 1")
def nesting_by_lines(spark, d):
    """The declaration around each declaration, by lines alone."""
    return P.nest(declared(spark, d).select(*_KEY, "idx", "line", "end_line"), _KEY, "idx", "line", "end_line").select(*_KEY, "idx", "inside")


@query(f"WITH {_REF}, {_D}, b AS (SELECT repo, path, name, idx, line AS first, end_line AS last FROM d), j AS (SELECT r.repo, r.path, r.name, r.line, b.idx, row_number() OVER (PARTITION BY r.repo, r.path, r.name, r.line ORDER BY b.last - b.first, b.idx DESC) AS k FROM (SELECT DISTINCT repo, path, name, line FROM ref) r JOIN b ON b.repo = r.repo AND b.path = r.path AND b.name = r.name AND r.line BETWEEN b.first AND b.last) SELECT repo, path, name, line, idx FROM j WHERE k = 1")
def bindings_in_force(spark, d):
    """The innermost block that binds a name where it is used."""
    uses = references(spark, d).select(*_KEY, "name", "line").distinct()
    blocks = declared(spark, d).select(*_KEY, "name", "idx", F.col("line").alias("first"), F.col("end_line").alias("last"))
    return P.innermost(uses, blocks, [*_KEY, "name"], "line", "first", "last", "idx", [*_KEY, "name", "line"]).select(*_KEY, "name", "line", "idx")


@query("SELECT repo, count(*) AS entries, sum(octet_length(encode(content))) AS bytes FROM (SELECT DISTINCT repo, path, content FROM files) GROUP BY repo")
def stored_sizes(spark, d):
    f = table(spark, d, "files").select("repo", "path", "content").distinct()
    return f.groupBy("repo").agg(F.count("*").alias("entries"), F.sum(F.octet_length("content")).alias("bytes"))


@query()
def python_functions(spark, d):
    """Functions of the Python files with their complexity, by parsing."""
    from ..operators.extract import extracted, relation

    files = filed(spark, d).where(F.coalesce(F.col("language") == "python", F.lit(False)) | F.col("path").endswith(".py"))
    return relation(extracted(files, _KEY), _KEY, "functions")


QUERIES, SQL = query.queries, query.sql
