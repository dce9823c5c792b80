"""Listings, revisions, resolution by imports, budgets and reports: the operators that the other plans do not show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import docs as D, graph as G, history as H, modules as M, resolve as R, snapshot as N, spans as P, stats as A
from ..runtime import shared_dir
from ..sources import repository as Y, sinks as K
from ..sources.tables import table
from .code import _D, _EDGES, _F, _KEY, _REF, _SITES, _SRC, _TREE, declared, filed, import_edges, import_rows, located, references, sites, tree_of
from .history import _H, changes, commits
from .registry import Registry

query = Registry()
_NOW = "2024-12-31"
#: What _EDGES adds to the lines of the sources.
_LINKS = _EDGES[len(_SRC):]


def _node(c: str) -> F.Column:
    return F.concat_ws(":", "repo", c)


# listings and revisions

@query(f"""WITH {_H}, n AS (SELECT DISTINCT repo || '/' || path AS path, substring(status, 1, 1) AS s FROM x WHERE pos < 50), l AS (SELECT DISTINCT repo || '/' || path AS path FROM files)
SELECT path FROM (SELECT path FROM l UNION SELECT path FROM n WHERE s = 'A') WHERE path NOT IN (SELECT path FROM n WHERE s = 'D')""")
def tracked_files(spark, d):
    """The listing with what the newest 50 commits added and without what they deleted."""
    path = F.concat_ws("/", "repo", "path").alias("path")
    new = changes(spark, d).where("pos < 50").select(path, F.substring("status", 1, 1).alias("s")).distinct()
    return Y.tracked(table(spark, d, "files").select(path), new.where("s = 'A'"), new.where("s = 'D'"))


@query("SELECT DISTINCT repo AS folder FROM files")
def nested_repositories(spark, d):
    """Folders that hold a repository of their own, from a listing that shows their private files too."""
    return Y.nested_repositories(table(spark, d, "files").select(F.concat_ws("/", "repo", F.lit(".git"), "path").alias("path")))


@query(f"""WITH {_H} SELECT DISTINCT repo, commit_id, substring(status, 1, 1) AS status, path, CASE WHEN substring(status, 1, 1) IN ('R', 'C') THEN coalesce(from_path, '') END AS from_path, CAST(commit_date AS VARCHAR) AS day, coalesce(author, '') AS author FROM x WHERE status IS NOT NULL AND commit_date IS NOT NULL""")
def commit_log(spark, d):
    """Commits and changes written as a raw log, one change a record, and read again."""
    x = changes(spark, d).where("status is not null and commit_date is not null")
    z, s = F.lit("\u0000"), F.substring("status", 1, 1)
    none = F.lit("")
    paths = F.when(s.isin("R", "C"), F.concat(F.coalesce("from_path", none), z, F.col("path"))).otherwise(F.col("path"))
    head = F.concat(F.lit("\u0001"), F.col("commit_id"), z, F.col("commit_date").cast("string"), z, F.coalesce("author", none), z, F.coalesce("subject", none), z, F.lit("p1"))
    value = F.concat(head, z, F.lit(":100644 100644 "), F.coalesce("old_blob", F.lit("0000")), F.lit(" "), F.coalesce("new_blob", F.lit("0000")), F.lit(" "), s, z, paths)
    raw = x.select("repo", value.alias("value"))
    log, change = Y.commit_log(raw)
    who = log.select("repo", "commit_id", F.col("commit_date").cast("string").alias("day"), "author").distinct()
    return change.select("repo", "commit_id", "status", "path", "from_path").distinct().join(who, ["repo", "commit_id"])


@query(f"""WITH {_H}, w AS (SELECT DISTINCT path, from_path, substring(status, 1, 1) AS s, seq % 3 AS k FROM x WHERE pos = 0 AND status IS NOT NULL)
SELECT DISTINCT path, CASE WHEN s IN ('R', 'C') THEN 'renamed' WHEN s = 'A' THEN 'added' WHEN s = 'D' THEN 'deleted' ELSE 'modified' END AS state, CASE k WHEN 0 THEN 'staged' WHEN 1 THEN 'unstaged' ELSE 'both' END AS staging, CASE WHEN s IN ('R', 'C') THEN from_path END AS from_path FROM w WHERE s NOT IN ('R', 'C') OR from_path IS NOT NULL""")
def working_tree(spark, d):
    """The newest commit of each repository as the lines of a status listing, read."""
    w = changes(spark, d).where("pos = 0 and status is not null").select("path", "from_path", F.substring("status", 1, 1).alias("s"), (F.col("seq") % 3).alias("k")).distinct()
    w = w.where("s not in ('R', 'C') or from_path is not null")
    xy = F.when(F.col("k") == 0, F.concat("s", F.lit(" "))).when(F.col("k") == 1, F.concat(F.lit(" "), "s")).otherwise(F.concat("s", "s"))
    to = F.when(F.col("s").isin("R", "C"), F.concat("from_path", F.lit(" -> "), "path")).otherwise(F.col("path"))
    return Y.porcelain(w.select(F.concat(xy, F.lit(" "), to).alias("value"))).distinct()


@query("""WITH m AS (SELECT DISTINCT measured_on AS day FROM metrics WHERE measured_on IS NOT NULL), n AS (SELECT 'app-' || CAST(day AS VARCHAR) || '.log' AS name, day FROM m UNION SELECT 'app.' || strftime(day, '%Y%m%d') || '.log.gz', day FROM m UNION SELECT 'app-9' || strftime(day, '%Y%m%d') || '.log', CAST(NULL AS DATE) FROM m)
SELECT name, CAST(day AS VARCHAR) AS day, day IS NULL OR day BETWEEN DATE '2024-03-01' AND DATE '2024-06-30' AS opened FROM n""")
def log_files_by_date(spark, d):
    """Log files of which a window of time needs to open only some, by the date in the name; those without one are opened."""
    m = table(spark, d, "metrics").select(F.col("measured_on").alias("day")).where("day is not null").distinct()
    short = F.date_format("day", "yyyyMMdd")
    names = F.array(F.concat(F.lit("app-"), F.col("day").cast("string"), F.lit(".log")), F.concat(F.lit("app."), short, F.lit(".log.gz")), F.concat(F.lit("app-9"), short, F.lit(".log")))
    n = m.select(F.explode(names).alias("name")).distinct().withColumn("date", S.date_in_name("name"))
    since, until = (F.lit(S.window_bound(x, "2024-01-01", e)).cast("timestamp_ntz").cast("date") for x, e in (("2024-03-01", False), ("2024-06-30 12:00", True)))
    return n.select("name", F.col("date").cast("string").alias("day"), (F.col("date").isNull() | F.col("date").between(since, until)).alias("opened"))


@query(f"""WITH {_H}, b AS (SELECT repo, path, arg_min(status, (pos, seq)) AS status, arg_min(coalesce(new_blob, ''), (pos, seq)) AS blob FROM x WHERE pos >= 50 GROUP BY repo, path) SELECT repo, path, nullif(blob, '') AS blob FROM b WHERE status NOT LIKE 'D%'""")
def blobs_at_revision(spark, d):
    """What each path holds as of the 50th newest commit."""
    return H.blobs_at(changes(spark, d), 50)


@query(f"""WITH {_H}, {_F}, b AS (SELECT repo, path, arg_min(status, (pos, seq)) AS status FROM x WHERE pos >= 50 GROUP BY repo, path), l AS (SELECT f.repo, f.path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f JOIN b ON b.repo = f.repo AND b.path = f.path WHERE content IS NOT NULL AND status NOT LIKE 'D%')
SELECT repo, path, line_no FROM l WHERE regexp_matches(line, 'return .*;')""")
def grep_of_revision(spark, d):
    """A search of the tree of an older commit."""
    from ..operators.text import lines, matches

    there = H.blobs_at(changes(spark, d), 50).select("repo", "path")
    return lines(filed(spark, d).join(there, _KEY, "left_semi"), _KEY, "content").where(matches("line", "return .*;")).select(*_KEY, "line_no")


@query("""SELECT DISTINCT repo, path FROM files WHERE starts_with(path, 'src/') OR ends_with(path, '.go')""")
def overlapping_bases(spark, d):
    """Two bases that overlap give each file once."""
    f = table(spark, d, "files").select("repo", "path")
    return f.where(S.under("path", "src")).union(f.where(F.col("path").endswith(".go"))).distinct()


@query("""WITH f AS (SELECT DISTINCT repo, path FROM files), a AS (SELECT * FROM (VALUES ('src'), ('lib'), ('nowhere')) v(folder)) SELECT a.folder, f.repo, f.path FROM a LEFT JOIN f ON starts_with(f.path, a.folder || '/')""")
def files_under(spark, d):
    """Folders as arguments: their files, and a row without a file for a folder that is not there."""
    return D.under(table(spark, d, "files").select("repo", "path").distinct(), ["src", "lib", "nowhere"])


@query("""WITH f AS (SELECT DISTINCT repo, path, regexp_extract(path, '^(.*)/', 1) AS folder FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY repo, folder ORDER BY path) AS k, count(*) OVER (PARTITION BY repo, folder) AS total FROM f) SELECT repo, folder, path, total FROM r WHERE k <= 40""")
def folder_entries(spark, d):
    """The first 40 files of each folder and how many there are."""
    f = table(spark, d, "files").select("repo", "path").distinct().withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    total = f.groupBy("repo", "folder").agg(F.count("*").alias("total"))
    first = f.withColumn("k", F.row_number().over(Window.partitionBy("repo", "folder").orderBy("path"))).where("k <= 40").drop("k")
    return first.join(total, ["repo", "folder"]).select("repo", "folder", "path", "total")


# scalars

@query(f"""WITH {_F}, {_D} SELECT DISTINCT d.repo, d.path, d.idx, CASE WHEN language = 'python' THEN replace(regexp_replace(d.path, '\\.[^./]*$', ''), '/', '.') ELSE regexp_replace(d.path, '\\.[^./]*$', '') END || '::' || d.name AS symbol, regexp_full_match(d.name, '[A-Za-z_][A-Za-z0-9_]+') AS bare, greatest(d.idx % 3, 1) AS weaker,
 CASE d.idx % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS label, CASE WHEN cc < 10 THEN '·' WHEN cc < 30 THEN '•' WHEN cc < 80 THEN '●' WHEN cc IS NOT NULL THEN '⚠' ELSE '?' END AS marker FROM d JOIN f USING (repo, path)""")
def scalar_symbols(spark, d):
    j = declared(spark, d).join(filed(spark, d).select(*_KEY, F.coalesce("language", F.lit("")).alias("language"), "cc"), _KEY)
    of3 = F.col("idx") % 3
    return j.select(*_KEY, "idx", S.symbol_id("path", "language", "name").alias("symbol"), S.bare_name("name").alias("bare"), S.weaker(of3, F.lit(1)).alias("weaker"), S.confidence_label(of3).alias("label"), S.rank_marker(S.rank_bucket("cc")).alias("marker"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|`[^`\\n]*`|<!--.*?-->|<[a-zA-Z/][^>]*>', ' ', 'g'), '(?:^|\\s)@((?:~|\\.{1,2})?/?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)', 1))), ',') AS mentions,
 length(regexp_replace(text, '^---\\r?\\n(?s:.*?)\\n---[ \\t]*\\r?\\n', '')) AS body FROM documents WHERE text IS NOT NULL""")
def document_mentions(spark, d):
    """Paths that texts take in with @path, and the length of what follows the front matter."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.array_join(F.array_sort(D.mentions(F.col("text"))), ",").alias("mentions"), F.length(D.body(F.col("text"))).alias("body"))


@query("""WITH p AS (SELECT DISTINCT path FROM file_changes WHERE path IS NOT NULL), n AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name FROM p) SELECT path, CASE WHEN regexp_matches(name, '^readme') THEN 'readme' WHEN regexp_matches(name, '^(changelog|changes|history)') THEN 'changelog' WHEN regexp_matches(name, '^(license|licence|copying)') THEN 'licence' WHEN starts_with(name, 'contributing') THEN 'contributing' WHEN regexp_matches(name, '\\.(md|mdx|rst|adoc|txt)$') THEN 'document' END AS kind FROM n""")
def document_kinds(spark, d):
    return table(spark, d, "file_changes").select("path").where("path is not null").distinct().select("path", D.kind("path").alias("kind"))


@query("""WITH c AS (SELECT DISTINCT commit_id, repo, subject, commit_date FROM commits WHERE commit_date IS NOT NULL), g AS (SELECT '---' || chr(10) || 'paths:' || chr(10) || '  - ' || repo || '/**' || chr(10) || '  - "' || commit_id || '"' || chr(10) || '---' || chr(10) || 'x' AS text, commit_id, repo FROM c) SELECT commit_id, repo || '/**,' || commit_id AS globs FROM g""")
def front_matter_globs(spark, d):
    """The globs of a rule's front matter."""
    c = table(spark, d, "commits").where("commit_date is not null").select("commit_id", "repo").distinct()
    text = F.concat(F.lit("---\npaths:\n  - "), F.col("repo"), F.lit('/**\n  - "'), F.col("commit_id"), F.lit('"\n---\nx'))
    return c.select("commit_id", F.array_join(D.front_globs(text), ",").alias("globs"))


# resolution

@query(f"""WITH {_SITES}{_LINKS}, fn AS (SELECT d.repo, d.path AS target_path, d.idx AS target_idx FROM d JOIN f USING (repo, path) WHERE d.kind IN ('function', 'class') AND f.language IS NOT NULL),
u AS (SELECT s.repo, s.target_path, s.target_idx, s.path, s.line, min(confidence) AS confidence FROM sites s WHERE confidence IS NOT NULL GROUP BY ALL), m AS (SELECT fn.*, u.path, u.line, u.confidence FROM fn JOIN u USING (repo, target_path, target_idx)),
im AS (SELECT fn.*, substring(e.importer, length(fn.repo) + 2) AS path, CAST(NULL AS INTEGER) AS line, e.confidence FROM fn JOIN edges e ON e.target = fn.repo || ':' || fn.target_path WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.repo = fn.repo AND u.target_path = fn.target_path AND u.target_idx = fn.target_idx))
SELECT * FROM m UNION ALL SELECT * FROM im""")
def callers_with_importers(spark, d):
    """Who calls each function or class; for those that nobody calls, who imports their file."""
    asked = located(spark, d).where("kind in ('function', 'class')").select("repo", F.col("path").alias("target_path"), F.col("idx").alias("target_idx"))
    used = sites(spark, d).groupBy("repo", "target_path", "target_idx", "path", "line").agg(F.min("confidence").alias("confidence"))
    edges = import_edges(spark, d).select(F.regexp_extract("target", "^([^:]*):", 1).alias("repo"), F.regexp_extract("target", "^[^:]*:(.*)$", 1).alias("target_path"), F.regexp_extract("importer", "^[^:]*:(.*)$", 1).alias("path"), "confidence")
    return R.callers(asked.join(used, ["repo", "target_path", "target_idx"], "left"), edges)


@query(f"""WITH {_REF}{_LINKS.split(',' + chr(10) + 'st AS')[0]}, b AS (SELECT DISTINCT repo, path, regexp_extract(module, '[^./:]*$') AS name FROM i) SELECT ref.repo, ref.path, ref.line, ref.name, ref.shape, ref.receiver FROM ref LEFT JOIN b USING (repo, path, name) WHERE b.name IS NULL""")
def references_not_bound(spark, d):
    """References to names that the file does not bind to something outside."""
    bound = import_rows(spark, d).select("repo", "path", S.tail("module").alias("name"))
    return R.without_external(references(spark, d), bound).select("repo", "path", "line", "name", "shape", "receiver")


_TOUCHED = "tb AS (SELECT DISTINCT repo, path, line_start, line_end FROM blame_regions), td AS (SELECT DISTINCT d.repo, d.path, d.idx FROM tb JOIN d ON d.repo = tb.repo AND d.path = tb.path AND d.line <= tb.line_end AND tb.line_start <= d.end_line WHERE d.kind IN ('function', 'method'))"


@query(f"""WITH {_SITES}, {_TOUCHED} SELECT DISTINCT s.repo, s.target_path, s.target_idx, s.path, s.line FROM sites s JOIN td ON td.repo = s.repo AND td.path = s.target_path AND td.idx = s.target_idx WHERE confidence < 2""")
def callers_of_touched(spark, d):
    """Who calls the functions that regions of the reports touch."""
    b = table(spark, d, "blame_regions").select(*_KEY, "line_start", "line_end").distinct()
    f = declared(spark, d).where("kind in ('function', 'method')").select(*_KEY, "idx", "line", "end_line")
    touched = P.overlapping(b, f, _KEY, "line_start", "line_end", "line", "end_line").select("repo", F.col("path").alias("target_path"), F.col("idx").alias("target_idx")).distinct()
    return sites(spark, d).where("confidence < 2").join(touched, ["repo", "target_path", "target_idx"], "left_semi").select("repo", "target_path", "target_idx", "path", "line").distinct()


@query(f"""WITH {_SITES}, q AS (SELECT s.*, k.kind, count(*) OVER (PARTITION BY s.repo, s.path, s.line) AS c FROM sites s JOIN d k ON k.repo = s.repo AND k.path = s.target_path AND k.idx = s.target_idx WHERE confidence < 2) SELECT repo, path, line, target_path, target_idx FROM q WHERE c = 1 AND kind IN ('function', 'method')""")
def resolved_lines(spark, d):
    """Lines that call one function and nothing else that is known."""
    return M.resolved_at(sites(spark, d))


@query(f"""WITH {_REF}, {_D}{_LINKS.split(',' + chr(10) + 'st AS')[0]}, w AS (SELECT DISTINCT repo, regexp_extract(module, '[^./:]*$') AS name FROM i), m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo = w.repo AND d.name = w.name)) SELECT DISTINCT m.repo, m.name, f.path FROM m JOIN f ON f.repo = m.repo AND lower(regexp_replace(regexp_extract(f.path, '[^/]*$'), '\\.[^.]*$', '')) = lower(m.name)""")
def modules_named(spark, d):
    """Files named like an imported module that nothing declares."""
    names = import_rows(spark, d).select("repo", S.tail("module").alias("name")).distinct()
    return M.stems_named(names, filed(spark, d), declared(spark, d))


_MODULES = r"""i AS (SELECT DISTINCT repo, path, lower(language) AS language, regexp_extract(line, '^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)\.([A-Za-z0-9_]+)\s*;', 1) AS module, regexp_extract(line, '^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)\.([A-Za-z0-9_]+)\s*;', 2) AS symbol FROM l WHERE lower(language) = 'java' AND regexp_matches(line, '^\s*import\s+(?:static\s+)?[A-Za-z0-9_.]+\.[A-Za-z0-9_]+\s*;')),
nm AS (SELECT repo, path AS target_path, unnest([regexp_replace(path, '\.[^./]*$', ''), path]) AS name FROM f WHERE lower(language) = 'java'),
wn AS (SELECT *, replace(module || '.' || symbol, '.', '/') AS n0, replace(module, '.', '/') AS n1 FROM i),
mt AS (SELECT wn.*, target_path, CASE WHEN name = n0 THEN 0 WHEN ends_with(name, '/' || n0) THEN 1 WHEN name = n1 THEN 2 ELSE 3 END AS p FROM wn JOIN nm ON nm.repo = wn.repo AND (name = n0 OR ends_with(name, '/' || n0) OR name = n1 OR ends_with(name, '/' || n1)) WHERE target_path <> path),
bs AS (SELECT repo, path, module, symbol, min(p) AS p FROM mt GROUP BY ALL), ok AS (SELECT DISTINCT repo, path, module, symbol, target_path FROM mt JOIN bs USING (repo, path, module, symbol, p)),
dn AS (SELECT DISTINCT d.repo, d.name, d.path AS target_path FROM d JOIN f USING (repo, path) WHERE lower(f.language) = 'java'),
fb AS (SELECT i.repo, i.path, i.module, i.symbol, dn.target_path FROM i JOIN dn ON dn.repo = i.repo AND dn.name = i.symbol WHERE dn.target_path <> i.path AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.repo = i.repo AND ok.path = i.path AND ok.module = i.module AND ok.symbol = i.symbol)),
al AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 0 ELSE 2 END AS confidence FROM ok WINDOW w AS (PARTITION BY repo, path, module, symbol) UNION ALL SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE 2 END FROM fb WINDOW w AS (PARTITION BY repo, path, module, symbol))"""


@query(f"""WITH {_REF}, {_D}, {_MODULES} SELECT al.repo, al.path, al.module, al.symbol, al.target_path, CAST(al.confidence AS INTEGER) AS confidence, dn.name AS named FROM al LEFT JOIN dn ON dn.repo = al.repo AND dn.name = al.symbol AND dn.target_path = al.target_path""")
def imports_of_java(spark, d):
    """Imports of the Java files, as extracted from their texts, to the files they mean."""
    from ..operators.extract import extracted, relation

    files = filed(spark, d).where("lower(language) = 'java'")
    rows = relation(extracted(files, [*_KEY, "language"], language="language", path="path"), [*_KEY, "language"], "imports").where("symbol is not null")
    return M.resolved(rows, filed(spark, d), located(spark, d)).select("repo", "path", "module", "symbol", "target_path", "confidence", "named")


@query(f"""WITH {_F}, {_D}, s AS (SELECT DISTINCT repo, path, name, trim(unnest(string_split(regexp_extract(regexp_replace(header, '<[^<>]*>', '', 'g'), '\\bextends\\s+([^{{]*?)(?:\\bimplements\\b|\\{{|$)', 1) || ',' || regexp_extract(regexp_replace(header, '<[^<>]*>', '', 'g'), '\\bimplements\\s+([^{{]*)', 1) || ',' || regexp_extract(regexp_replace(header, '<[^<>]*>', '', 'g'), '^\\s*class\\s+\\w+\\s*\\(([^)]*)\\)\\s*:', 1) || ',' || regexp_extract(regexp_replace(header, '<[^<>]*>', '', 'g'), '^\\s*class\\s+\\w+\\s*<\\s*([\\w:]+)', 1), ','))) AS supertype FROM d WHERE kind IN ('class', 'interface', 'trait', 'struct', 'enum')) SELECT repo, path, name, supertype FROM s WHERE supertype <> ''""")
def supertypes(spark, d):
    """The types that types extend or implement, by their heads."""
    return M.supertypes(declared(spark, d)).select("repo", "path", "name", "supertype").distinct()


_UP = f"""{_D}, hc AS (SELECT DISTINCT repo, name AS type, container AS supertype FROM d WHERE container IS NOT NULL AND container <> name AND kind IN ('class', 'method')),
up AS (SELECT repo, type, supertype, 1 AS distance FROM hc UNION SELECT up.repo, up.type, hc.supertype, up.distance + 1 FROM up JOIN hc ON hc.repo = up.repo AND hc.type = up.supertype WHERE up.distance < 6 AND hc.supertype <> up.type), ln AS (SELECT repo, type, supertype, min(distance) AS distance FROM up GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_UP} SELECT repo, type, supertype, CAST(distance AS INTEGER) AS distance FROM ln""")
def lineage(spark, d):
    """All that stands above a name, nearest first; containers stand in for supertypes, which the heads of these tables do not name."""
    c = declared(spark, d).where("container is not null and container <> name and kind in ('class', 'method')").select("repo", "name", F.col("container").alias("supertype"))
    return M.lineage(c, 6)


@query(f"""WITH RECURSIVE {_UP}, mb AS (SELECT DISTINCT repo, container AS type, kind AS member FROM d WHERE container IS NOT NULL), al AS (SELECT repo, type, member, type AS declared_in, 0 AS distance FROM mb UNION SELECT ln.repo, ln.type, mb.member, ln.supertype, ln.distance FROM ln JOIN mb ON mb.repo = ln.repo AND mb.type = ln.supertype),
r AS (SELECT *, rank() OVER (PARTITION BY repo, type, member ORDER BY distance) AS k FROM al) SELECT repo, type, member, declared_in, CAST(distance AS INTEGER) AS distance FROM r WHERE k = 1""")
def declaring_ancestors(spark, d):
    """Where in its own or a type above a kind of member is declared first."""
    c = declared(spark, d).where("container is not null")
    lines = M.lineage(c.where("container <> name and kind in ('class', 'method')").select("repo", "name", F.col("container").alias("supertype")), 6)
    return M.declaring(lines, c.select("repo", F.col("container").alias("type"), F.col("kind").alias("member")).distinct())


@query(f"""WITH {_D}, u AS (SELECT DISTINCT repo, path, container || '::' || name AS name FROM d WHERE container IS NOT NULL), b AS (SELECT DISTINCT repo, path, name AS local, min(header) AS module FROM d WHERE kind = 'class' GROUP BY ALL) SELECT u.repo, u.path, u.name, CASE WHEN b.module IS NOT NULL THEN b.module || substring(u.name, length(b.local) + 1) ELSE u.name END AS "full" FROM u LEFT JOIN b ON b.repo = u.repo AND b.path = u.path AND b.local = regexp_extract(u.name, '^(.*?)(?:::|$)', 1)""")
def bound_paths(spark, d):
    """Qualified names whose first part the file binds, with what it stands for in its place."""
    c = declared(spark, d)
    uses = c.where("container is not null").select(*_KEY, F.concat_ws("::", "container", "name").alias("name")).distinct()
    bound = c.where("kind = 'class'").groupBy(*_KEY, F.col("name").alias("local")).agg(F.min("header").alias("module"))
    return M.after_binding(uses, bound)


@query(f"""WITH {_F}, {_D}, t AS (SELECT repo, path, idx FROM d WHERE kind IN ('trait', 'interface')) SELECT d.repo, d.path, d.idx, coalesce(d.visibility = 0, false) AND lower(f.language) <> 'rust' AND t.idx IS NULL AS file_local FROM d JOIN f USING (repo, path) LEFT JOIN t ON t.repo = d.repo AND t.path = d.path AND t.idx = d.parent WHERE f.language IS NOT NULL""")
def file_local_declarations(spark, d):
    """Which declarations are seen from their file alone: not in Rust, nor where a trait holds them."""
    return R.file_local(located(spark, d)).select(*_KEY, "idx", "file_local")


# reach

@query(f"""WITH RECURSIVE {_EDGES}, step AS (SELECT DISTINCT target AS a, importer AS b FROM edges WHERE confidence < 2), s AS (SELECT a AS start, b AS node, 1 AS depth FROM step WHERE a <> b UNION SELECT s.start, step.b, s.depth + 1 FROM s JOIN step ON s.node = step.a WHERE s.depth < 3 AND step.b <> s.start),
reach AS (SELECT start, node, min(depth) AS depth FROM s GROUP BY start, node), r AS (SELECT start AS subject, count(*) FILTER (depth = 1) AS direct, count(*) AS transitive FROM reach GROUP BY start ORDER BY transitive DESC, direct DESC, subject DESC LIMIT 20),
sy AS (SELECT target, arg_min(regexp_extract(symbol, '[^/]*$'), importer) AS symbol FROM edges WHERE symbol IS NOT NULL GROUP BY target), {_D}, dn AS (SELECT DISTINCT repo || ':' || path AS target, name FROM d)
SELECT r.subject, r.direct, r.transitive, dn.name AS symbol FROM r LEFT JOIN sy ON sy.target = r.subject LEFT JOIN dn ON dn.target = r.subject AND dn.name = sy.symbol""")
def reach_ranking_named(spark, d):
    """The files that reach furthest with the symbol they are imported for, if they declare it."""
    e = import_edges(spark, d).withColumn("symbol", S.tail("symbol"))
    known = declared(spark, d).select(_node("path").alias("target"), F.col("name").alias("symbol"))
    named = G.named_symbols(e, known).withColumnRenamed("target", "subject")
    return G.ranked_by_reach(e, 3, 20).join(named, "subject", "left").select("subject", "direct", "transitive", "symbol")


@query(f"""WITH {_EDGES}, n AS (SELECT target AS importer, count(*) AS their FROM edges WHERE confidence < 2 GROUP BY target), j AS (SELECT e.target, e.importer, coalesce(their, 0) AS their_importers, row_number() OVER (PARTITION BY e.target ORDER BY coalesce(their, 0) DESC, e.importer) AS r FROM edges e LEFT JOIN n USING (importer)) SELECT target, importer, their_importers FROM j WHERE r <= 10""")
def top_importers(spark, d):
    """For each file the ten importers that are most imported themselves."""
    return G.top_importers(import_edges(spark, d), 10)


@query(f"""WITH RECURSIVE {_EDGES}, {_D}, t AS (SELECT DISTINCT repo || ':' || path AS target, lower(name) AS symbol FROM d WHERE kind = 'class'), s AS (SELECT t.symbol, e.importer AS node, 1 AS depth FROM t JOIN edges e USING (target) UNION SELECT s.symbol, e.importer, s.depth + 1 FROM s JOIN edges e ON e.target = s.node WHERE s.depth < 2)
SELECT symbol, count(DISTINCT node) AS files FROM s GROUP BY symbol""")
def symbol_usages(spark, d):
    """How many files lie within two steps of importing a file that declares each class."""
    t = declared(spark, d).where("kind = 'class'").select(_node("path").alias("start"), F.lower("name").alias("symbol")).distinct()
    reach = G.reachable_of(import_edges(spark, d), t, 2)
    return reach.groupBy("symbol").agg(F.countDistinct("node").alias("files"))


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT importer AS start, target AS node, 1 AS step FROM edges WHERE contains(importer, ':src/') UNION SELECT s.start, e.target, s.step + 1 FROM s JOIN edges e ON e.importer = s.node WHERE s.step < 4 AND e.target <> s.start) SELECT start, node, CAST(min(step) AS INTEGER) AS step FROM s GROUP BY start, node""")
def included_files(spark, d):
    """What some files take in, over at most four links."""
    e = import_edges(spark, d)
    starts = e.where(F.col("importer").contains(":src/")).select("importer").distinct()
    return D.includes(e.select(F.col("importer").alias("source"), "target"), starts)


@query(f"""WITH RECURSIVE {_H}, r AS (SELECT DISTINCT repo || ':' || path AS a, repo || ':' || from_path AS b FROM x WHERE from_path IS NOT NULL AND status LIKE 'R%'), s AS (SELECT a AS start, b AS node, 1 AS step FROM r WHERE a <> b UNION SELECT s.start, r.b, s.step + 1 FROM s JOIN r ON r.a = s.node WHERE s.step < 8 AND r.b <> s.start) SELECT start, node, CAST(min(step) AS INTEGER) AS step FROM s GROUP BY start, node""")
def rename_chains(spark, d):
    """The older names of each renamed path, newest first."""
    r = changes(spark, d).where("from_path is not null and status like 'R%'").select(_node("path").alias("a"), _node("from_path").alias("b")).distinct()
    return G.chain(r, r.select("a").distinct(), 8)


@query(f"""WITH {_EDGES}, x AS (SELECT regexp_extract(target, '^(.*/)', 1) AS tf, regexp_extract(importer, '^(.*/)', 1) AS im, target, importer FROM edges WHERE confidence < 2), y AS (SELECT * FROM x WHERE tf <> im), a AS (SELECT tf AS folder, count(DISTINCT importer) AS imported_by FROM y GROUP BY tf),
n AS (SELECT regexp_extract(repo || ':' || path, '^(.*/)', 1) AS folder, count(*) AS files FROM f GROUP BY 1), ac AS (SELECT regexp_extract(repo || ':' || path, '^(.*/)', 1) AS folder, count(*) AS annotations FROM (SELECT DISTINCT repo, path, idx, unnest(annotations) AS a FROM declarations) GROUP BY 1)
SELECT n.folder, n.files, coalesce(a.imported_by, 0) AS imported_by, coalesce(ac.annotations, 0) AS annotations FROM n LEFT JOIN a USING (folder) LEFT JOIN ac USING (folder) ORDER BY imported_by DESC, n.folder LIMIT 25""")
def folders_by_importers(spark, d):
    """Folders, the most imported first, with their files and annotations."""
    e = import_edges(spark, d)
    folder = lambda c: F.regexp_extract(c, "^(.*/)", 1)
    nodes = e.select(F.explode(F.array("target", "importer")).alias("path")).distinct().withColumn("folder", folder("path"))
    n = filed(spark, d).groupBy(folder(_node("path")).alias("folder")).agg(F.count("*").alias("files"))
    marks = table(spark, d, "declarations").select(*_KEY, "idx", F.explode("annotations").alias("a")).distinct().groupBy(folder(_node("path")).alias("folder")).agg(F.count("*").alias("annotations"))
    j = n.join(G.folder_edges(e, nodes).select("folder", "imported_by"), "folder", "left").join(marks, "folder", "left")
    none = F.lit(0)
    return j.select("folder", "files", F.coalesce("imported_by", none).alias("imported_by"), F.coalesce("annotations", none).alias("annotations")).orderBy(F.desc("imported_by"), "folder").limit(25)


@query(f"""WITH {_REF}, {_D}, o AS (SELECT DISTINCT repo, path, lower(name) AS symbol FROM d), u AS (SELECT DISTINCT repo, path, lower(name) AS symbol FROM ref) SELECT o.repo, o.path, o.symbol, count(u.path) AS reach FROM o LEFT JOIN u ON u.repo = o.repo AND u.symbol = o.symbol AND u.path <> o.path GROUP BY ALL""")
def symbol_reach(spark, d):
    """How many other files use each name that a file declares."""
    return R.symbol_reach(declared(spark, d), references(spark, d))


# history

@query(f"""WITH RECURSIVE {_H}, s AS (SELECT repo, commit_id, min(pos) AS pos, count(*) AS n FROM x GROUP BY repo, commit_id), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pos) AS r FROM s), t AS (SELECT * FROM k WHERE r <= 30),
w AS (SELECT repo, commit_id, r, CASE WHEN n <= 200 THEN n ELSE 0 END AS used, n <= 200 AS kept FROM t WHERE r = 1 UNION ALL SELECT t.repo, t.commit_id, t.r, CASE WHEN w.used + t.n <= 200 THEN w.used + t.n ELSE w.used END, w.used + t.n <= 200 FROM w JOIN t ON t.repo = w.repo AND t.r = w.r + 1)
SELECT repo, commit_id FROM w WHERE kept""")
def commits_within_budget(spark, d):
    """Of the 30 newest commits those whose files still fit 200; one that does not is passed over."""
    s = changes(spark, d).groupBy("repo", "commit_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    return H.greedy_fit(s, ["repo"], ["pos"], "n", 200, 30).select("repo", "commit_id")


@query(f"""WITH {_H}, b AS (SELECT author AS branch, max(commit_date) AS day FROM c WHERE author IS NOT NULL AND commit_date IS NOT NULL GROUP BY author) SELECT branch, CAST(day AS VARCHAR) AS day FROM b WHERE (DATE '{_NOW}' - day <= 21 AND NOT regexp_matches(branch, '^(feature|feat|fix|bugfix|hotfix|chore|dependabot|renovate)/')) OR branch = 'main'""")
def branch_candidates(spark, d):
    """Branches worth a look; authors stand in for branches, whose newest commit is theirs."""
    refs = commits(spark, d).where("author is not null and commit_date is not null").select(F.concat(F.lit("origin/"), "author").alias("name"), F.col("commit_date").alias("date"))
    return H.branches(refs, "main", _NOW).select("branch", F.col("date").cast("string").alias("day"))


@query(f"""WITH {_H}, {_D}, b AS (SELECT DISTINCT repo, path, sha, line_start, line_end, author_time FROM blame_regions), t AS (SELECT d.repo, d.path, d.idx, b.sha, max(b.author_time) AS touched_at FROM b JOIN d ON d.repo = b.repo AND d.path = b.path AND d.line <= b.line_end AND b.line_start <= d.end_line WHERE d.kind IN ('function', 'method') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path, idx ORDER BY touched_at DESC, sha) AS k FROM t) SELECT repo, path, idx, sha, touched_at FROM r WHERE k <= 20""")
def function_history(spark, d):
    """The newest 20 commits in the lines of each function."""
    b = table(spark, d, "blame_regions").select(*_KEY, "sha", "line_start", "line_end", "author_time").distinct()
    f = declared(spark, d).where("kind in ('function', 'method')").select(*_KEY, "idx", "line", "end_line")
    t = P.overlapping(b, f, _KEY, "line_start", "line_end", "line", "end_line").groupBy(*_KEY, "idx", "sha").agg(F.max("author_time").alias("touched_at"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy(*_KEY, "idx").orderBy(F.desc("touched_at"), "sha"))).where("k <= 20").drop("k")


@query(f"""WITH {_H}, n AS (SELECT repo, path, min(substring(status, 1, 1)) AS s, max(seq) AS q FROM x WHERE pos < 5 GROUP BY repo, path) SELECT repo, path, CASE s WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' WHEN 'M' THEN 'modified' WHEN 'T' THEN 'type changed' ELSE 'unknown' END AS state, CASE WHEN s = 'A' THEN 1 ELSE q END AS first, CASE WHEN s = 'A' THEN 2147483647 ELSE q + 2 END AS last FROM n""")
def changed_ranges(spark, d):
    """The lines of each changed file on its new side; of an added file all."""
    n = changes(spark, d).where("pos < 5").groupBy(*_KEY).agg(F.min(F.substring("status", 1, 1)).alias("s"), F.max("seq").alias("q"))
    return N.new_side(n.withColumn("hunk", F.concat(F.lit("+"), F.col("q"), F.lit(",3"))), "s", "hunk").select(*_KEY, S.status_label("s").alias("state"), "first", "last")


# contents of two states

_TWO = f"{_F}, fn AS (SELECT regexp_extract(path, '[^/]*$') AS path, repo || ':' || path AS k, content FROM f WHERE content IS NOT NULL), tw AS (SELECT path, arg_min(content, k) AS old, arg_max(content, k) AS new FROM fn GROUP BY path HAVING count(*) > 1)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    """(path, old, new): the texts of the first and the last file of a name, as two states of it."""
    f = filed(spark, d).where("content is not null").select(S.base_name("path").alias("path"), _node("path").alias("k"), "content")
    return f.groupBy("path").agg(F.min_by("content", "k").alias("old"), F.max_by("content", "k").alias("new"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"""WITH {_TWO}, n AS (SELECT path, len(regexp_extract_all(old, 'return')) AS was, len(regexp_extract_all(new, 'return')) AS is_now FROM tw) SELECT path, was, is_now, CASE WHEN was = 0 THEN 'added' WHEN is_now = 0 THEN 'removed' ELSE 'changed' END AS direction FROM n WHERE was <> is_now""")
def pickaxe_contents(spark, d):
    """Files whose texts hold a pattern a different number of times in two states."""
    return H.pickaxe_texts(_two(spark, d), "path", "old", "new", "return").select("path", "was", "is_now", "direction")


@query(f"""WITH {_TWO}, o AS (SELECT path, unnest(string_split(old, chr(10))) AS line FROM tw), w AS (SELECT path, unnest(string_split(new, chr(10))) AS line FROM tw), oc AS (SELECT path, line, count(*) AS n FROM o GROUP BY ALL), wc AS (SELECT path, line, count(*) AS n FROM w GROUP BY ALL)
SELECT DISTINCT coalesce(oc.path, wc.path) AS path FROM oc FULL JOIN wc ON wc.path = oc.path AND wc.line = oc.line WHERE coalesce(oc.n, 0) <> coalesce(wc.n, 0) AND contains(coalesce(oc.line, wc.line), 'return')""")
def pickaxe_confirmed(spark, d):
    """Of these the ones in which a line with the pattern differs."""
    return H.confirmed(_two(spark, d), "path", "old", "new", "return")


@query(f"""WITH {_F}, {_D}, bd AS (SELECT d.repo, d.path, d.name, d.kind, min(array_to_string(list_slice(string_split(f.content, chr(10)), d.line, d.end_line), chr(10))) AS body FROM d JOIN f USING (repo, path) WHERE f.content IS NOT NULL AND d.line >= 1 GROUP BY ALL), a AS (SELECT name, kind, min(repo || path || body) AS body FROM bd WHERE starts_with(path, 'src/') GROUP BY ALL), b AS (SELECT name, kind, min(repo || path || body) AS body FROM bd WHERE starts_with(path, 'lib/') GROUP BY ALL) SELECT a.name, a.kind FROM a JOIN b USING (name, kind) WHERE a.body <> b.body""")
def body_diff(spark, d):
    """Names of one kind that two trees declare with different bodies."""
    f = filed(spark, d).where("content is not null").select(*_KEY, "content")
    bodies = N.bodies(declared(spark, d).where("line >= 1").join(f, _KEY), "content", "line", "end_line")
    one = bodies.groupBy(*_KEY, "name", "kind").agg(F.min("body").alias("body")).withColumn("body", F.concat("repo", "path", "body"))
    side = lambda p: one.where(F.col("path").startswith(p)).groupBy("name", "kind").agg(F.min("body").alias("body"))
    return N.changed_bodies(side("src/"), side("lib/"), ["name", "kind"], "body")


@query(f"""WITH RECURSIVE {_D}, {_TREE}, c AS (SELECT w.repo, w.path, w.idx, d.kind || '/' || d.name AS key FROM w JOIN d USING (repo, path, idx) WHERE w.depth = 0 UNION ALL SELECT k.repo, k.path, k.idx, c.key || '/' || d.kind || '/' || d.name FROM k JOIN c ON c.repo = k.repo AND c.path = k.path AND c.idx = k.parent JOIN d ON d.repo = k.repo AND d.path = k.path AND d.idx = k.idx) SELECT repo, path, idx, key, row_number() OVER (PARTITION BY repo, path, key ORDER BY idx) - 1 AS ordinal FROM c""")
def surface_keys(spark, d):
    """The key of each declaration over edits: kinds and names from the outermost, and a number among equal ones."""
    up = tree_of(spark, d).where("path_ids is not null").select(*_KEY, F.col("id").alias("idx"), F.posexplode("path_ids").alias("place", "above"))
    parts = declared(spark, d).select(*_KEY, F.col("idx").alias("above"), F.concat_ws("/", "kind", "name").alias("part"))
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("place"), "part"))), lambda x: x["part"]), "/")
    keyed = up.join(parts, [*_KEY, "above"]).groupBy(*_KEY, "idx").agg(key.alias("key"))
    return N.with_ordinal(keyed, [*_KEY, "key"], ["idx"]).select(*_KEY, "idx", "key", "ordinal")


@query(f"""WITH {_D}, a AS (SELECT repo, name, kind, arg_min(header, (path, idx)) AS h, arg_min(line, (path, idx)) AS l, 1 AS x FROM d WHERE starts_with(path, 'src/') GROUP BY ALL), b AS (SELECT repo, name, kind, arg_min(header, (path, idx)) AS h, arg_min(line, (path, idx)) AS l, 1 AS x FROM d WHERE starts_with(path, 'lib/') GROUP BY ALL)
SELECT repo, name, kind, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' WHEN a.l <> b.l THEN 'moved' ELSE 'same' END AS state FROM a FULL JOIN b USING (repo, name, kind)""")
def surface_delta(spark, d):
    """Declarations of two trees: added, removed, changed in their head, or only moved."""
    place = F.struct("path", "idx")
    side = lambda p: declared(spark, d).where(F.col("path").startswith(p)).groupBy("repo", "name", "kind").agg(F.min_by("header", place).alias("header"), F.min_by("line", place).alias("line"))
    return N.surface_delta(side("src/"), side("lib/"), ["repo", "name", "kind"], ["header"], ["line"])


@query(f"""WITH {_D}, n AS (SELECT a.repo, a.path, a.idx, min(b.line) AS next FROM d a LEFT JOIN d b ON b.repo = a.repo AND b.path = a.path AND (b.line > a.line OR b.line = a.line AND b.idx > a.idx) AND (CASE WHEN b.container IS NULL THEN 0 ELSE 1 END) <= (CASE WHEN a.container IS NULL THEN 0 ELSE 1 END) GROUP BY a.repo, a.path, a.idx) SELECT n.repo, n.path, n.idx, greatest(d.line, coalesce(n.next - 1, f.lines)) AS last FROM n JOIN d USING (repo, path, idx) JOIN (SELECT repo, path, max(lines) AS lines FROM files GROUP BY ALL) f ON f.repo = n.repo AND f.path = n.path""")
def inferred_ends(spark, d):
    """Where declarations end if nobody says: before the next one that lies no deeper, else with the file."""
    deep = F.when(F.col("container").isNull(), 0).otherwise(1)
    rows = declared(spark, d).select(*_KEY, "idx", "line", deep.alias("deep")).join(filed(spark, d).select(*_KEY, "lines"), _KEY)
    return P.inferred_ends(rows, _KEY, "line", "idx", "deep", 1, "lines").select(*_KEY, "idx", "last")


# documents and sinks

@query("""WITH f AS (SELECT DISTINCT repo, path FROM files), dc AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder, path AS doc FROM f WHERE regexp_matches(path, '(data|codes)\\.[a-z]+$')), a AS (SELECT f.repo, f.path, len(string_split(f.path, '/')) - 1 AS depth, k AS level, array_to_string(list_slice(string_split(f.path, '/'), 1, k), '/') AS folder FROM (SELECT f.*, unnest(range(0, len(string_split(path, '/')))) AS k FROM f) f)
SELECT a.repo, a.path, dc.doc, a.depth - a.level AS distance FROM a JOIN dc ON dc.folder = a.folder""")
def documents_up_the_folders(spark, d):
    """All documents in the folders above each file, with their distance."""
    f = table(spark, d, "files").select("repo", "path").distinct()
    docs = f.where(F.col("path").rlike("(data|codes)\\.[a-z]+$")).select("path").distinct()
    return D.chain(f, docs).select("repo", "path", "doc", "distance")


@query("""WITH f AS (SELECT DISTINCT repo, path FROM files), r AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*)/', 1) AS folder FROM f WHERE regexp_matches(path, '(^|/)(src|lib|app)/[^/]*$')), a AS (SELECT f.repo, f.path, k, array_to_string(list_slice(string_split(f.path, '/'), 1, k), '/') AS folder FROM (SELECT f.*, unnest(range(1, len(string_split(path, '/')))) AS k FROM f) f) SELECT a.repo, a.path, arg_max(a.folder, k) AS root FROM a JOIN r USING (repo, folder) GROUP BY a.repo, a.path""")
def nearest_roots(spark, d):
    """The nearest folder above each file that is a package root of its repository."""
    f = table(spark, d, "files").select("repo", "path").distinct()
    roots = f.where(F.col("path").rlike("(^|/)(src|lib|app)/[^/]*$")).select("repo", F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct()
    return D.nearest_folder(f, roots, ["repo"])


@query(f"""WITH {_F}, {_D}, r AS (SELECT DISTINCT repo, path FROM d WHERE kind = 'enum') SELECT f.repo, f.path, f.language, f.lines FROM f JOIN r USING (repo, path)""")
def context_of_results(spark, d):
    """The facts of the files that a filtered result still names."""
    facts = filed(spark, d).select(_node("path").alias("node"), *_KEY, "language", "lines")
    rows = declared(spark, d).where("kind = 'enum'").select(_node("path").alias("node"))
    return K.named_context(rows, facts, "node").drop("node")


@query(f"""WITH {_D} SELECT DISTINCT repo || ' ' || path || ' ' || kind || ' ' || name AS value FROM d WHERE visibility >= 3 AND parent IS NULL""")
def plain_api(spark, d):
    """The interface as plain lines, written and read again."""
    rows = declared(spark, d).where("visibility >= 3 and parent is null").select(F.concat_ws(" ", "repo", "path", "kind", "name").alias("line")).distinct()
    where = f"{shared_dir(spark).rstrip('/')}/codeloam-text-{uuid.uuid4().hex}"
    K.plain_text(rows, where)
    return spark.read.text(where)


@query(f"""WITH {_F} SELECT repo, language, count(*) AS n FROM f GROUP BY repo, language""")
def versioned_counts(spark, d):
    """A table saved under its version and read by it."""
    n = filed(spark, d).groupBy("repo", "language").agg(F.count("*").alias("n"))
    return spark.read.parquet(K.versioned(n, f"{shared_dir(spark).rstrip('/')}/codeloam-versions", uuid.uuid4().hex))


@query(f"""WITH {_F}, s AS (SELECT repo, path, coalesce(cc, 0) AS cc, length(path) + coalesce(lines, 0) % 50 AS whole, length(path) AS brief FROM f), w AS (SELECT *, sum(brief) OVER o AS b, sum(whole - brief) OVER o AS m, sum(brief) OVER () AS al FROM s WINDOW o AS (ORDER BY cc DESC, repo, path ROWS UNBOUNDED PRECEDING))
SELECT repo, path, CASE WHEN b > 30000 THEN 'counted' WHEN 30000 - al < 0 THEN 'short' WHEN m <= 30000 - al THEN 'full' ELSE 'short' END AS tier FROM w""")
def listing_tiers(spark, d):
    """A listing within 30,000 characters: what keeps its detail, what only its name and what is counted."""
    s = filed(spark, d).select(*_KEY, (-F.coalesce("cc", F.lit(0))).alias("less"), (F.length("path") + F.coalesce("lines", F.lit(0)) % 50).alias("whole"), F.length("path").alias("brief"))
    return D.tiers(s, ["less", *_KEY], "whole", "brief", 30_000).select(*_KEY, "tier")


# statistics under a scope, orders

@query(f"""WITH m AS (SELECT DISTINCT repo, path, language, code, lines, complexity, measured_on, loaded_at FROM metrics WHERE path = 'src' OR starts_with(path, 'src/')) SELECT language, count(*) AS n, sum(code) AS code, sum(complexity) AS complexity FROM m GROUP BY language""")
def metrics_under_scope(spark, d):
    m = table(spark, d, "metrics").where(S.under("path", "src")).distinct()
    return m.groupBy("language").agg(F.count("*").alias("n"), F.sum("code").alias("code"), F.sum("complexity").alias("complexity"))


@query(f"""WITH {_EDGES}, {_H}, cg AS (SELECT repo, path, min(substring(status, 1, 1)) AS s FROM x WHERE pos < 20 GROUP BY repo, path), n AS (SELECT target, count(*) AS k FROM edges GROUP BY target) SELECT cg.repo, cg.path, coalesce(n.k, 0) AS direct, coalesce(f.cc, 0) AS complexity FROM cg LEFT JOIN n ON n.target = cg.repo || ':' || cg.path LEFT JOIN f ON f.repo = cg.repo AND f.path = cg.path ORDER BY direct DESC, complexity DESC, cg.repo, cg.path LIMIT 50""")
def diff_order(spark, d):
    """Changed files, those with most dependents first; here ambiguous ones count too."""
    c = changes(spark, d).where("pos < 20").select(*_KEY).distinct().withColumn("node", _node("path"))
    n = import_edges(spark, d).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("direct"))
    j = c.join(n, "node", "left").join(filed(spark, d).select(*_KEY, "cc"), _KEY, "left")
    return j.select(*_KEY, F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("cc", F.lit(0)).alias("complexity")).orderBy(F.desc("direct"), F.desc("complexity"), *_KEY).limit(50)


@query(f"""WITH {_EDGES}, {_H}, w AS (SELECT DISTINCT repo, path FROM x WHERE pos = 0), n AS (SELECT target, count(*) AS k FROM edges WHERE confidence < 2 GROUP BY target), j AS (SELECT w.repo, w.path, coalesce(n.k, 0) AS callers, coalesce(f.cc, 0) AS cc FROM w LEFT JOIN n ON n.target = w.repo || ':' || w.path LEFT JOIN f ON f.repo = w.repo AND f.path = w.path), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY callers DESC, cc DESC, path) AS k FROM j) SELECT repo, path, callers, cc FROM r WHERE k <= 10""")
def dirty_files(spark, d):
    """The ten changed files of each repository that most depends on."""
    w = changes(spark, d).where("pos = 0").select(*_KEY).distinct().withColumn("node", _node("path"))
    n = import_edges(spark, d).where("confidence < 2").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("callers"))
    j = w.join(n, "node", "left").join(filed(spark, d).select(*_KEY, "cc"), _KEY, "left").select(*_KEY, F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("cc", F.lit(0)).alias("cc"))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("callers"), F.desc("cc"), "path"))).where("k <= 10").drop("k")


@query(f"""WITH {_EDGES}, {_H}, pf AS (SELECT DISTINCT regexp_extract(repo || ':' || path, '^(.*/)', 1) AS folder FROM x WHERE pos < 5), y AS (SELECT regexp_extract(target, '^(.*/)', 1) AS folder, importer FROM edges WHERE confidence < 2 AND regexp_extract(target, '^(.*/)', 1) <> regexp_extract(importer, '^(.*/)', 1)) SELECT pf.folder, count(DISTINCT y.importer) AS imported_by FROM pf LEFT JOIN y USING (folder) WHERE pf.folder <> '' GROUP BY pf.folder""")
def changed_folders(spark, d):
    """The folders of changed files with what imports them."""
    folder = lambda c: F.regexp_extract(c, "^(.*/)", 1)
    e = import_edges(spark, d)
    nodes = e.select(F.explode(F.array("target", "importer")).alias("path")).distinct().withColumn("folder", folder("path"))
    touched = changes(spark, d).where("pos < 5").select(folder(_node("path")).alias("folder")).where("folder <> ''").distinct()
    return touched.join(G.folder_edges(e, nodes).select("folder", "imported_by"), "folder", "left").select("folder", F.coalesce("imported_by", F.lit(0)).alias("imported_by"))


# extraction

_TABLED = "('java', 'php', 'ruby', 'go', 'javascript', 'rust', 'typescript', 'c')"


@query(f"""WITH {_F}, {_D} SELECT d.repo, d.path, d.name, d.kind, d.header FROM d JOIN f USING (repo, path) WHERE f.content IS NOT NULL AND f.language IN {_TABLED}""")
def extracted_declarations(spark, d):
    """Declarations of the sources by the scanner, against those the table has of the same files; files of which it has none are left out."""
    from ..operators.extract import extracted, relation

    files = filed(spark, d).where(f"language in {_TABLED}").join(table(spark, d, "declarations").select(*_KEY).distinct(), _KEY, "left_semi")
    return relation(extracted(files, _KEY, language="language", path="path"), _KEY, "declarations").select(*_KEY, "name", "kind", "header")


@query()
def extracted_functions(spark, d):
    """Functions of all sources with their complexity."""
    from ..operators.extract import extracted, relation

    return relation(extracted(filed(spark, d), _KEY, language="language", path="path"), _KEY, "functions")


@query()
def extracted_references(spark, d):
    """Calls in all sources, by shape."""
    from ..operators.extract import extracted, relation

    rows = relation(extracted(filed(spark, d), _KEY, language="language", path="path"), _KEY, "references")
    return rows.groupBy(*_KEY, "shape").agg(F.count("*").alias("n"))


@query("""SELECT repo, path, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END AS lines FROM (SELECT repo, path, replace(max(content), chr(13) || chr(10), chr(10)) AS t FROM files WHERE content IS NOT NULL GROUP BY repo, path)""")
def measured_lines(spark, d):
    """Lines of the sources as measured from their texts."""
    from ..operators.extract import measured

    return measured(filed(spark, d), _KEY).select(*_KEY, "lines")


@query()
def measured_sources(spark, d):
    """Lines, lines of code and complexity of the sources."""
    from ..operators.extract import measured

    return measured(filed(spark, d), _KEY)


QUERIES, SQL = query.queries, query.sql
