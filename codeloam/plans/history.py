"""Commits, changes, authorship and documents along paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import docs as D, history as H, islands as I, stats as A
from ..sources.tables import table
from .registry import Registry

query = Registry()

_AS_OF = "2024-12-31"
_H = "c AS (SELECT DISTINCT repo, commit_id, pos, commit_date, author, subject, is_merge FROM commits), ch AS (SELECT DISTINCT repo, commit_id, seq, status, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') AS path, from_path, old_blob, new_blob FROM file_changes WHERE path IS NOT NULL), x AS (SELECT ch.*, c.pos, c.commit_date, c.author, c.subject FROM ch JOIN c USING (repo, commit_id))"


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("repo", "commit_id", "pos", "commit_date", "author", "subject", "is_merge").distinct()


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes with their commit, paths made equal."""
    ch = table(spark, d, "file_changes").where("path is not null").withColumn("path", S.clean_path("path")).select("repo", "commit_id", "seq", "status", "path", "from_path", "old_blob", "new_blob").distinct()
    return ch.join(commits(spark, d).drop("is_merge"), ["repo", "commit_id"])


_REN = _H + """, rn AS (SELECT repo, from_path AS o, pos AS rpos, min(path) AS n FROM x WHERE from_path IS NOT NULL AND status LIKE 'R%' GROUP BY ALL),
p AS (SELECT x.repo, x.commit_id, x.seq, x.path, arg_max(n, rpos) AS n FROM x LEFT JOIN rn ON rn.repo = x.repo AND o = x.path AND rpos < x.pos WHERE x.from_path IS NULL GROUP BY ALL),
nw AS (SELECT x.*, CASE WHEN x.from_path IS NULL THEN coalesce(p.n, x.path) ELSE x.path END AS now FROM x LEFT JOIN p USING (repo, commit_id, seq, path))"""


@query(f"WITH {_REN}, o AS (SELECT DISTINCT repo, now, commit_id, pos, commit_date, author, subject FROM nw) SELECT repo, now AS path, count(*) AS commits, count(*) FILTER (commit_date >= DATE '{_AS_OF}' - 30) AS recent, CAST(arg_max(commit_date, pos) AS VARCHAR) AS first_seen, CAST(arg_min(commit_date, pos) AS VARCHAR) AS last_modified, arg_min(subject, pos) AS last_subject FROM o GROUP BY repo, now")
def file_lifecycle(spark, d):
    facts = H.lifecycle(H.renamed(changes(spark, d)), "now", _AS_OF)
    return facts.select("repo", F.col("now").alias("path"), "commits", "recent", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_modified").cast("string").alias("last_modified"), "last_subject")


@query(f"WITH {_REN} SELECT repo, commit_id, seq, path, now FROM nw WHERE now <> path")
def rename_aliases(spark, d):
    return H.renamed(changes(spark, d)).where("now <> path").select("repo", "commit_id", "seq", "path", "now")


@query(f"WITH {_H}, o AS (SELECT DISTINCT repo, path, commit_id, author, pos FROM x), a AS (SELECT repo, path, author, count(*) AS n, min(pos) AS p FROM o WHERE author IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, p, author) AS rank FROM a) SELECT repo, path, author, n FROM r WHERE rank = 1")
def top_authors(spark, d):
    return H.top_authors(changes(spark, d), "path").select("repo", "path", "author", "n")


@query(f"""WITH {_H}, s AS (SELECT repo, commit_id FROM x GROUP BY ALL HAVING count(*) <= 100), u AS (SELECT DISTINCT repo, commit_id, pos, path FROM x JOIN s USING (repo, commit_id)),
a AS (SELECT a.repo, a.path, b.path AS other, count(*) AS n, min(a.pos) AS p FROM u a JOIN u b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.path <> b.path GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, p, other) AS rank FROM a) SELECT repo, path, other, n, rank FROM r WHERE rank <= 5""")
def co_changed_files(spark, d):
    return H.co_changed(changes(spark, d), "path").select("repo", "path", "other", "n", "rank")


@query(f"WITH {_H} SELECT repo, count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (is_merge) AS merges, CAST(max(commit_date) AS VARCHAR) AS newest FROM c GROUP BY repo")
def repository_history(spark, d):
    return commits(spark, d).groupBy("repo").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.sum(F.col("is_merge").cast("int")).alias("merges"), F.max("commit_date").cast("string").alias("newest"))


@query(f"WITH {_H}, n AS (SELECT repo, count(*) AS n, count(*) > 100 AS cut FROM c GROUP BY repo) SELECT repo, CASE WHEN NOT cut THEN n END AS commits, CASE WHEN cut THEN 100 END AS commits_at_least FROM n")
def floored_history(spark, d):
    """With a history cut at 100 commits only a lower bound is known."""
    n = commits(spark, d).groupBy("repo").agg(F.count("*").alias("n"))
    return n.select("repo", *H.floored(F.least("n", F.lit(100)), F.col("n") > 100))


@query(f"WITH {_H}, r AS (SELECT repo, path, commit_id, pos, row_number() OVER (PARTITION BY repo, path ORDER BY pos) AS k FROM (SELECT DISTINCT repo, path, commit_id, pos FROM x)) SELECT repo, path, commit_id FROM r WHERE k <= 10")
def recent_commits(spark, d):
    one = changes(spark, d).select("repo", "path", "commit_id", "pos").distinct()
    return one.withColumn("k", F.row_number().over(Window.partitionBy("repo", "path").orderBy("pos"))).where("k <= 10").select("repo", "path", "commit_id")


@query(f"WITH {_H}, r AS (SELECT repo, commit_id, pos, row_number() OVER (PARTITION BY repo ORDER BY pos) AS a, row_number() OVER (PARTITION BY repo ORDER BY pos DESC) AS b FROM c WHERE contains(subject, 'Fix')) SELECT repo, commit_id FROM r WHERE a <= 29 OR b = 1")
def newest_and_oldest(spark, d):
    return H.newest_and_oldest(commits(spark, d).where(F.col("subject").contains("Fix")).select("repo", "commit_id", "pos"), ["repo"], "pos").select("repo", "commit_id")


@query(f"WITH {_H}, k AS (SELECT DISTINCT new_blob AS blob, instr(new_blob, '7') AS n FROM x WHERE new_blob IS NOT NULL), j AS (SELECT x.repo, x.commit_id, x.seq, x.path, coalesce(o.n, 0) AS was, coalesce(w.n, 0) AS is_now FROM x LEFT JOIN k o ON o.blob = x.old_blob LEFT JOIN k w ON w.blob = x.new_blob) SELECT repo, commit_id, seq, path, CASE WHEN was = 0 THEN 'added' WHEN is_now = 0 THEN 'removed' ELSE 'changed' END AS direction FROM j WHERE was <> is_now")
def pickaxe(spark, d):
    x = changes(spark, d)
    k = x.where("new_blob is not null").select(F.col("new_blob").alias("blob"), F.instr("new_blob", "7").alias("n")).distinct()
    return H.pickaxe(x, k).select("repo", "commit_id", "seq", "path", "direction")


@query(f"WITH {_H} SELECT (SELECT count(*) FROM (SELECT DISTINCT author FROM c WHERE author IS NOT NULL AND commit_date < DATE '2024-06-01' EXCEPT SELECT author FROM c WHERE commit_date >= DATE '2024-06-01')) AS ahead, (SELECT count(*) FROM (SELECT DISTINCT author FROM c WHERE author IS NOT NULL AND commit_date >= DATE '2024-06-01' EXCEPT SELECT author FROM c WHERE commit_date < DATE '2024-06-01')) AS behind")
def ahead_behind(spark, d):
    c = commits(spark, d).where("author is not null")
    return H.ahead_behind(c.where("commit_date < date'2024-06-01'"), c.where("commit_date >= date'2024-06-01'"), "author")


@query(f"WITH {_H} SELECT path, string_agg(DISTINCT repo, ',' ORDER BY repo) AS labels FROM x GROUP BY path")
def presence(spark, d):
    """In which repositories each path is listed."""
    return H.present_in(changes(spark, d).select("path", F.col("repo").alias("label"))).select("path", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {_H}, h AS (SELECT repo || ':' || path AS path, count(DISTINCT commit_id) AS commits FROM x WHERE pos > 0 GROUP BY ALL),
w AS (SELECT repo || ':' || path AS path, max(repo || ':' || from_path) AS from_path, max(status) AS state FROM x WHERE pos = 0 GROUP BY ALL), p AS (SELECT DISTINCT repo || ':' || path AS path, repo AS labels FROM files)
SELECT coalesce(h.path, w.path, p.path) AS path, coalesce(h.commits, o.commits) AS commits, w.state, w.from_path, p.labels FROM h FULL JOIN w ON w.path = h.path FULL JOIN p ON p.path = coalesce(h.path, w.path) LEFT JOIN h o ON o.path = w.from_path""")
def live_facts(spark, d):
    """History without the newest commits, those as a working tree, and the listing of files, in one row per path."""
    name = lambda c: F.concat(F.col("repo"), F.lit(":"), F.col(c))
    x = changes(spark, d)
    h = x.where("pos > 0").groupBy(name("path").alias("path")).agg(F.countDistinct("commit_id").alias("commits"))
    w = x.where("pos = 0").groupBy(name("path").alias("path")).agg(F.max(name("from_path")).alias("from_path"), F.max("status").alias("state"))
    return H.live(h, w, table(spark, d, "files").select(name("path").alias("path"), F.col("repo").alias("labels")).distinct())


# authorship

_B = "b AS (SELECT DISTINCT repo, path, line_start, line_end, sha, author, author_time FROM blame_regions)"


def blame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blame_regions").select("repo", "path", "line_start", "line_end", "sha", "author", "author_time").distinct()


@query(f"WITH {_B}, a AS (SELECT repo, path, author, sum(line_end - line_start + 1) AS lines, min(line_start) AS p FROM b WHERE author IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY lines DESC, p, author) AS rank FROM a) SELECT repo, path, author, lines FROM r WHERE rank <= 5")
def blame_authors(spark, d):
    a = blame(spark, d).where("author is not null").groupBy("repo", "path", "author").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.min("line_start").alias("p"))
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "path").orderBy(F.desc("lines"), "p", "author"))).where("rank <= 5").select("repo", "path", "author", "lines")


_BL = _B + ", ln AS (SELECT DISTINCT repo, path, sha, unnest(range(line_start, line_end + 1)) AS line FROM b)"


@query(f"WITH {_BL}, g AS (SELECT *, line - row_number() OVER (PARTITION BY repo, path, sha ORDER BY line) AS k FROM ln) SELECT repo, path, sha, min(line) AS first_line, max(line) AS last_line FROM g GROUP BY repo, path, sha, k")
def blame_regions(spark, d):
    """Lines of the reports put together to maximal regions of one commit."""
    lines = blame(spark, d).select("repo", "path", "sha", F.explode(F.sequence("line_start", "line_end")).alias("line")).distinct()
    return I.regions(lines, ["repo", "path"], "line", ["sha"])


@query(f"WITH {_B} SELECT repo, path, line_start, line_end, arg_max(author, (author_time, sha, author)) AS author, CAST(CAST(DATE '1970-01-01' + CAST(max(author_time) // 86400 AS INTEGER) AS DATE) AS VARCHAR) AS day FROM b WHERE author IS NOT NULL GROUP BY repo, path, line_start, line_end")
def last_touched(spark, d):
    """Who touched each region last, over all reports of a file."""
    b = blame(spark, d).where("author is not null").groupBy("repo", "path", "line_start", "line_end").agg(F.max(F.struct("author_time", "sha", "author")).alias("v"))
    return b.select("repo", "path", "line_start", "line_end", "v.author", S.civil_date("v.author_time").cast("string").alias("day"))


@query(f"WITH {_BL}, g AS (SELECT repo, path, line, lag(line) OVER (PARTITION BY repo, path ORDER BY line) AS p FROM (SELECT DISTINCT repo, path, line FROM ln)), r AS (SELECT *, sum(CASE WHEN p IS NULL OR line > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line) AS run FROM g) SELECT repo, path, CAST(run AS BIGINT) AS run, min(line) AS first_line, count(*) AS n FROM r GROUP BY ALL")
def hunks(spark, d):
    """Runs of consecutive lines, numbered."""
    lines = blame(spark, d).select("repo", "path", F.explode(F.sequence("line_start", "line_end")).alias("line")).distinct()
    new = F.col("line") > F.coalesce(F.lag("line").over(Window.partitionBy("repo", "path").orderBy("line")), F.lit(-9)) + 1
    return I.runs(lines.withColumn("new", new), ["repo", "path"], ["line"], F.col("new")).groupBy("repo", "path", "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))


# documents along paths

@query("""WITH f AS (SELECT DISTINCT repo, path FROM files), dc AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder, path AS doc FROM f WHERE regexp_matches(path, '(data|codes)\\.[a-z]+$')),
a AS (SELECT f.repo, f.path, array_to_string(list_slice(string_split(f.path, '/'), 1, k), '/') AS folder, k FROM (SELECT f.*, unnest(range(1, len(string_split(path, '/')))) AS k FROM f) f), j AS (SELECT a.repo, a.path, dc.doc, row_number() OVER (PARTITION BY a.repo, a.path ORDER BY k DESC, doc) AS r FROM a JOIN dc USING (folder))
SELECT repo, path, doc FROM j WHERE r = 1""")
def nearest_document(spark, d):
    """For each file the nearest of some files up its folders."""
    f = table(spark, d, "files").select("repo", "path").distinct()
    docs = f.where(F.col("path").rlike("(data|codes)\\.[a-z]+$")).select("path").distinct()
    return D.nearest(f, docs).select("repo", "path", "doc")


@query("""WITH f AS (SELECT DISTINCT repo, path FROM files)
SELECT repo, path, CASE WHEN ends_with(path, '.py') THEN 1 WHEN starts_with(path, 'src/') AND ends_with(path, '.go') THEN 2 WHEN starts_with(path, 'lib/') THEN 3 END AS rule FROM f WHERE ends_with(path, '.py') OR starts_with(path, 'src/') AND ends_with(path, '.go') OR starts_with(path, 'lib/')""")
def rules_for_files(spark, d):
    """The first rule whose glob matches each file."""
    f = table(spark, d, "files").select("repo", "path").distinct()
    return D.first_rule(f, "path", {1: "*.py", 2: "src/**/*.go", 3: "lib/**"})


@query("""WITH r AS (SELECT DISTINCT agent, repo, file FROM read_ranges), w AS (SELECT DISTINCT repo, file FROM r) SELECT a.agent, count(*) AS not_read FROM (SELECT DISTINCT agent, w.repo, w.file FROM (SELECT DISTINCT agent, repo FROM r) a JOIN w USING (repo)) a LEFT JOIN r ON r.agent = a.agent AND r.repo = a.repo AND r.file = a.file WHERE r.file IS NULL GROUP BY a.agent""")
def documents_not_loaded(spark, d):
    """How many files of their repositories each agent has not opened."""
    r = table(spark, d, "read_ranges").select("agent", "repo", "file").distinct()
    # counts only: what a repository has less what the agent read of it
    has = r.groupBy("repo").agg(F.countDistinct("file").alias("has"))
    left = r.groupBy("agent", "repo").agg(F.count("*").alias("read")).join(has, "repo").withColumn("left", F.col("has") - F.col("read"))
    return left.groupBy("agent").agg(F.sum("left").alias("not_read")).where("not_read > 0")


@query("""SELECT doc_kind, source, count(*) AS documents, sum(length(text)) AS chars FROM documents GROUP BY doc_kind, source""")
def documents_by_source(spark, d):
    return table(spark, d, "documents").groupBy("doc_kind", "source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[^\\]\\n]*\\]\\((https?://[^)\\s]+)\\)', 1)) AS target FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, target FROM l""")
def document_links(spark, d):
    """Edges from documents to what they link."""
    return D.links(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT source, count(*) AS n, CAST(sum(CAST(('0x' || substring(sha256(doc_id || ':' || coalesce(n_chars, 0)), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM documents WHERE source IS NOT NULL GROUP BY source""")
def folder_fingerprints(spark, d):
    one = F.concat(F.col("doc_id"), F.lit(":"), F.coalesce("n_chars", F.lit(0)))
    return D.fingerprints(table(spark, d, "documents").where("source is not null").withColumn("v", one), "source", "v")


@query("""WITH d AS (SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), w AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d) SELECT doc_id, CASE WHEN upto <= 30000 THEN 'whole' WHEN upto - n < 30000 THEN 'cut' ELSE 'queued' END AS state FROM w""")
def delivery_queue(spark, d):
    """What of each source fits 30,000 characters, what is cut at the end and what waits."""
    x = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", F.length("text").alias("n"))
    return D.fit(x, ["source"], ["doc_id"], "n", 30_000).select("doc_id", "state")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CAST(props->>'k' AS INTEGER) AS k FROM events) SELECT event_type, count(*) AS n, min(k) AS least, max(k) AS most, count(DISTINCT user_id) AS users FROM e GROUP BY event_type""")
def typed_events(spark, d):
    """Events with a JSON payload as typed rows."""
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {_H}, a AS (SELECT repo, path, count(DISTINCT commit_id) AS commits FROM x GROUP BY ALL), f AS (SELECT DISTINCT repo, path, cyclomatic_complexity AS cc FROM files) SELECT f.repo, f.path, f.cc, coalesce(a.commits, 0) AS commits FROM f LEFT JOIN a ON a.repo = f.repo AND a.path = f.path""")
def files_with_history(spark, d):
    a = changes(spark, d).groupBy("repo", "path").agg(F.countDistinct("commit_id").alias("commits"))
    f = table(spark, d, "files").select("repo", "path", F.col("cyclomatic_complexity").alias("cc")).distinct()
    return f.join(a, ["repo", "path"], "left").withColumn("commits", F.coalesce("commits", F.lit(0)))


@query(f"""WITH {_H}, p AS (SELECT repo || ':' || regexp_extract(path, '^[^/]*') AS folder, commit_date, commit_id FROM x) SELECT folder, count(DISTINCT commit_id) AS commits, CAST(max(commit_date) AS VARCHAR) AS last_modified, bool_or(commit_date >= DATE '{_AS_OF}' - 30) AS recent FROM p GROUP BY folder""")
def folder_activity(spark, d):
    x = changes(spark, d).withColumn("folder", F.concat_ws(":", "repo", F.regexp_extract("path", "^[^/]*", 0)))
    return x.groupBy("folder").agg(F.countDistinct("commit_id").alias("commits"), F.max("commit_date").cast("string").alias("last_modified"), F.bool_or(F.col("commit_date") >= F.date_sub(F.lit(_AS_OF).cast("date"), 30)).alias("recent"))


@query("""SELECT to_json({'path': path, 'language': language, 'lines': lines}) AS document FROM (SELECT DISTINCT repo, path, language, lines FROM files WHERE language IS NOT NULL AND lines IS NOT NULL)""")
def json_documents(spark, d):
    f = table(spark, d, "files").select("repo", "path", "language", "lines").where("language is not null and lines is not null").distinct()
    return f.select(F.to_json(F.struct("path", "language", "lines")).alias("document"))


QUERIES, SQL = query.queries, query.sql
