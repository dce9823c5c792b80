"""Search in documents and source lines, log entries and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import islands, text as T
from ..sources.tables import table
from .registry import Registry

query = Registry()

LINES = "l AS (SELECT doc_id, line_no, regexp_replace(line, chr(13) || '+$', '') AS line FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE NOT (line_no = n AND line = ''))"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return T.lines(table(spark, d, "documents"), ["doc_id"], "text")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM l GROUP BY doc_id")
def lines_per_document(spark, d):
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL")
def line_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.line_count("text").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(cache|session)')")
def grep_lines(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "(cache|session)"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '(?i)error') GROUP BY doc_id")
def grep_ignore_case(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "error", ignore_case=True)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM l WHERE NOT regexp_matches(line, 'the') GROUP BY doc_id")
def grep_invert(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "the", invert=True)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '(?:^|[^A-Za-z0-9_])(?:lock)(?:$|[^A-Za-z0-9_])')")
def grep_word(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "lock", word=True)).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '^(?:## [A-Za-z0-9.]+)$')")
def grep_whole_line(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "## [A-Za-z0-9.]+", whole_line=True)).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE contains(line, '(#1')")
def grep_literal(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "(#1", literal=True)).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE contains(line, 'a[')")
def grep_bad_pattern_as_literal(spark, d):
    return doc_lines(spark, d).where(F.col("line").rlike(T.smart_pattern("a["))).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no, generate_subscripts(m, 1) AS nth, unnest(m) AS match FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[a-z]+_[a-z_]+') AS m FROM l)")
def grep_only_matching(spark, d):
    return T.submatches(doc_lines(spark, d), "line", "[a-z]+_[a-z_]+").select("doc_id", "line_no", "nth", "match")


@query(f"WITH {LINES}, w AS (SELECT *, lag(line, 1) OVER o AS b1, lag(line, 2) OVER o AS b2, lead(line, 1) OVER o AS a1 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)) "
       "SELECT doc_id, line_no, concat_ws('|', b2, b1) AS before, concat_ws('|', a1) AS after FROM w WHERE regexp_matches(line, 'WARN')")  # fmt: skip
def grep_context(spark, d):
    return T.context(doc_lines(spark, d), ["doc_id"], T.matches("line", "WARN"), 2, 1).select("doc_id", "line_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no, line, length(line) AS n, instr(line, 'unless') AS place FROM l WHERE contains(line, 'unless')),
s AS (SELECT *, CASE WHEN n <= 240 THEN 1 ELSE greatest(1, place - 80) END AS a FROM m)
SELECT doc_id, line_no, CASE WHEN a > 1 THEN '…' ELSE '' END || substring(line, a, 240) || CASE WHEN a + 240 <= n THEN '…' ELSE '' END AS snippet FROM s""")
def grep_snippets(spark, d):
    return doc_lines(spark, d).where(T.matches("line", "unless")).select("doc_id", "line_no", T.snippet("line", "unless").alias("snippet"))


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\.\\n\\n[A-Z][a-z]+')) AS m FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""")
def grep_multiline(spark, d):
    return T.multiline(table(spark, d, "documents"), ["doc_id"], "text", "\\.\\n\\n[A-Z][a-z]+").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT repo, path, content FROM files WHERE content IS NOT NULL)
SELECT repo, path, unnest(regexp_extract_all(content, 'if\\s*\\(\\s*[A-Za-z0-9_$]+\\s*>\\s*[A-Za-z0-9_$]+\\s*\\)')) AS match FROM f""")
def structural_pattern(spark, d):
    files = table(spark, d, "files").select("repo", "path", "content").distinct()
    return T.structural(files, ["repo", "path"], "content", "if ( $A > $B )").select("repo", "path", "match")


@query("""WITH f AS (SELECT DISTINCT repo, path FROM files) SELECT repo, path FROM f WHERE (ends_with(path, '.py') OR ends_with(path, '.rb')) AND NOT starts_with(path, 'tests/')""")
def find_by_globs(spark, d):
    files = table(spark, d, "files").select("repo", "path").distinct()
    return files.where(T.glob_match("path", "*.{py,rb}") & ~T.glob_match("path", "tests/**"))


@query("""SELECT DISTINCT repo, path FROM files WHERE starts_with(path, 'src/') AND NOT regexp_matches(path, '(^|/)codegen/')""")
def grep_overrides(spark, d):
    return table(spark, d, "files").where(T.overrides("path", ["src/**", "!codegen"])).select("repo", "path").distinct()


@query("""SELECT DISTINCT repo, path FROM files WHERE regexp_matches(lower(path), '(^|/)[^/]*lock[^/]*\\.go$')""")
def rule_matches_path(spark, d):
    return table(spark, d, "files").where(T.fnmatch("path", "*LOCK*.go") & F.col("path").rlike("(?i)[^/]*lock[^/]*$")).select("repo", "path").distinct()


@query("""SELECT repo, count(DISTINCT path) AS n FROM files WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ('ts', 'tsx', 'mts', 'cts') GROUP BY repo""")
def files_of_type(spark, d):
    return table(spark, d, "files").where(T.of_type("path", "ts")).groupBy("repo").agg(F.countDistinct("path").alias("n"))


@query(f"""WITH {LINES}, a AS (SELECT doc_id, min(line_no) AS a FROM l WHERE regexp_matches(line, '^## ') GROUP BY doc_id),
b AS (SELECT l.doc_id, min(l.line_no) AS b FROM l JOIN a USING (doc_id) WHERE l.line_no > a AND regexp_matches(line, '^## ') GROUP BY l.doc_id)
SELECT l.doc_id, l.line_no, l.line FROM l JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) WHERE l.line_no >= a AND (b IS NULL OR l.line_no <= b)""")
def read_between(spark, d):
    return T.between(doc_lines(spark, d), ["doc_id"], "^## ", "^## ")


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM l WHERE line_no BETWEEN 3 AND 5")
def read_lines(spark, d):
    return doc_lines(spark, d).where(F.col("line_no").between(3, 5))


_SOURCE = "l AS (SELECT repo, path, line_no, regexp_replace(line, chr(13) || '+$', '') AS line FROM (SELECT repo, path, unnest(p) AS line, generate_subscripts(p, 1) AS line_no, len(p) AS n FROM (SELECT DISTINCT repo, path, string_split(content, chr(10)) AS p FROM files WHERE content IS NOT NULL)) WHERE NOT (line_no = n AND line = ''))"


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return T.lines(table(spark, d, "files").select("repo", "path", "content").distinct(), ["repo", "path"], "content")


@query(f"""WITH {_SOURCE}, s AS (SELECT repo, path, min(line_no) AS stop FROM l WHERE NOT regexp_matches(line, '^\\s*(?://|#|/\\*|\\*|--|<!--)') AND trim(line) <> '' GROUP BY repo, path)
SELECT l.repo, l.path, count(*) AS n, max(CASE WHEN regexp_matches(line, '(?i)license') THEN 1 ELSE 0 END) AS licensed FROM l LEFT JOIN s USING (repo, path) WHERE (stop IS NULL OR line_no < stop) AND trim(line) <> '' GROUP BY l.repo, l.path""")
def leading_comments(spark, d):
    block = T.leading_block(source_lines(spark, d), ["repo", "path"])
    return block.groupBy("repo", "path").agg(F.count("*").alias("n"), F.max(F.col("line").rlike("(?i)license").cast("int")).alias("licensed"))


@query(f"""WITH {_SOURCE} SELECT repo, path, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS blank, count(*) FILTER (regexp_matches(line, '^\\s*(?://|#|/\\*|\\*)')) AS comments FROM l GROUP BY repo, path""")
def source_line_kinds(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return source_lines(spark, d).groupBy("repo", "path").agg(F.count("*").alias("n_lines"), n(F.trim("line") == "").alias("blank"), n(F.col("line").rlike("^\\s*(?://|#|/\\*|\\*)")).alias("comments"))


@query("""SELECT count(DISTINCT repo || '/' || path) AS n FROM files WHERE starts_with(content, '#!')""")
def shebangs(spark, d):
    return table(spark, d, "files").where(F.col("content").startswith("#!")).agg(F.countDistinct(F.concat_ws("/", "repo", "path")).alias("n"))


@query("""SELECT repo, path, len(regexp_extract_all(content, 'return ')) AS n FROM (SELECT DISTINCT repo, path, content FROM files WHERE content IS NOT NULL)""")
def pattern_counts(spark, d):
    return table(spark, d, "files").where("content is not null").select("repo", "path", "content").distinct().select("repo", "path", T.pattern_count(F.col("content"), "return ").alias("n"))


# log entries of the documents

_ISO, _CLF, _PHP, _SYS = r"(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2}):(\d{2})", r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}", r"\d{1,2}-[A-Za-z]{3}-\d{4}[ :]\d{2}:\d{2}:\d{2}", r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"


def _time(text: str) -> str:
    """The first form that gives a time, in SQL."""
    iso = f"TRY_CAST(regexp_replace(regexp_extract({text}, '{_ISO}'), '{_ISO}', '\\1-\\2-\\3 \\4:\\5:\\6') AS TIMESTAMP)"
    return f"coalesce({iso}, try_strptime(regexp_extract({text}, '{_CLF}'), '%d/%b/%Y:%H:%M:%S'), try_strptime(replace(regexp_extract({text}, '{_PHP}'), ' ', ':'), '%d-%b-%Y:%H:%M:%S'), try_strptime('1970 ' || regexp_replace(regexp_extract({text}, '{_SYS}'), '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S'))"


_STAMP = f"coalesce({_time('substring(line, 1, 64)')}, CASE WHEN starts_with(ltrim(line), '{{') THEN {_time('line')} END)"
_ENTRIES = f"""{LINES}, t AS (SELECT *, {_STAMP} AS stamp FROM l),
r AS (SELECT *, max(CASE WHEN line_no <= 200 AND (stamp IS NOT NULL OR starts_with(ltrim(line), '{{')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS framed FROM t),
o AS (SELECT *, CASE WHEN framed = 0 OR stamp IS NOT NULL OR starts_with(ltrim(line), '{{') OR line_no = 1 THEN 1 ELSE 0 END AS opens FROM r),
q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM o),
e AS (SELECT doc_id, entry, min(line_no) AS line_no, max(stamp) AS stamp, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines FROM q GROUP BY doc_id, entry)"""


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return islands.entries(doc_lines(spark, d).withColumn("stamp", S.stamp("line")), ["doc_id"], "stamp", opens=S.is_object("line"))


@query(f"WITH {_ENTRIES} SELECT doc_id, CAST(entry AS BIGINT) AS entry, line_no, n_lines, length(text) AS width FROM e")
def log_framing(spark, d):
    return log_entries(spark, d).select("doc_id", "entry", "line_no", "n_lines", F.length("text").alias("width"))


@query(f"WITH {_ENTRIES} SELECT doc_id, line_no FROM e WHERE regexp_matches(text, 'ERROR') AND (stamp IS NULL OR stamp BETWEEN TIMESTAMP '2024-03-01 00:00:00' AND TIMESTAMP '2024-06-30 23:59:59')")
def log_window(spark, d):
    since, until = (F.lit(S.window_bound(x, "2024-01-01", end)).cast("timestamp_ntz") for x, end in (("2024-03-01", False), ("2024-06-30", True)))
    w = F.col("stamp").isNull() | F.col("stamp").between(since, until)
    return log_entries(spark, d).where(F.col("text").rlike("ERROR") & w).select("doc_id", "line_no")


@query(f"WITH {_ENTRIES}, h AS (SELECT doc_id, entry, line_no, CASE WHEN regexp_matches(text, 'WARN') THEN 1 ELSE 0 END AS hit FROM e), n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY entry ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT doc_id, line_no, hit FROM n WHERE near = 1")
def log_around(spark, d):
    return islands.around(log_entries(spark, d), ["doc_id"], "entry", F.col("text").rlike("WARN"), 1).select("doc_id", "line_no", F.col("hit").cast("int").alias("hit"))


@query(f"""WITH {_ENTRIES}, h AS (SELECT doc_id, entry, line_no, stamp, CASE WHEN regexp_matches(text, 'ERROR') THEN 1 ELSE 0 END AS hit FROM e WHERE stamp IS NOT NULL),
n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY entry ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h),
k AS (SELECT *, sum(hit) OVER (ORDER BY stamp DESC, doc_id DESC, entry DESC ROWS UNBOUNDED PRECEDING) AS nth FROM n WHERE near = 1) SELECT doc_id, line_no, hit FROM k WHERE nth <= 50""")
def log_newest(spark, d):
    near = islands.around(log_entries(spark, d).where("stamp is not null"), ["doc_id"], "entry", F.col("text").rlike("ERROR"), 1)
    return islands.newest(near, ["stamp", "doc_id", "entry"], 50).select("doc_id", "line_no", F.col("hit").cast("int").alias("hit"))


@query(f"WITH {_ENTRIES} SELECT strftime(stamp, '%Y-%m') AS month, count(*) AS entries, count(DISTINCT doc_id) AS documents FROM e WHERE stamp IS NOT NULL GROUP BY 1")
def log_months(spark, d):
    return log_entries(spark, d).where("stamp is not null").groupBy(F.date_format("stamp", "yyyy-MM").alias("month")).agg(F.count("*").alias("entries"), F.countDistinct("doc_id").alias("documents"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN CAST(year(ts) AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS year FROM events""")
def log_carried_year(spark, d):
    e = table(spark, d, "events").withColumn("y", F.when(F.col("event_type") == "error", F.year("ts")))
    return e.select("event_id", islands.carried_year(e, ["user_id"], "event_id", "y").alias("year"))


# scalar functions

_P = "(SELECT DISTINCT path, coalesce(language, '') AS language FROM files)"


@query(f"""SELECT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE './' END AS directory, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem,
 regexp_extract(path, '\\.([^./]+)$', 1) AS ending, regexp_extract(path, '[^./:]*$') AS tail, len(string_split(path, '/')) AS depth,
 CASE WHEN language = 'python' THEN replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') ELSE regexp_replace(path, '\\.[^./]*$', '') END AS module,
 path = 'src' OR starts_with(path, 'src/') AS in_src FROM {_P}""")
def scalar_paths(spark, d):
    p = table(spark, d, "files").select("path", F.coalesce("language", F.lit("")).alias("language")).distinct()
    return p.select("path", S.directory_of("path").alias("directory"), S.base_name("path").alias("name"), S.stem("path").alias("stem"), S.ending("path").alias("ending"), S.tail("path").alias("tail"), S.depth("path").alias("depth"), S.file_to_module("path", "language").alias("module"), S.under("path", "src").alias("in_src"))


@query("""SELECT DISTINCT path, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') AS clean, regexp_replace(replace(path, chr(92), '/'), '^(\\./)+', '') AS normal FROM file_changes WHERE path IS NOT NULL""")
def scalar_clean_paths(spark, d):
    p = table(spark, d, "file_changes").select("path").where("path is not null").distinct()
    return p.select("path", S.clean_path("path").alias("clean"), S.normalized_path(F.translate("path", "\\", "/")).alias("normal"))


@query("""WITH x AS (SELECT DISTINCT commit_date, greatest(DATE '2025-01-01' - commit_date, 0) AS n FROM commits WHERE commit_date IS NOT NULL)
SELECT CAST(commit_date AS VARCHAR) AS commit_date, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 14 THEN n || ' days ago' WHEN n < 60 THEN (n // 7) || CASE WHEN n // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END
 WHEN n < 365 THEN (n // 30) || CASE WHEN n // 30 = 1 THEN ' month ago' ELSE ' months ago' END ELSE (n // 365) || CASE WHEN n // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS age FROM x""")
def scalar_ages(spark, d):
    return table(spark, d, "commits").select("commit_date").where("commit_date is not null").distinct().select(F.col("commit_date").cast("string").alias("commit_date"), S.age("commit_date", "2025-01-01").alias("age"))


@query("""WITH x AS (SELECT DISTINCT author_time, greatest(1735689600 - author_time, 0) AS s FROM blame_regions) SELECT author_time, CAST(CAST(DATE '1970-01-01' + CAST(author_time // 86400 AS INTEGER) AS DATE) AS VARCHAR) AS day,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 2592000 THEN (s // 86400) || 'd' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS span FROM x""")
def scalar_spans(spark, d):
    return table(spark, d, "blame_regions").select("author_time").distinct().select("author_time", S.civil_date("author_time").cast("string").alias("day"), S.humanize_seconds(F.lit(1735689600) - F.col("author_time")).alias("span"))


@query("""SELECT DISTINCT repo, path, idx, header, regexp_extract(header, '^\\s*((?:.|\\n)*?[.!?])(?:\\s|$)', 1) AS sentence, CASE WHEN length(header) <= 20 THEN header ELSE rtrim(substring(header, 1, 19)) || '…' END AS clipped, length(header) AS width FROM declarations""")
def scalar_texts(spark, d):
    return table(spark, d, "declarations").select("repo", "path", "idx", "header", S.first_sentence("header").alias("sentence"), S.clip("header", 20).alias("clipped"), S.utf16_width("header").alias("width")).distinct()


@query("""SELECT DISTINCT repo, path, idx, array_to_string(list_slice(w, 1, len(w) - 1), ' ') AS modifiers FROM (SELECT repo, path, idx, regexp_split_to_array(trim(regexp_extract(header, '^[^({]*')), '\\s+') AS w FROM declarations)""")
def scalar_modifiers(spark, d):
    return table(spark, d, "declarations").select("repo", "path", "idx", F.array_join(S.modifiers("header"), " ").alias("modifiers")).distinct()


@query("""SELECT status, CASE substring(status, 1, 1) WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' WHEN 'M' THEN 'modified' WHEN 'T' THEN 'type changed' ELSE 'unknown' END AS label, count(*) AS n FROM file_changes WHERE status IS NOT NULL GROUP BY status""")
def scalar_status(spark, d):
    return table(spark, d, "file_changes").where("status is not null").groupBy("status").agg(F.count("*").alias("n")).select("status", S.status_label("status").alias("label"), "n")


@query("""SELECT doc_id, sha256('1' || text || coalesce(source, '')) AS key FROM documents WHERE text IS NOT NULL""")
def content_keys(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.content_key("1", "text", F.coalesce("source", F.lit(""))).alias("key"))


@query(f"WITH {LINES} SELECT doc_id, line_no, substring(sha256(line), 1, 8) AS hash FROM l")
def line_hashes(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", F.substring(F.sha2("line", 256), 1, 8).alias("hash"))


@query("""SELECT file, lines, CASE WHEN lines < 1024 THEN lines || 'B' ELSE printf('%.1fK', lines / 1024.0) END AS size, c, CASE WHEN c < 10 THEN 'low' WHEN c < 30 THEN 'medium' WHEN c < 80 THEN 'high' ELSE 'critical' END AS rank
FROM (SELECT DISTINCT repo || '/' || path AS file, lines, cyclomatic_complexity AS c FROM files WHERE lines IS NOT NULL AND cyclomatic_complexity IS NOT NULL)""")
def scalar_sizes(spark, d):
    f = table(spark, d, "files").where("lines is not null and cyclomatic_complexity is not null").select(F.concat_ws("/", "repo", "path").alias("file"), "lines", F.col("cyclomatic_complexity").alias("c")).distinct()
    return f.select("file", "lines", S.format_size("lines").alias("size"), "c", S.rank_bucket("c").alias("rank"))


@query("""SELECT line_start, line_end, regexp_extract(h, '^[+](\\d+)', 1)::INTEGER AS first, line_start + n - 1 AS last FROM (SELECT DISTINCT line_start, line_end, '+' || line_start || ',' || (line_end - line_start + 1) AS h, line_end - line_start + 1 AS n FROM blame_regions)""")
def scalar_hunks(spark, d):
    b = table(spark, d, "blame_regions").select("line_start", "line_end").distinct()
    h = b.withColumn("h", S.hunk_range(F.concat(F.lit("+"), F.col("line_start"), F.lit(","), F.col("line_end") - F.col("line_start") + 1)))
    return h.select("line_start", "line_end", "h.first", "h.last")


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM l) SELECT doc_id, count(*) AS fits, max(upto) AS used FROM w WHERE upto <= 1000 GROUP BY doc_id""")
def budget_fit(spark, d):
    """The lines of each text that fit a budget of 1,000 characters, from the top."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return doc_lines(spark, d).withColumn("upto", F.sum(F.length("line") + 1).over(w)).where("upto <= 1000").groupBy("doc_id").agg(F.count("*").alias("fits"), F.max("upto").alias("used"))


QUERIES, SQL = query.queries, query.sql
