"""Relations read from files: source trees, logs and version-control listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S

#: Folders that hold what is built, fetched or private to tools.
SKIPPED = (".git", ".next", ".venv", "__pycache__", "build", "dist", "node_modules", "venv", "vendor")


def _relative(root: str) -> F.Column:
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    path = F.regexp_replace("path", "^file:/*", "/")
    return F.substring(path, F.instr(path, base) + len(base), F.length(path))


def source_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size_bytes, modified, content) of the files below root, paths relative, without skipped folders. Content is null where it is not text (a NUL in its first 8,000 bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    inside = rows.where(~F.col("path").rlike("(^|/)(" + "|".join(s.replace(".", "\\.") for s in skip) + ")/"))
    text = F.decode("content", "UTF-8")
    return inside.withColumn("content", F.when(F.instr(F.hex(F.substring("content", 1, 8000)), "00") % 2 != 1, text))


def nested_repositories(paths: DataFrame) -> DataFrame:
    """Folders that hold a .git of their own, from a listing with column path."""
    return paths.select(F.regexp_extract("path", "^(.*)/\\.git/", 1).alias("folder")).where("folder <> ''").distinct()


def tracked(listed: DataFrame, untracked: DataFrame, deleted: DataFrame) -> DataFrame:
    """Listed paths and untracked ones, each once, without those deleted on disk."""
    return listed.select("path").union(untracked.select("path")).distinct().join(deleted.select("path"), "path", "left_anti")


def log_lines(spark: SparkSession, root: str, glob: str = "*.log*") -> DataFrame:
    """(file, file_date, line_no, line, stamp) of log files, also compressed ones. NULs and trailing carriage returns go.

    Each file is read as one text so that lines keep their numbers; the date in the file's name is there to prune by.
    """
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = texts.select(_relative(root).alias("file"), F.replace("value", F.lit("\u0000"), F.lit("")).alias("value"))
    from ..operators.text import lines

    return lines(rows.withColumn("file_date", S.date_in_name("file")), ["file", "file_date"], "value").withColumn("stamp", S.stamp("line"))


def commit_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits and file_changes from a log in which records begin with \\x01 and their fields are parted by NUL.

    raw: (repo, value). A record holds id, date, author, subject and parents, then raw changes, each as
    `:modes old new status`, NUL, path and, for renames and copies, NUL and a second path. Blobs of zeros are null.
    """
    records = raw.select("repo", F.posexplode(F.filter(F.split("value", "\u0001"), lambda x: F.trim(x) != "")).alias("pos", "record"))
    parts = records.withColumn("f", F.split("record", "\u0000"))
    commits = parts.select("repo", F.col("f")[0].alias("commit_id"), "pos", F.to_date(F.col("f")[1]).alias("commit_date"), F.col("f")[2].alias("author"), F.col("f")[3].alias("subject"), (F.size(F.split(F.trim(F.col("f")[4]), " ")) > 1).alias("is_merge"))
    rest = parts.select("repo", F.col("f")[0].alias("commit_id"), F.slice("f", F.lit(6), F.size("f")).alias("f"))
    at = F.filter(F.transform("f", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"].startswith(":"))
    heads = rest.select("repo", "commit_id", "f", F.posexplode(at).alias("seq", "s"))
    words = F.split(F.col("s.x"), " ")
    blob = lambda c: F.when(~c.rlike("^0+$"), c)
    two = F.col("status").isin("R", "C")
    first, second = F.col("f")[F.col("s.i") + 1], F.get("f", F.col("s.i") + 2)
    changes = heads.select("repo", "commit_id", "seq", "f", "s", F.substring(words[4], 1, 1).alias("status"), blob(words[2]).alias("old_blob"), blob(words[3]).alias("new_blob"))
    return commits, changes.select("repo", "commit_id", "seq", "status", F.when(two, second).otherwise(first).alias("path"), F.when(two, first).alias("from_path"), "old_blob", "new_blob")


def porcelain(raw: DataFrame) -> DataFrame:
    """(path, state, staging, from_path) from status lines 'XY path' or 'XY old -> new' in column value."""
    xy, rest = F.substring("value", 1, 2), F.substring(F.col("value"), F.lit(4), F.length("value"))
    to = F.when(rest.contains(" -> "), F.regexp_extract(rest, " -> (.*)$", 1)).otherwise(rest)
    return raw.where(F.length("value") > 3).select(to.alias("path"), S.porcelain_state(xy).alias("state"), S.staging_word(xy).alias("staging"), F.when(rest.contains(" -> "), F.regexp_extract(rest, "^(.*) -> ", 1)).alias("from_path"))
