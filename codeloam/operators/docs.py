"""Documents along folders: the nearest one, rules, what is missing, links, fingerprints and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import pinned
from .text import glob_match


def ancestors(files: DataFrame, path: str = "path") -> DataFrame:
    """A row per folder above each file: columns `folder` and `level` (parts in it; the root is '' with 0)."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("level"), F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "/")).alias("folder")))
    return files.select("*", F.explode(up).alias("_a")).select(*files.columns, "_a.folder", "_a.level")


def nearest(files: DataFrame, docs: DataFrame, path: str = "path") -> DataFrame:
    """Adds `doc`, the document in the deepest folder above each file that has any (of several the first by name); files without one are dropped."""
    places = docs.select(F.regexp_extract(path, "^(.*)/", 1).alias("folder"), F.col(path).alias("_doc")).groupBy("folder").agg(F.min("_doc").alias("_doc"))
    met = ancestors(files, path).join(places, "folder")
    return met.groupBy(*files.columns).agg(F.max_by("_doc", "level").alias("doc"))


def nearest_folder(files: DataFrame, folders: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Adds `root`, the deepest of the folders above each file; files without one are dropped. folders: keys, folder."""
    met = ancestors(files, path).join(folders, [*keys, "folder"])
    return met.groupBy(*files.columns).agg(F.max_by("folder", "level").alias("root"))


def under(files: DataFrame, folders: list[str], path: str = "path") -> DataFrame:
    """(folder, files' columns): the files below each folder asked for; a folder without files has one row of nulls, so the caller can say so."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(f,) for f in folders], "folder string")
    inside = ancestors(files, path).where(F.col("folder").isin(folders)).select("folder", *files.columns)
    return asked.join(inside, "folder", "left")


def chain(files: DataFrame, docs: DataFrame, path: str = "path") -> DataFrame:
    """All documents in folders above each file, nearest first: `doc` and `distance`."""
    places = docs.select(F.regexp_extract(path, "^(.*)/", 1).alias("folder"), F.col(path).alias("doc")).distinct()
    depth = F.size(F.split(F.col(path), "/")) - 1
    return ancestors(files, path).join(places, "folder").select(*files.columns, "doc", (depth - F.col("level")).alias("distance"))


def first_rule(files: DataFrame, path: str, rules: dict) -> DataFrame:
    """Adds `rule`, the first in order whose glob matches; files without one are dropped. Rules are code of the caller, so they become one expression."""
    out = F.lit(None)
    for name, glob in reversed(list(rules.items())):
        out = F.when(glob_match(path, glob), F.lit(name)).otherwise(out)
    return files.withColumn("rule", out).where("rule is not null")


def missing(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(held.select(*keys).distinct(), keys, "left_anti")


def links(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, target) of the Markdown links in each text, each once."""
    found = F.regexp_extract_all(F.col(text), F.lit("\\[[^\\]\\n]*\\]\\((https?://[^)\\s]+)\\)"), F.lit(1))
    return docs.select(id_, F.explode(F.array_distinct(found)).alias("target"))


def fingerprints(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n and a fingerprint of the values of each key, whatever their order: the sum of 48 bits of each value's hash.

    Sums are formed before the shuffle, so no key is gathered.
    """
    part = F.conv(F.substring(F.sha2(value, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def fit(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Adds `state`: whole while the running size is within the budget, cut for the row that crosses it, queued after."""
    upto = running(rows, keys, order, size, "_u")
    return upto.withColumn("state", F.when(F.col("_u") <= budget, "whole").when(F.col("_u") - F.col(size) < budget, "cut").otherwise("queued")).drop("_u")


def running(rows: DataFrame, keys: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """Adds the running sum of `size` within each key in a total order, of keys of any size.

    Rows are sorted by range over all partitions; each adds up what it holds of a key, and what came before in other
    partitions (a row per partition and key that runs over several) is added to it.
    """
    placed = pinned(rows.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_part").agg(F.sum(size).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_before")).where("_before is not null")
    inside = F.sum(size).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = placed.withColumn("_inside", inside).join(offsets, [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))], "left")
    return met.select(*rows.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))


def tiers(rows: DataFrame, order: list[str], full: str, short: str, budget: int) -> DataFrame:
    """Adds `tier` to entries of a listing, the most important first: full, short (detail left out) or counted.

    Entries keep their detail while all that come before with theirs, and all after without, fit the budget; what does not
    even fit in short form is counted only. Sizes are of each entry in full and in short form.
    """
    one = rows.withColumn("_one", F.lit(1)).withColumn("_more", F.col(full) - F.col(short))
    brief = running(one, ["_one"], order, short, "_brief")
    both = running(brief, ["_one"], order, "_more", "_extra")
    room = budget - both.agg(F.sum(short)).first()[0] if both.limit(1).count() else 0
    tier = F.when(F.col("_brief") > budget, "counted").when(F.lit(room) < 0, "short").when(F.col("_extra") <= room, "full").otherwise("short")
    return both.withColumn("tier", tier).select(*rows.columns, "tier")


def front_globs(text: Column) -> Column:
    """The globs under `paths:` in a document's front matter, as an array; empty without any. Both a list of lines and one line parted by commas are read."""
    front = F.regexp_extract(text, "^---\\r?\\n([\\s\\S]*?)\\n---", 1)
    inline = F.regexp_extract(front, "(?m)^paths:[ \\t]*\\[?([^\\[\\]\\n]*)\\]?[ \\t]*$", 1)
    listed = F.regexp_extract_all(F.regexp_extract(front, "(?m)^paths:[ \\t]*\\r?\\n((?:[ \\t]*-[^\\n]*(?:\\n|$))+)", 1), F.lit("(?m)^[ \\t]*-[ \\t]*([^\\r\\n]*)"), F.lit(1))
    parts = F.when(F.trim(inline) != "", F.split(inline, ",")).otherwise(listed)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def body(text: Column) -> Column:
    """A document without its front matter."""
    return F.regexp_replace(text, "^---\\r?\\n[\\s\\S]*?\\n---[ \\t]*\\r?\\n", "")


def mentions(text: Column) -> Column:
    """Paths that a Markdown text takes in with @path at the start of a word, outside code, tags and comments."""
    bare = F.regexp_replace(text, "(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|`[^`\\n]*`|<!--.*?-->|<[a-zA-Z/][^>]*>", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("(?:^|\\s)@((?:~|\\.{1,2})?/?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)"), F.lit(1)))


def kind(path: str) -> Column:
    """What a document is, by its name."""
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    return F.when(name.rlike("^readme"), "readme").when(name.rlike("^(?:changelog|changes|history)"), "changelog").when(name.rlike("^(?:license|licence|copying)"), "licence").when(name.rlike("^contributing"), "contributing").when(name.rlike("\\.(?:md|mdx|rst|adoc|txt)$"), "document")


def includes(links: DataFrame, starts: DataFrame, most: int = 4) -> DataFrame:
    """(start, node, step): documents that each start takes in over at most `most` links. links: source, target; starts: one column."""
    from .graph import chain as follow

    return follow(links.select(F.col("source").alias("a"), F.col("target").alias("b")), starts, most)
