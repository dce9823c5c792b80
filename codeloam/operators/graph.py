"""Dependency edges: target, importer, confidence, symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import pinned

AMBIGUOUS = 2


def strongest(rows: DataFrame, order: str) -> DataFrame:
    """One edge per (target, importer), none to itself. Rows fold in order: a stronger one replaces confidence and symbol, also with no symbol; a later one fills a missing symbol."""
    seq = F.array_sort(F.collect_list(F.struct(order, "confidence", "symbol")))
    start = F.struct(F.lit(99).alias("confidence"), F.lit(None).cast("string").alias("symbol"))

    def step(acc, x):
        better = x["confidence"] < acc["confidence"]
        return F.struct(F.when(better, x["confidence"]).otherwise(acc["confidence"]).cast("int").alias("confidence"), F.when(better, x["symbol"]).otherwise(F.coalesce(acc["symbol"], x["symbol"])).alias("symbol"))

    folded = rows.where("target <> importer").groupBy("target", "importer").agg(F.aggregate(seq, start, step).alias("e"))
    return folded.select("target", "importer", "e.confidence", "e.symbol")


def importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, imported_by) of all files; ambiguous edges count for nothing."""
    n = edges.where(F.col("confidence") < AMBIGUOUS).groupBy(F.col("target").alias("path")).agg(F.count("*").alias("imported_by"))
    return files.join(n, "path", "left").withColumn("imported_by", F.coalesce("imported_by", F.lit(0)))


def imports(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("confidence") < AMBIGUOUS).groupBy(F.col("importer").alias("path")).agg(F.count("*").alias("imports"))


def folder_edges(edges: DataFrame, folder_of: DataFrame) -> DataFrame:
    """Per folder: importers from outside, imports to outside and the sorted folders imported. folder_of: path, folder."""
    sure = edges.where(F.col("confidence") < AMBIGUOUS)
    a, b = folder_of.select(F.col("path").alias("target"), F.col("folder").alias("to_folder")), folder_of.select(F.col("path").alias("importer"), F.col("folder").alias("from_folder"))
    out = sure.join(a, "target").join(b, "importer").where("to_folder <> from_folder")
    into = out.groupBy(F.col("to_folder").alias("folder")).agg(F.countDistinct("importer").alias("imported_by"))
    from_ = out.groupBy(F.col("from_folder").alias("folder")).agg(F.countDistinct("target").alias("imports"), F.array_sort(F.collect_set("to_folder")).alias("imported_folders"))
    return into.join(from_, "folder", "full_outer").select("folder", F.coalesce("imported_by", F.lit(0)).alias("imported_by"), F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("imported_folders", F.array().cast("array<string>")).alias("imported_folders"))


def _turned(edges: DataFrame, reverse: bool) -> DataFrame:
    """(a, b): from a one step leads to b. reverse: to those that import a."""
    return edges.select(F.col("target" if reverse else "importer").alias("a"), F.col("importer" if reverse else "target").alias("b")).distinct()


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = True) -> DataFrame:
    """(start, node, depth): what can be reached from each start, at its least depth; a start never reaches itself.

    Level by level: the frontier meets the edges, and what was seen stays out. Ambiguous edges lead on like any other.
    Each level is written to the shared folder.
    """
    one = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start"))
    return _levels(_turned(edges, reverse), one, "start", max_depth)


def _levels(step: DataFrame, seeds: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(start, node, depth > 0). What was seen of a node pair is one table that grows by a level at a time, kept apart by start."""
    seen = pinned(seeds.withColumn("depth", F.lit(0)).repartition(start))
    frontier = seen
    for depth in range(1, max_depth + 1):
        grown = frontier.join(step, F.col("node") == F.col("a")).select(start, F.col("b").alias("node"), F.lit(depth).alias("depth"))
        # a pair seen before keeps its lesser depth; one aggregation drops repeats and what is known
        met = grown.unionByName(seen).groupBy(start, "node").agg(F.min("depth").alias("depth"))
        seen = pinned(met)
        frontier = seen.where(F.col("depth") == depth)
        if depth == max_depth or not frontier.limit(1).count():
            break
    return seen.where("depth > 0").select(start, "node", "depth")


def reachable_of(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = True) -> DataFrame:
    """(symbol, node, depth): what is reached from the files of each symbol; starts: symbol, start. The files themselves count if another of them leads there."""
    step = _turned(edges, reverse)
    first = starts.join(step, F.col("start") == F.col("a")).select("symbol", F.col("b").alias("node")).distinct().withColumn("depth", F.lit(1))
    level = out = pinned(first)
    for depth in range(2, max_depth + 1):
        level = pinned(level.join(step, F.col("node") == F.col("a")).select("symbol", F.col("b").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        out = out.unionByName(level)
    return out.groupBy("symbol", "node").agg(F.min("depth").alias("depth"))


def ranked_by_reach(edges: DataFrame, max_depth: int, limit: int, reverse: bool = True) -> DataFrame:
    """Subjects by how much they reach without ambiguous edges: subject, direct, transitive; most transitive, most direct, then the last name first."""
    sure = edges.where(F.col("confidence") < AMBIGUOUS)
    subjects = sure.select(F.col("target" if reverse else "importer").alias("subject")).distinct()
    reach = reachable(sure, subjects, max_depth, reverse).groupBy(F.col("start").alias("subject")).agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("direct"), F.count("*").alias("transitive"))
    return reach.orderBy(F.desc("transitive"), F.desc("direct"), F.desc("subject")).limit(limit)


def named_symbols(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(target, symbol): the symbol that the first importer by name gave, dropped where the target does not declare it. declared: target, symbol."""
    first = edges.where("symbol is not null").groupBy("target").agg(F.min_by("symbol", "importer").alias("symbol"))
    known = declared.select("target", "symbol").distinct().withColumn("_k", F.lit(1))
    return first.join(known, ["target", "symbol"], "left").select("target", F.when(F.col("_k") == 1, F.col("symbol")).alias("symbol"))


def top_importers(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(target, importer, their_importers): who imports each file, at most `limit`, those imported most themselves first."""
    n = edges.where(F.col("confidence") < AMBIGUOUS).groupBy(F.col("target").alias("importer")).agg(F.count("*").alias("their_importers"))
    all_ = edges.select("target", "importer").join(n, "importer", "left").select("target", "importer", F.coalesce("their_importers", F.lit(0)).alias("their_importers"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("their_importers"), "importer"))
    return all_.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r")


def chain(links: DataFrame, start: DataFrame, max_steps: int) -> DataFrame:
    """(start, node, step): follows links a -> b from each start; a repeated node ends its chain, as does a node without a link."""
    return reachable(links.select(F.col("a").alias("importer"), F.col("b").alias("target")), start, max_steps, reverse=False).withColumnRenamed("depth", "step")
