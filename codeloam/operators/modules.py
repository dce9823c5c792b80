"""Imports to files by module path: relative and absolute names, package files, suffixes, and declared symbols as a last resort.

imports: repo, path, language, module, symbol. files: repo, path, language. Every name a file can be imported by is
spelled out, as is every path an import may mean, so both meet by equality; a suffix meets by its last part first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S

#: Names of files that stand for their folder.
PACKAGE_FILES = ("__init__", "index", "mod")
_FAMILY = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript"}


def family(language: Column) -> Column:
    """Languages whose files import each other count as one."""
    low = F.lower(language)
    out = low
    for name, of in _FAMILY.items():
        out = F.when(low == name, of).otherwise(out)
    return out


def python_absolute(module: Column, path: Column) -> Column:
    """The dotted module that a relative one names from a file: one dot is the file's package, each further dot its parent; null above the root."""
    dots = F.length(F.regexp_extract(module, "^\\.*", 0))
    folder = F.filter(F.split(F.regexp_extract(path, "^(.*)/", 1), "/"), lambda x: x != "")
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(module, "^\\.+", ""), "\\."), lambda x: x != "")
    return F.when(dots == 0, module).when(dots - 1 <= F.size(folder), F.array_join(F.concat(up, rest), "."))


def names_of(files: DataFrame) -> DataFrame:
    """(repo, family, name, target_path): what a file is imported by, with slashes: its path, the path without ending, and of a package file the folder."""
    bare = F.regexp_replace("path", "\\.[^./]*$", "")
    folder = F.regexp_extract("path", "^(.*)/", 1)
    names = F.array("path", bare, F.when(S.stem("path").isin(*PACKAGE_FILES), folder))
    return files.select("repo", family(F.col("language")).alias("family"), F.explode(F.array_distinct(F.array_compact(names))).alias("name"), F.col("path").alias("target_path")).where("name <> ''")


def _joined(path: Column, module: Column) -> Column:
    return S.normalized_path(F.concat(F.regexp_extract(path, "^(.*/)?", 0), module))


def wanted(imports: DataFrame) -> DataFrame:
    """The paths an import may mean, best first: the columns of an import, place and name (with slashes), and whether it stands for a path from the root or for its end."""
    language, module, symbol, path = F.lower("language"), F.col("module"), F.col("symbol"), F.col("path")
    slashed = lambda c, sep: F.replace(c, F.lit(sep), F.lit("/"))
    absolute = python_absolute(module, path)
    python = F.array(slashed(F.concat_ws(".", absolute, symbol), "."), slashed(absolute, "."))
    relative = module.startswith("./") | module.startswith("../") | module.isin(".", "..")
    script = F.when(relative, F.array(_joined(path, module)))
    php = F.array(slashed(F.concat_ws("\\", module, symbol), "\\"), slashed(module, "\\"))
    java = F.array(slashed(F.concat_ws(".", module, symbol), "."), slashed(module, "."))
    inner = F.regexp_replace(F.regexp_replace(F.concat_ws("::", module, symbol), "^(?:crate|self)::", ""), "^(?:super::)+", "")
    parts = F.split(inner, "::")
    rust = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    near = F.array(_joined(path, module), module)
    names = F.when(language == "python", python).when(family(language) == "javascript", script).when(language == "php", php).when(language == "java", java).when(language == "rust", rust).when(language.isin("ruby", "c", "lua", "bash"), near).otherwise(F.array(module))
    return imports.select("*", F.posexplode(names).alias("place", "name")).where("name is not null and name <> ''")


def resolved(imports: DataFrame, files: DataFrame, declared: DataFrame, mapped: tuple[str, ...] = ()) -> DataFrame:
    """(repo, path, language, module, symbol, target_path, confidence, named): the files each import means, none of them itself.

    One file by path is sure (0), several are ambiguous (2). Where no path leads anywhere, the files of the same language
    that declare the symbol count: one is inferred (1), several are ambiguous; languages in `mapped` have manifests that
    tell all paths and never fall back. named is the symbol where the target declares it, else null. declared: repo,
    path, language, name. Null modules and languages resolve to nothing; equal imports count once.
    """
    key = ["repo", "path", "language", "module", "symbol"]
    one = imports.where("module is not null and language is not null").select(*key).distinct()
    paths = wanted(one).withColumn("family", family(F.col("language")))
    names = names_of(files.where("language is not null"))
    same = F.xxhash64(*key)  # a number for an import, whose symbol may be null
    exact = paths.join(names, ["repo", "family", "name"]).withColumn("how", F.lit(0))
    tail = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    ends = names.select("repo", "family", F.col("name").alias("long"), tail("name").alias("tail"), "target_path")
    # a relative path of a script is a whole path; all others may be the end of one
    loose = paths.where("family <> 'javascript'").withColumn("tail", tail("name")).join(ends, ["repo", "family", "tail"]).where(F.expr("endswith(long, concat('/', name))")).withColumn("how", F.lit(1))
    met = exact.select(*key, "place", "how", "target_path").unionByName(loose.select(*key, "place", "how", "target_path")).where("target_path <> path").withColumn("_i", same)
    best = met.groupBy("_i").agg(F.min(F.struct("place", "how")).alias("_b"))
    by_path = met.join(best, "_i").where(F.struct("place", "how") == F.col("_b")).select(*key, "_i", "target_path").distinct()
    n = F.count("*").over(Window.partitionBy("_i"))
    sure = by_path.withColumn("confidence", F.when(n == 1, 0).otherwise(2))
    known = declared.where("name is not null").select("repo", family(F.col("language")).alias("family"), F.col("name").alias("symbol"), F.col("path").alias("target_path")).distinct()
    rest = one.where(F.col("symbol").isNotNull() & ~F.lower("language").isin(*mapped, "")).withColumn("_i", same).join(by_path.select("_i").distinct(), "_i", "left_anti")
    fallback = rest.withColumn("family", family(F.col("language"))).join(known, ["repo", "family", "symbol"]).where("target_path <> path").withColumn("confidence", F.when(n == 1, 1).otherwise(2))
    out = sure.select(*key, "target_path", "confidence").unionByName(fallback.select(*key, "target_path", "confidence"))
    says = known.select("repo", "symbol", "target_path", F.col("symbol").alias("named"))
    return out.join(says, ["repo", "symbol", "target_path"], "left").select(*key, "target_path", "confidence", "named")


def supertypes(declarations: DataFrame) -> DataFrame:
    """(repo, path, idx, name, supertype): the types that the head of a type names after extends, implements, a colon or, in Python, in brackets."""
    head = F.regexp_replace("header", "<[^<>]*>", "")
    after = F.concat_ws(",", F.regexp_extract(head, "\\bextends\\s+([^{]*?)(?:\\bimplements\\b|\\{|$)", 1), F.regexp_extract(head, "\\bimplements\\s+([^{]*)", 1), F.regexp_extract(head, "^\\s*class\\s+\\w+\\s*\\(([^)]*)\\)\\s*:", 1), F.regexp_extract(head, "^\\s*class\\s+\\w+\\s*<\\s*([\\w:]+)", 1))
    names = F.filter(F.transform(F.split(after, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[\\w.:\\\\]+$"))
    types = declarations.where("kind in ('class', 'interface', 'trait', 'struct', 'enum')")
    return types.select("repo", "path", "idx", "name", F.explode(F.array_distinct(names)).alias("supertype"))


def lineage(inherits: DataFrame, most: int = 16) -> DataFrame:
    """(repo, type, supertype, distance): all types above each type, at their least distance; a type above itself stays out. inherits: repo, name, supertype."""
    from .graph import reachable

    name = lambda c: F.concat_ws("\u0001", "repo", c)
    edges = inherits.select(name("name").alias("importer"), name("supertype").alias("target")).distinct()
    up = reachable(edges, edges.select("importer").distinct(), most, reverse=False)
    part = lambda c, k: F.split(c, "\u0001")[k]
    return up.select(part("start", 0).alias("repo"), part("start", 1).alias("type"), part("node", 1).alias("supertype"), F.col("depth").alias("distance"))


def declaring(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Of the members of a name in a type and above it, those nearest to the type: repo, type, member, declared_in, distance. members: repo, type, member."""
    own = members.select("repo", "type", "member", F.col("type").alias("declared_in"), F.lit(0).alias("distance"))
    above = lines.join(members.withColumnRenamed("type", "supertype"), ["repo", "supertype"]).select("repo", "type", "member", F.col("supertype").alias("declared_in"), "distance")
    all_ = own.unionByName(above).distinct()
    nearest = F.rank().over(Window.partitionBy("repo", "type", "member").orderBy("distance"))
    return all_.withColumn("_r", nearest).where("_r = 1").drop("_r")


def stems_named(names: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, name, path): files whose stem is the name, without regard to case, for names that nothing declares. names: repo, name."""
    bare = names.join(declared.select("repo", "name").distinct(), ["repo", "name"], "left_anti").withColumn("_s", F.lower("name"))
    return bare.join(files.select("repo", "path", F.lower(S.stem("path")).alias("_s")), ["repo", "_s"]).select("repo", "name", "path").distinct()


def resolved_at(sites: DataFrame) -> DataFrame:
    """Lines with exactly one site that is not ambiguous and means a function: repo, path, line, target_path, target_idx. sites: with target_kind and confidence."""
    w = Window.partitionBy("repo", "path", "line")
    return sites.where("confidence < 2").withColumn("_n", F.count("*").over(w)).where("_n = 1 and target_kind in ('function', 'method')").select("repo", "path", "line", "target_path", "target_idx")


def after_binding(uses: DataFrame, bound: DataFrame) -> DataFrame:
    """Adds `full`: a path whose first part is a bound name, spelled out from what the name stands for. uses: repo, path, name (parts by ::); bound: repo, path, local, module."""
    first = F.regexp_extract("name", "^(.*?)(?:::|$)", 1)
    met = uses.withColumn("local", first).join(bound, ["repo", "path", "local"], "left")
    rest = F.substring(F.col("name"), F.length("local") + 1, F.length("name"))
    return met.withColumn("full", F.when(F.col("module").isNotNull(), F.concat("module", rest)).otherwise(F.col("name"))).drop("local", "module")
