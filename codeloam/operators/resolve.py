"""Names to declarations: an index of symbols, which declarations a reference may mean, and how sure that is.

references: repo, path, language, line, name, shape (Free, Member, Static), receiver. declarations: repo, path, language,
idx, name, kind, container, line, end_line, visibility. Names meet without regard to case and within one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import same_name

TYPE_KINDS = ("class", "struct", "interface", "enum", "module", "impl", "trait", "type")


def file_local(declarations: DataFrame) -> DataFrame:
    """Adds `file_local`: seen from its file alone. Not in Rust, where modules decide, nor where a trait or interface holds it. Needs repo, path, idx, parent, visibility, kind, language."""
    holders = declarations.where("kind in ('trait', 'interface')").select("repo", "path", F.col("idx").alias("parent"), F.lit(True).alias("_held"))
    j = declarations.join(holders, ["repo", "path", "parent"], "left")
    return j.withColumn("file_local", F.coalesce(F.col("visibility") == 0, F.lit(False)) & (F.lower("language") != "rust") & F.col("_held").isNull()).drop("_held")


def symbol_reach(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(repo, path, symbol, reach): how many other files use a name that the file declares. Counted, never listed: the file's own use is taken off."""
    own = declarations.select("repo", "path", F.lower("name").alias("symbol")).where("symbol is not null").distinct()
    used = references.select("repo", "path", F.lower("name").alias("symbol")).distinct()
    n = used.groupBy("repo", "symbol").agg(F.count("*").alias("_n"))
    self = used.withColumn("_self", F.lit(1))
    j = own.join(n, ["repo", "symbol"], "left").join(self, ["repo", "path", "symbol"], "left")
    return j.select("repo", "path", "symbol", (F.coalesce("_n", F.lit(0)) - F.coalesce("_self", F.lit(0))).alias("reach"))


def symbol_counts(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(repo, symbol, defined_in, used_in): numbers of files per lower-case name."""
    n = lambda df, name: df.select("repo", F.lower("name").alias("symbol"), "path").distinct().groupBy("repo", "symbol").agg(F.count("*").alias(name))
    j = n(declarations, "defined_in").join(n(references, "used_in"), ["repo", "symbol"], "full_outer")
    return j.select("repo", "symbol", F.coalesce("defined_in", F.lit(0)).alias("defined_in"), F.coalesce("used_in", F.lit(0)).alias("used_in"))


def symbols(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(repo, symbol, defined_in, used_in): sorted files per lower-case name."""
    d = declarations.groupBy("repo", F.lower("name").alias("symbol")).agg(F.array_sort(F.collect_set("path")).alias("defined_in"))
    u = references.groupBy("repo", F.lower("name").alias("symbol")).agg(F.array_sort(F.collect_set("path")).alias("used_in"))
    none = F.array().cast("array<string>")
    return d.join(u, ["repo", "symbol"], "full_outer").select("repo", "symbol", F.coalesce("defined_in", none).alias("defined_in"), F.coalesce("used_in", none).alias("used_in"))


def shape_matches(shape: Column, kind: Column, container: Column, receiver: Column, language: Column) -> Column:
    """May a reference of this shape mean a declaration of this kind?

    Free: what is no method, types only where calling one makes it (Python, Ruby). Static: a type, or a member of the
    type named. Member: methods, and in PHP and Rust members of the receiver's type. Properties never.
    """
    is_type = kind.isin(*TYPE_KINDS)
    free = (kind != "method") & (~is_type | F.lower(language).isin("python", "ruby"))
    static = is_type | (container == receiver)
    member = (kind == "method") & (~F.lower(language).isin("php", "rust") | receiver.isNull() | (container == receiver))
    return (kind != "property") & F.when(shape == "Free", free).when(shape == "Static", F.coalesce(static, F.lit(False))).otherwise(F.coalesce(member, F.lit(False)))


def candidates(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """References with each declaration they may mean: target_path, target_idx, target_line, target_kind, local."""
    d = declarations.where("name is not null").select(
        F.col("repo").alias("d_repo"), F.lower("language").alias("d_language"), F.lower("name").alias("d_symbol"), F.col("name").alias("d_name"), F.col("path").alias("target_path"), F.col("idx").alias("target_idx"),
        F.col("line").alias("target_line"), F.col("kind").alias("target_kind"), F.col("container").alias("d_container"), F.col("visibility").alias("d_visibility"),
    )
    met = references.join(d, [F.col("repo") == F.col("d_repo"), F.lower("language") == F.col("d_language"), F.lower("name") == F.col("d_symbol")])
    fits = same_name("name", "d_name", "language") & shape_matches(F.col("shape"), F.col("target_kind"), F.col("d_container"), F.col("receiver"), F.col("language"))
    local = F.col("path") == F.col("target_path")
    # what is local to its file is seen from there alone
    out = met.where(fits).withColumn("local", local).where(local | F.coalesce(F.col("d_visibility") > 0, F.lit(True)))
    return out.drop("d_repo", "d_language", "d_symbol", "d_name", "d_container", "d_visibility")


def resolve(found: DataFrame, reference: list[str], imported: DataFrame | None = None) -> DataFrame:
    """Keeps the candidates a reference resolves to, with confidence 0 (sure), 1 (inferred) or 2 (ambiguous).

    reference names the columns of a reference; imported (repo, path, target_path, confidence) tells which files a file
    imports from. Exactly one local candidate of a free name wins. One candidate: sure in the same file without a
    receiver, else as its import, else inferred, and ambiguous for a member without an import. Several: the one imported has
    its import's confidence, several imported are ambiguous, and where none is, a member is ambiguous with all and other
    shapes give nothing.
    """
    w = Window.partitionBy(*reference)
    if imported is not None:
        i = imported.groupBy("repo", "path", "target_path").agg(F.min("confidence").alias("import_confidence"))
        found = found.join(i, ["repo", "path", "target_path"], "left")
    else:
        found = found.withColumn("import_confidence", F.lit(None).cast("int"))
    lone = found.withColumn("_locals", F.sum(F.col("local").cast("int")).over(w)).where((F.col("shape") != "Free") | (F.col("_locals") != 1) | F.col("local"))
    n, m = F.count("*").over(w), F.count("import_confidence").over(w)
    ranked = lone.withColumn("_n", n).withColumn("_m", m)
    single = F.when(F.col("local") & F.col("receiver").isNull(), 0).when(F.col("import_confidence").isNotNull(), F.col("import_confidence")).when(F.col("shape") == "Member", 2).otherwise(1)
    several = F.when((F.col("_m") == 1) & F.col("import_confidence").isNotNull(), F.col("import_confidence")).when((F.col("_m") > 1) & F.col("import_confidence").isNotNull(), 2).when((F.col("_m") == 0) & (F.col("shape") == "Member"), 2)
    return ranked.withColumn("confidence", F.when(F.col("_n") == 1, single).otherwise(several)).where("confidence is not null").drop("_n", "_m", "_locals", "import_confidence")


def resolve_plain(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """resolve(candidates()) without imports, and without spelling out candidates that come to nothing.

    A free name means its one local candidate, else the only one there is, so one row per name with a count and one per
    file and name answer it; a name that is declared everywhere is never multiplied by its references. A member with a
    receiver is ambiguous with all its candidates, however many, so nothing is counted. The rest goes the long way.
    """
    low = F.lower("language")
    key = lambda c: F.when(low == "php", F.lower(c)).otherwise(F.col(c))
    kinds = (F.col("kind") != "property") & (F.col("kind") != "method") & (~F.col("kind").isin(*TYPE_KINDS) | low.isin("python", "ruby"))
    d = declarations.where(F.col("name").isNotNull() & kinds).select("repo", low.alias("_l"), key("name").alias("_k"), "path", F.coalesce(F.col("visibility") > 0, F.lit(True)).alias("_seen"), F.struct(F.col("path").alias("target_path"), F.col("idx").alias("target_idx"), F.col("line").alias("target_line"), F.col("kind").alias("target_kind")).alias("_t"))
    anywhere = d.where("_seen").groupBy("repo", "_l", "_k").agg(F.count("*").alias("_n"), F.min("_t").alias("_only"))
    here = d.groupBy("repo", "_l", "_k", "path").agg(F.count("*").alias("_here"), F.sum((~F.col("_seen")).cast("int")).alias("_hidden"), F.min("_t").alias("_own"))
    free = references.where("shape = 'Free'").withColumn("_l", low).withColumn("_k", key("name"))
    met = free.join(anywhere, ["repo", "_l", "_k"], "left").join(here, ["repo", "_l", "_k", "path"], "left")
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_hidden", F.lit(0))
    target = F.when(F.col("_here") == 1, F.col("_own")).when((n == 1) & F.col("_here").isNull(), F.col("_only"))
    columns = [*references.columns, "target_path", "target_idx", "target_line", "target_kind", "local", "confidence"]
    sure = met.withColumn("_to", target).where("_to is not null").select(*references.columns, "_to.*", F.coalesce(F.col("_here") == 1, F.lit(False)).alias("local"))
    sure = sure.withColumn("confidence", F.when(F.col("local") & F.col("receiver").isNull(), 0).otherwise(1)).select(*columns)
    members = candidates(references.where("shape = 'Member' and receiver is not null"), declarations).withColumn("confidence", F.lit(2)).select(*columns)
    other = references.where("shape not in ('Free', 'Member') or shape = 'Member' and receiver is null")
    return sure.unionByName(members).unionByName(resolve(candidates(other, declarations), references.columns).select(*columns))


def unique_sites(sites: DataFrame) -> DataFrame:
    """One row per line and target, the strongest; folded before the shuffle."""
    keys = ["repo", "path", "line", "target_path", "target_line", "name"]
    rest = [c for c in ("confidence", "target_idx", *sites.columns) if c not in keys]
    rest = list(dict.fromkeys(rest))
    return sites.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_s")).select(*keys, "_s.*")


def without_external(references: DataFrame, bound: DataFrame) -> DataFrame:
    """Drops references to names that the file binds to something outside. bound: repo, path, name."""
    return references.join(bound.select("repo", "path", "name").distinct(), ["repo", "path", "name"], "left_anti")


def callers(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Use sites, and for declarations that have none the files that import their file. edges: repo, target_path, path, confidence; sites must hold a row per declaration searched, with a null path where there is no site."""
    used = sites.where("path is not null").select("repo", "target_path", "target_idx", "path", "line", "confidence")
    bare = sites.where("path is null").select("repo", "target_path", "target_idx").join(used.select("repo", "target_path", "target_idx"), ["repo", "target_path", "target_idx"], "left_anti")
    return used.unionByName(bare.join(edges, ["repo", "target_path"]).select("repo", "target_path", "target_idx", "path", F.lit(None).cast("int").alias("line"), "confidence"))


def named_imports(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Import rows (repo, path, module, symbol) to target files with confidence. modules: repo, module, target_path.

    Exactly one file of the module's name is sure, several are ambiguous. Where none is, files whose module ends with the
    name after a separator count: one is inferred, several are ambiguous.
    """
    keys = ["repo", "path", "module"]
    one = rows.select(*keys).distinct()
    exact = one.join(modules, ["repo", "module"])
    exact = exact.withColumn("confidence", F.when(F.count("*").over(Window.partitionBy(*keys)) == 1, 0).otherwise(2))
    rest = one.join(exact.select(*keys), keys, "left_anti")
    last = lambda c: F.regexp_extract(c, "[^./:]*$", 0)
    ends = modules.select("repo", F.col("module").alias("long"), "target_path").withColumn("tail", last("long"))
    loose = rest.withColumn("tail", last("module")).join(ends, ["repo", "tail"]).where(F.expr("endswith(long, concat('/', module)) or endswith(long, concat('.', module))")).drop("tail", "long")
    loose = loose.withColumn("confidence", F.when(F.count("*").over(Window.partitionBy(*keys)) == 1, 1).otherwise(2))
    return exact.select(*keys, "target_path", "confidence").unionByName(loose.select(*keys, "target_path", "confidence"))


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """The longest of the prefixes (prefix, root) that a name starts with, part by part: adds prefix and root, null without one.

    A name's own prefixes are spelled out and met by equality, so no row meets all prefixes.
    """
    parts = F.split(F.col(name), "[/\\\\.]")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    per = rows.select(name).distinct().withColumn("prefix", F.explode(upto))
    best = per.join(prefixes, "prefix").groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"), F.max_by("root", F.length("prefix")).alias("root"))
    return rows.join(best, name, "left")
