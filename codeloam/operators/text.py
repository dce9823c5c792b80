"""Line search: lines of texts, matches, submatches, context and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Names of file types for searches and the endings they stand for.
TYPES = {
    "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"), "cs": ("cs",), "css": ("css", "scss"), "go": ("go",), "html": ("html", "htm"), "java": ("java",), "js": ("js", "jsx", "mjs", "cjs"), "json": ("json",), "kotlin": ("kt", "kts"),
    "lua": ("lua",), "markdown": ("md", "markdown", "mdx"), "md": ("md", "markdown", "mdx"), "php": ("php",), "python": ("py", "pyi"), "py": ("py", "pyi"), "ruby": ("rb",), "rust": ("rs",), "scala": ("scala",), "sh": ("sh", "bash", "zsh"), "sql": ("sql",),
    "swift": ("swift",), "toml": ("toml",), "ts": ("ts", "tsx", "mts", "cts"), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "vue": ("vue",), "xml": ("xml",), "yaml": ("yaml", "yml"),
}


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line), numbered from 1. A last line break opens no line; line ends of either kind and trailing carriage returns go; null texts have no lines."""
    parts = F.split(F.col(text), "\n", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(cut).alias("line_no", "line"))
    return rows.select(*keys, (F.col("line_no") + 1).alias("line_no"), F.regexp_replace("line", "\r+$", "").alias("line"))


def matches(column: str, pattern: str, ignore_case: bool = False, invert: bool = False, word: bool = False, whole_line: bool = False, literal: bool = False) -> Column:
    """Condition of a search with the usual switches. A pattern that is no regular expression raises at once."""
    p = re.escape(pattern) if literal else pattern
    re.compile(p)
    if whole_line:
        p = f"^(?:{p})$"
    elif word:
        p = f"(?:^|[^A-Za-z0-9_])(?:{p})(?:$|[^A-Za-z0-9_])"
    hit = F.col(column).rlike(("(?i)" if ignore_case else "") + p)
    return ~hit if invert else hit


def smart_pattern(pattern: str) -> str:
    """A pattern in lower case ignores case; one that does not compile is taken as it stands, with its case."""
    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern if pattern != pattern.lower() else f"(?i){pattern}"


def submatches(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row per match in a line: the row's columns, nth (from 1) and match."""
    return rows.select("*", F.posexplode(F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1))).alias("nth", "match")).withColumn("nth", F.col("nth") + 1)


def multiline(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, match, line_no) of matches that may span lines; line_no is that of the match's first character."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # the text before each match by itself; one walk over the pairs counts line breaks
    pairs = F.arrays_zip(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)).alias("b"), found.alias("m"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<match:string,line_no:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["line"] + breaks(x["b"])
        return F.struct((here + breaks(x["m"])).alias("line"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("match"), here.cast("int").alias("line_no")))).alias("out"))

    rows = df.where(F.col(text).rlike(pattern)).select(*keys, F.explode(F.aggregate(pairs, start, step)["out"]).alias("_m"))
    return rows.select(*keys, "_m.match", "_m.line_no")


def context(rows: DataFrame, keys: list[str], hit: Column, before: int, after: int) -> DataFrame:
    """Matching lines with arrays of the lines before and after. The window holds one text's lines."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    near = rows.withColumn("_hit", hit)
    near = near.withColumn("before", F.collect_list("line").over(w.rowsBetween(-before, -1)) if before else F.array().cast("array<string>"))
    near = near.withColumn("after", F.collect_list("line").over(w.rowsBetween(1, after)) if after else F.array().cast("array<string>"))
    return near.where("_hit").drop("_hit")


def snippet(column: str, pattern: str, width: int = 240, lead: int = 80) -> Column:
    """At most width characters of a line around its first match, starting lead before it, with ellipses where it is cut."""
    line = F.col(column)
    at = F.regexp_instr(line, F.lit(pattern))
    start = F.when(F.length(line) <= width, 1).otherwise(F.greatest(F.lit(1), at - lead))
    cut = F.substring(line, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width <= F.length(line), "…").otherwise(""))


def glob_regex(glob: str, cross: bool = False) -> str:
    """The regular expression of a glob: ** crosses folders, * and ? do only if cross; {a,b} and [seq] as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append(".*" if cross else "[^/]*")
        elif c == "?":
            out.append("." if cross else "[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: str, glob: str) -> Column:
    """A glob with a slash is matched against the whole path, any other against the file's name."""
    name = F.col(path) if "/" in glob else F.regexp_extract(path, "[^/]*$", 0)
    return name.rlike(glob_regex(glob))


def overrides(path: str, globs: list[str]) -> Column:
    """Search globs: the last that matches decides; '!' excludes, also what lies below an excluded folder. With any positive glob all else is out."""
    keep = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        bare = g.removeprefix("!").rstrip("/")
        hit = F.col(path).rlike(glob_regex(bare if "/" in bare else f"**/{bare}")) | F.col(path).rlike(glob_regex((bare if "/" in bare else f"**/{bare}") + "/**"))
        keep = F.when(hit, F.lit(not g.startswith("!"))).otherwise(keep)
    return keep


def fnmatch(path: str, pattern: str) -> Column:
    """A rule's pattern without regard to case, where * crosses folders; one without a slash is also tried on the name."""
    p = F.lower(F.col(path))
    whole = p.rlike(glob_regex(pattern.lower(), True)) | p.rlike(glob_regex("**/" + pattern.lower().removeprefix("**/"), True))
    return whole if "/" in pattern else whole | F.regexp_extract(p, "[^/]*$", 0).rlike(glob_regex(pattern.lower(), True))


def of_type(path: str, name: str) -> Column:
    """Does the path have an ending of the named type? An unknown name raises."""
    if name not in TYPES:
        raise ValueError(f"unknown type: {name}")
    return F.regexp_extract(path, "\\.([^./]+)$", 1).isin(*TYPES[name])


def literals(pattern: str) -> list[str]:
    """Words of more than one letter that every match of a structural pattern holds; $NAMES stand for anything."""
    return [w for w in re.findall(r"[A-Za-z_]\w+", re.sub(r"\$+\w*", " ", pattern))]


def structural(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """Matches of a pattern of code in which $NAME stands for one name or number and $$$ for anything in brackets.

    The words of the pattern filter the texts first; white space in the pattern stands for any white space. The result
    is that of multiline().
    """
    need = F.lit(True)
    for w in literals(pattern):
        need = need & F.col(text).contains(w)
    out = []
    for piece in re.findall(r"\$\$\$\w*|\$\w+|\s+|\w+|.", pattern):
        out.append(r"[^()\n]*" if piece.startswith("$$$") else r"[A-Za-z0-9_$]+" if piece[0] == "$" and len(piece) > 1 else r"\s*" if piece.isspace() else re.escape(piece))
    return multiline(df.where(need), keys, text, "".join(out))


def between(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Lines from the first that matches start to the first after it that matches end; to the last line if none does."""
    first = rows.groupBy(*keys).agg(F.min(F.when(F.col("line").rlike(start), F.col("line_no"))).alias("_a")).where("_a is not null")
    marked = rows.join(first, keys)
    last = marked.where((F.col("line_no") > F.col("_a")) & F.col("line").rlike(end)).groupBy(*keys).agg(F.min("line_no").alias("_b"))
    return marked.join(last, keys, "left").where("line_no >= _a and (_b is null or line_no <= _b)").drop("_a", "_b")


def leading_block(rows: DataFrame, keys: list[str], comment: str = r"^\s*(?://|#|/\*|\*|--|<!--)") -> DataFrame:
    """The comment lines a text opens with: everything before its first line that is neither comment nor blank."""
    first = rows.where(~F.col("line").rlike(comment) & (F.trim("line") != "")).groupBy(*keys).agg(F.min("line_no").alias("_stop"))
    return rows.join(first, keys, "left").where((F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))) & (F.trim("line") != "")).drop("_stop")


def pattern_count(column: Column, pattern: str) -> Column:
    """Matches in a text; -1 for a binary one, which has a NUL in its first 8,000 characters."""
    return F.when(F.substring(column, 1, 8000).contains("\u0000"), -1).otherwise(F.regexp_count(column, F.lit(pattern)))
