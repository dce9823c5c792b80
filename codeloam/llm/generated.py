"""Generated, minified and vendored source files, and data blobs saved as code.

Files become sets of five-token shingles, once with all identifiers, numbers and strings masked and once as they stand.
MinHash signatures of the sets are cut into bands; files that share a band meet in a bucket, and a scan over each bucket
verifies by the signatures (128 values) that their similarity is 0.8 or more. Masked families whose members repeat one
shape indicate generation (or, if they are few long lines, a minifier), masked families of literals alone indicate blobs,
and unmasked clusters across repositories indicate vendoring. A file without relatives in the corpus is a family of one
and needs a clearer shape; what says of itself that it is output or a copy counts as such without a family.

Buckets are scanned in salted parts of bounded size, and only the leaders of clusters go on to the next round, so a family
that holds any share of all files is never gathered. Rounds only save comparisons: clusters of a crowded bucket that lack
company after them are compared with all files of other clusters in it, tile by tile, so that no link is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import changed, stored, whole_groups

#: Tokens in a shingle, values in a signature, bands of it, and the least similarity.
SHINGLE, PERMUTATIONS, BANDS, SIMILAR = 5, 128, 16, 0.8
#: Values of a signature in each band: the first ROWS of its slice.
ROWS = 4
#: Files of one bucket that are compared in one task.
PART = 512
#: Rounds of leaders at most, and files in a tile of what they leave.
ROUNDS, TILE = 6, 4096
#: Equal values in similar signatures, at least. They differ in fewer values than there are stretches, so one stretch is equal.
EQUAL = math.ceil(SIMILAR * PERMUTATIONS)
STRETCHES = PERMUTATIONS - EQUAL + 1

#: Words that languages reserve; they stay when identifiers are masked.
RESERVED = frozenset(
    """abstract and as async await begin bool boolean break byte case catch char class const continue crate def default defer do double echo else elsif elif end enum except
    export extends extern false final finally float fn for foreach from func function global go if impl implements import in include instanceof int interface is lambda let
    long match mod module mut namespace new nil None not null number of operator or package pass private protected pub public raise ref require return self short static
    string String struct super switch template this throw trait true True False try type typedef typeof union unless unsafe unsigned until use val var virtual void when where while with yield""".split()
)

_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?<![\w$])\#(?![\[{])[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[^\W\d][\w$]*|\$\w+|\d[\w.]*|[^\s\w]")
_COMMENT, _STRING, _NAME, _NUMBER, _MARK = range(5)

#: How generators, bundlers and copied files speak of themselves.
_OUTPUT = re.compile(
    r"\b(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using)\b|@generated\b|<auto-?generated|\bgenerated (?:file|code|source)s?\b|\bmachine[- ](?:written|generated|made)\b|\bdo not (?:edit|modify|change|touch)(?: (?:this|the generated) (?:file|code)| manually| by hand|[ \t]*(?:[.:!;,]|$))|"
    r"\b(?:hand|manual) edits (?:are|will be) (?:lost|overwritten)|\bchanges (?:will be|are) (?:lost|overwritten)\b|\boutput of \S+",
    re.I | re.M,
)
_COPY = re.compile(r"\bcopied (?:unchanged |verbatim )?from\b|\bkeep in step with upstream\b|\bupstream:\s*\S|\bvendored (?:from|copy)\b|^!?\s*[\w.@/-]+ - v?\d+\.\d+[\d.]* \||^[\w.@/-]+ v?\d+\.\d+[\d.]* \(c\) |\bthe [\w-]+ authors\b", re.I | re.M)
#: Folders that hold packages of others, each package in a folder of its own.
_PACKAGES = re.compile(r"(?:^|/)(?:vendor|_vendor|node_modules|third_party|thirdparty|3rdparty|external|deps|bower_components|Pods)/(?=[^/]*[-@.][^/]*/)[^/]+/")
_COMMENT_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/?|//+!?|#+|--+|<!--)?\s*|\s*(?:\*+/|-->)\s*$")


def kind_of(t: str) -> int:
    c = t[0]
    if c.isalpha() or c == "_" or c == "$" and len(t) > 1:
        return _NAME
    if c.isdigit():
        return _NUMBER
    if c in "\"'`" and len(t) > 1:
        return _STRING
    return _COMMENT if t[:2] in ("//", "/*") or c == "#" and len(t) > 1 else _MARK


class Vocabulary:
    """Numbers for tokens met so far, and by number the kind, the length and the codes of the token as it stands and masked."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.kind, self.length = np.empty(1024, np.int8), np.empty(1024, np.int64)
        self.plain, self.masked = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def add(self, t: str, kind: int) -> int:
        import xxhash

        i = self.number[t] = len(self.number)
        if i == len(self.kind):
            self.kind, self.length, self.plain, self.masked = (np.resize(x, 2 * i) for x in (self.kind, self.length, self.plain, self.masked))
        shown = t if kind == _MARK or kind == _NAME and t in RESERVED else {_STRING: "s", _NAME: "i", _NUMBER: "n"}[kind]
        self.kind[i], self.length[i] = kind, len(t)
        self.plain[i], self.masked[i] = xxhash.xxh64_intdigest(t), xxhash.xxh64_intdigest("\0" + shown)
        return i

    def read(self, text: str) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Numbers of the tokens but comments, and the comments with the number of tokens before each."""
        if len(self.number) > self.most:
            self.clear()
        known, out, comments = self.number.get, [], []
        for t in _TOKEN.findall(text):
            i = known(t)
            if i is None:
                kind = kind_of(t)
                if kind == _COMMENT:
                    comments.append((len(out), t))
                    continue
                i = self.add(t, kind)
            out.append(i)
        return np.array(out, np.int64), comments


def _runs(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of the runs of `size` tokens."""
    n = len(codes) - size + 1
    if n <= 0:
        return codes[:0]
    out = codes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
    out ^= out >> np.uint64(29)
    return out


_RANDOM = np.random.default_rng(11)
_A = _RANDOM.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signature(h: np.ndarray, least: int = 8) -> np.ndarray | None:
    """The least value of each permutation; none for fewer than `least` different codes."""
    h = np.unique((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    if len(h) < least:
        return None
    out = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(h), 2048):
        out = np.minimum(out, (_A[:, None] * h[None, k : k + 2048] + _B[:, None]).min(axis=1))
    return out


def _repetition(wide: np.ndarray, block: int = 256) -> float:
    """Share of the masked runs that come again within their block, so that long files are judged like short ones."""
    again = sum(len(x) - len(np.unique(x)) for x in (wide[k : k + block] for k in range(0, len(wide), block)))
    return again / len(wide) if len(wide) else 0.0


def _says(comments: list[tuple[int, str]], n_tokens: int, lines: list[str]) -> tuple[bool, bool]:
    """Does a comment before the first token or after the last, or in the first eight lines with text or the last three, say that the file is output, or a copy?"""
    output = copy = False
    near = ("\n".join(lines[:8]), "\n".join(lines[-3:]))
    for k, c in comments:
        if k in (0, n_tokens) or any(c in x for x in near):
            body = "\n".join(_COMMENT_MARK.sub("", x) for x in c.split("\n"))
            if _about_file(body):
                output = output or bool(_OUTPUT.search(body))
            copy = copy or bool(_COPY.search(body))
    return output, copy


def _about_file(body: str) -> bool:
    """Not a mere stub note or a request to colleagues."""
    return not re.search(r"\bgenerated stub\b|\bwithout asking\b|\bdo not \w+ these\b", body, re.I)


def features(path: str | None, text: str, words: Vocabulary) -> dict:
    """What one file shows by itself, and its signatures: the plain one from 40 tokens on, the masked one if any shape stands out.

    Written code of one language shares most masked shingles with thousands of other files, which would all be candidates
    of each other; a family indicates something only where its members repeat a shape, are long lines or literals, so
    files with none of this at all are left out of the masked side.
    """
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    at, comments = words.read(text[5:] if text.startswith("<?php") else text)
    kind, length, plain, masked = (x[at] for x in (words.kind, words.length, words.plain, words.masked))
    lines = [x for x in text.split("\n") if x.strip()]
    all_ = sum(map(len, lines))
    repeat = _repetition(_runs(masked, 20))
    is_literal = (kind == _STRING) | (kind == _NUMBER)
    literal, dense = float(length[is_literal].sum() / max(1, length.sum())), sum(len(x) for x in lines if len(x) > 200) / max(1, all_)
    output, copy = _says(comments, len(at), lines)
    return {
        "repeat": repeat, "n_tokens": len(at), "literal": literal, "logic": float((kind == _NAME).sum() / max(1, len(at))), "dense": dense,
        "says_output": output, "says_copy": copy or bool(_PACKAGES.search(path or "")),
        "masked": signature(_runs(masked, SHINGLE), 4) if max(repeat, literal, dense) >= 0.3 and len(at) >= 20 else None, "plain": signature(_runs(plain, SHINGLE)) if len(at) >= 40 else None,
    }


_FEATURES = "repo string, path string, repeat double, n_tokens int, literal double, logic double, dense double, says_output boolean, says_copy boolean, masked binary, plain binary"


def _featured(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for batch in batches:
            rows = batch.to_pylist()
            fs = [features(r["path"], r["content"], words) for r in rows]
            columns = [pa.array([r["repo"] for r in rows], pa.string()), pa.array([r["path"] for r in rows], pa.string())]
            for name, kind in (("repeat", pa.float64()), ("n_tokens", pa.int32()), ("literal", pa.float64()), ("logic", pa.float64()), ("dense", pa.float64()), ("says_output", pa.bool_()), ("says_copy", pa.bool_())):
                columns.append(pa.array([f[name] for f in fs], kind))
            for name in ("masked", "plain"):
                columns.append(pa.array([None if f[name] is None else f[name].tobytes() for f in fs], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["repo", "path", "repeat", "n_tokens", "literal", "logic", "dense", "says_output", "says_copy", "masked", "plain"])

    return files.select("repo", "path", "content").where("content is not null").mapInArrow(run, _FEATURES)


def _crowded(sketched: DataFrame, sketch: str, across: bool) -> DataFrame:
    """(bucket, id, home, sketch) of the files that share a band with others, if across with one of another repository.

    Bands are counted as numbers alone; signatures follow only where there is company.
    """
    width = 4 * (PERMUTATIONS // BANDS)
    rows = sketched.where(F.col(sketch).isNotNull()).select("repo", "path", F.col(sketch).alias("sketch"), F.xxhash64("repo", "path").alias("id"))
    light = rows.select("id", F.xxhash64("repo").alias("home"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k"))
    light = light.select(F.xxhash64("k", F.expr(f"substring(sketch, k * {width} + 1, {4 * ROWS})")).alias("bucket"), "id", "home").distinct()
    sizes = light.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("home") != F.max("home")).alias("homes"))
    company = light.join(sizes.where("n > 1" + (" and homes" if across else "")), "bucket")
    return company.select("bucket", "id", "home").join(rows.select("id", "sketch"), "id")


def _scan(rows: DataFrame) -> DataFrame:
    """Clusters each (bucket, part), at most PART files but for salting: all pairs that are alike by signature are linked, and linked files are one cluster. A row per file with its leader, the first of its cluster; leaders keep their signatures."""
    keys = ["bucket", "part"]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        cuts = [0, *([i + 1 for i, x in enumerate(changed(table, keys).to_pylist()) if x] if n > 1 else []), n]
        buckets, ids, homes, sketches = (table.column(c).to_pylist() for c in ("bucket", "id", "home", "sketch"))
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts, cuts[1:]):
            s = np.frombuffer(b"".join(sketches[a:b]), np.uint32).reshape(b - a, PERMUTATIONS)
            lead = np.arange(b - a)
            for i in range(1, b - a):
                like = lead[:i][(s[:i] == s[i]).mean(axis=1) >= SIMILAR]
                if len(like):
                    first = like.min()
                    lead[i] = first
                    if len(like) > 1:
                        lead[: i + 1][np.isin(lead[: i + 1], like)] = first
            for i, h in enumerate(lead.tolist()):
                for column, v in zip(out, (buckets[a + i], ids[a + i], homes[a + i], ids[a + h], sketches[a + i] if h == i else None)):
                    column.append(v)
        arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield from pa.Table.from_arrays(arrays, names=["bucket", "id", "home", "leader", "sketch"]).to_batches(max_chunksize=10_000)

    ordered = rows.select("bucket", "part", "id", "home", "sketch").repartition(*keys).sortWithinPartitions(*keys, "id")
    return ordered.mapInArrow(whole_groups(keys, run), "bucket long, id long, home long, leader long, sketch binary")


def similar_files(sketched: DataFrame, sketch: str, across: bool) -> DataFrame:
    """(repo, path) of files in a cluster with a verified similar file, of another repository if across, else anywhere.

    Crowded buckets are scanned in salted parts of PART files, and what leads a cluster in its part goes on to the next
    round, until a bucket fits one part or ROUNDS are over. What these rounds did not compare is compared by _missed.
    Rounds are counted on the driver.
    """
    level, members, crowded = _crowded(sketched, sketch, across), None, None
    for k in range(ROUNDS):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if k == 0 and most > PART:
            sizes = stored(sizes)
            crowded = sizes.where(F.col("n") > PART).select("bucket")
        part = F.when(F.col("n") > PART, F.pmod(F.xxhash64("id", F.lit(k)), F.ceil(F.col("n") / PART))).otherwise(0)
        scanned = stored(_scan(level.join(sizes, "bucket").withColumn("part", part.cast("long"))))
        step = scanned.select("bucket", F.col("id").alias("leader"), F.col("leader").alias("up")).distinct()
        members = scanned.drop("sketch") if members is None else members.join(step, ["bucket", "leader"], "left").select("bucket", "id", "home", F.coalesce("up", "leader").alias("leader"))
        level = scanned.where("sketch is not null").select("bucket", "id", "home", "sketch").join(sizes.where(F.col("n") > PART).select("bucket"), "bucket")
        if most <= PART:
            break
    ids = F.xxhash64("repo", "path").alias("id")
    value = "home" if across else "id"
    if crowded is not None:
        members = stored(members)
    good = members.groupBy("bucket", "leader").agg((F.min(value) != F.max(value)).alias("ok")).where("ok").drop("ok")
    if crowded is not None:
        rows = sketched.where(F.col(sketch).isNotNull()).select(ids, F.col(sketch).alias("sketch"))
        good = good.unionByName(_missed(members.join(crowded, "bucket"), rows, value)).distinct()
    found = members.join(good, ["bucket", "leader"]).select("id").distinct()
    return sketched.select("repo", "path", ids).join(found, "id", "left_semi").select("repo", "path").distinct()


def _missed(members: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(bucket, leader) of clusters of crowded buckets that have company only by links that the rounds did not compare.

    members: bucket, id, home, leader; rows: id, sketch. A cluster is open while all its members have one value (home or
    id). Members of open clusters are compared with those of all other clusters; then company spreads along the links
    until no open cluster gains any. Signatures that repeat in a cluster count once.
    """
    clusters = stored(members.groupBy("bucket", "leader").agg(F.min(value).alias("low"), F.max(value).alias("high")))
    is_open = F.col("low") == F.col("high")
    asked = clusters.groupBy("bucket").agg(F.count("*").alias("n"), F.max(is_open).alias("any")).where("n > 1 and any").select("bucket")
    points = members.join(asked, "bucket").join(clusters, ["bucket", "leader"]).join(rows, "id").select("bucket", "leader", is_open.alias("open"), "sketch")
    links = stored(_links(_tiled(stored(points.distinct()))).distinct())
    both = links.unionByName(links.select("bucket", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    state = stored(clusters.join(both.select("bucket", F.col("a").alias("leader")).distinct(), ["bucket", "leader"]))
    left = state.where(is_open).count()
    while left:
        near = both.join(state.withColumnRenamed("leader", "b"), ["bucket", "b"]).groupBy("bucket", F.col("a").alias("leader")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        state = stored(state.join(near, ["bucket", "leader"]).select("bucket", "leader", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")))
        before, left = left, state.where(is_open).count()
        if left == before:
            break
    return state.where(~is_open).select("bucket", "leader")


def _tiled(points: DataFrame) -> DataFrame:
    """Points (bucket, leader, open, sketch) with the tiles (a, b) in which they meet, side 0 in a or 1 in b; a row for each pair of tiles.

    A tile holds about TILE points of one bucket, all open or none; clusters that are larger have tiles of their own, which
    do not meet each other. Tiles of open clusters meet all.
    """
    counts = points.groupBy("bucket", "open", "leader").agg(F.count("*").alias("n")).withColumn("sole", F.when(F.col("n") > TILE, F.col("leader")).otherwise(0)).drop("n")
    held = points.join(counts, ["bucket", "open", "leader"])
    sizes = held.groupBy("bucket", "open", "sole").agg(F.count("*").alias("n"))
    tile = F.xxhash64("bucket", "open", "sole", F.pmod(F.xxhash64("leader", "sketch"), F.ceil(F.col("n") / TILE)))
    placed = stored(held.join(sizes, ["bucket", "open", "sole"]).select("bucket", "open", "sole", "leader", "sketch", tile.alias("tile")))
    tiles = placed.select("bucket", "open", "sole", "tile").distinct()
    a, b = (tiles.select("bucket", F.col("open").alias(f"open_{x}"), F.col("sole").alias(f"sole_{x}"), F.col("tile").alias(x)) for x in "ab")
    pairs = stored(a.where("open_a").join(b, "bucket").where("(not open_b or a <= b) and (sole_a <> sole_b or sole_a = 0)").select("a", "b"))
    sides = [placed.withColumnRenamed("tile", x).join(pairs.where(on), x).select("bucket", "leader", "sketch", "a", "b", F.lit(k).alias("side")) for k, x, on in ((0, "a", "true"), (1, "b", "a <> b"))]
    return sides[0].unionByName(sides[1])


def _links(met: DataFrame) -> DataFrame:
    """(bucket, a, b): leaders of clusters that are linked in some pair of tiles, each to one of all that it is linked with there."""
    keys = ["a", "b"]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        cuts = [0, *([i + 1 for i, x in enumerate(changed(table, keys).to_pylist()) if x] if n > 1 else []), n]
        sketches = table.column("sketch").to_pylist()
        buckets, leaders, sides = (table.column(c).to_numpy() for c in ("bucket", "leader", "side"))
        for i, j in zip(cuts, cuts[1:]):
            s = np.frombuffer(b"".join(sketches[i:j]), np.uint32).reshape(j - i, PERMUTATIONS)
            names, cluster = np.unique(leaders[i:j], return_inverse=True)
            first = int((sides[i:j] == 0).sum())
            joined = joined_clusters(s, cluster, first if first < j - i else 0)
            a, b = np.unique(np.stack([cluster, joined])[:, cluster != joined], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), buckets[i]), pa.int64()), pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64())], names=["bucket", "a", "b"])

    ordered = met.repartition(*keys).sortWithinPartitions(*keys, "side")
    return ordered.mapInArrow(whole_groups(keys, run), "bucket long, a long, b long")


def joined_clusters(s: np.ndarray, cluster: np.ndarray, first: int) -> np.ndarray:
    """The clusters of signatures after all links between the first ones and the others, or between any if first is 0."""
    joined = cluster.copy()
    for left, right in _may_be_alike(s, first):
        for i in left.tolist():
            rest = right[(right > i) & (joined[right] != joined[i])]
            if len(rest):
                for c in np.unique(joined[rest[(s[rest] == s[i]).sum(axis=1) >= EQUAL]]):
                    joined[joined == c] = joined[i]
    return joined


def _may_be_alike(s: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of signatures with an equal stretch, by side: all that can be alike. All at once where that is fewer comparisons."""
    n = len(s)
    whole = (np.arange(first or n), np.arange(first, n))
    groups, pairs = [], 0
    for columns in np.array_split(np.arange(PERMUTATIONS), STRETCHES):
        codes = np.zeros(n, np.uint64)
        for c in columns:
            codes *= np.uint64(0x9E3779B97F4A7C15)
            codes += s[:, c]
        order = np.argsort(codes, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes[order])) + 1, [n]])
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            g = order[cuts[k] : cuts[k + 1]]
            left, right = (g[g < first], g[g >= first]) if first else (g, g)
            if len(left) and len(right):
                groups.append((left, right))
                pairs += len(left) * len(right)
        if pairs >= len(whole[0]) * len(whole[1]):
            return [whole]
    return groups


def not_by_hand(files: DataFrame, families: bool = True, alone: bool = True, says: bool = True) -> DataFrame:
    """Files nobody wrote by hand here: repo, path and why (generated, minified, vendored, blob; several are joined by commas).

    In a masked family: blob if the members are literals (0.6 of the text) with next to no logic, minified if most of
    the text (0.7) lies in lines of over 200 characters, generated if half of the masked runs of 20 tokens come again.
    A file without relatives needs more: 0.88 in long lines, or seven tenths of its runs. vendored: a similar file in another
    repository, or says so, or lies in a package below a folder of packages. Statements of output count as generated.
    families, alone and says switch the three ways off, to measure what each finds. Null contents are left out, repeated
    rows count once, null languages do not matter; empty tables give no rows; other columns are ignored.
    """
    f = stored(_featured(files).distinct())
    all_ = f.drop("masked", "plain")
    if families:
        lib = similar_files(f, "plain", True).withColumn("_copied", F.lit(True))
        family = similar_files(f, "masked", False).withColumn("_family", F.lit(True))
        all_ = all_.join(lib, ["repo", "path"], "left").join(family, ["repo", "path"], "left")
    else:
        all_ = all_.withColumn("_copied", F.lit(False)).withColumn("_family", F.lit(False))
    related, single, said = F.coalesce("_family", F.lit(False)), F.lit(alone), F.lit(says)
    blob = (F.col("literal") >= 0.6) & (F.col("logic") <= 0.15) & (related | single)
    minified = (F.col("n_tokens") >= 30) & ((related & (F.col("dense") >= 0.7)) | (single & (F.col("dense") >= 0.88)))
    shaped = related & (F.col("repeat") >= 0.5) | single & (F.col("repeat") >= 0.7) & (F.col("n_tokens") >= 60)
    generated = said & F.col("says_output") | shaped & ~minified & ~blob
    why = F.concat_ws(",", F.when(generated, "generated"), F.when(minified, "minified"), F.when(said & F.col("says_copy") | F.col("_copied"), "vendored"), F.when(blob, "blob"))
    return all_.select("repo", "path", why.alias("why")).where("why <> ''").groupBy("repo", "path").agg(F.max("why").alias("why"))
