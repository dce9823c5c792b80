"""Commits and what they changed: lifecycle facts per path, authors, co-change, pickaxe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stats import first_mode

#: Commits of more changes than this say nothing of what belongs together.
WIDE = 100


def renamed(changes: DataFrame) -> DataFrame:
    """Adds `now`, the name under which a change counts: a rename counts for its new path, and a plain change of a path that a newer commit renamed counts for the name it got (one step, the rename nearest in time).

    changes: repo, commit_id, pos (0 = newest), path, from_path, status. Rows without a path are dropped.
    """
    rows = changes.where("path is not null")
    renames = rows.where("from_path is not null and status like 'R%'").select(F.col("repo").alias("_rrepo"), F.col("from_path").alias("_old"), F.col("path").alias("_new"), F.col("pos").alias("_rpos")).groupBy("_rrepo", "_old", "_rpos").agg(F.min("_new").alias("_new"))
    met = rows.where("from_path is null").join(renames, [F.col("_old") == F.col("path"), F.col("repo") == F.col("_rrepo"), F.col("_rpos") < F.col("pos")], "left")
    plain = met.groupBy(*[c for c in rows.columns]).agg(F.max_by("_new", "_rpos").alias("_to")).withColumn("now", F.coalesce("_to", "path")).drop("_to")
    return plain.unionByName(rows.where("from_path is not null").withColumn("now", F.col("path")))


def lifecycle(changes: DataFrame, path: str, as_of: str, days: int = 30) -> DataFrame:
    """Per (repo, path): commits, those in the last days, first and last date, last author and subject."""
    recent = F.col("commit_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    one = changes.groupBy("repo", path, "commit_id", "pos", "commit_date", "author", "subject").agg(F.lit(1).alias("_one"))
    return one.groupBy("repo", path).agg(
        F.count("*").alias("commits"), F.sum(F.when(recent, 1).otherwise(0)).alias("recent"), F.max_by("commit_date", F.col("pos")).alias("first_seen"), F.min_by("commit_date", F.col("pos")).alias("last_modified"),
        F.min_by("author", F.col("pos")).alias("last_author"), F.min_by("subject", F.col("pos")).alias("last_subject"),
    )


def floored(commits: Column, cut: Column) -> tuple[Column, Column]:
    """commits and commits_at_least: where the history was cut, the number is only a lower bound."""
    return F.when(~cut, commits).alias("commits"), F.when(cut, commits).alias("commits_at_least")


def top_authors(changes: DataFrame, path: str, top: int = 1) -> DataFrame:
    """The authors with most commits of each path; of equal ones the one whose commit is newest."""
    one = changes.select("repo", path, "commit_id", "author", "pos").distinct()
    return first_mode(one, ["repo", path], "author", "pos", top)


def co_changed(changes: DataFrame, path: str, top: int = 5, wide: int = WIDE) -> DataFrame:
    """The paths that most often change with each path: repo, path, other, n, rank.

    A commit of more than `wide` changes adds nothing (changes are counted, pairs are of distinct paths).
    """
    sized = changes.groupBy("repo", "commit_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= wide).drop("_n")
    used = changes.join(sized, ["repo", "commit_id"], "left_semi").select("repo", "commit_id", "pos", F.col(path).alias("path")).distinct()
    # a commit's paths are at most `wide`, so they travel as one array and pairs are made in place
    baskets = used.groupBy("repo", "commit_id", "pos").agg(F.collect_set("path").alias("ps")).where("size(ps) > 1")
    pairs = baskets.select("repo", "pos", F.explode("ps").alias("path"), "ps").select("repo", "pos", "path", F.explode("ps").alias("other")).where("path <> other")
    return first_mode(pairs, ["repo", "path"], "other", "pos", top)


def pickaxe(changes: DataFrame, counts: DataFrame, blob: str = "blob", n: str = "n") -> DataFrame:
    """Changes whose number of matches differs between the old and the new blob. counts: blob, n; a missing blob has none."""
    old = counts.select(F.col(blob).alias("old_blob"), F.col(n).alias("_was"))
    new = counts.select(F.col(blob).alias("new_blob"), F.col(n).alias("_is"))
    rows = changes.join(old, "old_blob", "left").join(new, "new_blob", "left").withColumn("was", F.coalesce("_was", F.lit(0))).withColumn("is_now", F.coalesce("_is", F.lit(0)))
    return rows.where("was <> is_now").drop("_was", "_is").withColumn("direction", F.when(F.col("was") == 0, "added").when(F.col("is_now") == 0, "removed").otherwise("changed"))


def blobs_at(changes: DataFrame, pos: int) -> DataFrame:
    """(repo, path, blob): what each path holds as of the commit at a position; paths whose last change before it deleted them are gone."""
    place = F.struct("pos", "seq")
    last = changes.where(F.col("pos") >= pos).groupBy("repo", "path").agg(F.min_by(F.struct("status", "new_blob"), place).alias("v"))
    return last.where("v.status not like 'D%'").select("repo", "path", F.col("v.new_blob").alias("blob"))


def pickaxe_texts(rows: DataFrame, key: str, old: str, new: str, pattern: str) -> DataFrame:
    """(key, was, is_now, direction) of rows whose two texts hold a different number of matches; -1 stands for a binary text."""
    from .text import pattern_count

    n = rows.select(key, F.coalesce(pattern_count(F.col(old), pattern), F.lit(0)).alias("was"), F.coalesce(pattern_count(F.col(new), pattern), F.lit(0)).alias("is_now")).where("was <> is_now")
    return n.withColumn("direction", F.when(F.col("was") == 0, "added").when(F.col("is_now") == 0, "removed").otherwise("changed"))


def confirmed(rows: DataFrame, key: str, old: str, new: str, pattern: str) -> DataFrame:
    """Keys for which a line with a match is on one side more often than on the other: what a count alone cannot tell."""
    line = lambda c, n: rows.select(key, F.explode(F.split(c, "\n", -1)).alias("_line"), F.lit(n).alias("_n"))
    both = line(old, -1).unionByName(line(new, 1)).where(F.col("_line").rlike(pattern))
    return both.groupBy(key, "_line").agg(F.sum("_n").alias("_d")).where("_d <> 0").select(key).distinct()


def newest_and_oldest(rows: DataFrame, keys: list[str], pos: str, newest: int = 29) -> DataFrame:
    """The newest rows of each key and its oldest. No group is gathered: the ranks of Window group limits stop early."""
    w = Window.partitionBy(*keys).orderBy(pos)
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest).drop("_r")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pos)))).where("_r = 1").drop("_r")
    return first.unionByName(last).distinct()


def live(history: DataFrame, working: DataFrame, presence: DataFrame) -> DataFrame:
    """History, working tree and presence of each path together. A path that the working tree renamed and that has no history takes that of its old name.

    history: path and facts; working: path, state, from_path; presence: path, labels.
    """
    facts = [c for c in history.columns if c != "path"]
    old = history.select(F.col("path").alias("from_path"), *[F.col(c).alias(f"_{c}") for c in facts])
    out = history.join(working, "path", "full_outer").join(presence, "path", "full_outer").join(old, "from_path", "left")
    return out.select("path", *[F.coalesce(c, f"_{c}").alias(c) for c in facts], "state", "from_path", "labels")


def present_in(listings: DataFrame) -> DataFrame:
    """(path, labels): the sorted distinct labels under which each path is listed."""
    return listings.groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def ahead_behind(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are only in a, and only in b."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).alias("ahead"), F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).alias("behind"))


def branches(refs: DataFrame, head: str, as_of: str, stale_days: int = 21) -> DataFrame:
    """Branches worth a look: the head first, then the newest; one per short name, without feature branches and those older than stale_days.

    refs: name (origin/x or x), date.
    """
    short = F.regexp_replace("name", "^(?:refs/(?:heads|remotes)/)?(?:origin/)?", "")
    rows = refs.select(short.alias("branch"), "date").groupBy("branch").agg(F.max("date").alias("date"))
    is_head = F.col("branch") == head
    fresh = F.datediff(F.lit(as_of).cast("date"), "date") <= stale_days
    return rows.where(is_head | (fresh & ~F.col("branch").rlike("^(?:feature|feat|fix|bugfix|hotfix|chore|dependabot|renovate)/"))).orderBy(is_head.desc(), F.desc("date"), "branch")


def greedy_fit(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, most: int) -> DataFrame:
    """Of the first `most` rows of each key in order those that still fit the budget; one that does not is passed over, later ones may fit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    short = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    listed = F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col(size).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["r"]))).otherwise(acc["kept"]).alias("kept"))

    kept = short.groupBy(*keys).agg(F.aggregate(listed, start, step)["kept"].alias("_kept")).select(*keys, F.explode("_kept").alias("_r"))
    return short.join(kept, [*keys, "_r"], "left_semi").drop("_r")


def greedy(rows: list[tuple], budget: int) -> list[tuple]:
    """Of (name, size) in order those that still fit the budget; one that does not is passed over, later ones may fit. For short lists on the driver."""
    out, used = [], 0
    for row in rows:
        if used + row[1] <= budget:
            out.append(row)
            used += row[1]
    return out
