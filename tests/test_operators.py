import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from codeloam.functions import scalars as S
from codeloam.operators import docs as D, extract as X, graph as G, history as H, islands as I, resolve as R, snapshot as N, spans as P, stats as A, text as T
from codeloam.sources import repository as Repo, sinks


def values(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_lines_and_line_count(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "a\r\nb"), (3, ""), (4, "\n"), (5, None)], "id int, text string")
    assert values(T.lines(df, ["id"], "text"), "id", "line_no", "line") == {(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (4, 1, "")}
    assert values(df.select("id", S.line_count("text").alias("n")), "id", "n") == {(1, 2), (2, 2), (3, 0), (4, 1), (5, None)}


def test_search_switches(spark):
    df = spark.createDataFrame([(1, "Lock the lock"), (2, "blocked"), (3, "a.b(c")], "id int, line string")
    ids = lambda c: {r.id for r in df.where(c).collect()}
    assert ids(T.matches("line", "lock", word=True)) == {1}
    assert ids(T.matches("line", "LOCK", ignore_case=True)) == {1, 2}
    assert ids(T.matches("line", "lock", invert=True)) == {3}
    assert ids(T.matches("line", "blocked", whole_line=True)) == {2}
    assert ids(T.matches("line", ".b(", literal=True)) == {3}
    with pytest.raises(Exception):
        T.matches("line", "(")
    assert T.smart_pattern("b(") == "b\\("
    with pytest.raises(ValueError):
        T.of_type("line", "nonsense")


def test_globs():
    import re

    yes = lambda g, p: re.match(T.glob_regex(g), p) is not None
    assert yes("src/**/*.go", "src/a.go") and yes("src/**/*.go", "src/x/y/a.go") and not yes("*.go", "src/a.go")
    assert yes("*.{py,rb}", "a.rb") and yes("[!a]b", "xb") and not yes("[!a]b", "ab") and yes("a?c", "abc")


def test_multiline_reports_the_first_line(spark):
    df = spark.createDataFrame([(1, "x\nfoo\nbar\nfoo\nbar\n")], "id int, text string")
    assert values(T.multiline(df, ["id"], "text", "foo\\nbar"), "match", "line_no") == {("foo\nbar", 2), ("foo\nbar", 4)}


def test_log_entries(spark):
    text = "2026-08-15 10:52:00 one\n2026-08-15 10:52:01 renew-loan\n#0 frame\n#1 frame\n2026-08-15 10:53:00 two"
    df = spark.createDataFrame([("a", text), ("b", "no stamp\nnone here"), ("c", "opening\n2026-08-15 10:00:00 x")], "f string, text string")
    e = I.entries(T.lines(df, ["f"], "text").withColumn("stamp", S.stamp("line")), ["f"], "stamp")
    assert values(e, "f", "line_no", "n_lines") == {("a", 1, 1), ("a", 2, 3), ("a", 5, 1), ("b", 1, 1), ("b", 2, 1), ("c", 1, 1), ("c", 2, 1)}
    hit = e.where("text like '%renew-loan%'").first()
    assert hit.stamp == dt.datetime(2026, 8, 15, 10, 52, 1) and hit.text.count("\n") == 2


def test_stamps(spark):
    lines = ["2026-08-15T10:52:01.123 x", "1.2.3.4 - - [15/Aug/2026:10:52:01 +0200] \"GET\"", "Aug  5 01:02:03 host app", "nothing", "2026-13-40 10:00:00 x", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(S.stamp("l")).collect()]
    assert got == [dt.datetime(2026, 8, 15, 10, 52, 1), dt.datetime(2026, 8, 15, 10, 52, 1), dt.datetime(1970, 8, 5, 1, 2, 3), None, None, None]


def test_newest_matches(spark):
    rows = [(i, i in (2, 5, 8)) for i in range(1, 10)]
    near = I.around(spark.createDataFrame(rows, "i int, m boolean").withColumn("k", F.lit(1)), ["k"], "i", F.col("m"), 1)
    assert {r.i for r in near.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    # two matches stay: what follows the dropped one stays as well, what precedes it goes
    assert {r.i for r in I.newest(near, ["i"], 2).collect()} == {3, 4, 5, 6, 7, 8, 9}
    assert I.newest(near, ["i"], 5).count() == 9


def test_percentile_rule(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 9, 40, 81, 3, 7, 10, 30)] + [("b", 5), ("b", None)], "g string, v int")
    got = {r.g: (r.n, r.median, r.p75, r.p90, r.p95, r.max) for r in A.distribution(df, ["g"], "v", {"p75": 0.75, "p90": 0.9, "p95": 0.95}).collect()}
    assert got == {"a": (10, 8, 10, 40, 40, 81), "b": (1, 5, 5, 5, 5, 5)}


def test_reach(spark):
    e = spark.createDataFrame([("b", "a", 0, "b_fn"), ("c", "b", 0, "c_fn"), ("d", "c", 0, "d_fn")], "target string, importer string, confidence int, symbol string")
    start = spark.createDataFrame([("a",)], "n string")
    for depth, want in ((1, {"b"}), (2, {"b", "c"}), (3, {"b", "c", "d"}), (9, {"b", "c", "d"})):
        assert {r.node for r in G.reachable(e, start, depth, reverse=False).collect()} == want
    ranked = [(r.subject, r.direct, r.transitive) for r in G.ranked_by_reach(e, 9, 10).collect()]
    assert ranked == [("d", 1, 3), ("c", 1, 2), ("b", 1, 1)]
    ring = spark.createDataFrame([("b", "a", 0, None), ("c", "b", 2, None), ("a", "c", 0, None)], e.schema)
    assert {(r.node, r.depth) for r in G.reachable(ring, start, 9, reverse=False).collect()} == {("b", 1), ("c", 2)}
    assert {r.subject for r in G.ranked_by_reach(ring, 9, 10).collect()} == {"a", "b"}


def test_strongest_edge_folds_in_order(spark):
    rows = [("t", "i", 1, 1, "x"), ("t", "i", 2, 0, None), ("t", "i", 3, 2, "y"), ("t", "t", 1, 0, "self"), ("u", "i", 1, 2, None)]
    df = spark.createDataFrame(rows, "target string, importer string, k int, confidence int, symbol string")
    assert values(G.strongest(df, "k"), "target", "importer", "confidence", "symbol") == {("t", "i", 0, "y"), ("u", "i", 2, None)}


_REFS = "repo string, path string, language string, line int, name string, shape string, receiver string"
_DECLS = "repo string, path string, language string, idx int, name string, kind string, container string, line int, end_line int, visibility int"


def test_confidence_ladder(spark):
    decls = spark.createDataFrame([
        ("r", "a.py", "python", 0, "here", "function", None, 1, 2, 4), ("r", "b.py", "python", 0, "rare", "function", None, 1, 2, 4), ("r", "c.py", "python", 0, "twice", "function", None, 1, 2, 4),
        ("r", "d.py", "python", 0, "twice", "function", None, 1, 2, 4), ("r", "c.py", "python", 1, "m", "method", "C", 5, 6, 4), ("r", "d.py", "python", 1, "m", "method", "D", 5, 6, 4), ("r", "e.go", "go", 0, "rare", "function", None, 1, 2, 4),
        ("r", "f.py", "python", 0, "prop", "property", None, 1, 1, 4), ("r", "c.py", "python", 2, "own", "function", None, 9, 9, 0),
    ], _DECLS)
    refs = spark.createDataFrame([("r", "a.py", "python", i, n, s, x) for i, (n, s, x) in enumerate([("here", "Free", None), ("rare", "Free", None), ("twice", "Free", None), ("m", "Member", "o"), ("prop", "Free", None), ("RARE", "Free", None), ("own", "Free", None)])], _REFS)
    key = ["repo", "path", "line", "name", "shape", "receiver"]
    found = R.candidates(refs, decls)
    assert values(R.resolve(found, key), "name", "target_path", "confidence") == {("here", "a.py", 0), ("rare", "b.py", 1), ("m", "c.py", 2), ("m", "d.py", 2)}
    imported = spark.createDataFrame([("r", "a.py", "c.py", 0)], "repo string, path string, target_path string, confidence int")
    assert ("twice", "c.py", 0) in values(R.resolve(found, key, imported), "name", "target_path", "confidence")


def test_renames_are_followed_one_step(spark):
    rows = [("r", "c0", 0, 0, "M", "B", None), ("r", "c1", 1, 0, "R100", "B", "A"), ("r", "c2", 2, 0, "M", "A", None), ("r", "c3", 3, 0, "R100", "A", "Z"), ("r", "c4", 4, 0, "M", "Z", None)]
    df = spark.createDataFrame(rows, "repo string, commit_id string, pos int, seq int, status string, path string, from_path string")
    assert values(H.renamed(df), "commit_id", "now") == {("c0", "B"), ("c1", "B"), ("c2", "B"), ("c3", "A"), ("c4", "A")}


def test_wide_commits_and_ties(spark):
    rows = [("r", "wide", 0, f"f{i}", "x") for i in range(101)] + [("r", "c1", 1, "f1", "ann"), ("r", "c1", 1, "f2", "ann"), ("r", "c2", 2, "f1", "bob"), ("r", "c2", 2, "f3", "bob")]
    df = spark.createDataFrame(rows, "repo string, commit_id string, pos int, path string, author string")
    assert values(H.co_changed(df, "path").where("path = 'f1'"), "other", "n", "rank") == {("f2", 1, 1), ("f3", 1, 2)}
    assert values(H.top_authors(df.where("commit_id <> 'wide'"), "path").where("path = 'f1'"), "author") == {("ann",)}


def test_moved_lines_and_innermost(spark):
    lines = spark.createDataFrame([("f", 1), ("f", 5), ("f", 20), ("g", 3)], "k string, line int")
    hunks = spark.createDataFrame([("f", 4, 6, 4, 4), ("f", 10, 9, 8, 12)], "k string, old_first int, old_last int, new_first int, new_last int")
    assert values(P.moved_line(lines, hunks, ["k"], "line"), "k", "line", "moved") == {("f", 1, 1), ("f", 5, None), ("f", 20, 23), ("g", 3, 3)}
    spans = spark.createDataFrame([("f", 0, 1, 300), ("f", 1, 2, 6), ("f", 2, 2, 6)], "k string, idx int, first int, last int")
    got = P.innermost(lines, spans, ["k"], "line", "first", "last", "idx", ["k", "line"], "left")
    assert values(got, "k", "line", "idx") == {("f", 1, 0), ("f", 5, 2), ("f", 20, 0), ("g", 3, None)}


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "id int, v string")
    assert values(N.keyed_diff(a, b, ["id"], ["v"]), "id", "state") == {(1, "same"), (2, "changed"), (3, "removed"), (4, "added")}
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(["a", "a", "b", None, None])], "k string, t int, v string")
    assert [r.offer for r in N.shown(rows, ["k"], ["t"], "v").orderBy("t").collect()] == ["New", "Same", "Changed", "Changed", "Same"]
    assert [r.epoch for r in N.epochs(rows, ["k"], ["t"], "v").orderBy("t").collect()] == [0, 0, 1, 2, 2]


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a",), (None,)], "p string")
    assert [r[0] for r in df.select(S.normalized_path("p")).collect()] == ["a/c", None, "a", None]
    assert [r[0] for r in df.select(S.directory_of("p")).collect()] == ["a/./b/../", "../", "./", None]


def test_nearest_document(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",)], "path string")
    docs = spark.createDataFrame([("a/README.md",), ("README.md",), ("a/b/DOC.md",)], "path string")
    assert values(D.nearest(files, docs), "path", "doc") == {("a/b/x.py", "a/b/DOC.md"), ("a/y.py", "a/README.md"), ("z.py", "README.md")}
    assert values(D.chain(files, docs).where("path = 'a/y.py'"), "doc", "distance") == {("a/README.md", 0), ("README.md", 1)}


SOURCE = '''from src.util import helper, other as o
import os.path

LIMIT = 3

def outer(a, b):
    if a and b:
        for x in b:
            while x:
                x -= 1
    def inner(y):
        return 1 if y else 2
    return helper(a) or os.path.join(a)

class _C:
    @property
    def m(self):
        return self.n()
'''


def test_python_extraction(spark):
    df = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def (:"), ("none.py", None)], "path string, content string")
    parsed = X.extracted(df, ["path"]).cache()
    assert values(X.relation(parsed, ["path"], "functions"), "name", "complexity") == {("outer", 6), ("outer.inner", 2), ("_C::m", 1)}
    assert values(X.relation(parsed, ["path"], "declarations"), "name", "kind", "container", "parent", "visibility") == {("LIMIT", "property", None, None, 4), ("outer", "function", None, None, 4), ("inner", "function", None, 1, 4), ("_C", "class", None, None, 2), ("m", "method", "_C", 3, 4)}
    assert values(X.relation(parsed, ["path"], "imports"), "module", "symbol") == {("src.util", "helper"), ("src.util", "other"), ("os.path", None)}
    assert values(X.relation(parsed, ["path"], "references"), "name", "shape", "receiver") == {("helper", "Free", None), ("join", "Member", "os.path"), ("n", "Member", "self")}
    assert parsed.where("path = 'bad.py'").first().declarations is None


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"a\x00b")
    (tmp_path / "node_modules/c.js").write_text("y")
    tree = Repo.source_tree(spark, str(tmp_path))
    assert values(tree, "path", "content") == {("src/a.py", "x = 1\n"), ("src/b.bin", None)}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/app-2026-08-14.log").write_text("2026-08-14 10:00:00 a\r\nmore\n")
    with gzip.open(tmp_path / "logs/old-2026-08-13.log.gz", "wt") as f:
        f.write("2026-08-13 09:00:00 z\n")
    got = Repo.log_lines(spark, str(tmp_path / "logs"))
    assert values(got, "file", "file_date", "line_no", "line") == {("app-2026-08-14.log", dt.date(2026, 8, 14), 1, "2026-08-14 10:00:00 a"), ("app-2026-08-14.log", dt.date(2026, 8, 14), 2, "more"), ("old-2026-08-13.log.gz", dt.date(2026, 8, 13), 1, "2026-08-13 09:00:00 z")}


def test_commit_log_and_status(spark):
    zero = "0" * 10
    raw = "\x01".join(["", f"c0\0{'2026-08-15'}\0ann\0Move it\0p1\0:100644 100644 aa bb R100\0old.py\0new.py\0:000000 100644 {zero} cc A\0x.py\0", "c1\0" + "2026-08-14\0bob\0Merge\0p1 p2\0"])
    commits, changes = Repo.commit_log(spark.createDataFrame([("r", raw)], "repo string, value string"))
    assert values(commits, "commit_id", "pos", "author", "is_merge") == {("c0", 0, "ann", False), ("c1", 1, "bob", True)}
    assert values(changes, "seq", "status", "path", "from_path", "old_blob", "new_blob") == {(0, "R", "new.py", "old.py", "aa", "bb"), (1, "A", "x.py", None, None, "cc")}
    status = spark.createDataFrame([("R  a -> b",), ("?? n",), (" M m",), ("MM q",)], "value string")
    assert values(Repo.porcelain(status), "path", "state", "staging", "from_path") == {("b", "renamed", "staged", "a"), ("n", "untracked", None, None), ("m", "modified", "unstaged", None), ("q", "modified", "both", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "path string, n int")
    assert sinks.document("q", df, df).first().document == '{"query":"q","result":{"path":"a","n":1},"context":{"path":"a","n":1}}'
    where = sinks.versioned(df, str(tmp_path), "7")
    assert spark.read.parquet(where).count() == 1


def test_streamed_offers(spark, tmp_path):
    from codeloam.streaming.offers import offers

    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("j", 1, "a")], "k string, t int, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = offers(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "v", "t")
    q = stream.writeStream.format("memory").queryName("offered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("offered"), "k", "t", "offer") == {("k", 1, "New"), ("k", 2, "Same"), ("k", 3, "Changed"), ("j", 1, "New")}


def test_documents(spark):
    text = "---\npaths:\n  - 'src/**'\n  - lib/*.py\ntitle: x\n---\nSee @docs/a.md and `@not/this`.\n```\n@nor/this\n```\n<!-- @nor/that -->\n@../b.md me@mail.org"
    df = spark.createDataFrame([(1, text), (2, "---\npaths: a, \"b\"\n---\nx"), (3, "plain"), (4, None)], "id int, t string")
    got = {r.id: (r.g, r.m) for r in df.select("id", D.front_globs(F.col("t")).alias("g"), D.mentions(F.col("t")).alias("m")).collect()}
    assert got == {1: (["src/**", "lib/*.py"], ["docs/a.md", "../b.md"]), 2: (["a", "b"], []), 3: ([], []), 4: (None, None)}
    assert df.where("id = 2").select(D.body(F.col("t"))).first()[0] == "x"
    links = spark.createDataFrame([(f"d{i}", f"d{i + 1}") for i in range(8)] + [("d2", "d0")], "source string, target string")
    start = spark.createDataFrame([("d0",)], "n string")
    assert values(D.includes(links, start), "node", "step") == {("d1", 1), ("d2", 2), ("d3", 3), ("d4", 4)}


def test_branches_and_budget(spark):
    refs = spark.createDataFrame([("origin/main", "2024-01-01"), ("main", "2023-01-01"), ("origin/dev", "2024-06-20"), ("feature/x", "2024-06-30"), ("old", "2024-01-02")], "name string, date string").withColumn("date", F.to_date("date"))
    assert [r.branch for r in H.branches(refs, "main", "2024-07-01").collect()] == ["main", "dev"]
    assert H.greedy([("a", 5), ("b", 9), ("c", 4)], 10) == [("a", 5), ("c", 4)]


def test_nest(spark):
    df = spark.createDataFrame([("f", 0, 1, 200), ("f", 1, 2, 150), ("f", 2, 2, 150), ("f", 3, 70, 80), ("f", 4, 300, 301), ("f", 5, 9, 8)], "k string, idx int, line int, end_line int")
    assert {r.idx: r.inside for r in P.nest(df, ["k"], "idx", "line", "end_line").collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: None, 5: None}
