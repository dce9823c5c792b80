import random
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F

from codeloam.functions import scalars as S
from codeloam.operators import docs as D, graph as G, history as H, intervals as I, islands, resolve as R, spans as P

TIMES = [
    ("[2026-08-15 10:52:01] local.ERROR: x", "2026-08-15 10:52:01"), ("2026/08/15T10:52:01 x", "2026-08-15 10:52:01"), ("2026-08-15 10:52 no seconds", None),
    ('10.0.0.1 - - [15/Aug/2026:10:52:01 +0000] "GET /"', "2026-08-15 10:52:01"), ("10.0.0.1 [15/aug/2026:10:52:01]", "2026-08-15 10:52:01"), ("[6-Jun-2026 12:52:27 UTC] WordPress", "2026-06-06 12:52:27"), ("[06-Jun-2026:12:52:27]", "2026-06-06 12:52:27"),
    ("Jun  6 12:52:27 host x", "1970-06-06 12:52:27"), ("on Jun  6 12:52:27 host", None), ("31-Foo-2026 12:52:27", None), ("2026-13-15 10:52:01", None), ("x" * 70 + " 2026-08-15 10:52:01", None),
    ('  {"a": "' + "x" * 70 + '", "t": "2026-08-15T10:52:01Z"}', "2026-08-15 10:52:01"), ("", None), (None, None),
]


def test_times_of_log_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, line string")
    got = {r.i: r.s and r.s.strftime("%Y-%m-%d %H:%M:%S") for r in df.select("i", S.stamp("line").alias("s")).collect()}
    assert [got[i] for i in range(len(TIMES))] == [want for _, want in TIMES]


def test_dates_bounds_and_clips(spark):
    names = {"laravel-2026-08-15.log": date(2026, 8, 15), "app.2026-08-15.log": date(2026, 8, 15), "x/app-20260815.log": date(2026, 8, 15), "app-120260815.log": None, "app-20261315.log": None, "app.log": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.d for r in df.select("n", S.date_in_name("n").alias("d")).collect()} == names
    bound = S.window_bound
    assert bound("2026-08-14 22:00", "2026-01-01") == "2026-08-14 22:00:00" and bound("9:05", "2026-01-02", True) == "2026-01-02 09:05:59" and bound("2026-08-14", "x", True) == "2026-08-14 23:59:59"
    assert bound("10:52:01", "2026-01-02", True) == "2026-01-02 10:52:01" and bound("soon", "2026-01-02") is None and bound("", "2026-01-02") is None and bound("2026-13-01", "x") is None
    cut = spark.createDataFrame([(" fits ",), ("a long one here",), (None,)], "t string").select(S.clip("t", 7).alias("c")).collect()
    assert [r.c for r in cut] == [" fits ", "a long…", None]


def test_entries_open_with_objects(spark):
    lines = [("f", 1, "start"), ("f", 2, '{"a": 1}'), ("f", 3, "more"), ("f", 4, "2026-08-15 10:52:01 x"), ("g", 1, "no time"), ("g", 2, "at all")]
    df = spark.createDataFrame(lines, "file string, line_no int, line string").withColumn("stamp", S.stamp("line"))
    got = islands.entries(df, ["file"], "stamp", opens=S.is_object("line")).orderBy("file", "entry").collect()
    assert [(r.file, r.text) for r in got] == [("f", "start"), ("f", '{"a": 1}\nmore'), ("f", "2026-08-15 10:52:01 x"), ("g", "no time"), ("g", "at all")]


def test_running_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(5)
    want, sums = {}, {}
    for k, i, n in rows:
        sums[k] = sums.get(k, 0) + n
        want[i] = sums[k]
    assert {x.i: x.u for x in D.running(df, ["k"], ["i"], "n", "u").collect()} == want
    assert D.running(df.limit(0), ["k"], ["i"], "n", "u").count() == 0 == D.tiers(df.limit(0), ["i"], "n", "n", 5).count()


def test_greedy_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 9, 4, 2, 1])] + [("b", 0, 99)], "k string, i int, n int")
    assert {(x.k, x.i) for x in H.greedy_fit(df, ["k"], ["i"], "n", 10, 4).collect()} == {("a", 0), ("a", 2)}


def test_moved_lines(spark):
    lines = spark.createDataFrame([("f", x) for x in (1, 5, 6, 7, 20, 30)], "f string, line int")
    hunks = spark.createDataFrame([("f", 5, 6, 5, 9), ("f", 10, 9, 13, 14), ("f", 30, 30, 35, 34)], "f string, old_first int, old_last int, new_first int, new_last int")
    assert {r.line: r.moved for r in P.moved_line(lines, hunks, ["f"], "line").collect()} == {1: 1, 5: None, 6: None, 7: 10, 20: 25, 30: None}


def test_reach_of_files(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "target string, importer string")
    got = {(r.start, r.node): r.depth for r in G.reachable(edges, edges.select("target").where("target = 'a'"), 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}


def test_plain_resolution_equals_the_long_way(spark):
    r = random.Random(3)
    name = lambda: r.choice(["go", "Go", "run", "load", "one"])
    refs = {("r", f"f{r.randrange(4)}", r.choice(["php", "python", "java"]), r.randrange(30), name(), r.choice(["Free", "Free", "Member", "Static"]), r.choice([None, "K", "x"])) for _ in range(150)}
    decl = [("r", f"f{r.randrange(4)}", r.choice(["php", "python", "java"]), i, name(), r.choice(["function", "method", "class", "property"]), r.choice([None, "K"]), i, i, r.choice([0, 2, 4, None])) for i in range(40)]
    references = spark.createDataFrame(sorted(refs, key=str), "repo string, path string, language string, line int, name string, shape string, receiver string")
    declarations = spark.createDataFrame(decl, "repo string, path string, language string, idx int, name string, kind string, container string, line int, end_line int, visibility int")
    columns = [*references.columns, "target_path", "target_idx", "confidence"]
    long_ = R.resolve(R.candidates(references, declarations), references.columns).select(*columns).collect()
    assert sorted(map(str, R.resolve_plain(references, declarations).select(*columns).collect())) == sorted(map(str, long_))


def test_partitions_of_one_task_are_swept_apart():
    part = lambda n, rows: pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows]), pa.array([s for _, s, _ in rows]), pa.array([e for _, _, e in rows]), pa.array([n] * len(rows), pa.int32())], names=["k", "_start", "_end", "_part"])
    first, second = part(0, [("a", 1, 2), ("a", 5, 6)]), part(1, [("a", 9, 9), ("b", 1, 1)])
    mixed = pa.RecordBatch.from_arrays([pa.chunked_array([second.column(i), first.column(i)]).combine_chunks() for i in range(4)], names=first.schema.names)
    for batches in ([second, first], [mixed]):
        got = {}
        for n, tables in I._partitions(iter(batches)):
            state = I._Carry(("a",), 6, 5) if n else I._Carry()
            got[n] = [state.scan(t, ["k"], 1)[1].tolist() for t in tables]
        assert got[0][0][1] == 2 and got[1][0][0] == 6
