from hypothesis import HealthCheck, given, settings, strategies as st

from codeloam.operators.intervals import gaps, gaps_within, periods

_DDL = "who string, s int, e int, period_end int, _end int"


def brute(rows, step=1):
    merged, holes = set(), set()
    for who in {r[0] for r in rows}:
        mine = sorted({(s, e) for w, s, e in rows if w == who and s is not None and e is not None and s <= e})
        out = []
        for s, e in mine:
            if out and s <= out[-1][1] + step:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        merged |= {(who, s, e) for s, e in out}
        holes |= {(who, a[1] + 1, b[0] - 1) for a, b in zip(out, out[1:])}
    return merged, holes


bound = st.one_of(st.none(), st.integers(-3, 30))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), bound, bound), max_size=60))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], _DDL)  # two columns whose names clash
    merged, holes = brute(rows)
    assert {tuple(r) for r in periods(df, ["who"], "s", "e").select("who", "period_start", "period_end").collect()} == merged
    assert {tuple(r) for r in gaps(df, ["who"], "s", "e").collect()} == holes


def test_one_entity_over_many_partitions(spark):
    rows = [("a", 10 * i, 10 * i + (15 if i % 50 else 5)) for i in range(2000)] + [("a", 0, 300), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "who string, s int, e int").repartition(7)
    merged, holes = brute(rows)
    assert {tuple(r) for r in periods(df, ["who"], "s", "e").select("who", "period_start", "period_end").collect()} == merged
    assert {tuple(r) for r in gaps(df, ["who"], "s", "e").collect()} == holes


def test_below_a_union_and_over_many_small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows end in one partition
    try:
        rows = [(w, 10 * i, 10 * i + 5) for i in range(300) for w in "ab"]  # a gap wherever a partition ends
        df = spark.createDataFrame(rows, "who string, s int, e int")
        merged, holes = brute(rows)
        g = gaps(df, ["who"], "s", "e")
        got = [tuple(r) for r in spark.range(5).selectExpr("'x' as who", "id as gap_start", "id as gap_end").unionByName(g).unionByName(g).where("who <> 'x'").collect()]
        assert sorted(got) == sorted([*holes, *holes])
        assert {tuple(r) for r in g.coalesce(1).collect()} == holes
        assert {tuple(r) for r in periods(df, ["who"], "s", "e").select("who", "period_start", "period_end").collect()} == merged
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_touching_and_steps(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", 6, 6)], "who string, s int, e int")
    ends = lambda step: {(r.period_start, r.period_end) for r in periods(df, ["who"], "s", "e", step).collect()}
    assert ends(1) == {(1, 4), (6, 6)}
    assert ends(0) == {(1, 2), (3, 4), (6, 6)}
    assert ends(2) == {(1, 6)}


def test_within_bounds(spark):
    df = spark.createDataFrame([("a", 3, 5, 1, 10), ("a", 8, 20, 1, 10), ("b", 1, 4, 1, 4), ("c", 1, 2, 1, None), ("d", 50, 60, 1, 9)], "who string, s int, e int, lo int, hi int")
    assert {tuple(r) for r in gaps_within(df, ["who"], "s", "e", "lo", "hi").collect()} == {("a", 1, 2), ("a", 6, 7), ("d", 1, 9)}


def test_empty(spark):
    df = spark.createDataFrame([], "who string, s int, e int")
    assert periods(df, ["who"], "s", "e").count() == 0
    assert gaps(df, ["who"], "s", "e").count() == 0
