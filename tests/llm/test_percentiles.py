import numpy as np
from pyspark.sql import functions as F

from codeloam.llm.percentiles import certified, digest, merge, quantiles

def ranks():
    return {"median": F.floor((F.col("n") - 1) / 2), "p90": F.greatest(F.floor(F.col("n") * 0.9) - 1, F.lit(0)), "p999": F.floor((F.col("n") - 1) * 0.999)}


def exact(values, q):
    return {"median": (len(values) - 1) // 2, "p90": max(int(len(values) * 0.9) - 1, 0), "p999": int((len(values) - 1) * 0.999)}[q]


def test_rank_errors_are_small_and_certified(spark):
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(0, 1, 8000), "heavy": rng.pareto(1.1, 8000), "two": rng.choice([1.0, 50.0], 3000), "one": np.array([7.0])}
    rows = [(g, float(v), 0.0, 0) for g, vs in data.items() for v in vs] + [("none", None, 0.0, 0), ("nan", float("nan"), 0.0, 0), (None, 4.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, mean double, n int").repartition(5)  # names that clash
    for part_rows in (200_000, 900):
        d = digest(df, ["g"], "v", part_rows=part_rows)
        assert d.groupBy("g").count().agg(F.max("count")).first()[0] <= 450
        got = {r.g: r for r in certified(df, ["g"], "v", quantiles(d, ["g"], ranks()), ranks()).collect()}
        assert set(got) == {*data, None}
        for g, vs in data.items():
            vs = np.sort(vs)
            for q in ranks():
                lo, hi = np.searchsorted(vs, got[g][q], "left"), np.searchsorted(vs, got[g][q], "right")
                off = max(lo - exact(vs, q), exact(vs, q) - max(hi - 1, lo), 0) / len(vs)
                assert abs(off - got[g][f"{q}_error"]) < 1e-9
                assert off <= 0.006, (g, q, off)


def test_digests_of_parts_merge(spark):
    df = spark.range(20_000).selectExpr("'a' as g", "cast(id % 7 as int) as day", "cast(pow(id % 5000, 1.5) as double) as v")
    parts = digest(df, ["g", "day"], "v").drop("day")
    e = certified(df, ["g"], "v", quantiles(merge(parts, ["g"]), ["g"], ranks()), ranks()).first()
    assert e.n == 20_000 and max(e.median_error, e.p90_error, e.p999_error) <= 0.006


def test_many_parts_merge_in_rounds(spark, monkeypatch):
    from codeloam.llm import percentiles

    monkeypatch.setattr(percentiles, "MERGED", 3)
    df = spark.range(9000).selectExpr("'a' as g", "cast(id as double) as v")
    d = digest(df, ["g"], "v", part_rows=500)
    e = certified(df, ["g"], "v", quantiles(d, ["g"], ranks()), ranks()).first()
    assert e.n == 9000 and max(e.median_error, e.p90_error, e.p999_error) <= 0.006


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert quantiles(digest(df, ["g"], "v"), ["g"], ranks()).count() == 0
