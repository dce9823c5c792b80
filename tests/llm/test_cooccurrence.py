import itertools
import random
from collections import Counter, defaultdict

import pytest

from codeloam.llm.cooccurrence import cooccurrence

_DDL = "scope string, record string, item string, n int, code long"


def brute(rows, most):
    baskets = defaultdict(set)
    for s, r, i, *_ in rows:
        if r is not None and i is not None:
            baskets[(s, r)].add(i)
    baskets = {k: v for k, v in baskets.items() if len(v) <= most}
    n, single, pair = Counter(), Counter(), Counter()
    for (s, _), items in baskets.items():
        n[s] += 1
        single.update((s, i) for i in items)
        pair.update((s, *p) for p in itertools.combinations(sorted(items), 2))
    return {(s, a, b, c, single[(s, a)], single[(s, b)], n[s]) for (s, a, b), c in pair.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["x", "y", None]), f"r{r.randrange(40)}", r.choice(["hot", *(f"i{k}" for k in range(12)), None]), 0, 0) for _ in range(600)]
    rows += [("x", "wide", f"w{k}", 0, 0) for k in range(30)] + [("x", None, "hot", 0, 0)] + rows[:9]
    got = cooccurrence(spark.createDataFrame(rows, _DDL).repartition(6), ["scope"], "record", "item", 12)
    assert {(p.scope, p.item_a, p.item_b, p.n_ab, p.n_a, p.n_b, p.records) for p in got.collect()} == brute(rows, 12)
    p = got.orderBy("n_ab", ascending=False).first()
    neither = p.records - p.n_a - p.n_b + p.n_ab
    assert p.lift == pytest.approx(p.n_ab * p.records / (p.n_a * p.n_b))
    assert p.odds_ratio == pytest.approx((p.n_ab + 0.5) * (neither + 0.5) / ((p.n_a - p.n_ab + 0.5) * (p.n_b - p.n_ab + 0.5)))


def test_rare_pairs_and_empty(spark):
    df = spark.createDataFrame([("x", "1", "a", 0, 0), ("x", "1", "b", 0, 0), ("x", "2", "a", 0, 0), ("x", "2", "b", 0, 0), ("x", "2", "c", 0, 0)], _DDL)
    assert {(p.item_a, p.item_b) for p in cooccurrence(df, ["scope"], "record", "item", 100, 2).collect()} == {("a", "b")}
    assert cooccurrence(df.limit(0), ["scope"], "record", "item").count() == 0
