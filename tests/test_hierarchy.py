import random

import pytest

from codeloam.operators.hierarchy import descendants, hierarchy

_DDL = "f string, idx int, parent int, name string, container string, depth int, extra string"


def brute(rows):
    """(f, idx) -> (root, depth, status, names, descendants, cycle)"""
    at = {}
    for f, i, p, n, c in rows:
        at[(f, i)] = (p, n, c)
    up = {}
    for (f, i), (p, n, c) in at.items():
        if p is None and c is not None:
            named = [j for (g, j), (_, m, _) in at.items() if g == f and m == c]
            p = min(named) if named else None
        up[(f, i)] = (f, p) if (f, p) in at else None
    out = {}
    for k in at:
        walk, seen = [k], {k}
        while up[walk[-1]] is not None and up[walk[-1]] not in seen:
            walk.append(up[walk[-1]])
            seen.add(walk[-1])
        if up[walk[-1]] is None:
            out[k] = (walk[-1][1], len(walk) - 1, "root" if len(walk) == 1 else "node", [at[x][1] or "" for x in reversed(walk)])
        else:
            back = up[walk[-1]]
            out[k] = (-1, -1, "loop" if back == k else "below_loop", None)
    below = {k: 0 for k in at}
    pairs = set()
    for k in at:
        if out[k][2] == "node":
            x, steps = up[k], 1
            while x is not None:
                below[x] += 1
                pairs.add((*x, k[1], steps))
                x, steps = up[x], steps + 1
    return out, below, pairs


def random_rows(seed, files=4, n=40):
    r = random.Random(seed)
    rows = []
    for f in [*map(str, range(files)), None]:
        for i in range(r.randint(1, n)):
            p = r.choice([None, None, r.randrange(n), max(0, i - 1), r.randrange(max(1, i))])
            rows.append((f, i, p, f"n{i}", r.choice([None, None, f"n{r.randrange(n)}", "nowhere"])))
    return rows


@pytest.mark.parametrize("max_rows", [200_000, 12, 3])
def test_against_brute_force(spark, max_rows):
    rows = random_rows(max_rows)
    df = spark.createDataFrame([(*r, 9, "x") for r in rows + rows[:5]], _DDL)
    got = hierarchy(df, ["f"], "idx", "parent", "name", "container", max_rows).cache()
    out, below, pairs = brute(rows)
    seen = {(r.f, r.id): r for r in got.collect()}
    assert set(seen) == set(out)
    for k, (root, depth, status, names) in out.items():
        r = seen[k]
        assert (r.root_id, r.depth, r.status, r.names) == (root, depth, status, names), k
        assert r.n_descendants == (below[k] if root >= 0 else 0)
        if status == "loop" and r.cycle is not None:
            assert k[1] in r.cycle
    assert {tuple(r) for r in descendants(got, ["f"]).collect()} == pairs
    trees = [r for r in seen.values() if r.enter is not None and r.enter >= 0]
    for a in trees:
        inside = {b.id for b in trees if b.f == a.f and b.root_id == a.root_id and a.enter < b.enter <= a.leave}
        assert len(inside) == a.n_descendants


def test_long_chain(spark):
    n = 400
    df = spark.range(n).selectExpr("'a' as f", "cast(id as int) as idx", "cast(nullif(id - 1, -1) as int) as parent", "concat('n', id) as name", "cast(null as string) as container")
    for most in (10_000, 100):
        r = hierarchy(df, ["f"], "idx", "parent", "name", "container", most).where(f"id = {n - 1}").first()
        assert (r.root_id, r.depth, len(r.names)) == (0, n - 1, n)


def test_large_loop(spark):
    df = spark.range(50).selectExpr("'a' as f", "cast(id as int) as idx", "cast(case when id = 0 then 20 else id - 1 end as int) as parent", "'n' as name", "cast(null as string) as container")
    for most in (1000, 10):
        got = {r.id: r.status for r in hierarchy(df, ["f"], "idx", "parent", "name", "container", most).collect()}
        assert got == {i: "loop" if i <= 20 else "below_loop" for i in range(50)}


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], _DDL)
    assert hierarchy(empty, ["f"], "idx", "parent", "name", "container").count() == 0
    df = spark.createDataFrame([("a", None, 1, "x", None, 0, ""), ("a", 1, 1, None, None, 0, ""), ("a", 2, 7, None, "gone", 0, "")], _DDL)
    assert {(r.id, r.status) for r in hierarchy(df, ["f"], "idx", "parent", "name", "container").collect()} == {(1, "loop"), (2, "root")}


@pytest.mark.parametrize("seed", [12, 3])
def test_size_of_components_does_not_change_results(spark, seed):
    rows = random_rows(seed) + [("loop", i, (i + 1) % 3 if i < 3 else i - 3, f"n{i}", None) for i in range(30)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], _DDL)
    whole, *cut = ({(r.f, r.id): r for r in hierarchy(df, ["f"], "idx", "parent", "name", "container", most).collect()} for most in (200_000, 12, 3))
    out, _, _ = brute(rows)
    up = {k: r.parent_id for k, r in whole.items()}
    for got in (whole, *cut):
        for k, r in got.items():
            loop = [k[1]]
            while out[k][2] == "loop" and up[k[0], loop[-1]] != k[1]:
                loop.append(up[k[0], loop[-1]])
            assert r.cycle == (sorted(loop) if out[k][2] == "loop" else None)
    assert cut == [whole, whole]
