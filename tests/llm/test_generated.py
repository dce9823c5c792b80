import random

import numpy as np

from codeloam.llm.generated import Vocabulary, features, kind_of, not_by_hand, signature

R = random.Random(2)
W = "lamp fence cable garden boiler window carpet tile pipe valve door roof wall stair floor".split()


def statement(r):
    a, b, c = (r.choice(W) for _ in range(3))
    return r.choice([f"{a} = open_{b}({c}, {r.randrange(99)})", f"if {a} > {r.randrange(500)}:\n        return {b}", f"for {a} in {b}s:\n        {c}.push({a})", f'{a} = "{b} {c}"', f"while {a} and not {b}:\n        {a} = {c}[{r.randrange(9)}]", f"{a}, {b} = {c}.split({r.randrange(9)}), {r.randrange(99)}", f"{a}.{b} += {c}({a}) * 2 - {r.randrange(50)}", f"raise {a.title()}({b} or {c})", f"assert {a} != {b}, {c}"])


def hand(seed, n=12):
    r = random.Random(seed)
    return "\n\n".join(f"def {r.choice(W)}_{r.choice(W)}_{i}({r.choice(W)}, {r.choice(W)}):\n    " + "\n    ".join(statement(r) for _ in range(r.randrange(3, 9))) for i in range(n)) + "\n"


ACCESSORS = "\n".join(f"def get_{R.choice(W)}_{i}(m):\n    return m.fields[{i}]\n" for i in range(40))
CASES = [
    ("a", "src/hand.py", hand(1), None), ("a", "src/other.py", hand(2), None), ("b", "src/third.py", "# Reads what a generator wrote; see notes.\n" + hand(3), None), ("b", "src/emit.py", hand(4) + 'BANNER = "Code generated by x. DO NOT EDIT."\n', None),
    ("a", "src/stub.py", '"""Auto-generated stub."""\n' + hand(5), None), ("a", "src/one_line.py", hand(6) + "KEYS = [" + ", ".join(str(R.randrange(9999)) for _ in range(60)) + "]\n" + hand(7), None),
    ("a", "pkg/x_pb.py", ACCESSORS, "generated"), ("a", "pkg/head.py", "# Code generated by kettle v1.2. DO NOT EDIT.\n" + hand(8), "generated"), ("b", "pkg/foot.py", hand(9) + "\n# This file was automatically generated from a.proto; changes will be lost.\n", "generated"),
    ("a", "web/app.min.js", "".join(f"function a{i}(b,c){{return b?c.d({i}):null}}" for i in range(90)), "minified"), ("a", "data/codes.py", "CODES = [\n" + "\n".join("  " + ", ".join(str(R.randrange(99999)) for _ in range(10)) + "," for _ in range(30)) + "\n]\n", "blob"),
    ("a", "tools/copy.py", hand(20), "vendored"), ("b", "lib/copied.py", hand(20), "vendored"), ("c", "x/edited.py", hand(20) + "\n\ndef more():\n    return 1\n", "vendored"), ("a", "vendor/kettle-1.2/src.py", hand(21), "vendored"), ("a", "lib/own.py", "# Copied unchanged from kettle 1.2, keep in step with upstream.\n" + hand(22), "vendored"),
    ("a", "src/external/adapter.py", hand(23), None), ("a", "empty.py", "", None), ("a", "tiny.py", "x = 1\n", None), ("c", "same.py", "import a\n", None), ("b", "same.py", "import a\n", None),
]


def test_kinds(spark):
    rows = [(r, p, c, "py", 1) for r, p, c, _ in CASES] + [("a", "none.py", None, None, 1), ("a", "pkg/x_pb.py", ACCESSORS, "py", 1)]
    df = spark.createDataFrame(rows, "repo string, path string, content string, language string, bucket int")
    got = {(r.repo, r.path): r.why for r in not_by_hand(df).collect()}
    assert got == {(r, p): k for r, p, _, k in CASES if k}
    assert not_by_hand(df.limit(0)).count() == 0


def test_family_held_by_a_third_of_all_files(spark):
    copies = [(f"r{i % 50}", f"lib/f{i}.py", hand(77) + f"\n\ndef last_{i}():\n    return {i}\n") for i in range(1500)]
    own = [("z", f"src/h{i}.py", hand(1000 + i)) for i in range(40)]
    got = not_by_hand(spark.createDataFrame(copies + own, "repo string, path string, content string"))
    found = {(r.repo, r.path) for r in got.collect()}
    assert found == {(a, b) for a, b, _ in copies}


def test_signatures_estimate_similarity():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = signature(h[:1100]), signature(h[100:1200])
    assert abs((a == b).mean() - 1000 / 1200) < 0.1
    assert signature(h[:3]) is None


def test_tokens():
    words = Vocabulary(most=3)
    text = 'x = "a//b" // note\n# [1]\n$y->z(3)'
    for _ in range(2):  # the second time after the vocabulary was cleared
        at, comments = words.read(text)
        back = {i: t for t, i in words.number.items()}
        assert [back[i] for i in at.tolist()] == ["x", "=", '"a//b"', "$y", "-", ">", "z", "(", "3", ")"]
        assert comments == [(3, "// note"), (3, "# [1]")]  # with the tokens before each
    assert [kind_of(t) for t in ("x", "$y", "7", "'a'", "//", "+")] == [2, 2, 3, 1, 0, 4]
    f = features("a.py", "", Vocabulary())
    assert f["n_tokens"] == 0 and f["plain"] is None


def test_notices_of_any_length_and_place():
    code = "\n".join(f"int f{i}(int a{i}) {{ return g{i}(a{i} + {i}); }}" for i in range(9))
    licence = "/*\n" + "\n".join(f" * clause {i} of a long licence, word for word" for i in range(60)) + "\n */\n"
    said = features("a.c", licence + "// Code generated by gen. DO NOT EDIT.\n\n" + code, Vocabulary())
    assert said["says_output"] and not features("a.c", licence + code, Vocabulary())["says_output"]
    assert features("a.php", "<?php\n" + licence.replace(" */", " * @generated\n */") + code, Vocabulary())["says_output"]
    assert not features("a.c", code + "\n// as do the files generated by gen\n" + code, Vocabulary())["says_output"]


def test_unlike_files_of_one_bucket_are_split(spark, monkeypatch):
    from codeloam.llm import generated as G

    monkeypatch.setattr(G, "PART", 8)
    monkeypatch.setattr(G, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    first = rng.integers(1, 1 << 32, 4, dtype=np.uint32)
    rows = []
    for i in range(60):  # one band in common, else unlike, but for the last two
        s = rng.integers(1, 1 << 32, 128, dtype=np.uint32)
        s[:4] = first
        rows.append((f"r{i % 3}", f"f{i}", s.tobytes()))
    rows.append(("r9", "twin", rows[-1][2]))
    got = G.similar_files(spark.createDataFrame(rows, "repo string, path string, plain binary"), "plain", False)
    assert {r.path for r in got.collect()} == {"f59", "twin"}


def _near(n, seed, most):
    """Files of one band, each up to `most` values off an earlier one or unlike all; seven of eight of one repository."""
    rng = np.random.default_rng(seed)
    first, all_, rows = rng.integers(1, 1 << 32, 4, dtype=np.uint32), [], []
    for i in range(n):
        s = all_[rng.integers(len(all_))].copy() if all_ and rng.random() < 0.7 else rng.integers(1, 1 << 32, 128, dtype=np.uint32)
        off = rng.choice(128, rng.integers(18, most), replace=False)
        s[off] = rng.integers(1, 1 << 32, len(off), dtype=np.uint32)
        s[:4] = first
        all_.append(s)
        rows.append((f"r{int(rng.random() < 0.125)}", f"f{i}", s.tobytes()))
    return rows


def _by_all_pairs(rows, across):
    """Clusters of each band by comparison of all pairs."""
    s = np.array([np.frombuffer(x, np.uint32) for *_, x in rows])
    like, found = (s[:, None] == s[None]).mean(axis=2) >= 0.8, set()
    for band in range(0, 128, 8):
        meet = like & (s[:, None, band : band + 4] == s[None, :, band : band + 4]).all(axis=2)
        seen = set()
        for i in range(len(rows)):
            cluster, todo = {i}, [i]
            while todo and i not in seen:
                new = set(np.flatnonzero(meet[todo.pop()]).tolist()) - cluster
                cluster |= new
                todo += new
            seen |= cluster
            if len({rows[j][0] for j in cluster} if across else cluster) > 1:
                found |= {rows[j][:2] for j in cluster}
    return found


def test_no_link_is_lost_in_crowded_buckets(spark, monkeypatch):
    from codeloam.llm import generated as G

    for name, v in (("PART", 8), ("ROUNDS", 2), ("TILE", 24)):
        monkeypatch.setattr(G, name, v, raising=False)
    for seed, most, across in ((3, 28, True), (4, 34, False)):
        rows = _near(150, seed, most)
        got = G.similar_files(spark.createDataFrame(rows, "repo string, path string, plain binary"), "plain", across)
        assert {tuple(r) for r in got.collect()} == _by_all_pairs(rows, across)


def test_similar_files_without_an_equal_split_meet(spark, monkeypatch):
    from codeloam.llm import generated as G

    monkeypatch.setattr(G, "PART", 8)
    monkeypatch.setattr(G, "ROUNDS", 2)
    rng = np.random.default_rng(6)
    rows, pairs = _near(60, 7, 120), set()
    rows = [(r, p, rng.integers(1, 1 << 32, 128, dtype=np.uint32)) for r, p, _ in rows]
    off = np.arange(4, 128, 5)
    off[[1, 4, 8, 11, 14, 17, 20, 24]] = np.arange(8, 128, 16)
    off[16] = 82
    for i in range(12):  # 25 values off, as many as may be: one in each stretch but the last, and in each band but the first
        twin = rows[i][2].copy()
        twin[off] += np.uint32(1)
        rows.append(("z", f"twin{i}", twin))
        pairs |= {rows[i][1], f"twin{i}"}
    for _, _, s in rows:
        s[:4] = 1
    rows = [(r, p, s.tobytes()) for r, p, s in rows]
    df = spark.createDataFrame(rows, "repo string, path string, plain binary")
    for across in (False, True):
        assert {r.path for r in G.similar_files(df, "plain", across).collect()} == pairs
