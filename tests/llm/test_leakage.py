import random

import numpy as np
import pytest

from codeloam.llm.leakage import SPAN, _stretches, aligned, leaks, own_passage, words

V = [f"w{i}x" for i in range(400)]


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def leaks_by_brute_force(item, doc):
    return any(8 * edits(item[i:j], doc) <= j - i for i in range(len(item)) for j in range(i + 25, min(len(item), i + 40) + 1))


@pytest.mark.parametrize("seed", range(6))
def test_alignment(seed):
    r = random.Random(seed)
    for _ in range(12):
        item = [r.randrange(60) for _ in range(r.randrange(26, 60))]
        a = r.randrange(0, len(item) - 25)
        part = item[a : a + r.randrange(22, 40)]
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(part))
            part = r.choice([part[:k] + part[k + 1 :], part[:k] + [-1] + part[k:], part[:k] + [-1] + part[k + 1 :]])
        doc = [r.randrange(60) for _ in range(20)] + part + [r.randrange(60) for _ in range(20)]
        want = leaks_by_brute_force(item, doc)
        assert aligned(np.array(item), np.array(doc), 25, 8) == want


def test_words_and_passages():
    assert words("The <b>Old</b> &amp; `read_it`\u200b\u00a0now — caf\u00e9\u00ad!") == ["the", "old", "read", "it", "now", "caf\u00e9"]
    assert own_passage("Do this.\n\nOne two.\n\nThree.") == "One two.\n\nThree."
    assert own_passage("no instruction here") == "no instruction here"


def test_leaks(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(V) for _ in range(n))
    passages = [text(60) for _ in range(12)]
    items = [(i, f"Read this.\n\n{p}") for i, p in enumerate(passages)] + [(50, f"Other words.\n\n{passages[0]}"), (51, "x\n\nshort one"), (52, None), (53, "")]
    docs, want = [], set()
    for i in range(300):
        docs.append((i, text(r.randrange(0, 200)), 1))
    for i, p in enumerate(passages):
        w = p.split()
        docs.append((1000 + i, text(40) + "\n" + "*/ " + "\n// ".join(w[5:30]).upper() + "\n" + text(30), 1))
        want.add((1000 + i, i))
        changed = w[10:50]
        changed[9::9] = ["zzz"] * len(changed[9::9])
        docs.append((2000 + i, " ".join(changed), 1))
        want.add((2000 + i, i))
        docs.append((3000 + i, " ".join(w[:20]) + " " + text(9) + " " + " ".join(w[21:41]), 1))
        worse = w[:]
        worse[3::4] = ["zzz"] * len(worse[3::4])
        docs.append((4000 + i, " ".join(worse), 1))
    want |= {(a, 50) for a, b in want if b == 0}
    docs += [(5000, None, 1), (5001, "", 1), (1000, docs[300][1], 1), (5002, text(60_000) + " " + passages[3], 1)]
    want.add((5002, 3))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in leaks(df, it).collect()} == want
    assert {tuple(x) for x in leaks(df, it, block_words=300).collect()} == want
    assert leaks(df.limit(0), it).count() == 0 == leaks(df, it.limit(0)).count()


@pytest.mark.parametrize("copies", [1, 100])
def test_edited_leaks_in_a_third_of_the_documents(spark, copies):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(V) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    items = [(i, f"Read this.\n\n{p}") for i, p in enumerate(passages)]
    docs, want = [(i, text(120)) for i in range(300 - copies)], set()
    for k in range(copies):
        w = passages[0].split()
        short, long = w[20:45], w[:]
        short[3], short[12], short[20] = "zzz", "yyy", "xxx"
        long[4::8] = ["zzz"] * len(long[4::8])
        near = w[:]
        near[4::6] = ["zzz"] * len(near[4::6])
        # a part of another item beside it draws the vector of the passage away
        docs += [(1000 + k, f"{text(30)} {' '.join(short)} {text(30)}"), (2000 + k, " ".join(passages[1].split()[:12] + short + passages[2].split()[:12])), (3000 + k, " ".join(long[:57])), (4000 + k, " ".join(near))]
        want |= {(1000 + k, 0), (2000 + k, 0), (3000 + k, 0)}
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == want


def test_stretches_hold_every_run_with_its_surroundings():
    r = random.Random(1)
    for _ in range(50):
        runs = sorted(r.sample(range(5000), r.randrange(1, 400)))
        cut = list(_stretches(runs, 50))
        assert all(any(a <= max(0, p - 50) and p + 56 <= b for a, b in cut) for p in runs)
        assert max(b - a for a, b in cut) <= SPAN + 106
