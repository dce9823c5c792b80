import random

import numpy as np
import pytest

from codeloam.llm.packing import _encoding, differencing, divide, pack, TOKENIZER


def test_differencing_is_near_equal():
    rng = np.random.default_rng(5)
    for windows in (2, 3, 17):
        sizes = rng.integers(1, 500, 400)
        load = np.bincount(differencing(sizes, windows), sizes, minlength=windows)
        assert load.sum() == sizes.sum() and load.max() - load.min() <= 5
    load = np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(load) == [14, 16]  # the known result of differencing on these numbers
    assert differencing(np.array([], np.int64), 3).tolist() == []
    assert sorted(differencing(np.array([5, 5, 5]), 3).tolist()) == [0, 1, 2]


def test_windows_rise_until_they_fit():
    at, windows = divide(np.array([6, 6, 6]), 10)
    assert windows == 3 and len(set(at.tolist())) == 3


def test_pack(spark):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["lock", "the", "session", "Größe", "x1"]) for _ in range(r.randrange(0, 120))), "z") for i in range(900)]
    texts += [(900, None, "z"), (901, "", "z"), (902, "word " * 1000, "z"), (903, "é" * 300_000, "z"), (5, texts[5][1], "z"), (None, "no id", "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, container string").repartition(3)
    got = pack(df, 256, block=200).collect()
    load, seen = {}, {}
    for x in got:
        load[x.container] = load.get(x.container, 0) + x.n_tokens
        seen.setdefault(x.doc_id, []).append((x.piece, x.first_token, x.n_tokens))
    assert max(load.values()) <= 256
    e = _encoding(TOKENIZER)
    for i, t, _ in texts[:900]:
        n = len(e.encode_ordinary(t))
        pieces = sorted(seen[i])
        assert sum(p[2] for p in pieces) == n * (2 if i == 5 else 1)
        assert len(pieces) == max(1, -(-n // 256)) * (2 if i == 5 else 1)
    assert 900 not in seen and seen[901] == [(0, 0, 0)] and None in seen
    assert [p[1] for p in sorted(seen[902])] == [256 * k for k in range(len(seen[902]))]
    assert sum(load.values()) / (256 * len(load)) > 0.95


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0)
