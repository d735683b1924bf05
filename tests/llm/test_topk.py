import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperloom.llm import topk


def brute(rows, every, k, scale=1024):
    good = [(i, np.array([math.floor(scale * float(x)) for x in v], dtype=np.int64)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6), st.integers(1, 12))
def test_tree_equals_brute_force(seed, n, dim, k):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (n, dim)).astype(float)
    ids = rng.permutation(n).astype(np.int64)
    tree, query = topk.Tree(points, ids, leaf=4), rng.integers(-3, 4, dim).astype(float)
    scores, found = tree.search(query, 0, k, -np.inf)
    want = sorted((-s, i) for s, i in zip((points @ query).tolist(), ids.tolist(), strict=True) if i != 0)[:k]
    assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want
    if len(want) == k:
        again = tree.search(query, 0, k, -want[-1][0])
        assert again[1].tolist() == found.tolist()


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 5) / 4]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0]), (2020, [1.0, math.nan, 0.0, 0.0, 0.0]), (2030, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, rank long")
    got = {tuple(r) for r in topk.top_k(df, every=10).collect()}
    assert got == brute(rows, 10, 10)
    assert topk.top_k(df.limit(0)).count() == 0
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), every=2).collect()} == brute(rows[:3], 2, 10)
