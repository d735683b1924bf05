import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda x: [ord(c) for c in x]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        for s in full or open_:
            out[s] = most * sizes[s] if full else unit * weight[s]
            left -= out[s]
        open_ -= full or open_
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_fitted_is_closest(pairs, budget):
    pairs.sort()
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    taken = mixing.fitted(sizes, counts, budget)
    assert ((taken >= 0) & (taken <= counts)).all()
    best = min(abs(budget - sum(k * s for k, s in zip(ks, sizes.tolist()))) for ks in itertools.product(*[range(c + 1) for c in counts.tolist()]))
    assert abs(budget - int((taken * sizes).sum())) == best


def test_fitted_large():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 9000, 3000))
    counts = rng.integers(1, 40, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.01, 0.37, 0.9, 0.999):
        taken = mixing.fitted(sizes, counts, int(total * share))
        assert abs(int((taken * sizes).sum()) - int(total * share)) <= 8 and (taken <= counts).all()


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size string")
    return mixing.mix(df).collect()


def test_hot_source_nulls_ties_and_copies(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot", "x", "y") for i in range(900)]
    rows += [(1000 + i, "a b c", None, None, None) for i in range(50)] + [(1000, "a b c", None, None, None)] * 3
    rows += [(2000, None, "z", None, None), (2001, "", "hot", None, None), (2002, " \n", "é", None, None), (2003, "only one here", "é", None, None)]
    got = mixed(spark, rows)
    assert len(got) == len(rows) and sorted(got) == sorted(mixed(spark, rows[::-1]))
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(r.target == pytest.approx(want[s]) and 0 <= r.times <= 3 for r in own)
        assert abs(sum(r.times * r.size for r in own) - want[s]) <= 3


def test_empty_and_wordless(spark):
    assert mixed(spark, []) == []
    assert [r.times for r in mixed(spark, [(1, None, "a", None, None), (2, "", None, None, None)])] == [0, 0]


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs)
    for r in got.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("t"), F.max("target").alias("target")).collect():
        assert abs(r.t - r.target) <= 10


def test_many_sources(spark):
    rng = np.random.default_rng(5)
    sizes = {f"host{i:06d}": int(x) for i, x in enumerate(rng.zipf(1.6, 100_000).clip(max=10**6))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert len(got) == len(sizes) and all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_one_huge_text_among_many_sizes():
    import tracemalloc

    sizes = np.concatenate([np.arange(1, 3000), np.arange(5_000_000, 5_003_000), [10_000_000]])
    tracemalloc.start()
    taken = mixing.fitted(sizes, np.ones(len(sizes), dtype=np.int64), 7_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(int((taken * sizes).sum()) - 7_000_000) <= 1 and peak < 400e6
