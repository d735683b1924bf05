"""Boundary cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.functions import hv
from hyperloom.functions.itemmem import item_memory, packed
from hyperloom.operators import encode, events, features, folds, normalise, predict, smooth, train, windows

K = ["s"]


def labels(spark, y, extra=None):
    return spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(y)], "s int, win long, y int")


def test_window_end_is_strict(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "s int, t long, x double")
    rows = windows.sliding_windows(df, K, 4, 2).groupBy("win").agg(F.min("t").alias("a"), F.count("*").alias("n")).orderBy("win").collect()
    assert [(r.win, r.a, r.n) for r in rows] == [(0, 0, 4), (1, 2, 4), (2, 4, 4)]


@pytest.mark.parametrize(("y", "want"), [("11000", [(1, 2)]), ("00111", [(2, 4)]), ("10001", []), ("01010", [(1, 2), (3, 4)]), ("11111", [(1, 4)]), ("00000", [])])
def test_events_at_the_ends(spark, y, want):
    got = events.label_events(labels(spark, y), K).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == want


def test_vote_starts(spark):
    df = labels(spark, "111100")
    got = {start: "".join(str(r.y_s1) for r in smooth.smooth_vote(df, K, 3, 0.5, start).orderBy("win").collect()) for start in ("after", "full")}
    assert got == {"after": "000110", "full": "001110"}


@pytest.mark.parametrize(("inclusive", "filled"), [(False, 0), (True, 5)])
def test_merge_gap(spark, inclusive, filled):
    df = labels(spark, "1" * 10 + "0" * 5 + "11").withColumnRenamed("y", "y_s1")
    assert smooth.merge_close(df, K, 5, inclusive).agg(F.sum("y_s2") - F.sum("y_s1")).first()[0] == filled


@pytest.mark.parametrize(("how", "want"), [("majority_up", 1), ("majority_round", 0), ("majority", 0), ("atLeastOne", 1), ("allOne", 0), ("start", 0)])
def test_label_voting(spark, how, want):
    df = spark.createDataFrame([(0, i, int(i == 3)) for i in range(5)], "s int, t long, label int")
    assert windows.window_labels(df, K, 4, 4, how).first().label == want


def test_levels_at_the_ends(spark):
    rows = spark.createDataFrame([("a", 5.0), ("a", 15.0), ("a", -9.0), ("b", 3.0), ("b", None), ("a", float("nan"))], "f string, v double")
    stats = spark.createDataFrame([("a", 0.0, 10.0), ("b", 3.0, 3.0)], "f string, lo double, hi double")
    got = sorted((r.f, r.level) for r in normalise.discretise(rows, stats, ["f"], 20).collect())
    assert got == [("a", 0), ("a", 0), ("a", 9), ("a", 19), ("b", 0), ("b", 0)]


def test_majority_and_prediction_ties(spark):
    bits = spark.createDataFrame([(0, 0, b) for b in (1, 1, 0, 0)] + [(0, 1, b) for b in (1, 1, 1, 0)], "s int, pos int, bit int")
    assert {r.pos: r.bit for r in encode.majority(bits, K).collect()} == {0: 0, 1: 1}
    tie = spark.createDataFrame([(3, 3)], "d0 int, d1 int")
    assert [tie.select(predict.label_of(x)).first()[0] for x in ("argmin", "positive", "strict")] == [0, 1, 0]


def test_scaled_memory_distances(spark):
    memory = packed(item_memory(spark, "scaleNoRand", "x", 20, 100), "idx")
    first = memory.filter("idx = 0").select(F.col("hv").alias("zero"))
    got = memory.crossJoin(first).select("idx", hv.hv_distance("hv", "zero").alias("d")).collect()
    assert all(r.d == 5 * r.idx for r in got)


def test_vector_functions_are_inverse(spark):
    d = 70
    m = packed(item_memory(spark, "random", "x", 6, d), "idx")
    rows = m.select((hv.hv_xor(hv.hv_xor("hv", "hv"), "hv") == F.col("hv")).alias("a"), (hv.hv_flip(hv.hv_flip("hv", d), d) == F.col("hv")).alias("b"), (hv.hv_rotate(hv.hv_rotate("hv", 9, d), -9, d) == F.col("hv")).alias("c"),
                    (hv.hv_count(hv.hv_flip("hv", d)) + hv.hv_count("hv") == d).alias("e"), (hv.hv_pack(hv.hv_unpack("hv", d), d) == F.col("hv")).alias("f"))
    assert all(all(r) for r in rows.collect())


def test_fast_forms_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    rows = [(w, w % 3, f, int(rng.integers(0, 20))) for w in range(40) for f in range(6)]
    df = spark.createDataFrame(rows, "win int, label int, f int, level int")
    m = encode.Memories(spark, 96, 20, 6, 1)
    plain = packed(encode.encode(df, m, "FeatxVal", ["win", "label"]), "win", "label")
    arrays = df.groupBy("win", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "level"))), lambda x: x["level"]).alias("levels"))
    fast = encode.encode_fast(arrays, m, ["win", "label"], 6)
    assert sorted(map(tuple, fast.select("win", "hv").collect())) == sorted(map(tuple, plain.select("win", "hv").collect()))
    bundle = {r.label: r for r in train.bundle_fast(fast, ["label"]).collect()}
    for r in packed(train.train_bundle(encode.encode(df, m, "FeatxVal", ["win", "label"]), ["label"]), "label").collect():
        assert bundle[r.label].hv == r.hv


def test_leave_one_out_is_total_less_own(spark):
    rng = np.random.default_rng(1)
    enc = spark.createDataFrame([(w % 4, w, p, int(rng.integers(0, 2))) for w in range(30) for p in range(8)], "r int, win int, pos int, bit int").withColumn("k", F.lit(0))
    loo = {(r.fold, r.pos): (r.acc, r.n, r.bit) for r in train.leave_one_out(train.train_bundle(enc, ["k", "r"]), ["k"], "r").collect()}
    for fold in range(4):
        for r in train.train_bundle(enc.filter(F.col("r") != fold), ["k"]).collect():
            assert loo[fold, r.pos] == (r.acc, r.n, r.bit)


def test_chunks_keep_rows_and_events(spark):
    y = "0001111100000011000111110"
    df = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(y)], "s int, t long, label int")
    ev = events.label_events(df.withColumnRenamed("t", "win").withColumnRenamed("label", "y"), K)
    rows = folds.rechunk_fixed(df, ev, K, 6).collect()
    assert len(rows) == len(y) and sum(r.label for r in rows) == y.count("1")
    for e in ev.collect():
        assert len({r.chunk for r in rows if e.start <= r.t < e.stop}) == 1
    assert folds.rechunk_event_to_event(df, K).select("chunk").distinct().count() == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=40), st.lists(st.integers(0, 1), min_size=2, max_size=40))
def test_episode_counts_add_up(a, b):
    def runs(y):
        edges = np.flatnonzero(np.diff([0, *y, 0]))
        return [(int(x), int(z)) for x, z in zip(edges[::2], edges[1::2], strict=True)]

    t, p = runs(a), runs(b)
    hits, missed, false = events.episode_counts(t, p)
    assert hits + missed == len(t) and 0 <= hits <= len(p) and false >= 0
    assert events.episode_counts(t, t)[:2] == (len(t), 0)


def test_kernels():
    t = np.arange(1024) / 256
    power = features.band_powers_of(np.sin(2 * np.pi * 10 * t), 256)
    assert power["rel_alpha"] > 0.9 and power["total"] == pytest.approx(0.5, rel=0.05)
    assert features.cwt_symbol_of(np.sin(2 * np.pi * 10 * t), 256, [5, 10, 20]) == 1
    x = np.cumsum(np.random.default_rng(0).normal(size=200))
    assert np.abs(features.simplified(x, 1.0) - x).max() <= 1.0 and (features.simplified(x, 1e9)[[0, -1]] == x[[0, -1]]).all()
    bands = features.dwt_of(np.ones(64), 3)
    assert all(np.abs(b).max() < 1e-9 for b in bands[:3]) and features.sample_entropy_of(np.sin(t[:200] * 20)) < features.sample_entropy_of(np.random.default_rng(1).normal(size=200))
    assert features.fft_spectrum_of(np.zeros(8), 8, 4).sum() == 0 and features.fft_spectrum_of(x, 8, 4).sum() == pytest.approx(1)


def test_wilcoxon_exact():
    assert events.exact_p(5, 0) == pytest.approx(2 / 32) and events.exact_p(6, 21) == 1.0


def test_bandpass(spark):
    """Against the difference equations one sample at a time, in chunks, and at known gains."""
    fs, lo, hi = 64.0, 1.0, 20.0
    g, sections = features.bandpass_sections(fs, lo, hi)

    def one_pass(v):
        past = v[0]
        for a1, a2 in sections:
            x1 = x2 = past
            y1 = y2 = past = 0.0
            out = []
            for x in v:
                y = g * (x - x2) - a1 * y1 - a2 * y2
                x1, x2, y1, y2 = x, x1, y, y1
                out.append(y)
            v = out
        return v

    x = np.random.default_rng(5).normal(size=4000).cumsum() + 100
    wide = [*(2 * x[0] - x[27:0:-1]), *x, *(2 * x[-1] - x[-2:-29:-1])]
    want = one_pass(one_pass(wide)[::-1])[::-1][27:-27]
    np.testing.assert_allclose(features.bandpass_of(x, fs, lo, hi), want, atol=1e-8)
    df = spark.createDataFrame([(k, t, float(v)) for k in (1, 2) for t, v in enumerate(x[: 4000 // k])], "subject int, t long, x double")
    got = features.bandpass(df, ["subject"], fs, lo, hi, chunk=700).orderBy("subject", "t").toPandas()
    assert len(got) == 6000
    np.testing.assert_allclose(got["y"][:4000], want, atol=1e-7)
    np.testing.assert_allclose(got["y"][4000:], features.bandpass_of(x[:2000], fs, lo, hi), atol=1e-7)
    t = np.arange(20000) / fs
    for f, gain in ((lo, 0.5), (hi, 0.5), (5.0, 1.0)):
        assert abs(np.abs(features.bandpass_of(np.sin(2 * np.pi * f * t), fs, lo, hi)[8000:12000]).max() - gain) < 0.01
    assert np.abs(features.bandpass_of(np.full(500, 7.0), fs, lo, hi)).max() < 1e-9 and len(features.bandpass_of(x[:1], fs, lo, hi)) == 1


def test_numbered(spark):
    rows = [(k, t) for k in (3, 1, 2) for t in range(400 if k == 3 else 7)]
    df = spark.createDataFrame(rows, "recording int, start int").repartition(5)
    for blocks in (2, 50, 1000):
        assert [(r.recording, r.start) for r in folds.numbered(df, ["recording", "start"], "k", blocks).orderBy("k").collect()] == sorted(rows)
    assert {r.k for r in folds.numbered(df, ["recording", "start"], "k", 50).collect()} == set(range(len(rows)))
    assert folds.numbered(df.limit(0), ["recording", "start"], "k").count() == 0
