"""Joins by bins, percentiles by selection, sums over pairs of elements, and prototypes as arrays, against plain forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import explain, features, polyline, predict, ranges, selection, similarity
from hyperloom.operators.events import match_events
from hyperloom.sources.scratch import kept


def intervals(rng, n, keys=3, most=60):
    return [(rng.randrange(keys), i, a := rng.randrange(-20, most), a + rng.choice([0, 1, 2, 5, 40])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, None])
def test_meeting_intervals(spark, width):
    rng = random.Random(2)
    a, b = intervals(rng, 60), intervals(rng, 60)
    df = lambda rows: spark.createDataFrame(rows, "k int, id int, start long, stop long")
    got = sorted((r.l_id, r.r_id) for r in ranges.meet(df(a), df(b), ["k"], width).collect())
    assert got == sorted((i, j) for k, i, s, e in a for m, j, t, f in b if k == m and s < f and e > t)


@pytest.mark.parametrize("width", [1, 9, None])
def test_places_in_intervals(spark, width):
    rng = random.Random(3)
    events = intervals(rng, 25)
    rows = [(k, t) for k in range(4) for t in range(-25, 110)]
    df, ev = spark.createDataFrame(rows, "k int, t long"), spark.createDataFrame(events, "k int, id int, start long, stop long")
    inside = {(k, t) for k, t in rows if any(k == m and a <= t < b for m, _, a, b in events)}
    assert {tuple(r) for r in ranges.covered(df, ev, ["k"], "left_semi", width=width).collect()} == inside
    assert sorted(map(tuple, ranges.covered(df, ev, ["k"], "left_anti", width=width).collect())) == sorted(set(rows) - inside)


def test_one_key_with_many_events(spark):
    """A hundred thousand events of a key on either side: pairs that meet, not all pairs."""
    events = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("event_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("stop"))
    later = events.withColumns({"start": F.col("start") + 2, "stop": F.col("stop") + 2})
    row = match_events(events, later, ["k"], 0, 0).agg(F.count("*"), F.sum("overlap")).first()
    assert tuple(row) == (100_000, 200_000)


def test_percentiles_by_selection(spark):
    rng = np.random.default_rng(5)
    groups = {
        "few": [3.0], "two": [-1.5, 2.5], "ties": [1.0] * 50 + [2.0] * 3, "spread": (rng.normal(size=400) * 10.0 ** rng.integers(-200, 200, 400)).tolist(), "zeros": [0.0, -0.0, -1e-320, 1e-320],
        "close": (1 + np.arange(99) * 2.0**-52).tolist(), None: rng.normal(size=64).tolist(), "infinite": [float("-inf"), 1.0, 2.0, float("inf")],
    }
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    found = {r.g: r.p for r in selection.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares, kept(spark, "values")).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        v = sorted(vs)
        for p, x in zip(shares, found[k]):
            at = p * (len(v) - 1)
            lo, hi = v[int(at)], v[min(int(at) + (at % 1 > 0), len(v) - 1)]
            assert x == (lo if at % 1 == 0 else pytest.approx((1 - at % 1) * lo + at % 1 * hi, rel=1e-12)), (k, p)
    whole = selection.exact_percentiles(spark.createDataFrame([(float(i),) for i in range(101)], "x double"), [], "x", [0.25], kept(spark, "values")).collect()
    assert [r.p for r in whole] == [[25.0]]
    assert selection.exact_percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5], kept(spark, "values")).count() == 0


def test_sums_over_pairs_of_elements(spark):
    """Also windows without some of the elements, and elements that never share a window."""
    rng = np.random.default_rng(7)
    rows = [(w, e, float(rng.random()), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for w in range(40) for e in range(6) if rng.random() < 0.7 and not (e == 5 and w < 38)]
    rows = [r for r in rows if not (r[1] == 4 and r[0] >= 38)]
    df = spark.createDataFrame(rows, "win int, element int, p1 double, pred int, y int").repartition(5)
    by = {(w, e): (p, a == b) for w, e, p, a, b in rows}
    got = {(r.one, r.other): r.agreement for r in explain.agreement(df, []).collect()}
    over = {(r.one, r.other): (r.cc, r.cw, r.wc, r.ww) for r in explain.prediction_overlap(df, []).collect()}
    want = {}
    for i, j in itertools.product(range(6), repeat=2):
        both = [(by[w, i], by[w, j]) for w in range(40) if (w, i) in by and (w, j) in by]
        if both:
            want[i, j] = 1 - np.mean([abs(a[0] - b[0]) for a, b in both])
            share = lambda x, y: np.mean([a[1] == x and b[1] == y for a, b in both])  # noqa: B023, E731
            assert over[i, j] == pytest.approx((share(True, True), share(True, False), share(False, True), share(False, False)))
    assert set(got) == set(over) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()) and (4, 5) not in want


@pytest.mark.parametrize("on", [[], ["k"]])
def test_nearest_prototypes_without_a_shuffle(spark, on):
    rng = np.random.default_rng(4)
    enc = spark.createDataFrame([(w, w % 2, [int(x) for x in rng.integers(0, 1 << 32, 2)]) for w in range(50)], "win int, k int, hv array<long>")
    model = spark.createDataFrame([(k, c, i, [int(x) for x in rng.integers(0, 1 << 32, 2)]) for k in (0, 1) for c in (0, 1) for i in range(3)], "k int, class int, centroid int, hv array<long>")
    model = model if on else model.filter("k = 0").drop("k")
    near, dist = predict.nearness(enc, model, ["win"], on), predict.distances(enc, model, ["win"], on)
    assert sorted(map(tuple, predict.nearest(near, ["win"]).collect())) == sorted(map(tuple, predict.predict(dist, ["win"]).collect()))
    assert sorted(map(tuple, predict.nearest_multi(near, ["win"]).collect())) == sorted(map(tuple, predict.predict_multi(dist, ["win"]).collect()))
    plan = predict.nearest(near, ["win"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(win" not in plan and "SortMergeJoin" not in plan


def test_symbols_over_noise(spark):
    df = spark.createDataFrame([(0, [4.0, 1.0, 1.0], 0), (1, [8.0, 1.0, 3.0], 0), (2, [8.0, 3.0, 1.0], 1), (3, [0.0, 0.0, 0.0], 0), (4, [9.0, 1.5, 1.0], 1)], "win int, energies array<double>, events int")
    noise = features.fit_noise(df, F.col("events") == 0)
    share = np.mean([[4 / 6, 1 / 6, 1 / 6], [8 / 12, 1 / 12, 3 / 12]], axis=0)
    assert noise.first().noise == pytest.approx(share.tolist())
    got = {r.win: r.symbol for r in features.noise_free_symbol(df, noise).collect()}
    assert got == {i: int(np.argmax(np.round(np.array(e) / share, 9))) for i, e, _ in df.collect()}


def test_growing_majorities_need_no_pairs(spark):
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (5, 2, 16))
    df = spark.createDataFrame([(s, c, p, int(bits[s, c, p])) for s, c, p in np.ndindex(bits.shape)], "subject int, class int, pos int, bit int")
    got = {(r["class"], r.k): (r.mean, r.std) for r in similarity.general_evolution_shuffled(df, ["class"], shuffles=4).collect()}
    import hashlib

    for c in (0, 1):
        sims = []
        for h in range(4):
            order = sorted(range(5), key=lambda s: (hashlib.md5(f"42|shuffle|{h}|{s}".encode()).hexdigest(), s))
            sims.append([np.mean([(bits[s, c] == (bits[order[:k], c].mean(axis=0) >= 0.5)).mean() for s in range(1, 5)]) for k in range(1, 6)])
        for k in range(1, 6):
            assert got[c, k] == (pytest.approx(np.mean([s[k - 1] for s in sims])), pytest.approx(np.std([s[k - 1] for s in sims])))


def test_hulls_answer_like_all_points():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 300):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n)), np.zeros(n), np.arange(n) * 0.1):
            at = polyline.hull(x)
            for _ in range(20):
                xa, xb = rng.normal(0, 3, 2)
                assert polyline.farthest(at, x[at], -5, n + 3, xa, xb) == polyline.farthest(np.arange(n), x, -5, n + 3, xa, xb)


@pytest.mark.parametrize("chunk", [4, 37, 4096])
def test_simplification_in_chunks(spark, chunk):
    """Equal to simplification of whole series, of any length, over chunks of any size."""
    rng = np.random.default_rng(chunk)
    series = {k: np.cumsum(rng.normal(size=n)) for k, n in enumerate((1, 2, 3, 60, 200))} | {9: np.zeros(50), 10: np.round(rng.normal(size=80))}
    df = spark.createDataFrame([(k, t, float(x)) for k, xs in series.items() for t, x in enumerate(xs)], "k int, t long, x double").repartition(6)
    got = {}
    for r in polyline.simplified_series(df, ["k"], [0.0, 0.5, 3.0], kept(spark, "simplified"), chunk).collect():
        got.setdefault((r.k, r.eps), {})[r.t] = r.x
    for k, xs in series.items():
        for e in (0.0, 0.5, 3.0):
            assert [got[k, e][t] for t in range(len(xs))] == features.simplified(xs, e).tolist(), (k, e)
