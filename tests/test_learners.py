"""Learners against slow second forms and small exact solvers."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.operators import boost, kernel, neighbours, similarity
from hyperloom.operators import train as tr
from hyperloom.sources.scratch import kept, scratch
from hyperloom.streaming import online


# ---- learners that go in order, worked out from the rules with plain numbers


def dist(a, b):
    return sum(x != y for x, y in zip(a, b)) / len(a)


def slow_online(x, y, subtract, power):
    classes = sorted(set(y))
    acc, n, bits = {c: [0.0] * len(x[0]) for c in classes}, dict.fromkeys(classes, 0.0), {c: [0] * len(x[0]) for c in classes}
    for v, c in zip(x, y):
        d = {k: dist(bits[k], v) for k in classes}
        pred = min(classes, key=lambda k: (d[k], k))
        w = d[c] ** power if n[c] else 1.0
        acc[c], n[c] = [a + w * (2 * b - 1) for a, b in zip(acc[c], v)], n[c] + w
        if pred != c and n[pred] and subtract:
            acc[pred], n[pred] = [a - (1 - d[pred]) * (2 * b - 1) for a, b in zip(acc[pred], v)], n[pred] - (1 - d[pred])
        bits = {k: [1 if a > 0 else 0 if a < 0 else b for a, b in zip(acc[k], bits[k])] for k in classes}
    return [(c, n[c], bits[c]) for c in classes]


def slow_soft(x, y, always, boosted):
    classes = sorted(set(y))
    acc, n = {c: [0.0] * len(x[0]) for c in classes}, dict.fromkeys(classes, 0.0)
    soft = lambda d: 1 / (1 + math.exp(-20 * (d - 0.5))) + 1 / (1 + math.exp(-20 * (-d - 0.5)))
    for v, c in zip(x, y):
        d = {k: soft(dist([int(a > 0) for a in acc[k]], v)) for k in classes}
        pred, first = min(classes, key=lambda k: (d[k], k)), n[c] == 0
        if pred == c and not always and not first:
            continue
        w = (1.0 if first else d[c]) * (boosted if c == 1 else 1.0)
        acc[c], n[c] = [a + w * (2 * b - 1) for a, b in zip(acc[c], v)], n[c] + w
        if pred != c and n[pred]:
            acc[pred], n[pred] = [a - 0.5 * (1 - d[pred]) * (2 * b - 1) for a, b in zip(acc[pred], v)], n[pred] - 0.5 * (1 - d[pred])
    return [(c, n[c], [int(a > 0) for a in acc[c]]) for c in classes]


def slow_multi(x, y):
    held, same, other = {c: [] for c in sorted(set(y))}, [], []
    bits = lambda m: [int(a > m[1] // 2) for a in m[0]]
    for v, c in zip(x, y):
        own = [dist(bits(m), v) for m in held[c]]
        rest = [dist(bits(m), v) for k in held if k != c for m in held[k]]
        if not own:
            held[c].append([list(v), 1])
            continue
        d = min(own)
        k = own.index(d)
        s, o = (sum(z) / len(z) if z else None for z in (same, other))
        if s is None or o is None or d < s or (d < o and o - d > d - s):
            held[c][k] = [[a + b for a, b in zip(held[c][k][0], v)], held[c][k][1] + 1]
        else:
            held[c].append([list(v), 1])
        same.append(d)
        other += [min(rest)] if rest else []
    return [(c, i, m[1], bits(m)) for c in held for i, m in enumerate(held[c])]


def drawn(seed, n=60, d=32, classes=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (classes, d))
    y = rng.integers(0, classes, n)
    return np.where(rng.random((n, d)) < 0.25, 1 - base[y], base[y]).astype(np.int8), y


@pytest.mark.parametrize("seed", range(4))
def test_learners_in_order(seed):
    x, y = drawn(seed)
    plain = x.tolist(), y.tolist()
    for subtract, power in ((True, 2), (False, 1)):
        got = [(c, pytest.approx(n), b.tolist()) for c, _, n, b in tr.online(x, y, subtract, power)]
        assert slow_online(*plain, subtract, power) == got
    for always, boosted in ((True, 1.0), (False, 2.0)):
        got = [(c, pytest.approx(n), b.tolist()) for c, _, n, b in tr.online_soft(x, y, always, boosted)]
        assert slow_soft(*plain, always, boosted) == got
    assert slow_multi(*plain) == [(c, i, n, b.tolist()) for c, i, n, b in tr.multi_centroid(x, y)]


def words(bits):
    return [int(w) for w in np.packbits(np.asarray(bits, dtype=np.uint8), bitorder="little").view("<u4")]


def test_learners_run_per_key_in_order(spark):
    """TRN3, TRN4 and TRN7 over keys whose rows come in any order."""
    rows, want = [], {}
    for fold in range(3):
        x, y = drawn(10 + fold)
        rows += [(fold, i, int(c), words(v)) for i, (v, c) in enumerate(zip(x, y))]
        want[fold] = {k: f(x, y) for k, f in (("online", tr.online), ("soft", tr.online_soft), ("multi", tr.multi_centroid))}
    df = spark.createDataFrame(rows, "fold int, win long, label int, hv array<long>").orderBy(F.rand(3))
    for name, learner in (("online", tr.online), ("soft", tr.online_soft), ("multi", tr.multi_centroid)):
        got = sorted((r["fold"], r["class"], r["centroid"], round(r["n"], 9), r["hv"]) for r in tr.in_order(df, ["fold"], learner, ()).collect())
        assert got == sorted((f, c, i, round(float(n), 9), words(b)) for f in want for c, i, n, b in want[f][name])


def slow_general(models, d, rule, passes):
    acc = {0: [0.0] * d, 1: [0.0] * d}
    like = lambda a, v: sum((x > 0) == (b == 1) for x, b in zip(a, v)) / d if any(a) else 0.0
    for _ in range(passes):
        for _, c, v in sorted(models):
            s, signed = {k: like(acc[k], v) for k in acc}, [2 * b - 1 for b in v]
            w = {"Avrg": 1.0, "WSub": 1.0}.get(rule, 1 - s[c])
            acc[c] = [a + w * b for a, b in zip(acc[c], signed)]
            if rule in ("WAdd&Sub", "WSub") and any(acc[1 - c]):
                acc[1 - c] = [a - s[1 - c] * b for a, b in zip(acc[1 - c], signed)]
    return {c: words([a > 0 for a in acc[c]]) for c in acc}


@pytest.mark.parametrize("rule", ["Avrg", "WAdd", "WAdd&Sub", "WSub"])
def test_general_models_by_weights(spark, rule):
    rng = np.random.default_rng(5)
    models = [(s, c, rng.integers(0, 2, 64).tolist()) for s in range(7) for c in (0, 1)]
    df = spark.createDataFrame([(s, c, words(v)) for s, c, v in models], "subject int, class int, hv array<long>")
    got = {r["class"]: r["hv"] for r in similarity.general_weighted(df, 64, rule, 2).collect()}
    assert got == slow_general(models, 64, rule, 2)


# ---- a stream's models


def test_online_models_dont_depend_on_the_cut(spark):
    rng = np.random.default_rng(8)
    base, rows = rng.integers(0, 2, (3, 64)), []
    for k, (start, n) in enumerate(((0, 90), (10, 40), (200, 60), (0, 30))):  # the last one falls silent, and comes again
        for i in range(n):
            label = int(rng.integers(0, 3))
            bits = np.where(rng.random(64) < 0.3, 1 - base[label], base[label])
            rows.append((k, start + i + (400 if k == 3 and i >= 15 else 0), i // 20, i, label, words(bits)))
    rows.append((9, 900, 0, 0, 0, words(base[0])))
    table = pd.DataFrame(rows, columns=["subject", "s", "batch", "win", "label", "hv"]).sort_values("s", kind="stable")
    schema = "subject int, ts timestamp, batch long, win long, label int, hv array<long>"

    def sent(cuts):
        path, out = scratch(spark, "cut"), scratch(spark, "models")
        for i, part in enumerate(np.array_split(np.arange(len(table)), cuts)):
            own = spark.createDataFrame(table.iloc[part]).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).selectExpr("int(subject) subject", "ts", "batch", "win", "int(label) label", "hv")
            own.coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")
        with online.rocksdb(spark):
            made = online.online_models(stream, ["subject"], 64, "100 seconds")
            made.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.parquet(f"{out}/b={i}")).start().awaitTermination()
        found = spark.read.option("recursiveFileLookup", True).schema("subject int, batch long, class int, acc array<double>, n double").parquet(out).collect()
        return sorted((r["subject"], r["batch"], r["class"], tuple(r["acc"]), r["n"]) for r in found)

    whole = sent(1)
    assert whole == sent(7)
    # the same mini-batches by hand
    model, want = {}, []
    own = table[table["subject"] == 0]
    for b, part in own.groupby("batch"):
        model = tr.minibatch(model, tr.bits_of(part), part["label"].to_numpy())
        want += [(0, b, c, tuple(a), n) for c, (a, n) in sorted(model.items())]
    assert [r for r in whole if r[0] == 0] == [(s, b, c, a, pytest.approx(n)) for s, b, c, a, n in want]
    assert sum(r[0] == 3 and r[1] == 0 for r in whole) == 6  # two models, since silence ended the first


def test_minibatch_adds_and_takes():
    x = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 1]], dtype=np.int8)
    first = tr.minibatch({}, x, np.array([0, 0, 1]))
    assert first[0][0].tolist() == [2, 0, -2, -2] and first[0][1] == 2 and first[1][0].tolist() == [-1, -1, 1, 1]
    # class 0 says 1000, class 1 says 0011: the vector 1001 of class 1 is predicted 0, at 1/4, and 1/2 from its own
    second = tr.minibatch(first, np.array([[1, 0, 0, 1]], dtype=np.int8), np.array([1]))
    assert second[1][0].tolist() == [-0.5, -1.5, 0.5, 1.5] and second[1][1] == 1.5
    assert second[0][0].tolist() == [2 - 0.375, 0.375, -2 + 0.375, -2 - 0.375]


# ---- baselines


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 5), st.integers(1, 6), st.sampled_from([3, 1000, 1 << 29]))
def test_best_equals_sorting(seed, n, width, k, most):
    rng = np.random.default_rng(seed)
    x, rows = rng.integers(-most, most, (7, width)), rng.integers(-most, most, (n, width))
    i, j, d = neighbours.best(x, rows, k)
    want = [(a, b, int(((x[a] - rows[b]) ** 2).sum())) for a in range(7) for b in sorted(range(n), key=lambda b: (int(((x[a] - rows[b]) ** 2).sum()), b))[:k]]
    assert list(zip(i.tolist(), j.tolist(), d.tolist())) == want


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SENT", 30)
    rng = np.random.default_rng(1)
    rows = [(i, [int(v) for v in rng.integers(0, 4, 3)], int(rng.integers(0, 3))) for i in range(60)] + [(100, [1, 2], 0)]
    df = spark.createDataFrame(rows, "id long, v array<long>, label int")
    got = sorted(map(tuple, neighbours.knn(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), 5, "id").collect()))
    want = []
    for i, v, _ in (r for r in rows if r[0] % 3 == 0 and len(r[1]) == 3):
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, y) for j, w, y in rows if j % 3 and len(w) == 3)[:5]
        votes = [y for *_, y in near]
        pred = min(set(votes), key=lambda y: (-votes.count(y), y))
        want.append((i, pred, votes.count(pred) / 5))
    assert got == want


def slow_boost(levels, y, rounds, n_levels):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        tried = []
        for f in range(levels.shape[1]):
            for t in range(n_levels - 1):
                says = (levels[:, f] > t).astype(int)
                e = w[says != y].sum() / w.sum()
                tried += [(round(e, 12), f, t, 0), (round(1 - e, 12), f, t, 1)]
        e, f, t, o = min(tried)
        if e >= 0.5:
            break
        vote = 0.5 * math.log((1 - max(e, 1e-10)) / max(e, 1e-10))
        out.append((f, t, 1 - 2 * o, round(vote, 9)))
        if e == 0:
            break
        h = np.where(levels[:, f] > t, 1, -1) * (1 - 2 * o)
        w = w * np.exp(-vote * h * (2 * y - 1))
    return out


@pytest.mark.parametrize("noise", [0.0, 0.3])
def test_stumps_equal_explicit_weights(spark, noise):
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 6, (200, 4))
    y = ((levels[:, 1] > 2) ^ (rng.random(200) < noise)).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(levels, y)], "levels array<int>, label int")
    stumps = boost.boosted_stumps(df, 5, 6)
    assert [(s.feature, s.cut, s.sign, round(s.vote, 9)) for s in stumps] == slow_boost(levels, y, 5, 6)
    assert boost.boosted_stumps(df.limit(0), 5, 6) == []


def moons(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a = rng.random(n) * 2 * np.pi
    r = np.where(y == 1, 1.0, 2.2) + rng.normal(0, 0.15, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), y


def exact_svm(x, y, c, gamma, sweeps=200):
    """Dual coordinate ascent on the kernel matrix, the border moved by a constant feature."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)) + 1
    s, alpha = 2.0 * y - 1, np.zeros(len(y))
    f = np.zeros(len(y))
    for _ in range(sweeps):
        for i in range(len(y)):
            new = min(c, max(0.0, alpha[i] + (1 - s[i] * f[i]) / k[i, i]))
            f += (new - alpha[i]) * s[i] * k[:, i]
            alpha[i] = new
    return lambda z: (np.exp(-gamma * ((z[:, None] - x[None]) ** 2).sum(axis=2)) + 1) @ (alpha * s)


def test_kernel_machine_agrees_with_an_exact_solver(spark):
    (x, y), (z, u) = moons(300, 1), moons(300, 2)
    rows = lambda a, b: spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(a, b))], "id int, v array<double>, label double")
    machine = kernel.KernelSVM(rows(x, y), gamma=0.5, n=1024)
    got = np.array([r["prediction"] for r in machine.transform(rows(z, u)).orderBy("id").collect()])
    want = exact_svm(x, y, 1.0, 0.5)(z) > 0
    assert (got == want).mean() > 0.97 and (got == u).mean() > 0.95
    linear = tr.baseline(rows(x, y).selectExpr("label", "v").withColumn("features", __import__("pyspark.ml.functions", fromlist=["x"]).array_to_vector("v")), "svm")
    assert linear.coefficients.size == 2  # a linear machine can't tell a ring from what is inside
    size, variance = kernel.spread(rows(x, y), "v")
    assert size == 2 and variance == pytest.approx(x.var())


def test_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    z = kernel.FourierFeatures(3, 8192, 0.7).of(x)
    assert np.abs(z @ z.T - np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 0.06


def test_boosted_trees_learn_what_one_cannot(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    x, y = moons(400, 3)
    rows = spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    learner = DecisionTreeClassifier(maxDepth=1, seed=1)
    right = lambda said: said.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    one = right(learner.setParams(featuresCol="features", labelCol="label").fit(rows).transform(rows))
    many = boost.AdaBoost(rows, DecisionTreeClassifier(maxDepth=1, seed=1), 12, kept(spark, "weights"))
    said = many.transform(rows)
    assert len(many.models) == 12 and right(said) > one + 0.1
    assert said.agg(F.min("p"), F.max("p")).first()[0] >= 0.5
