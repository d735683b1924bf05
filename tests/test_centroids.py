"""Models of several centroids, packed encoders, entropies and streams against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.functions.itemmem import packed
from hyperloom.operators import encode as en
from hyperloom.operators import features as fe
from hyperloom.operators import train as tr
from hyperloom.plans.streams import kept


@pytest.mark.parametrize("how", ["FeatxVal", "ChxFeatxVal", "FeatxChxVal", "ChFeatCombxVal", "FeatAppend", "ChAppend", "FeatValRot"])
def test_packed_encoders_give_the_bits_of_the_plain_ones(spark, how):
    rng, channels, features = np.random.default_rng(3), 3, 4
    x = rng.integers(0, 6, (7, channels, features))
    m = en.Memories(spark, 64, 6, features, channels)
    rows = spark.createDataFrame([(w, c, f, int(x[w, c, f])) for w, c, f in np.ndindex(x.shape)], "win int, ch int, f int, level int")
    keys = ["win", "block"] if how.endswith("Append") else ["win"]
    want = {tuple(r[k] for k in keys): r.hv for r in packed(en.encode(rows, m, how, ["win"]), *keys).collect()}
    arrays = spark.createDataFrame([(w, x[w].ravel().tolist()) for w in range(len(x))], "win int, levels array<int>")
    got = {tuple(r[k] for k in keys): r.hv for r in en.encode_packed(arrays, m, how, ["win"], features).collect()}
    assert got == want


def test_merging_until_none_is_near(spark):
    rng, d = np.random.default_rng(4), 64
    centres = rng.integers(0, 2, (3, d))
    model = []
    for i in range(9):
        n = int(rng.integers(1, 40)) * 2 + 1
        bits = centres[i % 3] ^ (rng.random(d) < 0.1)
        model.append([i, n, np.where(bits == 1, n, 0)])
    rows = spark.createDataFrame([(1, i, p, int(a[p]), n) for i, n, a in model for p in range(d)], "class int, centroid int, pos int, a long, n long")
    got = tr.reduce_by_merging(tr.with_bits(rows, ["class", "centroid"]), [], d, 0.5, kept(spark, "test"))
    while len(model) > 1:
        bits = {i: a > n // 2 for i, n, a in model}
        small = min(model, key=lambda m: (m[1], m[0]))
        others = [(np.mean(bits[small[0]] != bits[m[0]]), m[0]) for m in model if m is not small]
        best = min(others)
        if best[0] >= 0.5 * np.mean([x for x, _ in others]):
            break
        into = next(m for m in model if m[0] == best[1])
        into[1], into[2] = into[1] + small[1], into[2] + small[2]
        model.remove(small)
    assert 1 < len(model) < 9
    assert {r.centroid: (r.n, list(r.acc)) for r in got.collect()} == {i: (n, a.tolist()) for i, n, a in model}


def test_rule_of_retraining():
    assert tr.stops([0.1], -0.01, 0.02) and not tr.stops([0.1, -0.05], 0.05, 0.02)
    assert tr.stops([0.3, 0.01, -0.01, 0.005], 0.3, 0.02) and tr.stops([0.5, -0.1, -0.1, -0.1], 0.2, 0.02)
    assert not tr.stops([0.01, 0.3, 0.01, -0.2], 0.1, 0.02)


def test_retraining_returns_the_best_pass(spark):
    scores = iter([0.5, 0.6, 0.8, 0.7, 0.75, 0.74, 0.7, 0.65, 0.6])
    frame = spark.range(1).withColumn("v", F.lit(0))
    model, at, seen = tr.retrain_until(frame, lambda m: m.withColumn("v", F.col("v") + 1), lambda m: next(scores), lambda m: m, most=31, least=0.02)
    assert (model.first()["v"], at) == (2, 2) and seen == [0.5, 0.6, 0.8, 0.7, 0.75, 0.74, 0.7, 0.65]


def plain_counts(x, m, r):
    runs = [x[i : i + m] for i in range(len(x) - m + 1)]
    return [sum(all(abs(p - q) <= r for p, q in zip(a, b)) for b in runs) for a in runs]


def test_entropies_by_their_definitions():
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=40), np.sin(np.arange(60) / 3), rng.integers(0, 3, 50).astype(float)):
        r = 0.2 * x.std()
        phi = [sum(math.log(c / (len(x) - m + 1)) for c in plain_counts(x.tolist(), m, r)) / (len(x) - m + 1) for m in (2, 3)]
        assert fe.approximate_entropy_of(x) == pytest.approx(phi[0] - phi[1])
        b = sum(plain_counts(x[:-1].tolist(), 2, r)) - (len(x) - 2)
        a = sum(plain_counts(x.tolist(), 3, r)) - (len(x) - 2)
        assert fe.plain_sample_entropy_of(x) == pytest.approx(-math.log(a / b))
        shapes = [tuple(sorted(range(3), key=lambda k: (x[i + k], k))) for i in range(len(x) - 2)]
        p = [shapes.count(s) / len(shapes) for s in itertools.permutations(range(3)) if s in shapes]
        assert fe.perm_entropy_of(x) == pytest.approx(-sum(v * math.log2(v) for v in p) / math.log2(6))
    wave, noise = np.sin(2 * np.pi * np.arange(256) / 16), rng.normal(size=256)
    assert fe.spectral_entropy_of(wave) < 0.3 < 0.8 < fe.spectral_entropy_of(noise)
    assert fe.svd_entropy_of(np.ones(30)) == pytest.approx(0, abs=1e-6) and fe.svd_entropy_of(noise) > 0.9
    assert fe.spectral_entropy_of(np.zeros(20)) == 0 and fe.entropy_symbols_of(np.arange(64.0), 10)["perm"] == 0
    assert [len(fe.feature_set_of(noise, n, 64.0)) for n in (37, 45, 46, 54)] == [37, 45, 46, 54]


def test_open_events_are_sent_when_a_key_is_silent(spark, tmp_path):
    from hyperloom.streaming.operators import evidence_events

    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    sure = [(1, day(i + 1), i, 1, 0.9) for i in range(6)]  # positive to the end, then silent
    other = [(2, day(i + 1), i, i // 4 % 2, 0.9) for i in range(4, 30)]
    schema = "subject int, ts string, win int, y int, p double"
    for k, rows in enumerate((sure + other[:5], other[5:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part*")).withColumn("ts", F.to_timestamp("ts"))
    sent = []
    save = lambda df, i: sent.extend((r.subject, r.start, r.stop) for r in df.collect())
    evidence_events(stream, ["subject"], 3, 0.5, 2, "3 days").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    assert (1, 2, 6) in sent and sum(s == 1 for s, *_ in sent) == 1 and any(s == 2 for s, *_ in sent)
