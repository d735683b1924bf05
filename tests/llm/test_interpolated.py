import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import interpolated


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(rows):
    part = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in rows}
    train = Counter(t for d, x in rows if part[d] != 1 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = {}
    for d, x in rows:
        own = tokens(x)
        out[d] = (part[d] == 1, len(own), sum(train[t] > 0 for t in own), n, sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
    return out


@pytest.mark.parametrize("chars", [12_000_000, 40_000])
def test_tables(spark, monkeypatch, chars):
    monkeypatch.setattr(interpolated, "CHARS", chars)
    monkeypatch.setattr(interpolated, "RANGE", chars)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(90001, None), (90002, ""), (90003, " \t\n The END the \x85 é É"), (90005, "unseen wordswordswords")]
    got = interpolated.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("x"))).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4]) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_numbers_go_and_come_back():
    for kind in ("<u8", "<u4", "<i8"):
        x = np.array([0, 1, 2**31, 7], dtype=kind)
        assert (interpolated.read_back(interpolated.numbers(x, kind), kind) == x).all() and len(interpolated.read_back(b"", kind)) == 0


def test_weights_find_the_better_part():
    rng = np.random.default_rng(1)
    good, bad = rng.uniform(0.2, 0.4, 200), rng.uniform(0.001, 0.01, 200)
    w = interpolated.fitted(np.stack([bad, good, np.full(200, 1e-6)], 1), rng.integers(1, 9, 200))
    assert w[1] > 0.95 and w.sum() == pytest.approx(1) and interpolated.fitted(np.empty((0, 3)), np.empty(0)) == pytest.approx([1 / 3] * 3)


def test_odd_tables(spark):
    one = spark.createDataFrame([(None, "a b"), (4, None), (4, None)], "doc_id long, text string")
    assert len(interpolated.score(one).collect()) == 3
    assert interpolated.score(one.limit(0)).count() == 0


def learned(rows, weights_part=0):
    """Plain deleted interpolation: (probability of each token of each text) from counts in dictionaries."""
    part = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in rows}

    def counts(parts):
        one, two, begun = Counter(), Counter(), 0
        for d, x in rows:
            if part[d] in parts:
                begun += 1
                own = tokens(x)
                one.update(own)
                two.update(zip(["<begin>", *own], own))
        return one, two, begun, sum(one.values())

    def parts_of(x, model, types):
        one, two, begun, n = model
        for a, b in zip(["<begin>", *tokens(x)], tokens(x)):
            context = begun if a == "<begin>" else one[a]
            yield (int(math.log2(context)) + 1 if context else 0), (two[a, b] / context if context else 0, one[b] / n, 1 / (types + 1))

    every, kept = counts({0, 2, 3, 4}), counts({2, 3, 4})
    types, seen = len(every[0]), {}
    for d, x in rows:
        if part[d] == weights_part:
            for level, p in parts_of(x, kept, types):
                seen.setdefault(level, []).append(p)
    weights = {}
    for level, ps in [*seen.items(), (-1, [p for x in seen.values() for p in x])]:
        w = [1 / 3] * 3
        for _ in range(60):
            shares = [0.0] * 3
            for p in ps:
                total = sum(a * b for a, b in zip(w, p))
                shares = [s + a * b / total for s, a, b in zip(shares, w, p)]
            w = [s / sum(shares) for s in shares]
        weights[level] = [(x + 1e-6) / (1 + 3e-6) for x in w]
    return {d: sum(math.log10(sum(a * b for a, b in zip(weights.get(level, weights[-1]), p))) for level, p in parts_of(x, every, types)) for d, x in rows}


def test_score_equals_plain_interpolation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").orderBy("doc_id").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(90001, None), (90002, "unseen wordswordswords")]
    want = learned(rows)
    for r in interpolated.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=0.01), r.doc_id  # estimates are rounded for the weights


def test_one_key_for_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(interpolated, "CHARS", 2000)
    rows = [(7, f"word{i} " * 40 + "of the same key") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    apply = interpolated.runs
    monkeypatch.setattr(interpolated, "runs", lambda docs, ranges: sizes.extend(r["count"] for r in docs.groupBy("block").count().collect()) or apply(docs, ranges))
    assert interpolated.score(df).count() == 300 and len(sizes) > 8 and max(sizes) < 90
