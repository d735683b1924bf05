"""Steps whose work grows with their input, and edges at which queries differed from their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import events, explain, features, smooth
from hyperloom.plans import ORACLES, QUERIES


def test_merging_goes_once_through_a_series(spark):
    """No frame ends at the last row: Spark goes through such a one anew for every row."""
    rng = random.Random(4)
    labels = [int(rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(labels)], "subject int, win long, y_s1 int")
    out = smooth.merge_close(df, ["subject"], 3)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    ones = [i for i, v in enumerate(labels) if v]
    want = set(ones).union(*[range(a, b) for a, b in zip(ones, ones[1:]) if b - a - 1 < 3])
    assert {r.win for r in out.filter("y_s2 = 1").collect()} == want


def test_early_warnings_of_one_key_with_many_events(spark):
    """Events on either side of a key are met in time bins, not all with all."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("win"), (F.col("id") % 10 == 4).cast("int").alias("y_true"), (F.col("id") % 20 == 2).cast("int").alias("y"))
    out = events.metrics12(df, ["k"], 1, 2)
    assert "_bin" in out._jdf.queryExecution().optimizedPlan().toString()
    row = out.first()
    assert (row.sens_e, row.fp_per_hour, row.sens) == (0.5, 0.0, 0.0)
    row = events.metrics12(df, ["k"], 1, 1).first()  # a prediction at 2 ends at 3, before 4 - 1
    assert (row.sens_e, row.fp_per_hour) == (0.0, n / 20 / n)


@pytest.mark.parametrize("name", ["flt6_useful_bits", "prd2_prd7_two_class_rules"])
def test_equal_class_vectors(spark, tmp_path, name):
    """Classes whose vectors have no bit that differs, and windows at distance 0 from both."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS vec_id, [0.5::FLOAT FOR x IN range(64)] AS embedding, (i % 2)::INT AS label FROM range(6) AS r(i)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert len(want) == (0 if name == "flt6_useful_bits" else 6)


def test_greedy_order_reads_its_elements_once(spark, tmp_path):
    stored = []

    def keep(df):
        stored.append(df.columns)
        df.write.parquet(f"{tmp_path}/{len(stored)}")
        return spark.read.parquet(f"{tmp_path}/{len(stored)}")

    rng = random.Random(8)
    rows = [(w, e, w % 2, rng.random(), rng.random()) for w in range(40) for e in "abcd"]
    right = lambda df: df.groupBy("element").agg(F.round(F.avg((F.col("pred") == F.col("y")).cast("int")), 6).alias("value"))
    got = explain.greedy_order(spark.createDataFrame(rows, "win long, element string, y int, d0 double, d1 double"), right, 4, keep)
    gap, want = {(w, e): a - b for w, e, _, a, b in rows}, []
    for _ in range(4):
        taken = [e for e, _ in want]
        value = lambda e: round(sum((sum(gap[w, x] for x in [*taken, e]) > 0) == w % 2 for w in range(40)) / 40, 6)
        want.append(min(((e, value(e)) for e in "abcd" if e not in taken), key=lambda x: (-x[1], x[0])))
    assert got == want and stored == [["win", "gaps"]]


def test_values_of_two_histograms_stay_in_their_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("name"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("v"))
    session = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in session}
    for k, v in session.items():
        spark.conf.set(k, v)
    try:
        out = explain.class_histograms(rows, ["name"], 30)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.groupBy("name", "label").agg(F.round(F.sum("share"), 9).alias("s")).filter("s = 1").count() == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["enc12_lbp", "enc13_symbols", "enc14_enc15_spectra", "enc15_fft"])
def test_no_rows_of_bits(spark, name):
    """Majorities are counted in the task that has a window's symbols, not over a row for each bit."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "pos#" not in plan


def test_majorities_of_symbols(spark):
    """The same as from rows of bits, for even and odd numbers of symbols, lists of several lengths and vectors of 40 bits."""
    from hyperloom.functions.itemmem import packed
    from hyperloom.operators import encode

    rng = random.Random(8)
    m = encode.Memories(spark, 40, 6, 5, 4)
    value, channel = encode.bit_table(m.value), encode.bit_table(m.channel)
    rows = [(i, c, rng.randrange(6)) for i in range(30) for c in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "win long, ch int, symbol int")
    listed = df.groupBy("win").agg(F.collect_list(F.col("symbol") * 4 + F.col("ch")).alias("symbols"))
    got = encode.encode_tokens(listed, "symbols", encode.pairs_of(value, channel), ["win"], channel[0] ^ channel[1])
    want = packed(encode.encode_symbol(df, m, ["win"]), "win")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("win", "hv").collect()))
    hows = ["FreqxVal", "ChxFreqxVal", "PermChFreqxVal"]
    spectra = [(i, [[rng.randrange(6) for _ in range(3 + (i + c) % 3)] for c in range(i % 4 + 1)]) for i in range(30)]
    df = spark.createDataFrame(spectra, "win long, levels array<array<int>>")
    flat = spark.createDataFrame([(i, c, f, v) for i, lists in spectra for c, own in enumerate(lists) for f, v in enumerate(own)], "win long, ch int, f int, level int")
    got = sorted((r.how, r.win, r.hv) for r in encode.encode_spectra_packed(df, m, hows, ["win"]).collect())
    assert got == sorted((how, r.win, r.hv) for how in hows for r in packed(encode.encode_spectra(flat, m, how, ["win"]), "win").collect())


@pytest.mark.parametrize("n", [1, 2, 3, 8, 64, 300])
def test_features_of_many_windows(n):
    """Windows of one length go through numpy together and give what each gives alone, constant and repeating ones too."""
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=(20, n)).round(1), np.full((2, n), 0.3), np.tile([1.0, 2.0], (1, n))[:, :n]])
    pairs = [(features.entropy_set_by(x, 2, 3), [features.entropy_set_of(v, 2, 3) for v in x]), (features.feature_set_by(x, 54, 64.0), [features.feature_set_of(v, 54, 64.0) for v in x])]
    for many, alone in pairs:
        assert list(many) == list(alone[0])
        for k, v in many.items():
            np.testing.assert_allclose(v, [a[k] for a in alone], rtol=1e-9, atol=1e-12, err_msg=k)


def test_features_take_arrays_together(spark, monkeypatch):
    """The queries' features don't call a function for each row."""
    def alone(*_):
        raise AssertionError

    monkeypatch.setattr(features, "per_array", alone)
    df = spark.createDataFrame([(i, [float(i * j % 7) for j in range(60 + i % 3)] if i < 12 else None) for i in range(13)], "k long, v array<double>")
    got = features.feature_set(df, ["k"], "v", 54, 64.0).collect()
    assert [r.k for r in got if r.total is None] == [12] and len(got) == 13
    for r in (r for r in got if r.k < 12):
        want = features.feature_set_of(np.array([float(r.k * j % 7) for j in range(60 + r.k % 3)]), 54, 64.0)
        assert all(abs(r[c] - v) < 1e-9 for c, v in want.items())


def test_features_of_many_subjects(spark, tmp_path):
    """The number of folders doesn't grow with that of subjects, and one subject is read from one file."""
    from hyperloom.sources import tables

    path = str(tmp_path / "rows")
    df = spark.range(3000).select((F.col("id") % 500).cast("int").alias("subject"), F.col("id").alias("t"))
    tables.write_hashed(df, path, "subject", 8)
    assert len([p for p in (tmp_path / "rows").glob("_folder=*")]) == 8 and len([p for p in (tmp_path / "rows").glob("*/*.parquet")]) == 8
    back = tables.read_hashed(spark, path)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    own = tables.read_value(spark, path, "subject", 77, 8)
    assert sorted(r.t for r in own.collect()) == list(range(77, 3000, 500)) and len(own.inputFiles()) <= 8
    assert own.select(F.input_file_name()).distinct().count() == 1


def test_neighbours_hold_a_part_of_a_block(monkeypatch):
    """A block of training rows is taken in parts, with ties across them to the earlier row."""
    from hyperloom.operators import neighbours

    monkeypatch.setattr(neighbours, "TAKEN", 7)
    seen, best, rng = [], neighbours.best, np.random.default_rng(5)
    monkeypatch.setattr(neighbours, "best", lambda x, rows, k: (seen.append(len(rows)), best(x, rows, k))[1])
    for n in (0, 1, 7, 40):
        x, rows = rng.integers(-2, 3, (9, 3)), rng.integers(-2, 3, (n, 3))
        got = neighbours.best_of_block(x, neighbours.narrow(rows), 5)
        assert [c.tolist() for c in got] == [c.tolist() for c in best(x, rows, 5)]
    assert max(seen) == 7
    assert [neighbours.narrow(np.array([v, 0])).dtype for v in (-128, 128, 1 << 40)] == [np.int8, np.int16, np.int64]


def test_slices_of_long_series(monkeypatch):
    """Parts of a batch hold a bounded number of samples, each row once."""
    import pyarrow as pa

    from hyperloom.operators import polyline

    monkeypatch.setattr(polyline, "HELD", 10)
    rng = np.random.default_rng(6)
    for n in (0, 1, 30):
        sizes = rng.integers(1, 9, n)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([list(range(k)) for k in sizes], pa.list_(pa.int64()))], names=["k", "xs"])
        parts = list(polyline.slices(batch, sizes))
        assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(n))
        assert all(sum(map(len, polyline.arrays(p, "xs"))) < 10 + 9 for p in parts)
        assert [v.tolist() for p in parts for v in polyline.arrays(p, "xs")] == [list(range(k)) for k in sizes]
