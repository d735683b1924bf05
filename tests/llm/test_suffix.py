import random
from collections import Counter

import numpy as np
import pytest

from hyperloom.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), int(gone.sum()), runs, kept))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(60, 160)) for _ in range(4)]
    made = [prose(rng.randint(0, 30)) + rng.choice(shared)[rng.randint(0, 40) : rng.randint(200, 900)] + prose(rng.randint(0, 30)) for _ in range(40)]
    for _ in range(25):  # near copies
        x = list(rng.choice(made))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice("xyz") if x else ""
        made.append("".join(x))
    made += [made[3], made[3], None, "", "a" * 1500, "a" * 401, "ab" * 400, shared[0] * 3, "x" + shared[0], shared[0][:399], prose(2000) + shared[1]]
    return made


@pytest.mark.parametrize("block", [1 << 18, 512])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rows = texts(block)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, N_bytes int")
    got = {r.doc_id: r for r in suffix.dedup(df).collect()}
    for i, (n, removed, runs, kept) in enumerate(brute(rows, suffix.LENGTH)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, runs, kept), i


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in suffix.dedup(spark.createDataFrame(docs)).collect()}
    for d, (n, removed, runs, kept) in zip(docs, brute([d.text for d in docs], suffix.LENGTH), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, runs, kept)


def test_empty_and_repeated_rows(spark):
    long = "".join(map(chr, range(300, 700)))
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.n_removed) for r in suffix.dedup(df).collect()) == [(0, 0), (1, 800), (1, 800), (2, 0)]
    assert suffix.dedup(df.limit(0)).count() == 0


def test_unique_text_over_several_blocks_loses_nothing(spark):
    rng = random.Random(12)
    once = [rng.randbytes(330_000).hex() for _ in range(2)]
    rows = [(0, once[0]), (1, once[1] + once[0][1000:1600])]  # one passage of 600 bytes is shared
    got = {r.doc_id: r for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans) for k, r in got.items()} == {0: (660_000, 600, 1), 1: (660_600, 600, 1)}
    assert bytes(got[0].kept).decode() == once[0][:1000] + once[0][1600:] and bytes(got[1].kept).decode() == once[1]


def test_stretches_do_not_depend_on_the_block():
    text = random.Random(13).randbytes(20_000)
    whole = suffix.stretches(text, 1 << 18)
    for block in (400, 512, 5000):
        assert all((a == b).all() for a, b in zip(whole, suffix.stretches(text, block), strict=True))


@pytest.mark.parametrize("files", [1, 7])
def test_passages_about_the_length(spark, tmp_path, files):
    """Passages of 399 bytes stay, of 400 and 401 go, wherever their copies are read from."""
    rng = random.Random(files)
    noise = lambda: rng.randbytes(300).hex()
    shared = {n: "".join(rng.choice("abcdefghij é") for _ in range(n)).encode()[:n].decode("utf-8", "ignore").ljust(n, "z") for n in (399, 400, 401)}
    shared = {n: x.encode()[:n].decode("utf-8", "ignore") for n, x in shared.items()}
    shared = {n: x + "q" * (n - len(x.encode())) for n, x in shared.items()}
    rows = [(100 * k + i, noise() + "DE"[i] + x + "BC"[i] + noise()) for k, x in enumerate(shared.values()) for i in range(2)]  # other bytes on either side
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(path)
    got = {r.doc_id: r for r in suffix.dedup(spark.read.parquet(path)).collect()}
    for (i, _), (n, removed, runs, kept) in zip(rows, brute([t for _, t in rows], suffix.LENGTH), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (n, removed, runs, kept)
        assert (removed > 0) == (i >= 100)
