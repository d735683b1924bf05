import random
import re

import numpy as np
import xxhash

from hyperloom.llm import simhash
from hyperloom.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """fps: (doc, fingerprint) pairs."""
    up = {d: d for d, _ in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= radius and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d, _ in fps}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, Fingerprint string, note string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {d: brute_fingerprint(t) for d, t, *_ in rows}
    want = brute_components(sorted(fps.items()))
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_small_texts_nulls_ties(spark):
    rows = [None, "", " \n\t", "One", "one", "a b", "A B", "a b c", "É b c", "é b c", "x y z w", "a b c d e f g", "a b c d e f g", "q " * 3000]
    check(spark, [(i, t, None, "n") for i, t in enumerate(rows)] + [(5, "a b", None, "n")])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, None, None) for r in docs])


def test_large_bucket_is_tiled(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(2500)} | {rng.getrandbits(64) for _ in range(500)}
    nodes = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in nodes], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    want = brute_components(nodes)
    assert {n: got.get(n, n) for n, _ in nodes} == want
    assert 2 <= len(set(want.values())) < len(nodes)


def test_blocks_cover_all_links():
    rng = random.Random(5)
    for agree in (1, 2, 3):
        found = [m & (1 << 64) - 1 for m in simhash.masks(3, agree)]
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not diff & m for m in found)


def test_first_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (7, "else where"), (8, None), (9, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_each(df).collect()) == [1, 7, 8]


def test_first_of_each_keeps_null_keys_and_unlike_texts_of_one_key(spark):
    rows = [(None, "one two three four"), (None, "five six seven eight nine"), (1, "red green blue black"), (1, "north south east west"), (1, "north south east west"), (2, "red green blue black"), (None, "red green blue black")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(-1, rows[1][1]), (-1, rows[0][1]), (1, rows[3][1]), (1, rows[2][1])]
    assert sorted((r.doc_id or -1, r.text) for r in simhash.first_of_each(df).collect()) == want


def test_texts_of_one_key_are_not_linked(spark):
    rows = [(1, "red green blue black"), (1, "north south east west"), (3, "red green blue black"), (None, "alone with no key"), (4, "other words go here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, None), (1, 1), (1, 1), (3, 1), (4, 4)]
    fps = spark.createDataFrame([(5,), (5,), (-9,)], "fp long")
    assert sorted((r._fp, r._class) for r in simhash.classes(fps).collect()) == [(-9, -9), (5, 5)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got[i] for i in range(301)) == {0} and got[1001] == 1000
