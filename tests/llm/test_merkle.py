import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, _m map<string,int>"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text=...):
    values = [*row[:4], row[4] if text is ... else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        start = i - i % 3
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
        i //= 3
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: levels([leaf(r) for r in each[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0] if rows else None, []
    for k, s in enumerate(order):
        for i, r in enumerate(each[s]):
            steps = siblings(trees[s], i) + siblings(top, k)
            at = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                at = leaf(r, None if r[4] is None else r[4].replace("\n", ""))
            for a, b in steps:
                at = h(a, at, b)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*itertools.chain(*steps)), at, at == root))
    return sorted(out, key=str)


def asked(spark, rows, tmp_path):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op13_merkle_manifest(spark, path).collect()), key=str)


def test_equals_brute_force(spark, tmp_path):
    """A source of more than two stored levels, lone leaves, sizes about powers of three, nulls everywhere, repeated rows and keys."""
    rng = random.Random(3)
    rows = [(i, "big", "en", i, "a\nb" * rng.randint(0, 3)) for i in range(800)]
    rows += [(5000 + i, f"s{n}", None, None, None if i == 1 else "x\ny") for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82) for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, "é", 3, "é\n\nü"), (7, None, "en", 1, ""), (7, None, "en", 1, ""), (7, None, "en", 1, "other\n")]
    rows += [(9000, "é", "en", 5, "long\n" * 100_000), (9001, "", "en", 1, "\n"), (9002, "Z", "en", 1, "z"), (9003, "\U0001f600", "en", 1, "z")]
    rng.shuffle(rows)
    got = asked(spark, rows, tmp_path)
    assert got == brute(rows)
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


@pytest.mark.parametrize("rows", [[], [(4, "a", None, None, "t\n")], [(i, None, "en", 1, "t") for i in range(28)], [(3, "a", "en", 1, "same\n")] * 90])
def test_small_tables(spark, tmp_path, rows):
    assert asked(spark, rows, tmp_path) == brute(rows)


def test_tampering_with_anything_is_seen(spark):
    rows = [(i, f"s{i % 4}", "en", i, f"text {i}", 0, None) for i in range(100)]
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    bad = F.sha2(F.col("leaf"), 256)
    moved = F.transform("steps", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right")))
    row = proofs.select(*[F.sum((merkle.folded(a, b) == F.col("root")).cast("int")) for a, b in ((F.col("leaf"), F.col("steps")), (bad, F.col("steps")), (F.col("leaf"), moved))]).first()
    assert row[0] == 100 and row[1] == 0 and row[2] < 100
