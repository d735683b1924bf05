import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperloom.llm import queries, vector_codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 130), st.integers(1, 9), st.sampled_from([2, 50, 10_000, 1 << 27]))
def test_nearest_equals_all_distances(seed, n, width, most):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (40, width))
    x[:5] = entries[rng.integers(0, n, 5)]
    entry, distance = vector_codes.Book(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_candidates_are_the_box_of_the_radius():
    rng = np.random.default_rng(5)
    entries, x = rng.integers(-20, 20, (100, 3)), rng.integers(-20, 20, (30, 3))
    book, radius = vector_codes.Book(entries), rng.integers(0, 12, 30)
    masks = book.candidates(x, radius)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    bits = (masks[:, np.arange(100) // 64] >> (np.arange(100) % 64).astype(np.uint64)) & np.uint64(1)
    assert (bits.astype(bool) == inside).all() and inside.any() and not inside.all()


def test_masks_leave_few_entries_of_near_vectors():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 16))
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-60, 60, (500, 16))
    book, compared = vector_codes.Book(entries), []
    plain = book.compared
    book.compared = lambda *args: (out := plain(*args), compared.append(len(out[0])))[0]
    book.nearest(x)
    assert sum(compared) < 4 * len(x)


def brute(rows, entries=256, rounds=4):
    good = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for *_, v in good]
    if not good:
        return []
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    width = -(-size // 4)
    kept = []
    for i, label, v in good:
        if len(v) == size:
            ints = [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) if abs(x) < 1e300 else int(math.copysign(1 << 27, x)) for x in v] + [0] * (4 * width - size)
            kept.append((i, label, ints))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
    books = [[list(r[2][p * width : (p + 1) * width]) for r in first] for p in range(4)]

    def assign(p, v):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            own = {}
            for *_, v in kept:
                own.setdefault(assign(p, v)[1], []).append(v[p * width : (p + 1) * width])
            new.append([[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else e for j, e in enumerate(books[p])])
        books = new
    seal = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [assign(p, v) for p in range(4)]) for i, label, v in kept]
    total = {}
    for _, label, f in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), total[label], seal) for i, label, f in found), key=str)


def asked(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, _v int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, queries.op11_vector_codes(spark, str(tmp_path)).collect()), key=str)


def vectors(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.integers(-3000, 3000, size) / 2048], int(i % 3)) for i in range(n)]


ODD = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0], 1), (902, [math.nan] * 8, 1), (903, [-math.inf] * 8, 1), (904, [1.0], 1), (905, [], None)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, [0.25, -0.25, 0.5, 0.1], None)],
        vectors(330, 8) + ODD + [(3, [0.5] * 8, None)] * 4 + [(None, [0.5] * 8, None), (906, [1e300, -1e300, 3e5, -3e5, 0.0, 0.0, 0.0, 0.0], 2)],
        vectors(20, 6, 2) + [(7, [0.0] * 6, 1)] * 30,
        [(i, [], 1) for i in range(3)],
    ],
)
def test_equals_brute_force(spark, tmp_path, rows):
    """Nulls, non-finite and huge components, other lengths, lengths that don't divide, repeated rows and ids, ties, an empty table."""
    assert asked(spark, rows, tmp_path) == brute(rows)
