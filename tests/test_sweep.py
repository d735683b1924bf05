"""Scores of all thresholds against scores of each one."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperloom.operators import sweep
from hyperloom.operators.events import episode_counts


def events(y):
    """Runs of ones by the rules of label_events."""
    last, out, i = len(y) - 1, [], 0
    while i < len(y):
        if y[i]:
            j = i
            while j + 1 < len(y) and y[j + 1]:
                j += 1
            if not (i == j and i in (0, last)):
                out.append((max(i, 1), min(j + 1, last)))
            i = j
        i += 1
    return out


def nested(true, pred, before, after):
    """The same counts by looking at every pair."""
    used, hits, false = set(), 0, 0
    for a, b in true:
        for i, (c, d) in enumerate(pred):
            if i not in used and c < b and d > a:
                used.add(i)
                hits += 1
                false += (c < a - before) + (d > b + after)
                break
    near = {i for i, (c, d) in enumerate(pred) if i not in used and any(c < b + after and d > a - before for a, b in true)}
    return hits, len(true) - hits, false + len(pred) - len(used | near)


labels = st.lists(st.booleans(), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(labels, labels, st.integers(0, 4), st.integers(0, 4))
def test_pointers_equal_pairs(true, pred, before, after):
    assert episode_counts(events(true), events(pred), before, after) == nested(events(true), events(pred), before, after)


def test_many_events_in_linear_time():
    true = [(10 * i, 10 * i + 4) for i in range(200_000)]
    assert episode_counts(true, [(a + 2, b + 2) for a, b in true], 1, 1) == (200_000, 0, 200_000)


@settings(max_examples=300, deadline=None)
@given(st.data(), st.integers(1, 6), st.integers(0, 3), st.integers(0, 3))
def test_sweep_equals_each_level(data, levels, before, after):
    n = data.draw(st.integers(1, 40))
    height = data.draw(st.lists(st.integers(-1, levels - 1), min_size=n, max_size=n))
    true = events(data.draw(st.lists(st.booleans(), min_size=n, max_size=n)))
    islands, i = [], 0
    while i < n:
        j = i
        while j + 1 < n and height[j + 1] == height[i]:
            j += 1
        if height[i] >= 0:
            islands.append((i, j, height[i]))
        i = j + 1
    want = [nested(true, events([h >= g for h in height]), before, after) for g in range(levels)]
    assert sweep.swept(islands, true, n - 1, levels, before, after) == want


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for subject, n in enumerate((300, 40, 6, 3, 60)):
        e = np.cumsum(rng.normal(size=n)) if subject != 4 else np.ones(n)
        y = (e + rng.normal(size=n) > 1) if subject != 1 else np.zeros(n, dtype=bool)
        out += [(subject, w, int(y[w]), float(e[w]), w % 3) for w in range(n)]
    return pd.DataFrame(out, columns=["subject", "win", "y_true", "evidence", "fold"])


def plain_fit(own, length, step, before, after):
    e, y = own["evidence"].to_numpy()[length - 1 :], own["y_true"].to_numpy()
    if len(e) == 0 or not events(y):
        return 1.5, None
    middle = e.min() + 0.5 * (e.max() - e.min())
    grid = np.arange(middle, e.max(), step)
    scores = []
    for t in grid:
        on = np.concatenate([np.zeros(length - 1), e >= t])
        tp, fn, fp = nested(events(y), events(on), before, after)
        s, p = tp / (tp + fn), tp / (tp + fp) if tp + fp else 0.0
        scores.append(round(2 * s * p / (s + p), 9) if s + p else 0.0)
    if not scores:
        return 1.5, None
    ties = [t for t, f in zip(grid, scores) if f == max(scores)]
    return ties[len(ties) // 2], max(scores)


def test_threshold_of_each_key(spark, rows):
    """Also keys without true events, without a range of evidence, or shorter than a window."""
    found = sweep.fit_threshold(spark.createDataFrame(rows), ["subject"], 5, before=2, after=1).toPandas().set_index("subject")
    for subject, own in rows.groupby("subject"):
        t, f1 = plain_fit(own, 5, 0.2, 2, 1)
        assert found.loc[subject, "threshold"] == pytest.approx(t) and (pd.isna(found.loc[subject, "f1"]) if f1 is None else found.loc[subject, "f1"] == pytest.approx(f1))


def test_walk_forward_learns_from_earlier_folds(spark, rows):
    own = rows[rows["subject"] == 0].assign(fold=lambda x: x["win"] // 100)
    found = sweep.walk_forward(spark.createDataFrame(own), ["subject"], "fold", 5).toPandas().set_index("fold")
    assert found.loc[0, "threshold"] == 1.5
    for fold in (1, 2):
        assert found.loc[fold, "threshold"] == pytest.approx(plain_fit(own[own["fold"] < fold], 5, 0.2, 0, 0)[0])
