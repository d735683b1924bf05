"""Episode scores of all thresholds from one sweep: places are switched on from the highest evidence down, and a union-find of
runs keeps the events of every threshold, so no row meets a threshold it doesn't pass."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators.events import label_events, matched
from hyperloom.operators.windows import series


class Runs:
    """Islands of places (first, last), in order, that are switched on one by one; neighbours that touch become one run, whose
    name is its leftmost island."""

    def __init__(self, islands: list[tuple[int, int]], last: int):
        self.islands, self.last = islands, last
        self.parent, self.on, self.end = list(range(len(islands))), [False] * len(islands), list(range(len(islands)))
        self.lasts = [b for _, b in islands]

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def touch(self, i: int) -> bool:
        """Whether island i follows the one before without a gap, both being on."""
        return 0 < i < len(self.islands) and self.on[i - 1] and self.on[i] and self.islands[i - 1][1] + 1 == self.islands[i][0]

    def switch_on(self, i: int) -> tuple[int, list[int]]:
        """The run that island i is in from now on, and the runs that it takes in."""
        self.on[i], gone = True, []
        for left in (i, i + 1):
            if self.touch(left):
                a, b = self.find(left - 1), self.find(left)
                self.parent[b] = a
                self.end[a] = self.end[b]
                gone += [a, b]
        root = self.find(i)
        return root, gone

    def event(self, run: int) -> tuple[int, int] | None:
        """Its start and stop, by the rules of :func:`label_events`."""
        a, b = self.islands[run][0], self.islands[self.end[run]][1]
        return None if a == b and (a == 0 or b == self.last) else (max(a, 1), min(b + 1, self.last))

    def between(self, start: int, stop: int) -> list[tuple[int, int]]:
        """The events, in order, that may reach into the places from start to stop."""
        i, out = bisect_left(self.lasts, start), []
        while i < len(self.islands) and self.islands[i][0] < stop:
            if self.on[i]:
                run = self.find(i)
                if event := self.event(run):
                    out.append(event)
                i = self.end[run]
            i += 1
        return out


def swept(islands: list[tuple[int, int, int]], true: list[tuple[int, int]], last: int, levels: int, before: int = 0, after: int = 0) -> list[tuple[int, int, int]]:
    """Hits, misses and false alarms of every level: of the events made by islands (first, last, level) of at least that level.

    True events that a run connects are one component, which only grows as the level falls. Only the components whose runs
    changed are matched anew; runs that meet no true event count on their own.
    """
    islands = sorted(islands)
    runs, of_level = Runs([(a, b) for a, b, _ in islands], last), [[] for _ in range(levels)]
    for i, (_, _, level) in enumerate(islands):
        of_level[level].append(i)
    starts, stops = [a for a, _ in true], [b for _, b in true]
    parent, first, until = list(range(len(true))), list(range(len(true))), list(range(len(true)))
    scores, alone, out = {}, {}, [(0, 0, 0)] * levels

    def find(t: int) -> int:
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    hits = false = lone = 0
    for level in range(levels - 1, -1, -1):
        changed, dirty = set(), set()
        for i in of_level[level]:
            run, gone = runs.switch_on(i)
            for g in gone:
                lone -= alone.pop(g, 0)
                changed.discard(g)
            changed.add(run)
        for run in changed:
            event = runs.event(run)
            if event is None:
                continue
            j, k = bisect_right(stops, event[0]), bisect_left(starts, event[1])
            if j >= k:
                near = bisect_right(stops, event[0] - after)
                lone -= alone.pop(run, 0)
                alone[run] = int(not (near < len(true) and event[1] > starts[near] - before))
                lone += alone[run]
                continue
            lone -= alone.pop(run, 0)
            root = find(j)
            for t in range(until[root] + 1, k):  # those up to there are of the component already
                other = find(t)
                if other != root:
                    parent[other] = root
                    first[root], until[root] = min(first[root], first[other]), max(until[root], until[other])
                    old = scores.pop(other, (0, 0))
                    hits, false = hits - old[0], false - old[1]
            dirty.add(root)
        for root in {find(t) for t in dirty}:
            own = true[first[root] : until[root] + 1]
            new = matched(own, runs.between(own[0][0], own[-1][1]), before, after)[:2]
            old = scores.get(root, (0, 0))
            hits, false, scores[root] = hits + new[0] - old[0], false + new[1] - old[1], new
        out[level] = (hits, len(true) - hits, false + lone)
    return out


def threshold_scores(df: DataFrame, keys: list[str], length: int, step: float = 0.2, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, i, threshold, tp, fn, fp) for thresholds from the middle of each key's range of evidence up to its end, in steps.

    df has (keys, win, y_true, evidence); the first length - 1 places, whose evidence isn't of a full window, are never on.
    Spark cuts the evidence into levels and joins places of one level to islands; a task of the sweep gets islands and true
    events of a key, no rows.
    """
    rows = df.select(*keys, "win", "y_true", "evidence").withColumn("place", F.row_number().over(series(keys, "win")) - 1)
    full = F.when(F.col("place") >= length - 1, F.col("evidence"))
    ends = rows.groupBy(*keys).agg(F.min(full).alias("lo"), F.max(full).alias("hi"), (F.count("*") - 1).alias("last"))
    middle = F.col("lo") + 0.5 * (F.col("hi") - F.col("lo"))
    ends = ends.select(*keys, "last", middle.alias("middle"), F.ceil((F.col("hi") - middle) / step).cast("int").alias("levels"))
    guess = F.floor((full - F.col("middle")) / step).cast("int")
    reached = lambda i: full >= F.col("middle") + i * F.lit(step)
    level = F.when(reached(guess + 1), guess + 1).when(reached(guess), guess).otherwise(guess - 1)
    highest = F.when(full.isNotNull(), F.least(level, F.col("levels") - 1)).cast("int")
    cut = rows.join(ends, keys).select(*keys, "place", highest.alias("level")).filter("level >= 0")
    island = F.col("place") - F.row_number().over(W.partitionBy(*keys, "level").orderBy("place"))
    cut = cut.withColumn("_g", island).groupBy(*keys, "level", "_g").agg(F.min("place").alias("start"), F.max("place").alias("stop"))
    true = label_events(df.select(*keys, "win", F.col("y_true").alias("y")), keys)
    kind = lambda x: F.lit(x).alias("kind")
    parts = cut.select(*keys, kind(0), F.col("start").cast("long"), F.col("stop").cast("long"), "level")
    parts = parts.unionByName(true.select(*keys, kind(1), "start", "stop", F.lit(0).alias("level")))
    parts = parts.unionByName(ends.filter("levels > 0").select(*keys, kind(2), F.col("last").alias("start"), F.col("last").alias("stop"), F.col("levels").alias("level")))
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = lambda k, *names: sorted(pdf.loc[pdf["kind"] == k, list(names)].itertuples(index=False, name=None))
        end = part(2, "start", "level")
        counts = swept(part(0, "start", "stop", "level"), part(1, "start", "stop"), *end[0], before, after) if end else []
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], i, *c) for i, c in enumerate(counts)], columns=[*keys, "i", "tp", "fn", "fp"])

    scored = parts.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", i int, tp long, fn long, fp long")
    return scored.join(ends.select(*keys, "middle"), keys).select(*keys, "i", (F.col("middle") + F.col("i") * F.lit(step)).alias("threshold"), "tp", "fn", "fp")


def fit_threshold(df: DataFrame, keys: list[str], length: int, step: float = 0.2, default: float = 1.5, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, threshold, f1) with the best F1 of episodes; of thresholds that tie, the one in the middle (the upper one of two).
    The default, with a null F1, where there are no true events or no range of evidence."""
    scores = threshold_scores(df, keys, length, step, before, after).filter("tp + fn > 0")
    s, p = F.col("tp") / (F.col("tp") + F.col("fn")), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    f1 = scores.withColumn("f1", F.when(s + p > 0, F.round(2 * s * p / (s + p), 9)).otherwise(0.0))
    ties = f1.join(f1.groupBy(*keys).agg(F.max("f1").alias("f1")), [*keys, "f1"]).groupBy(*keys, "f1").agg(F.array_sort(F.collect_list("threshold")).alias("t"))
    best = ties.select(*keys, "f1", F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("t"))
    return df.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("t", F.lit(default)).alias("threshold"), "f1")


def walk_forward(df: DataFrame, keys: list[str], fold: str, length: int, **options) -> DataFrame:
    """(keys, fold, threshold, f1): for every fold of a key the threshold fitted to all its earlier folds, one behind another;
    the default for the first fold. Rows of a fold go to each later one: that is what the thresholds are of."""
    folds = df.select(*keys, F.col(fold).alias("_for")).distinct()
    order = W.partitionBy(*keys, "_for").orderBy(fold, "win")
    earlier = df.join(folds, keys).filter(F.col(fold) < F.col("_for")).withColumn("win", F.row_number().over(order) - 1)
    found = fit_threshold(earlier, [*keys, "_for"], length, **options)
    default = options.get("default", 1.5)
    return folds.join(found, [*keys, "_for"], "left").select(*keys, F.col("_for").alias(fold), F.coalesce("threshold", F.lit(default)).alias("threshold"), "f1")
