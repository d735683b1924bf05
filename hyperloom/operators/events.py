"""Events in label streams and scores on them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators.ranges import meet
from hyperloom.operators.windows import series


def label_events(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """(keys, event_id, start, stop) of the runs of ones: stop is the first place behind; a run that is on at the first
    place starts at 1; one that reaches the last place stops there; a single one at either end is none. Places count from 0."""
    w = series(keys, "win")
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_new": F.coalesce(F.lag(y).over(w), F.lit(0))})
    rows = rows.withColumn("_run", F.sum(F.when((F.col(y) == 1) & (F.col("_new") == 0), 1).otherwise(0)).over(w))
    last = df.groupBy(*keys).agg((F.count("*") - 1).alias("_last"))
    found = rows.filter(F.col(y) == 1).groupBy(*keys, "_run").agg(F.min("_i").alias("a"), F.max("_i").alias("b")).join(last, keys)
    start, stop = F.greatest("a", F.lit(1)), F.least(F.col("b") + 1, F.col("_last"))
    alone = (F.col("a") == F.col("b")) & ((F.col("a") == 0) | (F.col("b") == F.col("_last")))
    found = found.filter(~alone).select(*keys, start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    return found.withColumn("event_id", F.row_number().over(W.partitionBy(*keys).orderBy("start")))


def match_events(true: DataFrame, pred: DataFrame, keys: list[str], before: int, after: int, widen: bool = False) -> DataFrame:
    """Every pair of a true and a predicted event that meet, or come within the tolerances: overlap, fp_before, fp_after. They
    are joined by key and time bin."""
    wide = true.select(*keys, "event_id", (F.col("start") - before).alias("start"), (F.col("stop") + after).alias("stop"))
    both = meet(wide, pred.select(*keys, "event_id", "start", "stop"), keys)
    start, stop = F.col("l_start") + before, F.col("l_stop") - after
    low, high = (F.col("l_start"), F.col("l_stop")) if widen else (start, stop)
    return both.select(
        *[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_event_id").alias("true_id"), F.col("r_event_id").alias("pred_id"),
        F.greatest(F.least(F.col("r_stop"), high) - F.greatest(F.col("r_start"), low), F.lit(0)).alias("overlap"),
        F.greatest(F.col("l_start") - F.col("r_start"), F.lit(0)).alias("fp_before"), F.greatest(F.col("r_stop") - F.col("l_stop"), F.lit(0)).alias("fp_after"),
    )


def matched(true: list[tuple], pred: list[tuple], before: int = 0, after: int = 0) -> tuple[int, int, set[int]]:
    """Hits, false alarms of predictions that reach beyond the tolerances around their event, and the predictions used, from two
    ordered pointers: every true event takes the first prediction that meets it and isn't used. Events of either side are in
    order and don't overlap one another, so a prediction that ends before an event starts meets no later one."""
    hits, false, used, i = 0, 0, set(), 0
    for a, b in true:
        while i < len(pred) and pred[i][1] <= a:
            i += 1
        if i < len(pred) and pred[i][0] < b:
            used.add(i)
            hits, false = hits + 1, false + (pred[i][0] < a - before) + (pred[i][1] > b + after)
            i += 1
    return hits, false, used


def episode_counts(true: list[tuple], pred: list[tuple], before: int = 0, after: int = 0) -> tuple[int, int, int]:
    """Hits, misses and false alarms, in time order: an event of either side is used once; predictions that reach beyond the
    tolerances around their event count as further false alarms on that side."""
    hits, false, used = matched(true, pred, before, after)
    j = 0
    for i, (c, d) in enumerate(pred):
        while j < len(true) and true[j][1] + after <= c:
            j += 1
        false += i not in used and not (j < len(true) and d > true[j][0] - before)
    return hits, len(true) - hits, false


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def f1(s: Column, p: Column) -> Column:
    return F.when(s + p > 0, 2 * s * p / (s + p)).when(s.isNotNull() & p.isNotNull(), 0.0)


def duration_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y: str = "y", undefined: float | None = None) -> DataFrame:
    """Sensitivity, precision and F1 by rows; what has no denominator is null, or the given value."""
    tp, p, t = F.sum(F.col(y) * F.col(y_true)), F.sum(y), F.sum(y_true)
    rows = df.groupBy(*keys).agg(tp.alias("tp"), p.alias("p"), t.alias("t"))
    rows = rows.withColumns({"sens_d": ratio(F.col("tp"), F.col("t")), "prec_d": ratio(F.col("tp"), F.col("p"))}).withColumn("f1_d", f1(F.col("sens_d"), F.col("prec_d")))
    rows = rows.select(*keys, "sens_d", "prec_d", "f1_d")
    return rows if undefined is None else rows.fillna(undefined, ["sens_d", "prec_d", "f1_d"])


def episode_metrics(true: DataFrame, pred: DataFrame, keys: list[str], before: int = 0, after: int = 0) -> DataFrame:
    """Hits, misses and false alarms per key from the two event tables; only events reach Python, not rows."""
    types = dict(true.dtypes)
    both = true.select(*keys, "start", "stop", F.lit(1).alias("kind")).unionByName(pred.select(*keys, "start", "stop", F.lit(0).alias("kind")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = lambda k: sorted(pdf.loc[pdf["kind"] == k, ["start", "stop"]].itertuples(index=False, name=None))
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], *episode_counts(part(1), part(0), before, after))], columns=[*keys, "tp", "fn", "fp"])

    return both.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tp long, fn long, fp long")


def metrics9(df: DataFrame, keys: list[str], per_hour: int, y_true: str = "y_true", y: str = "y", before: int = 0, after: int = 0) -> DataFrame:
    """Episode and duration sensitivity, precision and F1, their arithmetic and geometric mean, and false alarms per day."""
    stream = lambda c: label_events(df.select(*keys, "win", F.col(c).alias("y")), keys)
    e = episode_metrics(stream(y_true), stream(y), keys, before, after)
    e = e.withColumns({"sens_e": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "prec_e": ratio(F.col("tp"), F.col("tp") + F.col("fp"))}).withColumn("f1_e", f1(F.col("sens_e"), F.col("prec_e")))
    d = duration_metrics(df, keys, y_true, y).join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    rows = d.join(e, keys, "left").withColumns({"f1_mean": (F.col("f1_e") + F.col("f1_d")) / 2, "f1_gmean": F.sqrt(F.col("f1_e") * F.col("f1_d")), "fp_per_day": F.coalesce("fp", F.lit(0)) / (F.col("n") / per_hour) * 24})
    return rows.select(*keys, "sens_e", "prec_e", "f1_e", "sens_d", "prec_d", "f1_d", "f1_mean", "f1_gmean", "fp_per_day")


def metrics36(df: DataFrame, keys: list[str], per_hour: int, streams: list[str], y_true: str = "y_true") -> DataFrame:
    """The nine metrics of every smoothing, as rows."""
    long = df.unpivot([*keys, "win", y_true], streams, "smoothing", "y")
    return metrics9(long, [*keys, "smoothing"], per_hour, y_true)


def metrics12(df: DataFrame, keys: list[str], per_hour: int, early: int, y_true: str = "y_true", y: str = "y") -> DataFrame:
    """Older report: events found (also up to ``early`` before), false alarms per hour, and row-wise rates."""
    stream = lambda c: label_events(df.select(*keys, "win", F.col(c).alias("y")), keys)
    t, p = stream(y_true), stream(y)
    early_too = t.select(*keys, "event_id", (F.col("start") - early).alias("start"), "stop")
    met = meet(early_too, p, keys).groupBy(*[F.col(f"l_{k}").alias(k) for k in keys]).agg(F.countDistinct("l_event_id").alias("found"), F.countDistinct("r_event_id").alias("right"))
    count = lambda a, b: F.sum(((F.col(y_true) == a) & (F.col(y) == b)).cast("int"))
    c = df.groupBy(*keys).agg(F.count("*").alias("n"), count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    n_true = t.groupBy(*keys).agg(F.count("*").alias("events"))
    n_pred = p.groupBy(*keys).agg(F.count("*").alias("called"))
    rows = c.join(n_true, keys, "left").join(n_pred, keys, "left").join(met, keys, "left").fillna(0, ["events", "called", "found", "right"])
    rows = rows.withColumn("false", F.col("called") - F.col("right"))
    sens, spec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return rows.select(
        *keys, ratio(F.col("found"), F.col("events")).alias("sens_e"), (F.col("false") / (F.col("n") / per_hour)).alias("fp_per_hour"), sens.alias("sens"), spec.alias("spec"),
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((sens + spec) / 2).alias("balanced"), F.sqrt(sens * spec).alias("gmean"),
    )


def event_durations(events: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("stop") - F.col("start")
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.min(d).alias("shortest"), F.max(d).alias("longest"))


def appended(df: DataFrame, keys: list[str]) -> DataFrame:
    """The streams of all folds of a key behind one another, with a new place."""
    return df.withColumn("win", F.row_number().over(W.partitionBy(*keys).orderBy("fold", "win")) - 1).drop("fold")


def summarise(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population standard deviation of values that are defined, per ``by`` and (nulls) over all."""
    clean = [F.when(~F.isnan(v), F.col(v)) for v in values]
    aggs = [f(c).alias(f"{v}_{n}") for v, c in zip(values, clean, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.rollup(*by).agg(*aggs)


def wilcoxon(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Signed-rank statistic min(W+, W-), number of pairs that differ, and the normal approximation's z."""
    rows = pairs.withColumn("_d", F.round(F.col(a) - F.col(b), 9)).filter("_d <> 0")
    w = W.partitionBy(*by)
    rows = rows.withColumn("_r", F.rank().over(w.orderBy(F.abs("_d")))).withColumn("_t", F.count("*").over(W.partitionBy(*by, F.abs("_d"))))
    rows = rows.withColumn("_r", F.col("_r") + (F.col("_t") - 1) / 2)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("down"), F.sum((F.col("_t") * F.col("_t") - 1.0)).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select(*by, "n", F.least("up", "down").alias("w"), F.when(spread > 0, (F.least("up", "down") - n * (n + 1) / 4) / spread).alias("z"))


def exact_p(n: int, w: float) -> float:
    """Two-sided exact probability of a signed-rank statistic without ties, for small n."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
    return min(1.0, 2 * sum(ways[: math.floor(w) + 1]) / 2**n)


def interpolated(points: DataFrame, by: list[str], grid: DataFrame, x: str, v: str) -> DataFrame:
    """Values on a grid of x, linearly between the points around it."""
    w = W.partitionBy(*by).orderBy(x)
    spans = points.withColumns({"_x": F.lead(x).over(w), "_v": F.lead(v).over(w)})
    met = spans.join(grid, (F.col("g") >= F.col(x)) & ((F.col("g") < F.col("_x")) | (F.col("_x").isNull() & (F.col("g") == F.col(x)))))
    return met.select(*by, "g", F.when(F.col("_x").isNull(), F.col(v)).otherwise(F.col(v) + (F.col("_v") - F.col(v)) * (F.col("g") - F.col(x)) / (F.col("_x") - F.col(x))).alias(v))
