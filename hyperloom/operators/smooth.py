"""Smoothing label streams. Rows are ordered by ``win`` within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators.windows import series


def smooth_vote(df: DataFrame, keys: list[str], length: int, share: float = 0.5, start: str = "after", y: str = "y", to: str = "y_s1") -> DataFrame:
    """1 where the mean of the last ``length`` labels reaches the share; the first outputs are 0: ``length`` of them
    ("after"), or one less ("full", as soon as the window is full)."""
    w = series(keys, "win")
    mean = F.avg(y).over(w.rowsBetween(-(length - 1), 0))
    guard = F.row_number().over(w) > (length if start == "after" else length - 1)
    return df.withColumn(to, F.when(guard & (mean >= share), 1).otherwise(0))


def merge_close(df: DataFrame, keys: list[str], gap: int, inclusive: bool = False, y: str = "y_s1", to: str = "y_s2") -> DataFrame:
    """Zeros between two positives become 1 where the next start is less than (or, inclusive, at most) the gap behind the
    last positive's end (exclusive). The next start is the last one in descending order: a frame that grows is added to from row
    to row, one that shrinks is gone through anew for every row."""
    at, grows = F.when(F.col(y) == 1, F.col("win")), (W.unboundedPreceding, 0)
    up, down = (W.partitionBy(*keys).orderBy(o).rowsBetween(*grows) for o in ("win", F.desc("win")))
    before, after = F.last(at, True).over(up), F.last(at, True).over(down)
    wide = after - before - 1
    near = wide <= gap if inclusive else wide < gap
    return df.withColumn(to, F.when((F.col(y) == 1) | F.coalesce(near, F.lit(False)), 1).otherwise(0))


def smooth_bayes(df: DataFrame, keys: list[str], length: int, threshold: Column | float = 1.5, y: str = "y", p: str = "p", to: str = "y_bayes") -> DataFrame:
    """1 where ln((prod p+ + 1e-8) / (prod (1 - p+) + 1e-8)) reaches the threshold, p+ being p for positives, else 1 - p.
    The threshold may be a column, different for every row."""
    w = series(keys, "win").rowsBetween(-(length - 1), 0)
    positive = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))

    def product(v: Column) -> Column:  # of the window; a zero makes it 0
        logs = F.sum(F.when(v > 0, F.log(v)).otherwise(0.0)).over(w)
        return F.when(F.min(v).over(w) <= 0, 0.0).otherwise(F.exp(logs))

    evidence = F.log((product(positive) + 1e-8) / (product(1 - positive) + 1e-8))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    guard = F.row_number().over(series(keys, "win")) >= length
    return df.withColumn("evidence", evidence).withColumn(to, F.when(guard & (F.col("evidence") >= limit), 1).otherwise(0))


def threshold_grid(df: DataFrame, keys: list[str], step: float = 0.2) -> DataFrame:
    """Thresholds from the middle of each key's range of evidence to its end."""
    ends = df.groupBy(*keys).agg(F.min("evidence").alias("lo"), F.max("evidence").alias("hi"))
    n = F.floor((F.col("hi") - (F.col("lo") + F.col("hi")) / 2) / step).cast("int")
    return ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: (F.col("lo") + F.col("hi")) / 2 + i * step)).alias("threshold"))


def fit_bayes_threshold(df: DataFrame, keys: list[str], step: float = 0.2, default: float = 1.5) -> DataFrame:
    """The threshold with the best F1 of labels against y_true, the median of ties; the default without any hit."""
    rows = df.join(threshold_grid(df, keys, step), keys).withColumn("z", (F.col("evidence") >= F.col("threshold")).cast("int"))
    tp = F.sum(F.col("z") * F.col("y_true"))
    f1 = F.round(2 * tp / (F.sum("z") + F.sum("y_true")), 9)
    scored = rows.groupBy(*keys, "threshold").agg(f1.alias("f1"))
    best = scored.withColumn("top", F.max("f1").over(W.partitionBy(*keys))).filter("f1 = top and f1 > 0").groupBy(*keys).agg(F.percentile("threshold", F.lit(0.5)).alias("t"))
    return df.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("t", F.lit(default)).alias("threshold"))
