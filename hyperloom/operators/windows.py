"""Segmentation of ordered series in windows. Series are given by keys and a place t from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(keys: list[str], order: str = "t") -> W:
    return W.partitionBy(*keys).orderBy(order)


def lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def sliding_windows(df: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """Rows with win, once for each window they lie in; starts are 0, step, ... strictly below n - length."""
    first = F.greatest(F.ceil((F.col("t") - length + 1) / step), F.lit(0))
    rows = df.join(lengths(df, keys), keys)
    last = F.least(F.floor(F.col("t") / step), F.ceil((F.col("n") - length) / step) - 1)
    rows = rows.withColumn("win", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return rows.drop("n")


def moving_average(df: DataFrame, keys: list[str], length: int, step: int, value: str = "x") -> DataFrame:
    return sliding_windows(df, keys, length, step).groupBy(*keys, "win").agg(F.avg(value).alias("avg"))


def window_labels(df: DataFrame, keys: list[str], length: int, step: int, how: str = "majority") -> DataFrame:
    """One label per window: "majority" (mean over one half), "majority_up" (mean rounded up), "majority_round"
    (mean + 0.001 rounded), "atLeastOne", "allOne", or "start" (the first sample's)."""
    mean = F.avg("label")
    label: Column = {
        "majority": (mean > 0.5).cast("int"), "majority_up": F.ceil(mean).cast("int"), "majority_round": F.floor(mean + 0.501).cast("int"),
        "atLeastOne": F.max("label"), "allOne": F.min("label"), "start": F.min_by("label", "t"),
    }[how]
    return sliding_windows(df, keys, length, step).groupBy(*keys, "win").agg(label.alias("label"))


def running_sum(df: DataFrame, keys: list[str], n: int, value: str = "x") -> DataFrame:
    """Centred sum over n samples, as a convolution with ones of the same size has it."""
    frame = series(keys).rowsBetween(-(n // 2), n - n // 2 - 1)
    return df.withColumn("run", F.sum(value).over(frame))


def time_shift(df: DataFrame, keys: list[str], shifts: list[int], value: str = "level", mode: str = "val") -> DataFrame:
    """Lagged copies (or differences to them) as columns shift_k; the first max(shifts) rows go."""
    w = series(keys)
    lagged = {f"shift_{k}": F.lag(value, k).over(w) if k else F.col(value) for k in shifts}
    if mode == "diff":
        lagged = {n: F.col(value) - c for n, c in lagged.items()}
    rows = df.withColumns({**lagged, "_nth": F.row_number().over(w)})
    return rows.filter(F.col("_nth") > max(shifts)).drop("_nth")


def zero_crossings(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """zc: 1 where the sign of the first difference changes, on the sample before the change."""
    w = series(keys)
    up = F.signum(F.lead(value, 1).over(w) - F.col(value))
    rows = df.withColumn("_sign", up)
    return rows.withColumn("zc", (F.lead("_sign", 1).over(w) != F.col("_sign")).cast("int")).drop("_sign")


def running_stats(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    w = series(keys).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"run_mean": F.avg(value).over(w), "run_min": F.min(value).over(w)})
