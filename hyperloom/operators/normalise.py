"""Normalising features and cutting them into levels. Statistics are small tables; they join by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.operators.selection import exact_percentiles


def fit_minmax(train: DataFrame, by: list[str]) -> DataFrame:
    return train.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def fit_percentile(train: DataFrame, by: list[str], keep, p: float = 0.9) -> DataFrame:
    """Minimum and a high exact percentile in the place of the maximum."""
    found = exact_percentiles(train, by, "v", [0.0, p], keep)
    return found.select(*by, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def leveled(norm: Column, levels: int) -> Column:
    """floor((levels - 1) * norm) within 0 .. levels - 1; 0 where undefined."""
    level = F.floor((levels - 1) * norm)
    return F.when(norm.isNull() | F.isnan(norm), 0).otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1))).cast("int")


def discretise(df: DataFrame, stats: DataFrame, by: list[str], levels: int, clip: bool = False) -> DataFrame:
    """Adds norm and level, from statistics (by, lo, hi) of any origin: train rows, one recording, or a stored table."""
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    norm = F.least(norm, F.lit(1.0)) if clip else norm
    return df.join(stats, by).withColumn("norm", norm).withColumn("level", leveled(F.col("norm"), levels)).drop("lo", "hi")


def clean(df: DataFrame, by: list[str]) -> DataFrame:
    """Values that are no finite number become the mean of the others of their column, else 0."""
    bad = F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull()
    mean = df.filter(~bad).groupBy(*by).agg(F.avg("v").alias("_mean"))
    return df.join(mean, by, "left").withColumn("v", F.when(bad, F.coalesce("_mean", F.lit(0.0))).otherwise(F.col("v"))).drop("_mean")
