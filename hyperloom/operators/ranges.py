"""Joins of intervals, and of places with intervals, by bins of a grid: what overlaps shares a bin, so the join is by key and bin
and a key with many events is spread over its bins. Intervals are half-open and whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_width(*sides: DataFrame) -> int:
    """The mean length of the intervals (start, stop): they lie in about two bins each."""
    lengths = None
    for side in sides:
        own = side.agg(F.sum(F.col("stop").cast("double") - F.col("start")).alias("s"), F.count("*").alias("n"))
        lengths = own if lengths is None else lengths.unionByName(own)
    total, n = lengths.agg(F.sum("s"), F.sum("n")).first()
    return max(1, round((total or 0.0) / n)) if n else 1


def bins(start: Column, stop: Column, width: int) -> Column:
    """The bins that an interval reaches; an empty one has that of its start."""
    at = lambda x: F.floor(x / width)
    return F.sequence(at(start), F.greatest(at(start), at(stop - 1)))


def meet(left: DataFrame, right: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """All pairs (l.*, r.*) of one key with l.start < r.stop and l.stop > r.start, each once: in the bin of the later start."""
    width = width or bin_width(left, right)
    a = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("stop"), width))).alias("l")
    b = right.withColumn("_bin", F.explode(bins(F.col("start"), F.col("stop"), width))).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_bin"]]
    overlap = (F.col("l.start") < F.col("r.stop")) & (F.col("l.stop") > F.col("r.start"))
    first = F.col("l._bin") == F.floor(F.greatest("l.start", "r.start") / width)
    names = lambda side, df: [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in df.columns]
    return a.join(b, [*same, overlap, first]).select(*names("l", left), *names("r", right))


def covered(rows: DataFrame, intervals: DataFrame, keys: list[str], how: str, place: str = "t", width: int | None = None) -> DataFrame:
    """Rows whose place lies in an interval (start, stop) of their key ("left_semi"), or in none ("left_anti"), each once: a row
    has one bin."""
    own = intervals.select(*keys, "start", "stop").filter("stop > start")
    width = width or bin_width(own)
    d = rows.withColumn("_bin", F.floor(F.col(place) / width)).alias("d")
    i = own.withColumn("_bin", F.explode(bins(F.col("start"), F.col("stop"), width))).alias("i")
    same = [F.col(f"d.{k}") == F.col(f"i.{k}") for k in [*keys, "_bin"]]
    inside = (F.col(f"d.{place}") >= F.col("i.start")) & (F.col(f"d.{place}") < F.col("i.stop"))
    return d.join(i, [*same, inside], how).drop("_bin")
