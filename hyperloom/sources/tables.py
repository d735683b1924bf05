"""Reading and writing signals, features, marks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, paths: str | list[str], schema: str, header: bool = False) -> DataFrame:
    """Sample or feature matrices from CSV, plain or gzip, with a given schema."""
    return spark.read.schema(schema).option("header", header).csv(paths)


def read_recordings(spark: SparkSession, root: str, schema: str, header: bool = False, pattern: str = r"([^/]+?)_(\d+)(_s)?\.csv(?:\.gz)?$") -> DataFrame:
    """All files under a folder, with subject, recording and whether it has events, from their names."""
    df = spark.read.schema(schema).option("header", header).option("recursiveFileLookup", True).csv(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, pattern, i)
    return df.select("*", part(1).alias("subject"), part(2).alias("recording"), (part(3) != "").alias("has_event"))


def read_features(spark: SparkSession, path: str, label: str = "Labels") -> DataFrame:
    """Wide Parquet features (label, channel_feature ...) as rows."""
    return long_features(spark.read.parquet(path), label)


def long_features(df: DataFrame, label: str) -> DataFrame:
    values = [c for c in df.columns if c != label]
    return df.unpivot([label], values, "name", "v")


def concat_recordings(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recording, n, end): the end offset of every recording when all are put behind one another."""
    n = df.groupBy(*keys, "recording").agg(F.count("*").alias("n"))
    return n.withColumn("end", F.sum("n").over(W.partitionBy(*keys).orderBy("recording")))


def pair_marks(marks: DataFrame, keys: list[str], start: int = 32, stop: int = 33) -> DataFrame:
    """The i-th start with the i-th stop of a recording."""
    nth = F.row_number().over(W.partitionBy(*keys, "code").orderBy("time"))
    rows = marks.filter(F.col("code").isin(start, stop)).withColumn("nth", nth)
    a = rows.filter(F.col("code") == start).select(*keys, "nth", F.col("time").alias("start"))
    b = rows.filter(F.col("code") == stop).select(*keys, "nth", F.col("time").alias("stop"))
    return a.join(b, [*keys, "nth"])


def rescale_marks(marks: DataFrame, f1: float, f2: float) -> DataFrame:
    return marks.withColumn("time", (F.col("time") / F.lit(f1) * F.lit(f2)).cast("long"))


def admit(recordings: DataFrame, *, rate: float, channels: int, length: int, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Recordings with the first rule they break (null: admitted), and counts of reasons per subject with enough good ones.
    recordings: subject, recording, rate, channels, length."""
    reason = F.when(F.col("rate") != rate, "rate").when(F.col("channels") < channels, "channels").when(F.col("length") < length, "length")
    rows = recordings.withColumn("reason", reason)
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    report = rows.groupBy("subject").agg(count(F.col("reason").isNull()).alias("good"), *[count(F.col("reason") == r).alias(f"bad_{r}") for r in ("rate", "channels", "length")])
    return rows, report.withColumn("enough", F.col("good") >= wanted)


ALIASES = {"ClassicHD": "StdHD", "OnlineHD": "OnlHD", "OnlineHDAddSub": "OnlHD"}


def canonical_methods(models: DataFrame) -> DataFrame:
    out = F.col("method")
    for a, b in ALIASES.items():
        out = F.when(F.col("method") == a, b).otherwise(out)
    return models.withColumn("method", out)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return canonical_methods(spark.read.parquet(path))


def write_matrix(df: DataFrame, path: str, codec: str = "gzip") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", codec).csv(path)


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet with a folder for each value of the columns: features by subject; models and predictions by subject, fold and method."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_hashed(df: DataFrame, path: str, by: str, folders: int = 64) -> None:
    """Parquet in a number of folders that doesn't grow with the values of the column: a value lies in one folder and task, in
    order among its rows, so a reader of one value skips the others. For values as many as subjects of a large study."""
    rows = df.withColumn("_folder", F.pmod(F.xxhash64(by), F.lit(folders)).cast("int"))
    rows.repartition(folders, "_folder").sortWithinPartitions("_folder", by).write.mode("overwrite").partitionBy("_folder").parquet(path)


def read_hashed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_folder")


def read_value(spark: SparkSession, path: str, by: str, value, folders: int = 64) -> DataFrame:
    """The rows of one value, from its folder alone."""
    rows = spark.read.parquet(path)
    own = F.lit(value).cast(rows.schema[by].dataType)
    return rows.filter((F.col("_folder") == F.pmod(F.xxhash64(own), F.lit(folders)).cast("int")) & (F.col(by) == own)).drop("_folder")
