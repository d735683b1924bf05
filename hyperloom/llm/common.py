"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add: a clashing column is replaced."""
    return df.drop(*names)


def set_apart(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with other names for all columns but those that an operator reads, so that none clashes with a column that it
    uses inside, and the way back for withColumnsRenamed."""
    names = {c: f"extra{i}_{c}" for i, c in enumerate(df.columns) if c not in own}
    return df.withColumnsRenamed(names), {b: a for a, b in names.items()}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode a temporary one is set if the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="hyperloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def for_this_run(spark: SparkSession, path: str) -> None:
    """Has a stored table deleted when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: With this setting Spark drops the shuffle files of a query once it ends, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read back: lineage is cut, columns can be pruned on each
    read, and the shuffle files of the steps before it go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hyperloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for_this_run(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array when there are none."""
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))
