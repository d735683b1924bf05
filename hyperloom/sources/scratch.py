"""Frames that are stored between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hyperloom-")
    path = f"{root}/hyperloom-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)  # with the application
    return f"{path}/rows"


def kept(spark, label):
    """Writes a model and reads it back: each pass starts from a stored one."""

    def keep(model: DataFrame) -> DataFrame:
        path = scratch(spark, label)
        model.write.parquet(path)
        return spark.read.schema(model.schema).parquet(path)

    return keep
