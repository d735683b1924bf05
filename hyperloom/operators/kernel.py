"""A support vector machine with a Gaussian kernel: random Fourier features, whose inner products approach the kernel's values
as their number grows, and a linear machine on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(train: DataFrame, vector: str) -> tuple[int, float]:
    """The length of vectors and the variance of all their components."""
    x = train.select(F.size(vector).alias("k"), F.explode(vector).alias("x")).agg(F.max("k"), F.var_pop("x")).first()
    return x[0] or 0, x[1] or 0.0


class FourierFeatures:
    """z(x) = sqrt(2 / n) cos(W x + b) with z(x) z(y) near exp(-gamma |x - y|^2), the same for every task from one seed."""

    def __init__(self, size: int, n: int, gamma: float, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.w, self.b, self.n = rng.normal(0, np.sqrt(2 * gamma), (size, n)), rng.uniform(0, 2 * np.pi, n), n

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / self.n) * np.cos(x @ self.w + self.b)

    def add(self, df: DataFrame, vector: str, to: str) -> DataFrame:
        """The rows with their features, made over Arrow batches; the weights sent are size * n numbers."""
        sent = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(vector).flatten(), dtype=float).reshape(batch.num_rows, -1)
                z = sent.value.of(x) if len(x) else np.zeros((0, sent.value.n))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * sent.value.n, pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, to])

        return df.mapInArrow(run, schema)


class KernelSVM:
    """Fitted to rows with an array of doubles and a label (0, 1). ``c`` weighs errors against width, as for one row; gamma, if
    not given, is 1 / (components * variance)."""

    def __init__(self, train: DataFrame, vector: str = "v", label: str = "label", c: float = 1.0, gamma: float | None = None, n: int = 512, iterations: int = 50, seed: int = 42):
        from pyspark.ml.classification import LinearSVC
        from pyspark.ml.functions import array_to_vector

        size, variance = spread(train, vector)
        self.vector, self.features = vector, FourierFeatures(size, n, gamma if gamma is not None else 1 / (size * variance) if size * variance > 0 else 1.0, seed)
        rows = self.features.add(train, vector, "_z").withColumn("_z", array_to_vector("_z")).select("_z", label).persist()
        self.model = LinearSVC(featuresCol="_z", labelCol=label, maxIter=iterations, regParam=1 / (c * max(rows.count(), 1)), standardization=False).fit(rows)
        rows.unpersist()

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and score, the distance from the border in units of the margin."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.features.add(df, self.vector, "_z").withColumn("_z", array_to_vector("_z"))
        said = self.model.transform(rows)
        return said.withColumn("score", F.get(vector_to_array("rawPrediction"), F.lit(1))).select(*df.columns, "prediction", "score")
