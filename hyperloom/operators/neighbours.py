"""Exact nearest neighbours: blocks of training rows are sent to the tasks, which keep the k best of each block for a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of training rows in a block that is sent, distances that a task holds at once, and training rows that it takes at once.
SENT, HELD, TAKEN = 1 << 22, 1 << 20, 1 << 13


def best(x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in rows, squared distance) of the k rows nearest to each x, ties to the earlier row."""
    if len(rows) == 0 or len(x) == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    exact = 4 * max(np.abs(x).max(initial=0), np.abs(rows).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 53
    if exact:  # products and sums are whole numbers that doubles hold
        a, b = x.astype(float), rows.astype(float)
        d = ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    else:
        d = np.stack([((rows - own) ** 2).sum(axis=1) for own in x])
    limit = np.partition(d, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
    i, j = np.nonzero(d <= limit[:, None])
    return first(i, j, d[i, j], k)


def first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least d of each i, ties to the smaller j."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], d[nth < k]


def best_of_block(x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, TAKEN rows at a time, so that what a task holds doesn't grow with a block."""
    out = (np.zeros(0, dtype=np.int64),) * 3
    for a in range(0, len(rows), TAKEN):
        i, j, d = best(x, rows[a : a + TAKEN].astype(np.int64), k)
        out = first(*(np.concatenate(c) for c in zip(out, (i, j + a, d))), k)
    return out


def narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest signed type that holds them."""
    lo, hi = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def blocks(train: DataFrame, key: str, features: str, label: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, vectors, labels) of SENT numbers at most; the driver holds one block at a time, vectors as bytes."""
    most, held = max(1, SENT // max(size, 1)), []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().cast(pa.int64()).to_numpy().reshape(batch.num_rows, size)  # a null fails
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([row.tobytes() for row in v], pa.binary())], names=["key", "label", "v"])

    def made():
        keys, labels, vectors = zip(*held)
        order = np.argsort(np.array(keys), kind="stable")
        return np.array(keys)[order], narrow(np.frombuffer(b"".join(vectors), dtype="<i8").reshape(len(held), size)[order]), np.array(labels)[order]

    rows, types = train.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(features).alias("v")), dict(train.dtypes)
    for row in rows.mapInArrow(packed, f"key {types[key]}, label {types[label]}, v binary").toLocalIterator():
        held.append((row.key, row.label, bytes(row.v)))
        if len(held) == most:
            yield made()
            held = []
    if held:
        yield made()


def knn(train: DataFrame, test: DataFrame, k: int, key: str, features: str = "v", label: str = "label") -> DataFrame:
    """(key, pred, p): the label voted by the k nearest training rows by squared distance of integer features (the smallest, if
    tied) and its share. Ties of distance go to the smaller key; rows of another length than the training rows' are compared
    with none. Test rows stay where they are: a pass for each block of training rows (one up to SENT numbers, which is what a
    set to learn from should have), k rows from each, merged by rank."""
    spark, types = train.sparkSession, dict(test.dtypes)
    size = train.agg(F.max(F.size(features))).first()[0] or 0
    rows = test.select(F.col(key).alias("key"), F.col(features).alias("v")).filter(F.size("v") == size)
    found = None
    for block in blocks(train.filter(F.size(features) == size), key, features, label, size):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, vectors, labels = sent.value
            step = max(1, HELD // max(min(len(keys), TAKEN), 1))
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    i, j, d = best_of_block(np.asarray(part.column("v").flatten(), dtype=np.int64).reshape(part.num_rows, -1), vectors, k)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(i)), pa.array(keys[j]), pa.array(labels[j].astype(np.int64)), pa.array(d)], names=["key", "other", "own", "d"])

        own = rows.mapInArrow(run, f"key {types[key]}, other {dict(train.dtypes)[key]}, own long, d long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], f"key {types[key]}, other long, own long, d long")
    first = found.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("d", "other"))).filter(F.col("_r") <= k)
    votes = first.groupBy("key", "own").agg(F.count("*").alias("c"))
    top = votes.groupBy("key").agg(F.max(F.struct("c", (-F.col("own")).alias("o"))).alias("b"), F.sum("c").alias("n"))
    return top.select(F.col("key").alias(key), (-F.col("b.o")).alias("pred"), (F.col("b.c") / F.col("n")).alias("p"))
