"""Which features and channels matter: separability, confidence, voting, overlap, divergence. Element tables are rows
(keys, win, element, d0, d1) with distances to the two classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.functions.hv import hv_distance


def separability(model: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Share of bits in which the two class vectors of a block differ."""
    a, b = model.filter("class = 0").select(*keys, F.col("hv").alias("a")), model.filter("class = 1").select(*keys, F.col("hv").alias("b"))
    return a.join(b, keys).select(*keys, (hv_distance("a", "b") / d).alias("separability"))


def element_confidence(el: DataFrame, keys: list[str]) -> DataFrame:
    """(d0 - d1) over the mean of its size in the window."""
    gap = F.col("d0") - F.col("d1")
    mean = F.avg(F.abs(gap)).over(W.partitionBy(*keys, "win"))
    return el.withColumn("confidence", F.when(mean > 0, gap / mean).otherwise(0.0))


def confidence_gain(conf: DataFrame) -> DataFrame:
    """Per element: mean confidence when right, when wrong, and their relative difference."""
    right = ((F.col("confidence") > 0).cast("int") == F.col("y"))
    rows = conf.groupBy("element").agg(F.avg(F.when(right, F.abs("confidence"))).alias("right"), F.avg(F.when(~right, F.abs("confidence"))).alias("wrong"))
    return rows.withColumn("gain", (F.col("right") - F.col("wrong")) / (0.001 + F.col("wrong")))


def element_probability(el: DataFrame, eps: float = 1e-5) -> DataFrame:
    total = F.col("d0") + F.col("d1") + eps
    return el.withColumn("pred", (F.col("d1") < F.col("d0")).cast("int")).withColumn("p", F.greatest("d0", "d1") / total)


def vote_topk(conf: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, win, k, pred) for every k: the sign of the summed confidence of the k best elements, in one pass."""
    ranked = quality.withColumn("k", F.row_number().over(W.orderBy(F.desc("quality"), "element"))).select("element", "k")
    w = W.partitionBy(*keys, "win").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return conf.join(ranked, "element").withColumn("pred", (F.round(F.sum("confidence").over(w), 9) > 0).cast("int")).select(*keys, "win", "y", "k", "pred")


def greedy_order(el: DataFrame, score, steps: int, keep) -> list[tuple[str, float]]:
    """Forward selection: in every step all elements left are tried in one job and the best is taken. ``score`` turns rows
    (element, win, y, pred) into (element, value). ``keep`` stores a window's elements as one row and reads them back, so the
    distances are made once and a step moves nothing but what ``score`` does. The driver sees one row per element."""
    chosen: list[tuple[str, float]] = []
    gap = F.struct("element", "y", (F.col("d0") - F.col("d1")).alias("gap"))
    held = keep(el.groupBy("win").agg(F.collect_list(gap).alias("gaps")))
    for _ in range(steps):
        names = [e for e, _ in chosen]
        taken = F.filter("gaps", lambda g: g["element"].isin(names))
        done = F.aggregate(taken, F.lit(0.0), lambda s, g: s + F.coalesce(g["gap"], F.lit(0.0)))
        rows = held.select("win", done.alias("sum"), F.explode(F.filter("gaps", lambda g: ~g["element"].isin(names))).alias("g")).select("win", "sum", "g.*")
        best = score(rows.withColumn("pred", (F.round(F.col("gap") + F.col("sum"), 9) > 0).cast("int"))).orderBy(F.desc("value"), "element").first()
        if best is None:
            break
        chosen.append((best["element"], best["value"]))
    return chosen


def optimal_count(perf: DataFrame, keys: list[str], slack: float = 0.005) -> DataFrame:
    """First k whose value comes within the slack of the best."""
    top = F.max("value").over(W.partitionBy(*keys))
    return perf.withColumn("_top", top).filter(F.col("value") > F.col("_top") - slack).groupBy(*keys).agg(F.min("k").alias("k"))


def by_pairs(el: DataFrame, keys: list[str], value: str, sums: list[str], of) -> DataFrame:
    """(one, other, n, sums) over all windows that have both elements. Windows come as rows of a matrix, one column for each
    element, in Arrow batches; ``of`` turns values and a mask of those that are there into element x element sums, which a task
    adds up: windows x elements rows are shuffled once, and elements^2 rows leave a task, not windows x elements^2."""
    kind = dict(el.dtypes)["element"]
    rows = el.groupBy(*keys, "win").agg(F.collect_list("element").alias("element"), F.collect_list(F.col(value).cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        held = np.zeros((len(sums) + 1, 0, 0))
        for batch in batches:
            lists, values = batch.column("element"), batch.column("v")
            coded = lists.flatten().dictionary_encode()
            own = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], dtype=np.int64)
            x = np.full((batch.num_rows, len(names)), np.nan)
            if len(own):
                x[np.asarray(pc.list_parent_indices(lists)), own[np.asarray(coded.indices)]] = np.asarray(values.flatten())
            there = ~np.isnan(x)
            grown = len(names) - held.shape[1]
            held = np.pad(held, ((0, 0), (0, grown), (0, grown))) if grown else held
            seen = there.astype(float)
            held += np.stack([seen.T @ seen, *of(np.where(there, x, 0.0), seen)])
        i, j = np.nonzero(held[0])
        labels = pa.array(list(names)).cast(pa.from_numpy_dtype(np.int64)) if names and isinstance(next(iter(names)), int) else pa.array(list(names), pa.string())
        columns = [labels.take(pa.array(i)), labels.take(pa.array(j)), *[pa.array(h[i, j]) for h in held]]
        yield pa.RecordBatch.from_arrays(columns, names=["one", "other", "n", *sums])

    wide = "long" if kind in ("int", "bigint", "smallint", "tinyint") else "string"
    parts = rows.select("element", "v").mapInArrow(run, f"one {wide}, other {wide}, n double, " + ", ".join(f"{s} double" for s in sums))
    added = parts.groupBy("one", "other").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    return added.withColumns({"one": F.col("one").cast(kind), "other": F.col("other").cast(kind)})


def agreement(el: DataFrame, keys: list[str]) -> DataFrame:
    """1 - mean difference of two elements' probabilities of class 1."""

    def apart(x: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        return [np.stack([(np.abs(x[:, i : i + 1] - x) * there * there[:, i : i + 1]).sum(axis=0) for i in range(x.shape[1])])]

    return by_pairs(el, keys, "p1", ["apart"], apart).select("one", "other", (1 - F.col("apart") / F.col("n")).alias("agreement"))


def prediction_overlap(el: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of windows that both, one or none of two elements predict right."""
    rows = el.withColumn("ok", (F.col("pred") == F.col("y")).cast("int"))

    def counts(x: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        wrong = there - x
        return [x.T @ x, x.T @ wrong, wrong.T @ x, wrong.T @ wrong]

    names = ["cc", "cw", "wc", "ww"]
    return by_pairs(rows, keys, "ok", names, counts).select("one", "other", *[(F.col(c) / F.col("n")).alias(c) for c in names])


def reduce_pairs(pairs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of defined values over (one, other) pairs split in their parts, per ``by``."""
    return pairs.groupBy(*by).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))


def class_histograms(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, label, bin, share) on bins common to the classes; the last bin is closed. The ends, a row for each histogram, are sent
    to the values, which would else be shuffled to as many tasks as there are histograms."""
    ends = df.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counted = df.join(F.broadcast(ends), by).groupBy(*by, "label", at.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    return counted.withColumn("share", F.col("c") / F.sum("c").over(W.partitionBy(*by, "label"))).drop("c")


def kl_js(hist: DataFrame, by: list[str], delta: float = 1e-6) -> DataFrame:
    """Divergences of the histograms of class 0 and class 1 in base 2: both directions, and Jensen-Shannon."""
    share = lambda c: F.sum(F.when(F.col("label") == c, F.col("share")).otherwise(0.0))
    rows = hist.groupBy(*by, "bin").agg((share(0) + delta).alias("p"), (share(1) + delta).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda a, b: F.sum(F.col(a) * F.log2(F.col(a) / F.col(b)))
    return rows.groupBy(*by).agg(kl("p", "q").alias("kl_01"), kl("q", "p").alias("kl_10"), ((kl("p", "m") + kl("q", "m")) / 2).alias("js"))


def useful_distance(hv: Column, own: Column, a: Column, b: Column) -> Column:
    """Share of different bits to a class vector among those where the class vectors differ."""
    mask = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    diff = F.zip_with(F.zip_with(hv, own, lambda x, y: x.bitwiseXOR(y)), mask, lambda x, y: x.bitwiseAND(y))
    count = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + F.bit_count(x))
    return F.when(count(mask) > 0, count(diff) / count(mask)).otherwise(0.0)
