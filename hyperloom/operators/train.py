"""Class prototypes. Bundles are grouped sums; learners that depend on the order of windows run per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.hv import WORD, hv_distance


def train_bundle(enc: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, pos, bit) of all windows: acc (times set), n and the majority bit."""
    model = enc.groupBy(*keys, "pos").agg(F.sum("bit").alias("acc"), F.count("*").alias("n"))
    return model.withColumn("bit", (F.col("acc") > F.floor(F.col("n") / 2)).cast("int"))


def train_bundle_twice(enc: DataFrame, keys: list[str], recording: str) -> DataFrame:
    """Majority within each recording, then over recordings with the threshold (recordings - 1) / 2."""
    inner = train_bundle(enc, [*keys, recording])
    outer = inner.groupBy(*keys, "pos").agg(F.sum("bit").alias("acc"), F.count("*").alias("n"))
    return outer.withColumn("bit", (F.col("acc") > (F.col("n") - 1) / 2).cast("int"))


def leave_one_out(partial: DataFrame, keys: list[str], recording: str) -> DataFrame:
    """Models of all folds from one bundle per recording: the total less the recording's own part."""
    total = partial.groupBy(*keys, "pos").agg(F.sum("acc").alias("all"), F.sum("n").alias("n_all"))
    rows = partial.join(total, [*keys, "pos"]).select(*keys, F.col(recording).alias("fold"), "pos", (F.col("all") - F.col("acc")).alias("acc"), (F.col("n_all") - F.col("n")).alias("n"))
    return rows.filter("n > 0").withColumn("bit", (F.col("acc") > F.floor(F.col("n") / 2)).cast("int"))


def bundle_fast(enc: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acc array, n, hv) from packed vectors: one row of counters per key leaves each batch, and only those are added up."""
    types = dict(enc.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", acc array<bigint>, n bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                words = np.stack(own["hv"].to_numpy()).astype("<u4")
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
                out.append((*(key if isinstance(key, tuple) else (key,)), bits.sum(axis=0, dtype=np.int64), len(own)))
            yield pd.DataFrame(out, columns=[*keys, "acc", "n"])

    partial = enc.select(*keys, "hv").mapInPandas(run, schema)
    added = partial.select(*keys, "n", F.posexplode("acc")).groupBy(*keys, "pos").agg(F.sum("col").alias("a"), F.sum("n").alias("n"))
    return with_bits(added, keys)


def updated(model: DataFrame, wrong: DataFrame, keys: list[str], factor: float = 1.0, subtract: bool = True) -> DataFrame:
    """One pass with a frozen model: the vectors of wrongly predicted windows are added to their class and, if asked, taken
    from the one predicted. model has (keys, class, pos, acc, n); wrong has (keys, label, pred, pos, bit, weight)."""
    w = F.col("weight") * factor
    gain = wrong.select(*keys, F.col("label").alias("class"), "pos", (w * F.col("bit")).alias("da"), w.alias("dn"))
    if subtract:
        gain = gain.unionByName(wrong.select(*keys, F.col("pred").alias("class"), "pos", (-w * F.col("bit")).alias("da"), (-w).alias("dn")))
    total = gain.groupBy(*keys, "class", "pos").agg(F.sum("da").alias("da"), F.sum("dn").alias("dn"))
    rows = model.join(total, [*keys, "class", "pos"], "left")
    rows = rows.withColumns({"acc": F.col("acc") + F.coalesce("da", F.lit(0.0)), "n": F.col("n") + F.coalesce("dn", F.lit(0.0))}).drop("da", "dn")
    return rows.withColumn("bit", (F.col("acc") > F.col("n") / 2).cast("int"))


def bits_of(pdf: pd.DataFrame) -> np.ndarray:
    words = np.stack(pdf["hv"].to_numpy()).astype("<u4")
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.int8)


def in_order(enc: DataFrame, keys: list[str], learner, args: tuple) -> DataFrame:
    """Runs a learner over each key's windows in order: (keys, class, centroid, n, hv)."""
    types = dict(enc.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", `class` int, centroid int, n double, hv array<bigint>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win")
        rows = learner(bits_of(pdf), pdf["label"].to_numpy(), *args)
        key = [pdf[k].iloc[0] for k in keys]
        out = [(*key, c, i, float(n), np.packbits(b, bitorder="little").view("<u4").astype(np.int64)) for c, i, n, b in rows]
        return pd.DataFrame(out, columns=[*keys, "class", "centroid", "n", "hv"])

    return enc.groupBy(*keys).applyInPandas(run, schema)


def online(x: np.ndarray, y: np.ndarray, subtract: bool = True, power: int = 2) -> list[tuple]:
    """Every window is added to its class with its distance, to a power, as weight; a wrong prediction is taken from its class."""
    classes = np.unique(y)
    acc, n = np.zeros((len(classes), x.shape[1])), np.zeros(len(classes))
    bits = np.zeros_like(acc, dtype=np.int8)
    for v, label in zip(x, y, strict=True):
        d = np.abs(bits - v).mean(axis=1)
        true, pred = int(np.flatnonzero(classes == label)[0]), int(d.argmin())
        signed = 2.0 * v - 1
        w = d[true] ** power if n[true] else 1.0
        acc[true] += w * signed
        n[true] += w
        if pred != true and n[pred] and subtract:
            acc[pred] -= (1 - d[pred]) * signed
            n[pred] -= 1 - d[pred]
        bits = np.where(acc > 0, 1, np.where(acc < 0, 0, bits)).astype(np.int8)
    return [(int(c), 0, n[i], bits[i].astype(np.uint8)) for i, c in enumerate(classes)]


def online_soft(x: np.ndarray, y: np.ndarray, always: bool = False, boost: float = 1.0, taken: float = 0.5, slope: float = 20.0) -> list[tuple]:
    """As above with soft distances; class 1 gains by a factor; half as much is taken away."""
    classes = np.unique(y)
    acc, n = np.zeros((len(classes), x.shape[1])), np.zeros(len(classes))
    sig = lambda v: 1 / (1 + np.exp(-v))
    for v, label in zip(x, y, strict=True):
        d = sig(slope * (np.abs((acc > 0) - v).mean(axis=1) - 0.5)) + sig(slope * (-np.abs((acc > 0) - v).mean(axis=1) - 0.5))
        true, pred = int(np.flatnonzero(classes == label)[0]), int(d.argmin())
        signed, first = 2.0 * v - 1, n[true] == 0
        if pred != true or always or first:
            w = (1.0 if first else d[true]) * (boost if label == 1 else 1.0)
            acc[true] += w * signed
            n[true] += w
            if pred != true and n[pred]:
                acc[pred] -= taken * (1 - d[pred]) * signed
                n[pred] -= taken * (1 - d[pred])
    return [(int(c), 0, n[i], (acc[i] > 0).astype(np.uint8)) for i, c in enumerate(classes)]


def minibatch(model: dict[int, tuple[np.ndarray, float]], x: np.ndarray, y: np.ndarray, always: bool = True, taken: float = 0.5) -> dict[int, tuple[np.ndarray, float]]:
    """One mini-batch: all windows are predicted with the model as it was, then each is added to its class with its distance as
    weight (1 where the class is new), only the wrongly predicted ones unless ``always``, and these are taken from the class
    predicted with a share of one less their distance. Class: (counters of bits as +-1, weight added)."""
    known = sorted(model)
    signed = 2.0 * x - 1
    bits = np.array([model[c][0] > 0 for c in known]).reshape(len(known), x.shape[1])
    d = np.abs(bits[None, :, :] - x[:, None, :]).mean(axis=2)
    new = {c: (a.copy(), n) for c, (a, n) in model.items()}
    pred = np.array(known)[d.argmin(axis=1)] if known else np.full(len(x), -1)
    wrong = pred != y if known else np.ones(len(x), dtype=bool)
    for c in np.unique(y).tolist():
        own = (y == c) & (wrong | always | (c not in model))
        w = d[own, known.index(c)] if c in model else np.ones(int(own.sum()))
        a, n = new.get(c, (np.zeros(x.shape[1]), 0.0))
        new[c] = (a + w @ signed[own], n + float(w.sum()))
    for c in known if taken else []:
        own = wrong & (pred == c)
        w = taken * (1 - d[own, known.index(c)])
        new[c] = (new[c][0] - w @ signed[own], new[c][1])
    return new


def multi_centroid(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """A window joins its class's nearest centroid while it is no farther than usual, or clearly nearer than other classes; else it opens one."""
    accs: dict[int, list] = {int(c): [] for c in np.unique(y)}
    same, other = [], []
    for v, label in zip(x, y, strict=True):
        own = [np.abs((a > n // 2) - v).mean() for a, n in accs[int(label)]]
        rest = [np.abs((a > n // 2) - v).mean() for c, members in accs.items() if c != label for a, n in members]
        if not own:
            accs[int(label)].append([v.astype(float), 1])
            continue
        k, d = int(np.argmin(own)), min(own)
        s, o = (np.mean(z) if z else None for z in (same, other))
        if s is None or o is None or d < s or d < o and o - d > d - s:
            accs[int(label)][k][0] += v
            accs[int(label)][k][1] += 1
        else:
            accs[int(label)].append([v.astype(float), 1])
        same.append(d)
        if rest:
            other.append(min(rest))
    return [(c, i, n, (a > n // 2).astype(np.uint8)) for c, members in accs.items() for i, (a, n) in enumerate(members)]


def reduce_by_removal(model: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """For every step the centroids that are left when the smallest step / steps of a class are dropped (never the largest)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "class")
    ranked = model.withColumns({"_r": F.row_number().over(w.orderBy("n", "centroid")), "_k": F.count("*").over(w)})
    every = ranked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return every.filter((F.col("_r") > F.floor(F.col("_k") * F.col("step") / steps)) | (F.col("_r") == F.col("_k"))).drop("_r", "_k")


def merge_candidates(model: DataFrame, keys: list[str], d: int, threshold: float) -> DataFrame:
    """The smallest centroid of each class with its nearest other one, where that is under the threshold times its mean distance."""
    a, b = model.alias("a"), model.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "class"]]
    pairs = a.join(b, [*same, F.col("a.centroid") != F.col("b.centroid")]).select(*[f"a.{k}" for k in [*keys, "class"]], "a.centroid", "a.n", F.col("b.centroid").alias("into"), (hv_distance("a.hv", "b.hv") / d).alias("dist"))
    near = pairs.groupBy(*keys, "class", "centroid", "n").agg(F.min(F.struct("dist", "into")).alias("best"), F.avg("dist").alias("mean"))
    smallest = near.groupBy(*keys, "class").agg(F.min(F.struct("n", "centroid", "best", "mean")).alias("m"))
    return smallest.filter(F.col("m.best.dist") < threshold * F.col("m.mean")).select(*keys, "class", F.col("m.centroid").alias("centroid"), F.col("m.best.into").alias("into"), F.col("m.best.dist").alias("dist"))


def merged_model(model: DataFrame, keys: list[str], d: int, threshold: float) -> DataFrame:
    """One round of merging: of each class the smallest centroid's counters (keys, class, centroid, acc array, n, hv) are added
    to those of the one that :func:`merge_candidates` names."""
    pairs = merge_candidates(model, keys, d, threshold).select(*keys, "class", "centroid", "into")
    moved = model.join(pairs, [*keys, "class", "centroid"], "left").withColumn("centroid", F.coalesce("into", "centroid")).drop("into")
    return with_bits(moved.select(*keys, "class", "centroid", "n", F.posexplode("acc")).groupBy(*keys, "class", "centroid", "pos").agg(F.sum("col").alias("a"), F.sum("n").alias("n")), [*keys, "class", "centroid"])


def with_bits(counters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acc array, n, hv) from counters (keys, pos, a, n); a bit is set where the counter is over half of n."""
    model = counters.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]).alias("acc"), F.first("n").alias("n"))
    word = lambda w: F.aggregate(F.transform(F.slice("acc", w * WORD + 1, WORD), lambda a, i: F.when(a > F.floor(F.col("n") / 2), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return model.withColumn("hv", F.transform(F.sequence(F.lit(0), (F.size("acc") / WORD).cast("int") - 1), word))


def reduce_by_merging(model: DataFrame, keys: list[str], d: int, threshold: float, keep) -> DataFrame:
    """Rounds of merging until no class has a candidate. ``keep`` stores the model between rounds and reads it back. Each round
    takes one centroid from a class, so there are fewer rounds than centroids; pairs are of the centroids of one class."""
    model = keep(model)
    while not merge_candidates(model, keys, d, threshold).isEmpty():
        model = keep(merged_model(model, keys, d, threshold))
    return model


def stops(improvements: list[float], since_start: float, least: float) -> bool:
    """The rule of retraining: worse than at the start, the last three gains all under the limit in size, or none of them a gain."""
    last = improvements[-3:]
    return since_start < 0 or len(last) == 3 and (all(abs(x) < least for x in last) or all(x <= 0 for x in last))


def retrain_until(model: DataFrame, one_pass, score, keep, most: int = 31, least: float = 0.001) -> tuple[DataFrame, int, list[float]]:
    """Passes until the rule says stop: the best model, its pass, and the scores of all passes."""
    model = keep(model)
    scores, best = [score(model)], (model, 0)
    while len(scores) < most and not (len(scores) > 1 and stops([b - a for a, b in zip(scores, scores[1:])], scores[-1] - scores[0], least)):
        model = keep(one_pass(model))
        scores.append(score(model))
        if scores[-1] > max(scores[:-1]):
            best = (model, len(scores) - 1)
    return *best, scores


class Bagging:
    """Trees fitted to seeded samples, drawn with replacement, of the training rows; their votes are averaged."""

    def __init__(self, train: DataFrame, trees: int, features: str, label: str):
        from pyspark.ml.classification import DecisionTreeClassifier

        learner = DecisionTreeClassifier(maxDepth=5, seed=1, featuresCol=features, labelCol=label)
        self.models = [learner.fit(train.sample(True, 1.0, i)) for i in range(trees)]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        for i, m in enumerate(self.models):
            df = m.transform(df).withColumn(f"_p{i}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
        names = [f"_p{i}" for i in range(len(self.models))]
        widest = F.greatest(*[F.size(n) for n in names]) if len(names) > 1 else F.size(names[0])
        mean = F.transform(F.sequence(F.lit(0), widest - 1), lambda c: sum((F.coalesce(F.get(n, c), F.lit(0.0)) for n in names), F.lit(0.0)) / len(names))
        out = df.withColumn("_mean", mean).withColumn("prediction", (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("_mean")).drop("_mean", *names)


def baseline(train: DataFrame, kind: str, features: str = "features", label: str = "label"):
    """A fitted classifier of Spark's library (boosting and svm: two classes); see neighbours.knn, kernel.KernelSVM and boost.AdaBoost for the others."""
    from pyspark.ml import classification as c

    if kind == "bagging":
        return Bagging(train, 10, features, label)
    made = {
        "tree": lambda: c.DecisionTreeClassifier(maxDepth=5, seed=1), "forest": lambda: c.RandomForestClassifier(numTrees=100, seed=1),
        "boosting": lambda: c.GBTClassifier(maxIter=5, seed=1), "svm": lambda: c.LinearSVC(maxIter=10),
    }[kind]()
    return made.setParams(featuresCol=features, labelCol=label).fit(train)
