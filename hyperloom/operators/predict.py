"""Nearest-prototype prediction. A model is one row per class (and centroid, block): it joins to every window by key or, being
of the number of classes, to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.hv import hv_distance, softabs


def distances(enc: DataFrame, model: DataFrame, keys: list[str], on: list[str] = ()) -> DataFrame:
    """(keys, class, centroid?, dist): bits by which a window differs from each prototype; ``on`` are shared columns."""
    extra = [c for c in ("centroid",) if c in model.columns]
    m = model.select(*on, "class", *extra, F.col("hv").alias("_hv"))
    joined = enc.join(m, list(on)) if on else enc.crossJoin(m)
    return joined.select(*keys, *[c for c in on if c not in keys], "class", *extra, hv_distance("hv", "_hv").alias("dist"))


#: Words of prototypes that are sent to every task as one row; a larger model is joined as Spark sees fit.
SENT = 1 << 23


def nearness(enc: DataFrame, model: DataFrame, keys: list[str], on: list[str] = ()) -> DataFrame:
    """(keys, near): each window with the array of (dist, class, centroid) to all prototypes. The model, stored before, comes as
    one row of arrays (one for each value of ``on``), sent to the tasks if its counted size is under SENT, so windows neither
    multiply nor move, and what is asked of the distances is asked in the row."""
    centroid = F.col("centroid") if "centroid" in model.columns else F.lit(0)
    size = model.agg(F.sum(F.size("hv"))).first()[0] or 0
    held = model.groupBy(*on).agg(F.collect_list(F.struct(F.col("class"), centroid.cast("int").alias("centroid"), F.col("hv").alias("of"))).alias("_model"))
    held = F.broadcast(held) if size <= SENT else held
    joined = enc.join(held, list(on)) if on else enc.crossJoin(held)  # without on, held is one row
    near = F.transform("_model", lambda m: F.struct(hv_distance("hv", m["of"]).alias("dist"), m["class"].alias("class"), m["centroid"].alias("centroid")))
    return joined.select(*keys, near.alias("near"))


def nearest(near: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest class, as :func:`predict`, from rows of :func:`nearness`."""
    b = F.array_min("near")
    return near.select(*keys, b["class"].alias("pred"), b["dist"].alias("dist"))


def least(near: str, c: int) -> Column:
    """The nearest (dist, centroid) of a class."""
    return F.array_min(F.transform(F.filter(near, lambda x: x["class"] == c), lambda x: F.struct(x["dist"].alias("dist"), x["centroid"].alias("centroid"))))


def nearest_multi(near: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`predict_multi`, from rows of :func:`nearness`."""
    both = near.select(*keys, least("near", 0).alias("a"), least("near", 1).alias("b"))
    one = F.coalesce(F.col("b.dist") < F.col("a.dist"), F.col("a").isNull())
    return both.select(*keys, one.cast("int").alias("pred"), F.when(one, F.col("b.centroid") + 1).otherwise(-F.col("a.centroid") - 1).alias("centroid"))


def predict(dist: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest class; ties go to the lowest."""
    best = dist.groupBy(*keys).agg(F.min(F.struct("dist", "class")).alias("b"))
    return best.select(*keys, F.col("b.class").alias("pred"), F.col("b.dist").alias("dist"))


def two_class(dist: DataFrame, keys: list[str]) -> DataFrame:
    """d0 and d1, the smallest distance to each class."""
    pick = lambda c: F.min(F.when(F.col("class") == c, F.col("dist")))
    return dist.groupBy(*keys).agg(pick(0).alias("d0"), pick(1).alias("d1"))


def label_of(tie: str = "argmin") -> Column:
    """From d0 and d1: "argmin" gives 0 in a tie, "positive" 1, "strict" 1 only if d1 is smaller."""
    return F.when(F.col("d1") < F.col("d0"), 1).when((F.col("d1") == F.col("d0")) & F.lit(tie == "positive"), 1).otherwise(0)


def probability(eps: float = 0.0) -> Column:
    """Share of the other class's distance in both, for the class voted."""
    far, near = F.greatest("d0", "d1"), F.least("d0", "d1")
    total = far + near + F.lit(eps)
    return F.when(total > 0, far / total).otherwise(0.5)


def predict_multi(dist: DataFrame, keys: list[str]) -> DataFrame:
    """Class 1 only if its nearest centroid is strictly closer; signed number of that centroid (+k+1 or -k-1)."""
    pick = lambda c: F.min(F.when(F.col("class") == c, F.struct("dist", "centroid")))
    both = dist.groupBy(*keys).agg(pick(0).alias("a"), pick(1).alias("b"))
    one = F.coalesce(F.col("b.dist") < F.col("a.dist"), F.col("a").isNull())
    return both.select(*keys, one.cast("int").alias("pred"), F.when(one, F.col("b.centroid") + 1).otherwise(-F.col("a.centroid") - 1).alias("centroid"))


def predict_confident(two: DataFrame, threshold: float, d: int) -> DataFrame:
    """Soft distances; positives below the threshold become 0 with the probability turned round."""
    soft = two.withColumns({"d0": softabs(F.col("d0") / d), "d1": softabs(F.col("d1") / d)})
    rows = soft.withColumns({"pred": label_of(), "p": F.greatest("d0", "d1") / (F.col("d0") + F.col("d1") + 1e-7)})
    low = (F.col("pred") == 1) & (F.col("p") < threshold)
    return rows.withColumns({"pred": F.when(low, 0).otherwise(F.col("pred")), "p": F.when(low, 1 - F.col("p")).otherwise(F.col("p"))})


def score_summary(dist: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per class: windows, share predicted right, mean distance to the right class and to the nearest wrong one."""
    rows = dist.join(truth, keys)
    right = F.min(F.when(F.col("class") == F.col("label"), F.col("dist")))
    wrong = F.min(F.when(F.col("class") != F.col("label"), F.col("dist")))
    each = rows.groupBy(*keys, "label").agg(F.min(F.struct("dist", "class"))["class"].alias("pred"), right.alias("right"), wrong.alias("wrong"))
    hit = (F.col("pred") == F.col("label")).cast("int")
    return each.groupBy("label").agg(F.count("*").alias("n"), F.sum(hit).alias("n_right"), F.avg("right").alias("d_right"), F.avg("wrong").alias("d_wrong"))


def confidence_grid(pred: DataFrame, bins: int = 20) -> DataFrame:
    """Balanced accuracy for every pair of thresholds on the probability of class 1 and class 0, from histograms only."""
    cell = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    hist = pred.groupBy(cell.alias("bin"), "y", "pred").agg(F.count("*").alias("n"))
    axis = lambda name: hist.sparkSession.range(bins).select(F.col("id").cast("int").alias(name))
    pairs = axis("t1").crossJoin(axis("t0"))
    kept = F.when(F.col("pred") == 1, F.col("bin") >= F.col("t1")).otherwise(F.col("bin") >= F.col("t0"))
    final = F.when(kept, F.col("pred")).otherwise(1 - F.col("pred"))
    rows = pairs.crossJoin(hist).withColumn("final", final)
    hit = lambda c: F.sum(F.when((F.col("y") == c) & (F.col("final") == c), F.col("n")).otherwise(0)) / F.sum(F.when(F.col("y") == c, F.col("n")))
    return rows.groupBy("t1", "t0").agg(((hit(1) + hit(0)) / 2).alias("balanced"))
