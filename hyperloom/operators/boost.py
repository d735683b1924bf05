"""Boosting by reweighted rows: stumps on levels, and any of Spark's classifiers that takes weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An error of nothing would have an infinite vote.
LEAST = 1e-10


@dataclass(frozen=True)
class Stump:
    """Votes 1 where the level of a feature is over the cut (sign 1) or not over it (sign -1)."""

    feature: int
    cut: int
    sign: int
    vote: float

    def says(self, levels: str) -> Column:
        return F.when(F.get(levels, F.lit(self.feature)) > self.cut, self.sign * self.vote).otherwise(-self.sign * self.vote)


def margin(stumps: list[Stump], levels: str = "levels") -> Column:
    """The votes of all stumps, for 1 if over zero."""
    return sum((s.says(levels) for s in stumps), F.lit(0.0))


def best_stump(sums: list[tuple[int, int, int, float]], n_levels: int) -> tuple[float, int, int, int]:
    """(error, feature, cut, sign) of the least weighted error, rounded to 12 places, from the weights of every (feature, level,
    label); ties go to the smallest feature, then cut, then to sign 1."""
    held: dict[int, list[list[float]]] = {}
    for feature, level, label, w in sums:
        held.setdefault(feature, [[0.0, 0.0] for _ in range(n_levels)])[level][label] += w
    tried = []
    for feature, cells in held.items():
        total, ones = sum(a + b for a, b in cells), sum(b for _, b in cells)
        zeros_under = ones_under = 0.0
        for cut, (a, b) in enumerate(cells[:-1]):
            zeros_under, ones_under = zeros_under + a, ones_under + b
            wrong = ones_under + (total - ones) - zeros_under  # ones under the cut and zeros over it
            tried += [(round(wrong / total, 12), feature, cut, 0), (round(1 - wrong / total, 12), feature, cut, 1)]
    error, feature, cut, turned = min(tried)
    return error, feature, cut, -1 if turned else 1


def boosted_stumps(rows: DataFrame, rounds: int, n_levels: int, levels: str = "levels", label: str = "label") -> list[Stump]:
    """From rows with an array of levels (0 .. n_levels - 1) and a label (0, 1), stumps in the order in which they were found.

    A round is one pass: a row's weight follows from the stumps so far, so nothing is kept or joined, and sums of weights by
    (feature, level, label) are all that is shuffled and that the driver sees. It ends early at an error of nothing or a half.
    """
    stumps: list[Stump] = []
    for _ in range(rounds):
        weight = F.exp(-(2 * F.col(label) - 1) * margin(stumps, levels))
        cells = rows.select(F.col(label).cast("int").alias("y"), weight.alias("w"), F.posexplode(levels).alias("f", "level"))
        sums = [tuple(r) for r in cells.groupBy("f", "level", "y").agg(F.sum("w").alias("w")).collect()]
        if not sums:
            break
        error, feature, cut, sign = best_stump(sums, n_levels)
        if error >= 0.5:
            break
        stumps.append(Stump(feature, cut, sign, 0.5 * math.log((1 - max(error, LEAST)) / max(error, LEAST))))
        if error == 0:
            break
    return stumps


class AdaBoost:
    """Rounds of one of Spark's classifiers on reweighted rows, two classes. ``learner`` has a weightCol; ``keep`` stores the
    weighted rows between rounds and reads them back, so that a round costs one fit and one pass."""

    def __init__(self, train: DataFrame, learner, rounds: int, keep, features: str = "features", label: str = "label"):
        self.label, self.features, self.models = label, features, []
        rows = keep(train.withColumn("_w", F.lit(1.0)))
        for _ in range(rounds):
            model = learner.copy({}).setParams(featuresCol=features, labelCol=label, weightCol="_w").fit(rows)
            said = model.transform(rows)
            right = F.col("prediction") == F.col(label)
            total, wrong = said.agg(F.sum("_w"), F.sum(F.when(right, 0.0).otherwise(F.col("_w")))).first()
            error = (wrong or 0.0) / total if total else 0.5
            if error >= 0.5:
                break
            vote = 0.5 * math.log((1 - max(error, LEAST)) / max(error, LEAST))
            self.models.append((model, vote))
            if error == 0:
                break
            scale = 0.5 / (total * error), 0.5 / (total * (1 - error))  # the new weights sum to one
            rows = keep(said.withColumn("_w", F.col("_w") * F.when(right, scale[1]).otherwise(scale[0])).select(*train.columns, "_w"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and p, the share of the votes for it."""
        out, columns = df.withColumn("_votes", F.lit(0.0)), df.columns
        for model, vote in self.models:
            said = model.transform(out)
            out = said.withColumn("_votes", F.col("_votes") + F.when(F.col("prediction") == 1, vote).otherwise(-vote)).select(*columns, "_votes")
        total = sum(v for _, v in self.models) or 1.0
        return out.withColumns({"prediction": (F.col("_votes") > 0).cast("double"), "p": 0.5 + F.abs("_votes") / (2 * total)}).drop("_votes")
