"""Similarities of prototypes and general models made of personal ones. All tables here are models: rows per subject and
class, never windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.hv import hv_cosine, hv_distance


def pairs(a: DataFrame, b: DataFrame, names: list[str], on: list[str] = ()) -> DataFrame:
    left = a.select(*on, *[F.col(n).alias(f"{n}_a") for n in names], F.col("hv").alias("_a"))
    right = b.select(*on, *[F.col(n).alias(f"{n}_b") for n in names], F.col("hv").alias("_b"))
    return left.join(right, list(on)) if on else left.crossJoin(right)


def similarity_matrix(model: DataFrame, names: list[str], d: int, on: list[str] = ()) -> DataFrame:
    return pairs(model, model, names, on).withColumn("similarity", 1 - hv_distance("_a", "_b") / d).drop("_a", "_b")


def cosine_matrix(model: DataFrame, names: list[str], on: list[str] = ()) -> DataFrame:
    return pairs(model, model, names, on).withColumn("similarity", 1 - hv_cosine("_a", "_b")).drop("_a", "_b")


def most_similar(matrix: DataFrame, names: list[str]) -> DataFrame:
    """For every vector the most similar other one (ties to the smaller names)."""
    own = [F.col(f"{n}_a") == F.col(f"{n}_b") for n in names]
    same = own[0]
    for x in own[1:]:
        same = same & x
    best = F.min(F.struct((-F.col("similarity")).alias("s"), *[f"{n}_b" for n in names]))
    rows = matrix.filter(~same).groupBy(*[f"{n}_a" for n in names]).agg(best.alias("b"))
    return rows.select(*[f"{n}_a" for n in names], *[F.col(f"b.{n}_b").alias(f"{n}_b") for n in names], (-F.col("b.s")).alias("similarity"))


def similarity_summary(matrix: DataFrame) -> DataFrame:
    """Per subject: mean similarity of class 1 to class 1 vectors, 0 to 0 and 1 to 0 of other subjects."""
    other = matrix.filter("subject_a <> subject_b")
    mean = lambda a, b: F.avg(F.when((F.col("class_a") == a) & (F.col("class_b") == b), F.col("similarity")))
    return other.groupBy(F.col("subject_a").alias("subject")).agg(mean(1, 1).alias("ss"), mean(0, 0).alias("nsns"), mean(1, 0).alias("sns"))


def personal_vector(folds: DataFrame, keys: list[str], how: str = "loo") -> DataFrame:
    """From fold models (keys, fold, pos, bit): the majority with ties to 1 ("loo"), or the last fold ("rolling")."""
    if how == "rolling":
        return folds.groupBy(*keys, "pos").agg(F.max_by("bit", "fold").alias("bit"))
    return folds.groupBy(*keys, "pos").agg((F.sum("bit") >= F.count("*") / 2).cast("int").alias("bit"))


def general_vector(models: DataFrame, by: list[str]) -> DataFrame:
    """Sum over subjects of acc / |n|, set where it exceeds floor(subjects / 2); subjects with n = 0 don't count."""
    rows = models.filter("n <> 0").groupBy(*by, "pos").agg(F.sum(F.col("acc") / F.abs("n")).alias("sum"), F.count("*").alias("subjects"))
    return rows.withColumn("bit", (F.round("sum", 9) > F.floor(F.col("subjects") / 2)).cast("int"))


def general_vector_loso(models: DataFrame, by: list[str], subject: str = "subject") -> DataFrame:
    """The same without each subject in turn, from one sum: the total less the subject's own part."""
    rows = models.filter("n <> 0").withColumn("part", F.col("acc") / F.abs("n"))
    total = rows.groupBy(*by, "pos").agg(F.sum("part").alias("all"), F.count("*").alias("subjects"))
    met = rows.join(total, [*by, "pos"])
    return met.select(F.col(subject).alias("held_out"), *by, "pos", (F.round(F.col("all") - F.col("part"), 9) > F.floor((F.col("subjects") - 1) / 2)).cast("int").alias("bit"))


def general_weighted(models: DataFrame, d: int, rule: str, passes: int = 1) -> DataFrame:
    """Subjects in order added to both classes of a general model: "Avrg" (1), "WAdd" (1 - similarity), "WAdd&Sub" (also taken
    from the other class), "WSub" (added whole, taken by similarity). models: (subject, class, hv)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = {0: np.zeros(d), 1: np.zeros(d)}
        for _ in range(passes):
            for _, own in pdf.sort_values(["subject", "class"]).groupby("subject", sort=True):
                for c, hv in zip(own["class"], own["hv"], strict=True):
                    v = 2.0 * np.unpackbits(np.asarray(hv, dtype="<u4").view(np.uint8), bitorder="little")[:d] - 1
                    alike = {k: float(((acc[k] > 0) == (v > 0)).mean()) if acc[k].any() else 0.0 for k in acc}
                    acc[c] += (1.0 if rule in ("Avrg", "WSub") else 1 - alike[c]) * v
                    if rule in ("WAdd&Sub", "WSub") and acc[1 - c].any():
                        acc[1 - c] -= alike[1 - c] * v
        rows = [(c, np.packbits(np.pad((a > 0).astype(np.uint8), (0, -d % 32)), bitorder="little").view("<u4").astype(np.int64)) for c, a in acc.items()]
        return pd.DataFrame(rows, columns=["class", "hv"])

    return models.groupBy(F.lit(rule).alias("rule")).applyInPandas(lambda key, pdf: run(pdf).assign(rule=key[0])[["rule", "class", "hv"]], "rule string, class int, hv array<bigint>")


def general_evolution(models: DataFrame, by: list[str], order: str = "subject") -> DataFrame:
    """The growing general vector: after each subject in order, its bits."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by, "pos").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = models.filter("n <> 0").withColumns({"sum": F.sum(F.col("acc") / F.abs("n")).over(w), "k": F.count("*").over(w)})
    return rows.select(*by, order, "k", "pos", (F.round("sum", 9) > F.floor(F.col("k") / 2)).cast("int").alias("bit"))


def general_evolution_shuffled(personal: DataFrame, by: list[str], shuffles: int = 10, seed: int = 42, subject: str = "subject") -> DataFrame:
    """(by, k, mean, std): how alike the majority (ties to 1) of the first k subjects is to the personal vectors of all but the
    first subject, over seeded orders of the subjects. personal: (subject, by, pos, bit), rows with the same places each.

    Orders are a table, majorities running sums along them. The mean likeness to many vectors needs no pairs: at each place it
    is the share of the vectors that have the majority's bit.
    """
    from pyspark.sql import Window as W

    names = personal.select(subject).distinct()
    orders = names.crossJoin(personal.sparkSession.range(shuffles).select(F.col("id").cast("int").alias("shuffle")))  # a few orders of subjects
    mixed = F.md5(F.concat_ws("|", F.lit(f"{seed}|shuffle"), F.col("shuffle").cast("string"), F.col(subject).cast("string")))
    orders = orders.withColumn("_at", F.row_number().over(W.partitionBy("shuffle").orderBy(mixed, subject))).select(subject, "shuffle", "_at")
    w = W.partitionBy("shuffle", *by, "pos").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    grown = personal.join(orders, subject).withColumns({"_sum": F.sum("bit").over(w), "k": F.count("*").over(w)})
    grown = grown.select("shuffle", *by, "pos", F.col("k").cast("int").alias("k"), (2 * F.col("_sum") >= F.col("k")).alias("_set"))
    first = personal.agg(F.min(subject).alias("_first"))
    shares = personal.crossJoin(first).filter(F.col(subject) != F.col("_first")).groupBy(*by, "pos").agg(F.avg("bit").alias("_share"))
    alike = F.avg(F.when(F.col("_set"), F.col("_share")).otherwise(1 - F.col("_share")))
    each = grown.join(shares, [*by, "pos"]).groupBy("shuffle", *by, "k").agg(alike.alias("s"))
    return each.groupBy(*by, "k").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


def compare_rules(personal: DataFrame, general: DataFrame, d: int) -> DataFrame:
    """(rule, measure, mean, std) over subjects of the likeness of personal vectors (subject, class, hv) to general ones (rule,
    class, hv): nsns, ss, nss (general 0, personal 1), sns, those of one class together (correct), of the other one (wrong), and
    by how much the own class is nearer (margin)."""
    p = personal.select("subject", F.col("class").alias("own"), F.col("hv").alias("_a"))
    g = general.select("rule", F.col("class").alias("of"), F.col("hv").alias("_b"))
    each = p.crossJoin(g).select("rule", "subject", "own", "of", (1 - hv_distance("_a", "_b") / d).alias("s"))  # models only
    pick = lambda of, own: F.max(F.when((F.col("of") == of) & (F.col("own") == own), F.col("s")))
    wide = each.groupBy("rule", "subject").agg(pick(0, 0).alias("nsns"), pick(1, 1).alias("ss"), pick(0, 1).alias("nss"), pick(1, 0).alias("sns"))
    both = {"correct": ["nsns", "ss"], "wrong": ["nss", "sns"]}
    parts = [F.struct(F.lit(m).alias("measure"), F.col(c).alias("v")) for m, cs in ({m: [m] for m in ("nsns", "ss", "nss", "sns")} | both).items() for c in cs]
    parts += [F.struct(F.lit("margin").alias("measure"), (F.col(a) - F.col(b)).alias("v")) for a, b in (("nsns", "sns"), ("ss", "nss"))]
    rows = wide.select("rule", F.explode(F.array(*parts)).alias("m")).select("rule", "m.*")
    return rows.groupBy("rule", "measure").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def similarity_histogram(matrix: DataFrame, bins: int = 20, lo: float = 0.5, hi: float = 1.05) -> DataFrame:
    """(kind, bin, n, share) of the similarities within subjects (of their two classes) and between subjects (nsns, sns, ss), less
    those of a vector with one equal to it (over 0.9999); values outside lo .. hi aren't counted."""
    from pyspark.sql import Window as W

    same, a, b = F.col("subject_a") == F.col("subject_b"), F.col("class_a"), F.col("class_b")
    kind = F.when(same & (a == 1) & (b == 0), "within").when(same, None).when((a == 0) & (b == 0), "nsns").when((a == 1) & (b == 1), "ss").when((a == 1) & (b == 0), "sns")
    rows = matrix.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("similarity") <= 0.9999) & (F.col("similarity") >= lo))
    counted = rows.groupBy("kind", F.floor((F.col("similarity") - lo) / ((hi - lo) / bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("kind")))


def compare_general(personal: DataFrame, general: DataFrame, d: int) -> DataFrame:
    """Mean and spread of the similarity of personal vectors to a general model's, by classes."""
    p = pairs(personal, general, ["class"]).withColumn("s", 1 - hv_distance("_a", "_b") / d)
    return p.groupBy("class_a", "class_b").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


def hybrid_model(personal: DataFrame, general: DataFrame, personal_class: int) -> DataFrame:
    """Every subject's own vector of one class with the general one of the other."""
    own = personal.filter(F.col("class") == personal_class)
    rest = personal.select("subject").distinct().crossJoin(general.filter(F.col("class") != personal_class))
    return own.unionByName(rest.select(own.columns))
