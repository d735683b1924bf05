"""Exact percentiles of groups of any size: radix selection in a few counting passes, instead of a group's values in a buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a digit: a pass counts up to 2 ** DIGIT of them for each group and rank that is looked for.
DIGIT = 16
SIGN = -(1 << 63)


def ordered_bits(v: Column) -> Column:
    """A double's bits as a long that, read without a sign, is in the order of the doubles (both zeros alike, NaN last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits.bitwiseXOR(F.lit(SIGN))).otherwise(F.bitwise_not(bits))


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], keep) -> DataFrame:
    """(by, p): for each group the array of the values at the shares, linearly between ranks as ``percentile`` gives them.

    Every value is its 64 bits in order, read as digits. A pass counts, for each group and leading digits that a wanted rank is
    known to have, the values by their next digit; sums of the counts tell the next digit. It ends after the fourth pass, or
    once each wanted rank is in a bucket of one value. A task holds 2 ** DIGIT counts for a group and rank, not its values, and a
    group's rows are never together. ``keep`` stores a frame and reads it back. Nulls are left out; null groups are groups.
    """
    rows = keep(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")).withColumn("key", ordered_bits(F.col("v"))))
    alike = lambda a, b, more=(): [F.lit(True), *[F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by], *[F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in more]]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    at = [F.lit(p) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in at])))
    wanted = sizes.filter("n > 0").select(*by, F.explode(ranks).alias("rank")).withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    wanted = keep(wanted)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        lead = F.shiftrightunsigned("key", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        cut = rows.select(*by, "v", lead.alias("prefix"), digit.alias("digit")).alias("r")
        open_ = wanted.select(*by, "prefix").distinct().alias("w")
        counts = cut.join(open_, alike("r", "w", ["prefix"])).select("r.*").groupBy(*by, "prefix", "digit").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        lower = F.sum("c").over(W.partitionBy(*by, "prefix").orderBy("digit")) - F.col("c")
        c, w = counts.withColumn("lower", lower).alias("c"), wanted.alias("w")
        inside = (F.col("w.rank") >= F.col("w.before") + F.col("c.lower")) & (F.col("w.rank") < F.col("w.before") + F.col("c.lower") + F.col("c.c"))
        found = w.join(c, [*alike("w", "c", ["prefix"]), inside])
        longer = F.shiftleft("w.prefix", DIGIT).bitwiseOR(F.col("c.digit"))
        wanted = keep(found.select(*[f"w.{k}" for k in by], "rank", longer.alias("prefix"), (F.col("w.before") + F.col("c.lower")).alias("before"), "c.least", "c.most"))
        if wanted.filter("least <> most").isEmpty():
            break
    held = wanted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "least"))).alias("held")).alias("h")
    pick = lambda x: F.element_at("held", x.cast("long"))
    between = lambda x: F.when(F.floor(x) == x, pick(F.floor(x))).otherwise((F.ceil(x) - x) * pick(F.floor(x)) + (x - F.floor(x)) * pick(F.ceil(x)))
    met = sizes.alias("s").join(held, alike("s", "h"))
    return met.select(*[f"s.{k}" for k in by], F.array(*[between(x) for x in at]).alias("p"))
