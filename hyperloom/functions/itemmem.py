"""Item memories: basis vectors as rows (idx, pos, bit), from an md5 of seed, kind, index and place, so any engine has the
same bits. ``packed`` turns them into rows (idx, hv)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.functions.hv import WORD

SEED = "42"


def md5_bit(kind: str, idx: Column, pos: Column, seed: str = SEED) -> Column:
    return (F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(kind), idx.cast("string"), pos.cast("string"))), 1, 1) >= "8").cast("int")


def grid(spark: SparkSession, k: int, d: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("pos"))


def im_random(spark: SparkSession, kind: str, k: int, d: int) -> DataFrame:
    return grid(spark, k, d).withColumn("bit", md5_bit(kind, F.col("idx"), F.col("pos")))


def im_sandwich(spark: SparkSession, kind: str, k: int, d: int) -> DataFrame:
    """Even vectors random; an odd one has the first half of the one before and the second of the one behind; an odd last
    one the first half of the one before and a second half of its own."""
    even, own = F.col("idx") % 2 == 0, F.col("idx")
    source = F.when(even, own).when(F.col("pos") < d // 2, own - 1).when(own < k - 1, own + 1).otherwise(own)
    return grid(spark, k, d).withColumn("bit", md5_bit(kind, source, F.col("pos")))


def im_scale(spark: SparkSession, kind: str, k: int, d: int, f: int = 1) -> DataFrame:
    """Vector i is vector 0 with its first i * floor(d / (f * k)) bits inverted."""
    n = d // (f * k)
    bit = md5_bit(kind, F.lit(0), F.col("pos"))
    return grid(spark, k, d).withColumn("bit", F.when(F.col("pos") < F.col("idx") * n, 1 - bit).otherwise(bit))


def im_scale_rand(spark: SparkSession, kind: str, k: int, d: int, f: int = 1) -> DataFrame:
    """Each vector is the one before with floor(d / (f * k)) places of 1..d-1, first by their hashes, inverted."""
    n = d // (f * k)
    rank = F.row_number().over(W.partitionBy("idx").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), F.lit(f"{kind}-flip"), F.col("idx").cast("string"), F.col("pos").cast("string"))), "pos"))
    flips = grid(spark, k, d).filter("idx > 0 and pos > 0").withColumn("r", rank).filter(F.col("r") <= n).select("idx", "pos", F.lit(1).alias("flip"))
    total = F.sum(F.coalesce("flip", F.lit(0))).over(W.partitionBy("pos").orderBy("idx"))
    rows = grid(spark, k, d).join(flips, ["idx", "pos"], "left").withColumn("flips", total)
    return rows.select("idx", "pos", ((md5_bit(kind, F.lit(0), F.col("pos")) + F.col("flips")) % 2).cast("int").alias("bit"))


def im_radius(spark: SparkSession, kind: str, k: int, d: int, r: int = 4) -> DataFrame:
    """Every r-th vector random; between them a growing tail comes from the next one."""
    axis = F.floor(F.col("idx") / r).cast("int")
    bit = F.when(F.col("pos") < d - (F.col("idx") % r) * (d // r), md5_bit(kind, axis, F.col("pos"))).otherwise(md5_bit(kind, axis + 1, F.col("pos")))
    return grid(spark, k, d).withColumn("bit", bit)


KINDS = {"random": im_random, "sandwich": im_sandwich, "scaleNoRand": im_scale, "scaleRand": im_scale_rand, "scaleWithRadius": im_radius}


def item_memory(spark: SparkSession, how: str, kind: str, k: int, d: int, **options) -> DataFrame:
    """(idx, pos, bit) of the named construction."""
    return KINDS[how](spark, kind, k, d, **options)


def packed(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys, hv) from (keys, pos, bit)."""
    words = bits.groupBy(*keys, F.floor(F.col("pos") / WORD).alias("w")).agg(F.sum(F.col("bit") * F.pow(F.lit(2.0), F.col("pos") % WORD).cast("long")).alias("v"))
    return words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("hv"))


def im_similarity(memory: DataFrame, d: int) -> DataFrame:
    """Mean share of different bits over all pairs of basis vectors (rows idx, pos, bit). A place with c ones among k vectors
    differs in c * (k - c) pairs, so no pair is made."""
    ones = memory.groupBy("pos").agg(F.sum("bit").alias("c"), F.count("*").alias("k"))
    pairs = F.max(F.col("k") * (F.col("k") - 1) / 2)
    return ones.agg((F.sum(F.col("c") * (F.col("k") - F.col("c"))) / F.nullif(pairs, F.lit(0.0)) / F.lit(d)).alias("mean_difference"))
