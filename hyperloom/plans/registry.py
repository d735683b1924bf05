"""The library's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, for comparing engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


#: Events as a signal: one series per user, its samples in order of time.
S = """s AS (SELECT user_id AS subject, event_type AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
        value AS x, (value > 100)::INT AS label FROM events)"""
L, STEP = 8, 4
#: Windows of that signal: 8 samples every 4, the last start strictly below n - 8.
WINS = f"""{S}, n AS (SELECT subject, count(*) AS n FROM s GROUP BY 1),
    wi AS (SELECT subject, unnest(range(0, ((n - {L} + {STEP} - 1) // {STEP})::BIGINT)) AS win FROM n WHERE n > {L}),
    w AS (SELECT s.*, win FROM s JOIN wi ON s.subject = wi.subject AND t >= win * {STEP} AND t < win * {STEP} + {L})"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rows.select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel"), place.cast("long").alias("t"), F.col("value").alias("x"), (F.col("value") > 100).cast("int").alias("label"))


#: Embeddings as features of 8 channels and 8 features, in 10 classes, levels of 20.
E_ = """e AS (SELECT vec_id AS win, label, u.i AS i, u.i // 8 AS ch, u.i % 8 AS f, embedding[u.i + 1]::DOUBLE AS v FROM embeddings, unnest(range(0, 64)) AS u(i))"""
LV = f"""{E_}, mm AS (SELECT i, min(v) AS lo, max(v) AS hi FROM e GROUP BY i),
    lv AS (SELECT win, label, i, ch, f, v, least(greatest(floor(19 * (CASE WHEN hi > lo THEN (v - lo) / (hi - lo) END)), 0), 19)::INT AS level FROM e JOIN mm USING (i))"""
LEVELS = 20


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("win"), "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("win", "label", "i", F.floor(F.col("i") / 8).cast("int").alias("ch"), (F.col("i") % 8).cast("int").alias("f"), F.col("v").cast("double").alias("v"))


def levels(spark: SparkSession, sf: str) -> DataFrame:
    from hyperloom.operators.normalise import discretise, fit_minmax

    e = vectors(spark, sf)
    return discretise(e, fit_minmax(e, ["i"]), ["i"], LEVELS).drop("norm")


def level_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """(win, levels): the levels of every vector as an array, by the bounds of each place as one row of arrays."""
    from hyperloom.operators.normalise import fit_minmax, leveled

    at = fit_minmax(vectors(spark, sf), ["i"]).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("win"), "embedding").crossJoin(F.broadcast(at))
    norm = lambda v, b: F.when(b["hi"] > b["lo"], (v.cast("double") - b["lo"]) / (b["hi"] - b["lo"]))
    return rows.filter(F.size("embedding") > 0).select("win", F.transform("embedding", lambda v, i: leveled(norm(v, F.get("b", i)), LEVELS)).alias("levels"))


def listed_words(df: DataFrame) -> DataFrame:
    """Packed vectors as text for comparing engines."""
    return df.withColumn("hv", F.array_join(F.transform("hv", lambda x: x.cast("string")), ","))


def bit_sql(kind: str, idx: str, pos: str) -> str:
    return f"(substr(md5('42|{kind}|' || ({idx})::VARCHAR || '|' || ({pos})::VARCHAR), 1, 1) >= '8')::INT"


D = 64
P = f"p AS (SELECT unnest(range(0, {D}))::INT AS pos)"
#: Level vectors: vector 0 with the first 3 i bits inverted.
IM = f"""{P}, vm AS (SELECT l.i::INT AS level, pos, CASE WHEN pos < l.i * {D // LEVELS} THEN 1 - {bit_sql("level", "0", "pos")} ELSE {bit_sql("level", "0", "pos")} END AS bit FROM unnest(range(0, {LEVELS})) AS l(i), p),
    fm AS (SELECT l.i::INT AS f, pos, {bit_sql("feat", "l.i", "pos")} AS bit FROM unnest(range(0, 64)) AS l(i), p),
    cm AS (SELECT l.i::INT AS ch, pos, {bit_sql("ch", "l.i", "pos")} AS bit FROM unnest(range(0, 8)) AS l(i), p),
    pm AS (SELECT l.i::INT AS pair, pos, {bit_sql("pair", "l.i", "pos")} AS bit FROM unnest(range(0, 64)) AS l(i), p)"""
#: One-level encoding of all 64 features, class models and predictions.
ENC = f"""{LV}, {IM}, enc AS (SELECT win, lv.label, fm.pos, (sum(xor(fm.bit, vm.bit)) > count(*) // 2)::INT AS bit FROM lv JOIN fm ON lv.i = fm.f JOIN vm ON lv.level = vm.level AND vm.pos = fm.pos GROUP BY ALL)"""
MODEL = f"""{ENC}, m AS (SELECT label AS class, pos, sum(bit)::BIGINT AS acc, count(*) AS n, (sum(bit) > count(*) // 2)::INT AS bit FROM enc GROUP BY 1, 2)"""
DIST = f"""{MODEL}, dist AS (SELECT win, enc.label, class, sum(xor(enc.bit, m.bit))::INT AS dist FROM enc JOIN m USING (pos) GROUP BY ALL),
    pred AS (SELECT win, label, arg_min(class, dist * 100 + class) AS pred, min(dist) AS dist FROM dist GROUP BY 1, 2)"""


def hv_sql(bits: str, *keys: str) -> str:
    """Packed words of a bit relation, as comma-joined text."""
    k = ", ".join(keys)
    return f"SELECT {k}, string_agg(v::VARCHAR, ',' ORDER BY w) AS hv FROM (SELECT {k}, pos // 32 AS w, sum(bit::BIGINT << (pos % 32))::BIGINT AS v FROM ({bits}) GROUP BY {k}, pos // 32) GROUP BY {k}"


def shown(df: DataFrame, *keys: str) -> DataFrame:
    """Bits (keys, pos, bit) packed, and as text for comparing engines."""
    from hyperloom.functions.itemmem import packed

    return packed(df, *keys).withColumn("hv", F.array_join(F.transform("hv", lambda x: x.cast("string")), ","))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """(win, label, pos, bit) of the one-level encoding."""
    from hyperloom.operators.encode import Memories, encode

    m = Memories(spark, D, LEVELS, 64, 8)
    rows = levels(spark, sf).select("win", "label", F.col("i").alias("f"), "level")
    return encode(rows, m, "FeatxVal", ["win", "label"])


def model_of(enc: DataFrame) -> DataFrame:
    from hyperloom.operators.train import train_bundle

    return train_bundle(enc, ["label"]).withColumnRenamed("label", "class")


def distances_of(spark: SparkSession, sf: str) -> DataFrame:
    from hyperloom.functions.itemmem import packed
    from hyperloom.operators.predict import distances

    enc = encoded(spark, sf)
    return distances(packed(enc, "win", "label"), packed(model_of(enc), "class"), ["win", "label"])


#: Order rows as a label stream per customer: truth, prediction and a probability.
Y = """y AS (SELECT o_custkey % 100 AS subject, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey) - 1 AS win, (o_orderstatus = 'O')::INT AS y_true,
    (o_totalprice > 150000)::INT AS y, (1 + o_orderkey % 97) / 100.0::DOUBLE AS p FROM orders)"""


def stream_of(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("subject", F.col("o_custkey") % 100)
    place = F.row_number().over(W.partitionBy("subject").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select("subject", place.cast("long").alias("win"), (F.col("o_orderstatus") == "O").cast("int").alias("y_true"), (F.col("o_totalprice") > 150000).cast("int").alias("y"), ((1 + F.col("o_orderkey") % 97) / 100.0).alias("p"))
