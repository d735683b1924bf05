"""Selection, segments, balancing, chunks and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators.ranges import covered


def select_channels(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows of the named channels with their place; a recording that lacks one is left out."""
    own = df.filter(F.col("channel").isin(names)).withColumn("pos", F.array_position(F.array(*map(F.lit, names)), F.col("channel")).cast("int") - 1)
    whole = own.groupBy(*keys).agg(F.count_distinct("channel").alias("c")).filter(F.col("c") == len(names)).select(*keys)
    return own.join(whole, keys)


def resolve_channels(df: DataFrame, keys: list[str], a: list[str], b: list[str]) -> DataFrame:
    """(keys, vocabulary): "a" if all of its names are there, else "b", else null."""
    has = lambda names: F.size(F.array_intersect("c", F.array(*map(F.lit, names)))) == len(names)
    return df.groupBy(*keys).agg(F.collect_set("channel").alias("c")).select(*keys, F.when(has(a), "a").when(has(b), "b").alias("vocabulary"))


def derive_pairs(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """-(first - second) of every pair of channels at the same place."""
    wide = df.groupBy(*keys, "t").pivot("channel", sorted({c for p in pairs for c in p})).agg(F.first("x"))
    rows = [F.struct(F.lit(f"{a}-{b}").alias("channel"), (-(F.col(f"`{a}`") - F.col(f"`{b}`"))).alias("x")) for a, b in pairs]
    return wide.select(*keys, "t", F.explode(F.array(*rows)).alias("p")).select(*keys, "t", "p.*").filter("x is not null")


def decimate(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.col("t") % k == 0).withColumn("t", F.floor(F.col("t") / k))


def cut_segments(df: DataFrame, onsets: DataFrame, keys: list[str], segments: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows at offsets from..to (exclusive) of an onset, for every named segment."""
    parts = onsets.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in segments.items()])))
    parts = parts.select(*keys, F.col("s.segment").alias("segment"), (F.col("onset") + F.col("s.a")).alias("lo"), (F.col("onset") + F.col("s.b")).alias("hi"))
    return df.join(parts, keys).filter("t >= lo and t < hi").drop("lo", "hi")


def drop_margins(df: DataFrame, events: DataFrame, keys: list[str], before: int, after: int, after_events: bool = True) -> DataFrame:
    """Rows outside the margins around events, looked up by key and time bin. A margin ends where the neighbouring event begins."""
    w = W.partitionBy(*keys).orderBy("start")
    lo = F.greatest(F.col("start") - before, F.coalesce(F.lag("stop").over(w), F.lit(0)))
    hi = F.least(F.col("stop") + after, F.coalesce(F.lead("start").over(w), F.lit(1 << 62))) if after_events else F.col("stop")
    margins = events.select(*keys, "start", "stop", lo.alias("lo"), hi.alias("hi"))
    cut = F.array(F.struct(F.col("lo").alias("start"), F.col("start").alias("stop")), F.struct(F.col("stop").alias("start"), F.col("hi").alias("stop")))
    margins = margins.select(*keys, F.explode(cut).alias("m")).select(*keys, "m.*")
    return covered(df, margins, keys, "left_anti")


def drop_first(df: DataFrame, n: int = 1) -> DataFrame:
    return df.filter(F.col("t") >= n)


def label_by_interval(df: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """label 1 for rows with start <= t < stop of an interval."""
    rows = df.drop("label")
    hit = covered(rows, intervals, keys, "left_semi").withColumn("label", F.lit(1))
    return hit.unionByName(covered(rows, intervals, keys, "left_anti").withColumn("label", F.lit(0)))


def numbered(df: DataFrame, order: list[str], to: str, blocks: int = 256) -> DataFrame:
    """Adds the place of every row, from 0, in an order that tells rows apart. Rows are numbered within blocks between bounds
    drawn from them, of which there are at most so many, and blocks by their counts; any bounds give the same numbers."""
    place = F.struct(*order)
    drawn = df.select(place.alias("p")).withColumn("r", F.rand(7)).orderBy("r").limit(blocks - 1).select(F.array_sort(F.collect_list("p")).alias("_bounds"))
    bounds = df.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # as values, so that every use has the same
    rows = df.join(F.broadcast(bounds), how="cross").withColumn("_block", F.size(F.filter("_bounds", lambda x: x < place))).drop("_bounds")
    counts = rows.groupBy("_block").agg(F.count("*").alias("n"))
    before = counts.select("_block", (F.sum("n").over(W.orderBy("_block")) - F.col("n")).alias("_before"))  # a row for each block
    rows = rows.withColumn(to, F.row_number().over(W.partitionBy("_block").orderBy(*order)) - 1)
    return rows.join(F.broadcast(before), "_block").withColumn(to, F.col(to) + F.col("_before")).drop("_block", "_before")


def balance(events: DataFrame, background: DataFrame, factor: int, seed: int = 42) -> DataFrame:
    """For every event (recording, start, stop) a stretch of a background recording (recording, n), factor times as long:
    recordings in turn, offsets by a hash. Half of it goes before the event, half behind (before_n, after_n)."""
    e = numbered(events, ["recording", "start"], "k").withColumn("need", factor * (F.col("stop") - F.col("start")))
    b = numbered(background, ["recording"], "j").select(F.col("recording").alias("background_recording"), "n", "j")
    n = F.broadcast(b.agg(F.count("*").alias("m")))
    met = e.crossJoin(n).join(b, F.col("k") % F.col("m") == F.col("j")).filter("n >= need")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("recording").cast("string"), F.col("start").cast("string"))), 1, 8), 16, 10).cast("long")
    half = F.floor(F.col("need") / 2)
    return met.select(F.col("recording").alias("event_recording"), "start", "stop", "background_recording", (place % (F.col("n") - F.col("need") + 1)).alias("offset"), half.alias("before_n"), (F.col("need") - half).alias("after_n"))


def balance_same(events: DataFrame, lengths: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """The stretch around each event, factor * length / 2 to either side, within the recording."""
    half = F.floor(factor * (F.col("stop") - F.col("start")) / 2)
    return events.join(lengths, keys).select(*keys, "start", "stop", F.greatest(F.col("start") - half, F.lit(0)).alias("lo"), F.least(F.col("stop") + half, F.col("n")).alias("hi"))


def recompose(before: DataFrame, event: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    parts = [p.withColumn("part", F.lit(i)) for i, p in enumerate((before, event, after))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("win", F.row_number().over(W.partitionBy(*keys).orderBy("part", "t")) - 1)


def rechunk_fixed(df: DataFrame, events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Chunks of n rows; a cut that would split an event moves to its end, and the next chunk starts there. The cuts follow
    one another, so they are made per key from the events alone, and rows join to them."""
    total = df.groupBy(*keys).agg(F.max("t").alias("last"))
    types = dict(df.dtypes)
    todo = total.join(events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("events")), keys, "left")

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                marks = [(e["start"], e["stop"]) for e in (row["events"] if row["events"] is not None else [])]
                a, chunk = 0, 0
                while a <= row["last"]:
                    b = a + n
                    for s, e in marks:
                        if s < b < e:
                            b = e
                    out.append((*[row[k] for k in keys], chunk, a, b))
                    a, chunk = b, chunk + 1
            yield pd.DataFrame(out, columns=[*keys, "chunk", "lo", "hi"])

    cuts = todo.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", chunk long, lo long, hi long")
    return df.join(cuts, keys).filter("t >= lo and t < hi").drop("lo", "hi")


def first_chunk_with_event(df: DataFrame, keys: list[str], h: int) -> DataFrame:
    """Leading chunks merge into chunk 0 until there are h of them and an event among them; the rest are numbered on."""
    per = df.groupBy(*keys, "chunk").agg(F.max("label").alias("has"))
    w = W.partitionBy(*keys).orderBy("chunk")
    ok = per.withColumns({"nth": F.row_number().over(w), "seen": F.max("has").over(w)}).filter((F.col("nth") >= h) & (F.col("seen") == 1)).groupBy(*keys).agg(F.min("chunk").alias("_first"))
    return df.join(ok, keys, "left").withColumn("chunk", F.when(F.col("chunk") <= F.coalesce("_first", F.lit(-1)), 0).otherwise(F.col("chunk") - F.coalesce("_first", F.lit(0)))).drop("_first")


def rechunk_event_to_event(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk = number of events that ended before the row."""
    w = W.partitionBy(*keys).orderBy("t")
    ends = F.when((F.col("label") == 1) & (F.coalesce(F.lead("label").over(w), F.lit(1)) == 0), 1).otherwise(0)
    return df.withColumn("_end", ends).withColumn("chunk", F.coalesce(F.sum("_end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_end")


def recordings(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "recording").distinct().withColumn("idx", F.row_number().over(W.partitionBy(*keys).orderBy("recording")) - 1)


def folds_loo(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recording, fold, role): every recording is the test of one fold and trains in the others."""
    r = recordings(df, keys)
    f = r.select(*keys, F.col("idx").alias("fold"))
    return r.join(f, keys).select(*keys, "recording", "fold", F.when(F.col("idx") == F.col("fold"), "test").otherwise("train").alias("role"))


def folds_rolling(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fold k trains on recordings up to k and tests on k + 1."""
    r = recordings(df, keys)
    f = r.select(*keys, F.col("idx").alias("fold"))
    met = r.join(f, keys).filter("idx <= fold + 1")
    last = r.groupBy(*keys).agg(F.max("idx").alias("last"))
    return met.join(last, keys).filter("fold < last").select(*keys, "recording", "fold", F.when(F.col("idx") <= F.col("fold"), "train").otherwise("test").alias("role"))


def folds_groups(df: DataFrame, n: int, subject: str = "subject") -> DataFrame:
    """Fixed groups of subjects, here by number modulo n; group = the fold in which a subject is tested."""
    s = df.select(subject).distinct().withColumn("group", F.pmod(F.col(subject), F.lit(n)).cast("int"))
    return s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(subject, "fold", F.when(F.col("group") == F.col("fold"), "test").otherwise("train").alias("role"))
