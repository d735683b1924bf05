"""Encoders: levels of features become hypervectors, by binding basis vectors and taking the majority of every bit.

Two forms give the same bits. The plain one works on rows (keys, pos, bit): every encoder is joins to item memories and
grouped majorities. The fast one, :func:`encode_fast`, has one row of levels per window and counts bits in numpy with the
(feature, level) table bound once; use it for long vectors.

``levels`` has the keys (window), ch, f and level. The majority is strict, so ties of an even number give 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions.itemmem import item_memory, packed


def majority(bits: DataFrame, keys: list[str], part: int = 2) -> DataFrame:
    """Bits set in more than floor(n / part) of the rows; part 4 is the rule for AND-bound vectors."""
    counted = bits.groupBy(*keys, "pos").agg(F.sum("bit").alias("_set"), F.count("*").alias("_rows"))
    return counted.select(*keys, "pos", (F.col("_set") > F.floor(F.col("_rows") / part)).cast("int").alias("bit"))


def share(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Not rounded: the share of rows in which the bit is set."""
    return bits.groupBy(*keys, "pos").agg((F.sum("bit") / F.count("*")).alias("share"))


def named(memory: DataFrame, idx: str, bit: str) -> DataFrame:
    return memory.select(F.col("idx").alias(idx), "pos", F.col("bit").alias(bit))


def bound(rows: DataFrame, memory: DataFrame, on: str, how: str = "xor") -> DataFrame:
    """Rows with bits, bound to the basis vector of a column."""
    both = rows.join(named(memory, on, "_b"), [on, "pos"])
    bit = F.col("bit").bitwiseXOR(F.col("_b")) if how == "xor" else F.col("bit").bitwiseAND(F.col("_b"))
    return both.withColumn("bit", bit).drop("_b")


def valued(levels: DataFrame, values: DataFrame) -> DataFrame:
    """Every level row with the bits of its level's vector."""
    return levels.join(named(values, "level", "bit"), "level")


class Memories:
    """Item memories of one encoder."""

    def __init__(self, spark: SparkSession, d: int, levels: int, features: int, channels: int, how: str = "scaleNoRand"):
        self.d = d
        self.value = item_memory(spark, how, "level", levels, d)
        self.feature = item_memory(spark, "random", "feat", features, d)
        self.channel = item_memory(spark, "random", "ch", channels, d)
        self.pair = item_memory(spark, "random", "pair", features * channels, d)
        self.channels = channels


def encode(levels: DataFrame, m: Memories, how: str, keys: list[str], bind: str = "xor") -> DataFrame:
    """Rows (keys, pos, bit), with ``block`` where vectors are appended instead of joined."""
    part = 4 if bind == "and" else 2
    rows = valued(levels, m.value)
    if how == "FeatxVal":
        return majority(bound(rows, m.feature, "f", bind), keys, part)
    if how == "ChxFeatxVal":
        inner = majority(bound(rows, m.feature, "f", bind), [*keys, "ch"], part)
        return majority(bound(inner, m.channel, "ch", bind), keys, part)
    if how == "FeatxChxVal":
        inner = majority(bound(rows, m.channel, "ch", bind), [*keys, "f"], part)
        return majority(bound(inner, m.feature, "f", bind), keys, part)
    if how == "ChFeatCombxVal":
        return majority(bound(rows.withColumn("pair", F.col("f") * m.channels + F.col("ch")), m.pair, "pair", bind), keys, part)
    if how == "FeatAppend":
        return majority(bound(rows, m.channel, "ch", bind), [*keys, "f"], part).withColumnRenamed("f", "block")
    if how == "ChAppend":
        return majority(bound(rows, m.feature, "f", bind), [*keys, "ch"], part).withColumnRenamed("ch", "block")
    if how == "FeatValRot":  # the feature's vector rotated by the level
        turned = levels.join(named(m.feature, "f", "bit"), "f").withColumn("pos", F.pmod(F.col("pos") - F.col("level"), F.lit(m.d)))
        return majority(turned, keys, part)
    raise ValueError(f"unknown encoder {how}")


def encode_time(levels: DataFrame, m: Memories, shifts: list[int], how: str, keys: list[str], series: list[str], order: str = "win") -> DataFrame:
    """Encodings of lagged windows: "append" (as blocks), "sum" (majority), "perm" (the i-th rotated by i * d / (n + 1), then majority)."""
    enc = encode(levels, m, "FeatxVal", keys)
    parts = None
    for i, k in enumerate(shifts):
        own = enc.withColumn(order, F.col(order) + k).withColumn("block", F.lit(i))
        if how == "perm":
            own = own.withColumn("pos", F.pmod(F.col("pos") - i * (m.d // (len(shifts) + 1)), F.lit(m.d)))
        parts = own if parts is None else parts.unionByName(own)
    whole = levels.groupBy(*series).agg(F.max(order).alias("_last"))
    parts = parts.join(whole, series).filter((F.col(order) >= max(shifts)) & (F.col(order) <= F.col("_last"))).drop("_last")
    return parts if how == "append" else majority(parts, keys)


def encode_symbol(symbols: DataFrame, m: Memories, keys: list[str]) -> DataFrame:
    """Majority over channels of channel and symbol, with a tie vector (channel 0 and 1 bound) for an even number."""
    rows = bound(valued(symbols.withColumnRenamed("symbol", "level"), m.value), m.channel, "ch")
    n = symbols.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n % 2 = 0").drop("_n")
    zero, one = named(m.channel, "i", "a").filter("i = 0").drop("i"), named(m.channel, "i", "b").filter("i = 1").drop("i")
    tie = zero.join(one, "pos").select("pos", F.col("a").bitwiseXOR(F.col("b")).alias("bit"))
    return majority(rows.select(*keys, "pos", "bit").unionByName(n.crossJoin(tie)), keys)


def encode_raw(samples: DataFrame, m: Memories, keys: list[str], how: str = "ValxCh") -> DataFrame:
    """Raw amplitudes: samples have keys, ch, t (within the window) and level. "ValxCh", "PermValSamplxCh", "PermValSampl"."""
    rows = valued(samples, m.value)
    if how != "ValxCh":  # the sample's place in the window rotates its value
        rows = rows.withColumn("pos", F.pmod(F.col("pos") - F.col("t"), F.lit(m.d)))
    if how == "PermValSampl":
        return majority(rows, keys)
    inner = majority(rows, [*keys, "ch"])
    return majority(bound(inner, m.channel, "ch"), keys)


def encode_fast(levels: DataFrame, m: Memories, keys: list[str], features: int) -> DataFrame:
    """FeatxVal for windows given as an array ``levels`` in feature order: (keys, hv), counted in numpy.

    The table of features, levels and words is of fixed size; it goes to the tasks once.
    """
    table = m.feature.select(F.col("idx").alias("f"), "pos", F.col("bit").alias("a")).join(named(m.value, "level", "b"), "pos")
    rows = packed(table.select("f", "level", "pos", F.col("a").bitwiseXOR(F.col("b")).alias("bit")), "f", "level").collect()
    n_levels = max(r.level for r in rows) + 1
    words = np.zeros((features, n_levels, len(rows[0].hv)), dtype="<u4")
    for r in rows:
        words[r.f, r.level] = r.hv
    sent = levels.sparkSession.sparkContext.broadcast(words)
    types = dict(levels.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", hv array<bigint>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(sent.value.view(np.uint8), axis=2, bitorder="little")
        for pdf in frames:
            x = np.stack(pdf["levels"].to_numpy()) if len(pdf) else np.zeros((0, features), int)
            counts = np.zeros((len(pdf), bits.shape[2]), dtype=np.uint16)
            for f in range(features):
                counts += bits[f, x[:, f]]
            hv = np.packbits(counts > features // 2, axis=1, bitorder="little").view("<u4").astype(np.int64)
            yield pdf[keys].assign(hv=list(hv))

    return levels.select(*keys, "levels").mapInPandas(run, schema)


def bit_table(memory: DataFrame) -> np.ndarray:
    """An item memory as a matrix of bits. Its size is that of a model (vectors times bits), never of the data; more than
    MOST_BITS is refused."""
    n, d = memory.agg(F.max("idx") + 1, F.max("pos") + 1).first()
    if n * d > MOST_BITS:
        raise ValueError(f"an item memory of {n} vectors of {d} bits is too large to send to every task")
    words = np.zeros((n, -(-d // 32)), dtype="<u4")
    for r in packed(memory, "idx").collect():
        words[r.idx] = r.hv
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :d]


#: Bits of an item memory that is sent to the tasks (bytes there).
MOST_BITS = 1 << 28


def encode_packed(levels: DataFrame, m: Memories, how: str, keys: list[str], features: int) -> DataFrame:
    """The encoders of :func:`encode` for windows given as an array ``levels`` in order of channel, then feature: (keys, hv),
    with ``block`` for appended vectors. Bits are counted in numpy, a batch of windows at a time; nested majorities are
    counts of counts, so no row of bits is ever made. A level that is null or out of range fails the task."""
    channels = m.channels
    tables = {"value": bit_table(m.value), "feature": bit_table(m.feature), "channel": bit_table(m.channel)}
    if how == "ChFeatCombxVal":
        tables["pair"] = bit_table(m.pair)
    sent = levels.sparkSession.sparkContext.broadcast(tables)
    appended = how in ("FeatAppend", "ChAppend")
    types = dict(levels.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (", block int" if appended else "") + ", hv array<bigint>"

    def made(x: np.ndarray) -> list[np.ndarray]:
        """Bits of every window, for each block; x: windows, channels, features."""
        value, feature, channel = (sent.value[k] for k in ("value", "feature", "channel"))

        def over(pairs) -> np.ndarray:
            counts, n = np.zeros((len(x), value.shape[1]), dtype=np.uint16), 0
            for bits in pairs:
                counts += bits
                n += 1
            return (counts > n // 2).astype(np.uint8)

        every = [(c, f) for c in range(channels) for f in range(features)]
        if how == "FeatxVal":
            return [over(value[x[:, c, f]] ^ feature[f] for c, f in every)]
        if how == "ChFeatCombxVal":
            return [over(value[x[:, c, f]] ^ sent.value["pair"][f * channels + c] for c, f in every)]
        if how == "FeatValRot":
            d = value.shape[1]
            return [over(feature[f][(np.arange(d)[None, :] + x[:, c, f][:, None]) % d] for c, f in every)]
        by_channel = how in ("ChxFeatxVal", "ChAppend")
        if by_channel:
            inner = (over(value[x[:, c, f]] ^ feature[f] for f in range(features)) for c in range(channels))
        else:
            inner = (over(value[x[:, c, f]] ^ channel[c] for c in range(channels)) for f in range(features))
        if appended:
            return list(inner)
        outer = channel if by_channel else feature
        return [over(bits ^ outer[i] for i, bits in enumerate(inner))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), 512):  # so many windows at once
                part = pdf[a : a + 512]
                x = np.stack(part["levels"].to_numpy()).reshape(len(part), channels, features)
                if x.min() < 0 or x.max() >= len(sent.value["value"]):
                    raise ValueError("a level is out of range")
                for block, bits in enumerate(made(x)):
                    hv = np.packbits(bits, axis=1, bitorder="little").view("<u4").astype(np.int64)
                    yield part[keys].assign(**({"block": block} if appended else {}), hv=list(hv))

    return levels.select(*keys, "levels").mapInPandas(run, schema)


def encode_spectra(spectra: DataFrame, m: Memories, how: str, keys: list[str]) -> DataFrame:
    """Spectra given as (keys, ch, f: number of the frequency, level). "FreqxVal": frequency and level bound, majority over the
    frequencies of a channel, then over channels; "ChxFreqxVal": the first bound to its channel; "PermChFreqxVal": the
    channel's vector rotated by the frequency's number and bound to the level, majority over all."""
    if how == "PermChFreqxVal":
        rows = valued(spectra, m.value)
        turned = rows.join(named(m.channel, "ch", "_b").withColumn("_from", F.col("pos")).drop("pos"), "ch").filter(F.pmod(F.col("_from") - F.col("f"), F.lit(m.d)) == F.col("pos"))
        return majority(turned.withColumn("bit", F.col("bit").bitwiseXOR(F.col("_b"))), keys)
    inner = majority(bound(valued(spectra, m.value), m.feature, "f"), [*keys, "ch"])
    return majority(inner if how == "FreqxVal" else bound(inner, m.channel, "ch"), keys)


#: Bits (a byte each) that a task looks up at once.
HELD = 1 << 23


def elected(vectors: np.ndarray, sizes: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    """Bits set in more than half of the vectors of each row, which has so many of them, one behind another (none has 0);
    a row of an even number gets the tie vector too."""
    counts, n = np.add.reduceat(vectors, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32), sizes
    if tie is not None:
        even = sizes % 2 == 0
        counts, n = counts + even[:, None] * tie.astype(np.int32), sizes + even
    return (counts > (n // 2)[:, None]).astype(np.uint8)


def words(bits: np.ndarray) -> pa.ListArray:
    """Rows of bits as lists of 32-bit words."""
    v = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 32))), axis=1, bitorder="little").view("<u4").astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def parts(batch: pa.RecordBatch, column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of which HELD bits are looked up, with the lengths of their lists and the flat numbers."""
    longest = max(pc.max(pc.list_value_length(batch.column(column))).as_py() or 1, 1)
    step = max(1, HELD // (d * longest))
    for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
        lists = part.column(column)
        yield part, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def encode_tokens(rows: DataFrame, column: str, table: np.ndarray, keys: list[str], tie: np.ndarray | None = None) -> DataFrame:
    """(keys, hv): the majority of the vectors whose numbers in ``table`` (of a model's size, sent to the tasks) a row's array
    has. Bits are counted in numpy, so no row of bits is made or shuffled. Rows without a number have no vector."""
    sent, types = rows.sparkSession.sparkContext.broadcast((table, tie)), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tie = sent.value
        for batch in batches:
            for part, sizes, flat in parts(batch, column, table.shape[1]):
                at = flat.to_numpy(zero_copy_only=False)
                if at.min() < 0 or at.max() >= len(table):
                    raise ValueError("a number is out of range")
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], words(elected(table[at], sizes, tie))], names=[*keys, "hv"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", hv array<bigint>"
    return rows.filter(F.size(column) > 0).select(*keys, column).mapInArrow(run, schema)


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vectors i of a and j of b bound, as number i * len(b) + j."""
    return (a[:, None] ^ b[None]).reshape(-1, a.shape[1])


def encode_spectra_packed(spectra: DataFrame, m: Memories, hows: list[str], keys: list[str], column: str = "levels") -> DataFrame:
    """(how, keys, hv): the forms of :func:`encode_spectra` for rows with an array, by channel, of arrays of the levels of the
    frequencies, all in one pass. No channel is empty or unknown to the memories."""
    sent, types = spectra.sparkSession.sparkContext.broadcast((bit_table(m.value), bit_table(m.feature), bit_table(m.channel))), dict(spectra.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, feature, channel = sent.value
        for batch in batches:
            for part, channels, lists in parts(batch, column, 8 * value.shape[1]):
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                level = lists.flatten().to_numpy(zero_copy_only=False)
                ch = np.arange(len(sizes)) - np.repeat(np.cumsum(channels) - channels, channels)
                f = np.arange(len(level)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                if level.min() < 0 or level.max() >= len(value):
                    raise ValueError("a level is out of range")
                inner = elected(value[level] ^ feature[f], sizes) if set(hows) != {"PermChFreqxVal"} else None
                for how in hows:
                    if how == "PermChFreqxVal":
                        turned = np.stack([np.roll(channel, -k, axis=1) for k in range(f.max() + 1)])
                        bits = elected(value[level] ^ turned[f, np.repeat(ch, sizes)], np.add.reduceat(sizes, np.cumsum(channels) - channels))
                    else:
                        bits = elected(inner if how == "FreqxVal" else inner ^ channel[ch], channels)
                    yield pa.RecordBatch.from_arrays([pa.array([how] * part.num_rows), *[part.column(k) for k in keys], words(bits)], names=["how", *keys, "hv"])

    schema = ", ".join(["how string"] + [f"`{k}` {types[k]}" for k in keys]) + ", hv array<bigint>"
    return spectra.filter(F.size(column) > 0).select(*keys, column).mapInArrow(run, schema)
