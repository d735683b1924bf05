"""SimHash near-duplicates: tiled exact comparison of fingerprints by exclusive or and bit counts.

Distinct fingerprints are dealt to buckets of equal blocks of bits: of radius + agree blocks, two fingerprints within the
radius agree in some choice of ``agree`` blocks, so every link is found in a bucket (agree grows with the number of
fingerprints, so buckets stay small). A bucket with more than TILE fingerprints is cut in tiles by bit count and a hash,
and only pairs of tiles whose bit counts differ by no more than the radius meet. In a pair of tiles numpy compares all
with all, and what leaves it is a spanning forest of the links: connectivity is whole, pairs aren't written out.

Defined results: null texts and texts without words have fingerprint 0 and link like others; rows with a null key have a
fingerprint and get the component of equal fingerprints with a key, if any; repeated rows and ties share their component;
extra columns are kept, clashing ones replaced; an empty table gives no rows. Whole texts are read, of any length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import set_apart, stored, without
from hyperloom.llm.components import components

TILE = 512
#: Fingerprints expected in a bucket, beyond which blocks are combined.
BUCKET = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The bits set in over half the hashes of the shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: A-Z and the six kinds of ASCII white space only
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else iter([b" ".join(parts)])
    n, totals = max(1, len(parts) - words + 1), np.zeros(64, dtype=np.int64)
    while len(some := np.fromiter((xxh64_intdigest(s, seed) for s in itertools.islice(shingles, 1 << 15)), dtype="<u8")):
        totals += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The frame without its text, with fp (long: the 64 bits)."""
    df = without(df, "fp")
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in batch.column(text)]
            out = batch.drop_columns([text])
            yield out.append_column("fp", pa.array(np.array(made, dtype=np.uint64).view(np.int64)))

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def masks(radius: int, agree: int) -> list[int]:
    """The bits of each choice of ``agree`` of the radius + agree blocks, as signed 64-bit numbers."""
    n = radius + agree
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    found = [sum(x) for x in itertools.combinations(blocks, agree)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that join what the links of all pairs within the radius join."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    members = np.flatnonzero(label != np.arange(len(fps)))
    return members, label[members]


def linked(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The links of a frame of whole groups, sorted by group."""
    fps, nodes = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
    starts = np.flatnonzero(pdf["first"].to_numpy())
    sizes = np.diff(np.append(starts, len(pdf)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(sizes):
        at = starts[sizes == n]
        if n <= 24:  # small groups of one size: column against column
            for i in range(n - 1):
                for j in range(i + 1, n):
                    hit = at[np.bitwise_count(fps[at + i] ^ fps[at + j]) <= radius]
                    found.append((nodes[hit + i], nodes[hit + j]))
        else:
            for s in at.tolist():
                a, b = forest(fps[s : s + n], radius)
                found.append((nodes[s + a], nodes[s + b]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return pd.DataFrame({"a": a, "b": b})


def links(nodes: DataFrame, *, radius: int = 3) -> DataFrame:
    """From distinct fingerprints (node, fp), links (a, b) that connect all within the radius."""
    n, agree = nodes.count(), 1
    while agree < 4 and n > BUCKET << (64 * agree // (radius + agree)):
        agree += 1
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks(radius, agree))])
    rows = nodes.select("node", "fp", F.bit_count("fp").alias("ones"), F.explode(tables).alias("x")).select("node", "fp", "ones", "x.*")
    counted = rows.groupBy("t", "bits", "ones").agg(F.count("*").alias("n"))
    parts = F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))))
    buckets = stored(counted.groupBy("t", "bits").agg(F.sum("n").alias("size"), parts.alias("parts")).filter("size > 1"), "buckets")
    met = rows.join(buckets, ["t", "bits"])
    own = F.col("ones") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.element_at("parts", F.col("ones"))).cast("int")
    others = F.flatten(
        F.transform(
            F.filter(F.map_keys("parts"), lambda q: F.abs(q - F.col("ones")) <= radius),
            lambda q: F.transform(F.sequence(F.lit(0), F.element_at("parts", q) - 1), lambda s: q * (1 << 20) + s),
        )
    )
    met = met.withColumn("own", F.when(F.col("size") > TILE, own).otherwise(0)).withColumn("other", F.explode(F.when(F.col("size") > TILE, others).otherwise(F.array(F.lit(0)))))
    pair = ["t", "bits", "lo", "hi"]
    met = met.select("t", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[pair].to_numpy()
            first = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
            last = int(np.flatnonzero(first)[-1])  # its group may go on
            if last:
                yield linked(pdf[:last].assign(first=first[:last]), radius)
            rest = pdf[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield linked(rest.assign(first=np.arange(len(rest)) == 0), radius)

    return met.repartition(*pair).sortWithinPartitions(*pair).mapInPandas(run, "a long, b long").distinct()


def classes(marked: DataFrame, *, radius: int = 3) -> DataFrame:
    """From rows with fp, every fingerprint (_fp) and the smallest one it reaches (_class). Each fingerprint is a node of its
    own, so rows of one key and unlike texts don't meet."""
    nodes = stored(marked.select("fp").distinct().withColumn("node", F.col("fp")), "distinct")
    joined = components(links(nodes, radius=radius))
    return nodes.join(joined, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("_class"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """The frame without its text, with fingerprint (16 hexadecimal digits) and component_id (smallest key reachable)."""
    df, names = set_apart(without(df, "fingerprint", "component_id"), key, text)
    whole = {"tinyint", "smallint", "int"}
    own = F.col(key).cast("long") if dict(df.dtypes)[key] in whole else F.col(key)
    marked = stored(fingerprints(df, text=text, words=words, seed=seed), "fingerprints")
    found = stored(classes(marked, radius=radius), "classes")
    least = marked.groupBy("fp").agg(F.min(own).alias("_least"))
    least = found.join(least, F.col("_fp") == F.col("fp")).groupBy(F.col("_class").alias("_c")).agg(F.min("_least").alias("component_id"))
    known = found.join(least, F.col("_class") == F.col("_c")).select("_fp", "component_id")
    out = marked.join(stored(known, "components"), F.col("fp") == F.col("_fp"))
    return out.select(*[marked[c] for c in marked.columns if c != "fp"], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").withColumnsRenamed(names)


def first_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """One row, in its columns, of every component: of the smallest key, null keys last, then of the smallest hash of the
    text. A row is kept for its own text, so rows that share a key or have none don't stand for each other."""
    same, (df, names) = F.xxhash64(text), set_apart(df, key, text)
    marked = stored(fingerprints(df.select(F.col(key).alias("_key"), same.alias("_same"), F.col(text).alias("_text")), text="_text", words=words, seed=seed), "fingerprints")
    place = F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), F.col("_same").alias("same"))
    best = marked.groupBy("fp").agg(F.min(place).alias("_best"))
    best = best.join(classes(marked, radius=radius), F.col("fp") == F.col("_fp")).groupBy("_class").agg(F.min("_best").alias("_best"))
    kept = stored(best.select(F.col("_best.key").alias("_key"), F.col("_best.same").alias("_same")), "first")
    rows = df.withColumn("_own", same).join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_same")), "left_semi")
    from pyspark.sql import Window as W

    # rows of one key and text are copies of each other
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(key, "_own").orderBy("_own"))).filter("_nth = 1").drop("_nth", "_own").withColumnsRenamed(names)
