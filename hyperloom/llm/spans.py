"""Substring dedup by sliding spans of sentences.

A text is cut into sentences; from every sentence on, and up to every sentence, the shortest run of at least SENTENCES
sentences and WORDS words is hashed. The first place of every hash (smallest key, then place) is found by a combined aggregate over all documents, and
the sentences under any run that is not the first of its hash are removed. Runs that occur once never leave the aggregate.
Hashes have 128 bits and aren't compared by content: of n different runs about n^2 / 2^129 pairs share one.

A sentence ends at a full stop, exclamation or question mark before white space, or at a line end; one of more than LONG
words is cut where its content says: after a word whose hash, with the next word, is the smallest among LONG / 2 on either
side, so that a passage is cut alike wherever it stands (where words only repeat there is no such place; such a stretch is
cut every LONG words). A text of one sentence and WORDS words is one run. Runs are compared in lower case
with white space made even. Defined results: null texts stay null, texts without a run stay as they are; what is left of a
text keeps its own white space, an emptied text is the empty string; repeated rows of one key and text count as one
document; rows with a null key are compared among themselves last; extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import set_apart, stored, without
from hyperloom.llm.suffix import least

SENTENCES, WORDS, LONG = 2, 20, 30


def cuts(words: list[str]) -> list[int]:
    """The places in a long list of words behind which it is cut, ascending."""
    near = LONG // 2
    hashes = np.fromiter((crc32(f"{a} {b}".lower().encode()) for a, b in zip(words, words[1:])), np.uint64, len(words) - 1)
    # smallest of its neighbours, and the first of equal ones, by their places
    placed = (hashes << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.concatenate([np.full(near, ~np.uint64(0)), placed, np.full(near, ~np.uint64(0))])
    found = [0, *(np.flatnonzero(least(padded, 2 * near + 1) == placed) + 1).tolist(), len(words)]
    out = []
    for a, b in zip(found, found[1:]):
        out += [*range(a + LONG, b - LONG, LONG), b] if b - a > 4 * LONG else [b]
    return [x for x in out if x]


def sentences(text: str) -> list[str]:
    """The text in pieces that join to it."""
    pieces = re.split(r"(?<=[.!?])(?=\s)(?!\s*\n)|(?<=\n)", text)
    out = []
    for piece in pieces:
        if not piece:
            continue
        if len(piece) < 2 * LONG or len(plain := piece.split()) <= LONG:
            out.append(piece)
        else:
            words = re.findall(r"\s*\S+", piece)
            places = cuts(plain)
            cut = ["".join(words[a:b]) for a, b in zip([0, *places], places)]
            cut[-1] += piece[sum(map(len, words)) :]
            out += cut
    return out


def runs(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The sentences, and for each run its first sentence, the one behind its last, and its hash, two numbers of 64 bits."""
    from xxhash import xxh3_128_digest

    pieces = sentences(text)
    plain = [x.split() for x in pieces]
    filled = [i for i, x in enumerate(plain) if x]
    sizes = np.cumsum([0, *(len(plain[i]) for i in filled)])
    n = len(filled)
    starts = np.arange(n)
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + WORDS), starts + SENTENCES)
    backward = np.minimum(np.searchsorted(sizes, sizes[1:] - WORDS, side="right") - 1, starts + 1 - SENTENCES)
    pairs = np.concatenate([np.stack([starts, ends], 1)[ends <= n], np.stack([backward, starts + 1], 1)[backward >= 0]])
    if n and n < SENTENCES and sizes[-1] >= WORDS:
        pairs = np.array([[0, n]])
    starts, ends = np.unique(pairs, axis=0).T
    keys = [" ".join(plain[i]).lower().encode() for i in filled]
    hashes = np.frombuffer(b"".join(xxh3_128_digest(b"\n".join(keys[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype="<i8").reshape(-1, 2)
    place = np.array([*filled, len(pieces)], dtype=np.int64)
    return pieces, place[starts], place[ends - 1] + 1 if len(ends) else ends, hashes


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same: hash of the text, at: first sentence and the one behind the last in one number, g, h: the hash) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ats, hs, n = batch.column("text"), [], [], []
            for x in texts:
                _, start, end, h = runs(x.as_py() or "")
                ats.append(start << 32 | end)
                hs.append(h)
                n.append(len(h))
            take = pa.array(np.repeat(np.arange(len(texts)), n))
            at = np.concatenate(ats).astype(np.int64) if ats else np.empty(0, np.int64)
            h = np.concatenate(hs) if hs else np.empty((0, 2), np.int64)
            out = batch.drop_columns(["text"]).take(take).append_column("at", pa.array(at, pa.int64()))
            yield out.append_column("g", pa.array(h[:, 0], pa.int64())).append_column("h", pa.array(h[:, 1], pa.int64()))

    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], *[T.StructField(c, T.LongType()) for c in ("at", "g", "h")]])
    return rows.mapInArrow(run, schema)


def repeated(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, same, at) of the runs that are not the first of their hash."""
    every = stored(hashed(df, key, text), "runs")
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "same", "at")
    first = every.groupBy("g", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("g", "h", "first")
    met = every.join(stored(first, "first-runs"), ["g", "h"]).filter(place != F.col("first"))
    return met.select("key", "same", "at")


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their text less the sentences under repeated runs; adds n_sentences, n_removed and removed (their
    numbers from 0)."""
    df, names = set_apart(without(df, "n_sentences", "n_removed", "removed"), key, text)
    places = repeated(df, key=key, text=text).groupBy(F.col("key").alias("_key"), F.col("same").alias("_same")).agg(F.sort_array(F.collect_set("at")).alias("_at"))
    rows = df.withColumns({"_k": F.col(key), "_s": F.xxhash64(text)})
    met = rows.join(places, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_same")), "left").select(*df.columns, "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for x, at in zip(batch.column(text).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                pieces = sentences(x or "")
                drop = np.zeros(len(pieces), dtype=bool)
                for a in at or ():
                    drop[a >> 32 : a & 0xFFFFFFFF] = True
                texts.append("".join(p for p, d in zip(pieces, drop, strict=True) if not d) if drop.any() else x)
                totals.append(len(pieces))
                gone.append(np.flatnonzero(drop).tolist())
            out = batch.drop_columns(["_at"])
            out = out.set_column(out.schema.get_field_index(text), text, pa.array(texts, pa.string()))
            out = out.append_column("n_sentences", pa.array(totals, pa.int64())).append_column("n_removed", pa.array([len(g) for g in gone], pa.int64()))
            yield out.append_column("removed", pa.array(gone, pa.list_(pa.int32())))

    added = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))]
    return met.mapInArrow(run, T.StructType([*df.schema.fields, *added])).withColumnsRenamed(names)
