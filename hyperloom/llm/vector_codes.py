"""Vector code compression: each vector as one codebook index per part, the nearest entries found by slice-and-intersect
bitmasks.

For every dimension of a codebook the entries' coordinates lie in order, each place with a mask (uint64 words, a bit for each
entry) of the entries up to it. A query's initial radius is its distance from the best of a few entries, those that are
nearest in one coordinate; the entries within the radius in a dimension are two masks exclusive-ored, the masks of all
dimensions are ANDed, and what is left holds the nearest entry and all that tie with it, so the radius need never grow. A
quarter of it is tried first: an entry found there makes the radius smaller before all of it is looked at.

A round of training is one pass over the vectors, whose tasks send a sum and a count for each entry and coordinate. The driver
sees the codebooks and their sums only, of PARTS * ENTRIES * width numbers, whatever the table's size. Vectors are stored once
as 32-bit integers.

Defined results: components become floor(scale * x) as double, beyond 2^27 either way 2^27; null vectors and vectors holding
null or non-finite components take no part, neither do vectors of another length than the most frequent one (the longest, if
tied); a length that doesn't divide by PARTS is filled up with zeros, which change no distance. The first codebooks are of
the smallest ids (null last, equal ids by their vectors); with fewer vectors than ENTRIES there are as many entries as
vectors. Repeated rows count and get a code each; an empty table gives no rows. Other columns aren't carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components beyond are cut off: distances and their sums stay within 64 bits.
MOST = 1 << 27
#: Numbers that a search holds at once, and the part of the radius that is tried first.
HELD, PROBE = 1 << 22, 4


class Book:
    """The entries of one part's codebook, with masks of entries in order of each coordinate."""

    def __init__(self, entries: np.ndarray):
        n, width = entries.shape
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.coordinates = np.take_along_axis(entries.T, self.order, axis=1)
        bits = np.zeros((n, -(-n // 64)), dtype=np.uint64)
        e = np.arange(n)
        bits[e, e // 64] = np.uint64(1) << (e % 64).astype(np.uint64)
        self.prefix = np.zeros((width, n + 1, bits.shape[1]), dtype=np.uint64)
        if width:
            self.prefix[:, 1:] = np.bitwise_or.accumulate(bits[self.order], axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """No less than the distance from the nearest entry: that from the best of the entries nearest in one coordinate."""
        n, best = len(self.entries), np.full(len(x), np.iinfo(np.int64).max)
        for d, (order, line) in enumerate(zip(self.order, self.coordinates)):
            right = np.minimum(np.searchsorted(line, x[:, d]), n - 1)
            left = np.maximum(right - 1, 0)
            near = order[np.where(np.abs(line[left] - x[:, d]) < np.abs(line[right] - x[:, d]), left, right)]
            best = np.minimum(best, ((x - self.entries[near]) ** 2).sum(axis=1))
        return rounded_up(best)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that lie within the radius of each row in every coordinate."""
        left = np.full((len(x), self.prefix.shape[2]), np.iinfo(np.uint64).max, dtype=np.uint64)
        for d, line in enumerate(self.coordinates):
            high = np.searchsorted(line, x[:, d] + radius, side="right")
            low = np.searchsorted(line, x[:, d] - radius, side="left")
            left &= self.prefix[d, high] ^ self.prefix[d, low]
        return left

    def compared(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, squared distance) of the candidates, by row and entry."""
        masks = np.ascontiguousarray(self.candidates(x, radius).astype("<u8"))
        row, entry = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, count=len(self.entries), bitorder="little"))
        return row, entry, ((x[row] - self.entries[entry]) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower one if tied, and its squared distance."""
        n, width = self.entries.shape
        if not width:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        step, found, distances = max(1, HELD // (n * width)), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for own in (x[i : i + step] for i in range(0, len(x), step)):
            radius, best = self.radius(own), np.full(len(own), np.iinfo(np.int64).max)
            row, _, d = self.compared(own, radius // PROBE)  # a near entry, if there is one, makes the radius smaller
            np.minimum.at(best, row, d)
            radius = np.minimum(radius, rounded_up(best))
            row, entry, d = self.compared(own, radius)
            least = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(own))))
            at = np.nonzero(d == least[row])[0]
            found.append(entry[at[np.searchsorted(row[at], np.arange(len(own)))]])
            distances.append(least)
        return np.concatenate(found), np.concatenate(distances)


def rounded_up(squares: np.ndarray) -> np.ndarray:
    """No less than the roots."""
    return np.ceil(np.sqrt(squares.astype(float))).astype(np.int64) + 1


def parts_of(column: pa.Array | pa.ChunkedArray, parts: int, width: int) -> np.ndarray:
    """Stored vectors as (part, row, position)."""
    rows = np.frombuffer(b"".join(x.as_py() for x in column), dtype="<i4").astype(np.int64)
    return rows.reshape(len(column), parts, width).transpose(1, 0, 2)


def whole_vectors(df: DataFrame, key: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(key, label, v) of the vectors that take part, v as 32-bit integers in bytes; the width of a part."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    width = -(-size // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, size)
            whole = np.zeros((batch.num_rows, parts * width), dtype="<i4")
            whole[:, :size] = np.clip(np.floor(scale * x), -MOST, MOST)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([r.tobytes() for r in whole], pa.binary())], names=["key", "label", "v"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("v", T.BinaryType())])
    return stored(rows.filter(F.size("v") == size).mapInArrow(run, schema), "vectors"), width


def trained(rows: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as (part, entry, position)."""
    first = rows.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).toArrow()
    books = parts_of(first.column("v"), parts, width).copy()
    sums = "part int, entry int, position int, total long"
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            held, searched = np.zeros((*own.shape[:2], width + 1), dtype=np.int64), [Book(x) for x in own]
            for batch in batches:
                for part, x in enumerate(parts_of(batch.column("v"), parts, width)):
                    entry, _ = searched[part].nearest(x)
                    order = np.argsort(entry, kind="stable")
                    used, start, n = np.unique(entry[order], return_index=True, return_counts=True)
                    if width and len(used):
                        held[part, used, :width] += np.add.reduceat(x[order], start, axis=0)
                    held[part, used, width] += n
            at = np.argwhere(held[:, :, width] > 0)
            part, entry = np.repeat(at, width + 1, axis=0).T
            arrays = [part.astype(np.int32), entry.astype(np.int32), np.tile(np.arange(width + 1, dtype=np.int32), len(at)), held[at[:, 0], at[:, 1]].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "position", "total"])

        all_sums = rows.select("v").mapInArrow(run, sums).groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toPandas()
        table = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
        table[all_sums["part"], all_sums["entry"], all_sums["position"]] = all_sums["total"]
        n = table[:, :, width:]
        books = np.where(n > 0, table[:, :, :width] // np.maximum(n, 1), books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, label, code, error) of stored vectors."""
    sent, (parts, _, width) = rows.sparkSession.sparkContext.broadcast(books), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Book(x) for x in sent.value]
        for batch in batches:
            found = [book.nearest(x) for book, x in zip(searched, parts_of(batch.column("v"), parts, width))]
            codes, errors = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
            texts = ["".join(f"{i:02x}" for i in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=["key", "label", "code", "error"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema)


def compress(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each vector that takes part its key, label, code, error (squared distance from what the code stands for),
    label_error (the sum of errors over its label) and codebooks_sha256."""
    rows, width = whole_vectors(df, key, vector, label, scale, parts)
    books = trained(rows, width, parts=parts, entries=entries, rounds=rounds)
    codes = stored(encoded(rows, books), "codes")
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    c, s = codes.alias("c"), sums.alias("s")
    seal = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    met = c.join(s, F.col("c.label").eqNullSafe(F.col("s.label")))
    return met.select(F.col("c.key").alias(key), F.col("c.label").alias(label), "code", "error", "label_error", F.lit(seal).alias("codebooks_sha256"))
