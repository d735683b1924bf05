"""Substring dedup over bytes by bucket-pointer refinement.

Wanted are the bytes under any string of LENGTH bytes that starts in two places or more. Suffixes start in buckets by
their first Q bytes and are refined by the buckets of later offsets: the bucket of 2q bytes at i comes from the buckets of q
bytes at i and i + q, and so on up to LENGTH. A bucket's identifier is a hash of its content, so identifiers agree
between documents and no global renumbering is needed; updates of one step are what the next one refines.

Only few suffixes have to be compared at all. Each string of LENGTH bytes is represented by the smallest of the q-gram
buckets in it, its anchor, which follows from its content alone; neighbouring strings share anchors, one for about 170
bytes. So (1) anchors are counted by bucket, refined by a hash of the whole stretch of strings that share the anchor: equal
stretches are settled at once, and anchors whose bucket holds one stretch only are done; (2) of the rest one stretch of
each kind is refined, first in groups of STEP strings (the bytes that all of a group share, then the bytes under any of
them), and only groups that agree in the first but not in the second string by string. Counts are combined before each
shuffle, by content, so a passage in a third of all documents is no hot key; documents are joined by their own key.

Identifiers have 128 bits in all comparisons (anchor bucket and refined bucket). Defined results: null texts are empty;
texts under LENGTH bytes lose nothing; repeated rows (same key and text) are separate places, so both lose their repeated
bytes; extra columns stay, clashing ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import stored, without

LENGTH, Q, STEP = 400, 64, 16
#: Starts of strings that are handled together; longer texts are cut in such blocks (LENGTH at least), never inside a stretch.
BLOCK = 1 << 18

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))  # odd numbers with mixed bits


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(29))


def refined(ids: np.ndarray, shift: int) -> np.ndarray:
    """Identifiers of the buckets at i and i + shift, as one."""
    a, b = ids[: max(0, len(ids) - shift)], ids[shift:]
    return scrambled(a * M1 + (b ^ (b >> np.uint64(31))) * M2)


def buckets(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the strings of the given length at every place of the bytes."""
    ids, q = scrambled((data.astype(np.uint64) + np.uint64(1)) * M1), 1
    while 2 * q <= length:
        ids, q = refined(ids, q), 2 * q
    return refined(ids, length - q) if q < length else ids


def least(ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n identifiers in a row."""
    k = 1
    while 2 * k <= n:
        ids, k = np.minimum(ids[:-k], ids[k:]), 2 * k
    return np.minimum(ids[: len(ids) - (n - k)], ids[n - k :]) if k < n else ids


def stretches(text: bytes, block: int) -> tuple[np.ndarray, ...]:
    """Of each stretch of strings that share an anchor: first start, number of starts, anchor's place behind the first
    start, bucket of the anchor, hash of all its bytes."""
    from xxhash import xxh3_64_intdigest

    parts, at, end = [], 0, len(text) - LENGTH + 1
    while at < end:
        piece = text[at : at + block + LENGTH - 1]
        data = np.frombuffer(piece, dtype=np.uint8)
        ids = buckets(data, Q)
        mask = np.uint64((1 << 20) - 1)
        owner = (least((ids & ~mask) | np.arange(len(ids), dtype=np.uint64), LENGTH - Q + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        n = np.diff(np.append(first, len(owner)))
        following = at + len(owner)
        if following < end:  # the last stretch may go on: the next block starts with it
            following = at + int(first[-1])
            first, n = first[:-1], n[:-1]
        anchor = owner[first]
        hashes = np.fromiter((xxh3_64_intdigest(piece[a : a + k + LENGTH - 1], (p - a) * 1024 + k) for a, k, p in zip(first.tolist(), n.tolist(), anchor.tolist(), strict=True)), np.uint64, len(first))
        parts.append((first + at, n, anchor - first, ids[anchor], hashes))
        at = following
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def packed(first: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Starts first .. first + n - 1 of strings with an anchor ``before`` bytes behind the first, in one number."""
    return (first << 20) | (n << 10) | before


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 20, (x >> 10) & 1023, x & 1023


def each_document(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make(text bytes, packs or None)`` gives as arrays, for every document, with its identity ``doc``."""
    listed = "packs" in df.columns
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs, packs = batch.column("text"), batch.column("doc"), batch.column("packs") if listed else None
            found, size = [], 0
            for i in range(len(batch)):
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                made = make(text, np.array(packs[i].as_py(), dtype=np.int64)) if listed else make(text)
                found.append((np.full(len(made[0]), docs[i].as_py(), dtype=np.int64), *made))
                size += len(made[0])
                if size > 100_000 or i == len(batch) - 1:
                    arrays = [np.concatenate(x) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names=["doc", *fields.names])
                    found, size = [], 0

    return df.mapInArrow(run, T.StructType([T.StructField("doc", T.LongType()), *fields.fields]))


def chain(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of 64 and of 256 bytes at every place."""
    low = buckets(np.frombuffer(piece, dtype=np.uint8), Q)
    return low, refined(refined(low, 64), 128)


def in_blocks(text: bytes, packs: np.ndarray, block: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The packs in blocks of the text: the block's place and bytes, and the packs' parts, by places in the block."""
    first, n, before = unpacked(np.sort(packs))
    for k in np.unique(first // block).tolist():
        own, at = first // block == k, max(0, k * block - STEP)
        yield at, text[at : (k + 1) * block + 1024 + 2 * LENGTH], first[own] - at, n[own], before[own]


def grouped(text: bytes, packs: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """For every STEP strings of the stretches: pack, anchor bucket, bucket of what all share, bucket of all they cover
    (0: beyond the text, so of no other)."""
    out = []
    for at, piece, first, n, before in in_blocks(text, packs, block):
        low, high = chain(piece)
        shared, cover = refined(high, LENGTH - STEP + 1 - 256), refined(high, LENGTH + STEP - 1 - 256)
        anchor, lo, hi = first + before, (before - n + 1) // STEP, before // STEP
        times = hi - lo + 1
        which = np.repeat(np.arange(len(first)), times)
        g = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + lo[which]
        middle = anchor[which] - STEP * g
        a, b = np.maximum(first[which], middle - STEP + 1), np.minimum(first[which] + n[which] - 1, middle)
        left = middle - STEP + 1
        inside = (left >= 0) & (left < len(cover))
        outer = np.where(inside, cover[np.where(inside, left, 0)] if len(cover) else np.uint64(0), np.uint64(0))
        out.append((packed(a + at, b - a + 1, anchor[which] - a), low[anchor[which]], shared[middle], outer))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def single(text: bytes, packs: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """For every string of the packs: its own pack, its anchor's bucket and its bucket."""
    out = []
    for at, piece, first, n, before in in_blocks(text, packs, block):
        low, high = chain(piece)
        whole = refined(high, LENGTH - 256)
        which = np.repeat(np.arange(len(first)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = first[which] + k
        out.append((packed(start + at, np.ones_like(start), before[which] - k), low[first[which] + before[which]], whole[start]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def with_packs(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """The documents with the list of packs that rows (doc, pack) hold for them."""
    lists = rows.groupBy("doc").agg(F.collect_set("pack").alias("packs"))
    return docs.join(lists, "doc", how)


def more_than_one(rows: DataFrame, *by: str) -> DataFrame:
    return stored(rows.groupBy(*by).agg(F.count("*").alias("times")).filter("times > 1").select(*by), "repeated")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, pack) of the starts of strings that start elsewhere too, from (doc, text)."""
    block = BLOCK  # goes to the workers inside the functions
    found = stored(each_document(docs, partial(stretch_columns, block=block), "pack long, h long, e long"), "stretches")
    kinds = stored(found.groupBy("h", "e").agg(F.count("*").alias("times"), F.min(F.struct("doc", "pack")).alias("one")), "kinds")
    settled = kinds.filter("times > 1").select("h", "e")
    done = found.join(settled, ["h", "e"]).select("doc", "pack")
    mixed = more_than_one(kinds, "h")
    some = kinds.join(mixed, "h").select("one.*")
    groups = stored(each_document(with_packs(docs, some), partial(grouped, block=block), "pack long, h long, inner long, outer long"), "groups")
    inner = more_than_one(groups, "h", "inner")
    outer = more_than_one(groups.filter("outer <> 0"), "h", "outer").withColumn("whole", F.lit(True))
    met = stored(groups.join(inner, ["h", "inner"]).join(outer, ["h", "outer"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "met")
    open_ = met.filter("not whole")
    # strings of the open groups may also start in a settled one: one of each kind stands for those
    alike = met.filter("whole").groupBy("h", "inner", "outer", F.col("pack").bitwiseAND(F.lit((1 << 20) - 1))).agg(F.min(F.struct("doc", "pack")).alias("one"))
    alike = alike.join(stored(open_.select("h", "inner").distinct(), "open"), ["h", "inner"]).select("one.*")
    asked = open_.select("doc", "pack").union(alike)
    strings = stored(each_document(with_packs(docs, asked), partial(single, block=block), "pack long, h long, w long"), "strings")
    last = strings.join(more_than_one(strings, "h", "w"), ["h", "w"])
    return done.union(met.filter("whole").select("doc", "pack")).union(last.select("doc", "pack"))


def stretch_columns(text: bytes, block: int) -> tuple[np.ndarray, ...]:
    first, n, before, h, e = stretches(text, block)
    return packed(first, n, before), h, e


def left_over(text: bytes, packs: np.ndarray) -> tuple[np.ndarray, int]:
    """A mask of the bytes that stay and the number of runs that go."""
    change = np.zeros(len(text) + 1, dtype=np.int64)
    first, n, _ = unpacked(packs)
    np.add.at(change, first, 1)
    np.add.at(change, first + n + LENGTH - 1, -1)
    gone = np.cumsum(change)[:-1] > 0
    return ~gone, int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without their text, with kept (binary: the bytes that stay), n_bytes, n_removed and n_spans."""
    df = without(df, "kept", "n_bytes", "n_removed", "n_spans")
    doc = F.xxhash64(F.col(key), F.col(text))
    docs = df.select(doc.alias("doc"), F.col(text).alias("text"))
    rest = [c for c in df.columns if c != text]
    rows = with_packs(df.select(doc.alias("doc"), F.col(text).alias("text"), *[F.col(c).alias(f"r_{c}") for c in rest]), repeated_starts(docs), "left")
    kept_fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for x, p in zip(batch.column("text"), batch.column("packs"), strict=True):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                if p.is_valid:
                    stays, spans = left_over(data, np.array(p.as_py(), dtype=np.int64))
                    kept = np.frombuffer(data, dtype=np.uint8)[stays].tobytes()
                else:
                    kept, spans = data, 0
                for name, value in (("kept", kept), ("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("n_spans", spans)):
                    out[name].append(value)
            arrays = [batch.column(f"r_{c}") for c in rest] + [pa.array(out["kept"], pa.binary())] + [pa.array(out[k], pa.int64()) for k in list(out)[1:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *out])

    added = [T.StructField("kept", T.BinaryType()), *[T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")]]
    return rows.mapInArrow(run, T.StructType([*kept_fields, *added]))
