"""Line simplification of long series: a series lies in chunks, and the point farthest from a chord is found chunk by chunk, from
the convex hull where the chord spans all of a chunk, so no task holds a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a chunk, and samples that a task has as arrays at once.
CHUNK, HELD = 1 << 16, 1 << 18


def slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with HELD samples or a row more, from the samples of each row."""
    part = (np.cumsum(sizes) - sizes) // HELD
    ends = [*np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip([0, *ends], ends):
        if b > a:
            yield batch.slice(a, b - a)


def arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The arrays of a column, as parts of one."""
    lists = batch.column(name)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def repeated(batch: pa.RecordBatch, names: list[str], found: list[np.ndarray]) -> list[pa.Array]:
    at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
    return [batch.column(n).take(at) for n in names]


def hull(x: np.ndarray) -> np.ndarray:
    """Places of the points that can be farthest from a chord, in order: those of the upper and the lower hull, with the points
    that lie on their edges, as far as rounding can tell."""
    kept: set[int] = set()
    for sign in (1.0, -1.0):
        line, v = [], sign * x
        slack = 1e-9 * (np.abs(x).max(initial=0.0) + 1)
        for i in range(len(v)):
            while len(line) > 1:
                a, b = line[-2], line[-1]
                if v[b] < v[a] + (v[i] - v[a]) * (b - a) / (i - a) - slack:
                    line.pop()
                else:
                    break
            line.append(i)
        kept.update(line)
    return np.array(sorted(kept), dtype=np.int64)


def farthest(t: np.ndarray, x: np.ndarray, a: int, b: int, xa: float, xb: float) -> tuple[float, int, float]:
    """(distance, place, value) of the first of the points that are farthest, up or down, from the chord."""
    off = np.abs(x - np.interp(t, [a, b], [xa, xb]))
    k = int(off.argmax())
    return float(off[k]), int(t[k]), float(x[k])


def split(x: np.ndarray, first: int, a: int, b: int, eps: float) -> list[int]:
    """The places between a and b that simplification of their samples keeps; x starts at place first."""
    kept, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if b - a >= 2:
            off, k, _ = farthest(np.arange(a, b + 1), x[a - first : b + 1 - first], a, b, x[a - first], x[b - first])
            if off > eps:
                kept.append(k)
                todo += [(a, k), (k, b)]
    return kept


def chunked(df: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, chunk, xs, hull_t, hull_x) from (keys, t, x), t from 0 without gaps."""
    rows = df.groupBy(*keys, F.floor(F.col("t") / chunk).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"].cast("double")).alias("xs"))
    types = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hulls = [hull(np.asarray(x, dtype=float)) for x in pdf["xs"]]
            ts = [h + c * chunk for h, c in zip(hulls, pdf["chunk"])]
            yield pdf.assign(hull_t=ts, hull_x=[np.asarray(x, dtype=float)[h] for h, x in zip(hulls, pdf["xs"])])

    return rows.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in rows.columns) + ", hull_t array<long>, hull_x array<double>")


def kept_points(chunks: DataFrame, keys: list[str], eps: list[float], keep, chunk: int) -> DataFrame:
    """(keys, eps, t, x) of the points that stay, from stored chunks.

    A round takes all chords that cross a border of chunks: for the chunks that a chord spans, hulls answer, for those at its
    ends, samples. There are no more such chords than borders, and what the first rounds leave lies within chunks, each of which
    a task finishes by itself.
    """
    types = dict(chunks.dtypes)
    chord = [*keys, "eps", "a", "b", "xa", "xb"]
    ends = chunks.groupBy(*keys).agg(F.min_by(F.get("xs", F.lit(0)), "chunk").alias("xa"), F.max_by(F.element_at("xs", -1), "chunk").alias("xb"), (F.sum(F.size("xs")) - 1).alias("b"))
    chords = ends.select(*keys, F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps"), F.lit(0).cast("long").alias("a"), "b", "xa", "xb")
    chords = keep(chords)
    points = [chords.select(*keys, "eps", F.col("a").alias("t"), F.col("xa").alias("x")), chords.select(*keys, "eps", F.col("b").alias("t"), F.col("xb").alias("x"))]
    at = lambda c: F.floor(F.col(c) / chunk)
    inside, found = [], "off double, t long, x double"

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [farthest(np.asarray(t), np.asarray(x), a, b, xa, xb) for t, x, a, b, xa, xb in zip(pdf["ts"], pdf["xs"], pdf["a"], pdf["b"], pdf["xa"], pdf["xb"])]
            yield pd.concat([pdf[chord].reset_index(drop=True), pd.DataFrame(out, columns=["off", "t", "x"])], axis=1)

    while True:
        inside.append(chords.filter((at("a") == at("b")) & (F.col("b") - F.col("a") >= 2)))
        wide = chords.filter(at("a") < at("b"))
        if wide.isEmpty():
            break
        asked = wide.withColumn("chunk", F.explode(F.sequence(at("a"), at("b"))))
        spans = (F.col("a") <= F.col("chunk") * chunk) & (F.col("b") >= (F.col("chunk") + 1) * chunk - 1)
        low, high = F.greatest("a", F.col("chunk") * chunk), F.least("b", (F.col("chunk") + 1) * chunk - 1)
        part = F.slice("xs", (low - F.col("chunk") * chunk + 1).cast("int"), (high - low + 1).cast("int"))
        whole = asked.filter(spans).join(chunks.select(*keys, "chunk", F.col("hull_t").alias("ts"), F.col("hull_x").alias("xs")), [*keys, "chunk"]).select(*chord, "ts", "xs")
        partly = asked.filter(~spans).join(chunks.select(*keys, "chunk", "xs"), [*keys, "chunk"]).select(*chord, F.sequence(low, high).alias("ts"), part.alias("xs"))
        schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", eps double, a long, b long, xa double, xb double, " + found
        said = whole.unionByName(partly).mapInPandas(answers, schema)
        best = said.groupBy(*chord).agg(F.max(F.struct("off", (-F.col("t")).alias("first"), "x")).alias("m"))
        cut = keep(best.filter(F.col("m.off") > F.col("eps")).select(*chord, (-F.col("m.first")).alias("t"), F.col("m.x").alias("x")))
        points.append(cut.select(*keys, "eps", "t", "x"))
        left = cut.select(*keys, "eps", "a", F.col("t").alias("b"), "xa", F.col("x").alias("xb"))
        chords = keep(left.unionByName(cut.select(*keys, "eps", F.col("t").alias("a"), "b", F.col("x").alias("xa"), "xb")))
    rest = inside[0]
    for x in inside[1:]:
        rest = rest.unionByName(x)
    held = rest.groupBy(*keys, at("a").alias("chunk")).agg(F.collect_list(F.struct("eps", "a", "b")).alias("chords"))
    held = held.select(*keys, "chunk", *[F.col(f"chords.{c}").alias(f"chord_{c}") for c in ("eps", "a", "b")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("xs").value_lengths().to_numpy(zero_copy_only=False)):
                ts, es, vs = [], [], []
                for c, x, *own in zip(part.column("chunk").to_pylist(), *(arrays(part, n) for n in ("xs", "chord_eps", "chord_a", "chord_b"))):
                    found = [np.array(split(x, c * chunk, int(a), int(b), e), dtype=np.int64) for e, a, b in zip(*own)]
                    t = np.concatenate(found)
                    ts.append(t)
                    es.append(np.repeat(own[0], [len(f) for f in found]))
                    vs.append(x[t - c * chunk])
                yield pa.RecordBatch.from_arrays([*repeated(part, keys, ts), *(pa.array(np.concatenate(v)) for v in (es, ts, vs))], names=[*keys, "eps", "t", "x"])

    done = held.join(chunks.select(*keys, "chunk", "xs"), [*keys, "chunk"]).mapInArrow(finish, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", eps double, t long, x double")
    for p in points:
        done = done.unionByName(p)
    return done.distinct()


def simplified_series(df: DataFrame, keys: list[str], eps: list[float], keep, chunk: int = CHUNK) -> DataFrame:
    """(keys, eps, t, x): the series (keys, t, x) between the points that vertical-distance simplification keeps, interpolated
    back, for every eps. ``keep`` stores a frame and reads it back."""
    chunks = keep(chunked(df, keys, chunk))
    points = keep(kept_points(chunks, keys, eps, keep, chunk))
    w = W.partitionBy(*keys, "eps").orderBy("t")
    lines = points.select(*keys, "eps", "t", "x", F.lead("t").over(w).alias("u"), F.lead("x").over(w).alias("z")).withColumn("u", F.coalesce("u", "t"))
    lines = lines.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("t") / chunk), F.floor(F.col("u") / chunk))))
    ends = F.array(F.struct("t", "x"), F.struct(F.col("u").alias("t"), F.col("z").alias("x")))  # the last point has no line behind it
    held = lines.groupBy(*keys, "chunk", "eps").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(ends, lambda p: p["x"].isNotNull()))))).alias("points"))
    held = held.select(*keys, "chunk", "eps", *[F.col(f"points.{c}").alias(f"point_{c}") for c in ("t", "x")])
    types = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("n").to_numpy(zero_copy_only=False)):
                firsts, sizes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "n"))
                ts = [np.arange(c * chunk, c * chunk + n) for c, n in zip(firsts, sizes)]
                xs = [np.interp(t, at, x) for t, at, x in zip(ts, arrays(part, "point_t"), arrays(part, "point_x"))]
                yield pa.RecordBatch.from_arrays([*repeated(part, [*keys, "eps"], ts), pa.array(np.concatenate(ts)), pa.array(np.concatenate(xs))], names=[*keys, "eps", "t", "x"])

    met = held.join(chunks.select(*keys, "chunk", F.size("xs").alias("n")), [*keys, "chunk"])
    return met.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", eps double, t long, x double")
