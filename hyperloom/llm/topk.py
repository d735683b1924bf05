"""Exact top-k by integer inner product: KD-trees per shard with best-first traversal.

Vectors are dealt to shards by median splits of a bounded sample, so a shard holds neighbours; a leaf of the splits with more
than SHARD vectors (equal ones, say) is dealt on by a hash of their ids. In a task a shard's vectors are split at medians of
their widest dimension into leaves with tight bounding boxes, and every query walks its tree best box first: the bound of a
box is the largest inner product with any point in it, and a box whose bound is under the query's kth score (so far, or
carried over from a first round against its own shard) ends the walk. After the first round a query goes only to shards
whose box reaches its kth score, and a shard only to the blocks of queries that ask for it. All vectors within the last box
are compared, so the result is exact whatever the sample was. A query's scores from the shards are merged by rank.

Defined results: components become floor(scale * x) as double; null vectors and vectors holding null or non-finite
components take no part, neither do vectors of another length than the most frequent one (the longest, if tied); ties go to
the smaller id; a repeated id counts as often as it occurs, apart from a query's own; rows with a null id are left out;
fewer than k candidates give fewer rows; an empty table gives none. Extra columns aren't carried.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.llm.common import stored

#: Vectors in a shard, queries in a block, vectors in a leaf, boxes that a block of queries is compared with at once.
SHARD, BLOCK, LEAF, BOXES = 8192, 2048, 64, 1024
#: Vectors drawn for the splits, at most about so many, and the least of them in a leaf of the splits.
SAMPLE, DRAWN = 1 << 16, 8


class Tree:
    """Median splits down to leaves; each node has the bounding box of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own, node = points[order[a:b]], len(self.low)
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append(None)
            self.rows.append((a, b))
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > leaf and (high > low).any():
                axis, half = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                self.children[node] = (-1, -1)
                todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best, best first; those under ``least`` may be left out."""
        positive, negative = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.high @ positive + self.low @ negative
        heap, scores, ids = [(-bounds[0], 0)], np.empty(0), np.empty(0, dtype=np.int64)
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for x in self.children[node]:
                    if bounds[x] >= least:
                        heapq.heappush(heap, (-bounds[x], x))
                continue
            a, b = self.rows[node]
            new = self.points[a:b] @ query
            good = (new >= least) & (self.ids[a:b] != own)
            scores, ids = np.append(scores, new[good]), np.append(ids, self.ids[a:b][good])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                least = max(least, scores[-1])
        return scores, ids


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v array of double) of the rows that take part."""
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n"))["n"].alias("usual"))
    return rows.crossJoin(F.broadcast(usual)).filter(F.size("v") == F.col("usual")).select("id", "v")  # one row


def search_shards(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each query in each group of shard and block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["ask"].to_numpy()
        held, queries = pdf[~asks], pdf[asks]
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(held) and len(queries):
            tree = Tree(np.stack(held["v"].to_numpy()).astype(np.float64), held["id"].to_numpy())
            for q, v, least in zip(queries["id"].to_numpy(), queries["v"], queries["least"].to_numpy(), strict=True):
                scores, ids = tree.search(np.asarray(v, dtype=np.float64), q, k, -np.inf if np.isnan(least) else least)
                out["query_id"].append(np.full(len(ids), q))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        return pd.DataFrame({"query_id": join(out["query_id"], np.int64), "vec_id": join(out["vec_id"], np.int64), "score": join(out["score"], np.int64)})

    return pairs.groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score long")


def splits(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, node under the cut, other node) of median splits of the widest dimensions; a leaf has no axis (-1)."""
    nodes, todo = [(-1, 0.0, 0, 0)], [(0, np.arange(len(points)))]
    while todo and 2 * leaves > len(nodes) + 1:
        at, own = todo.pop(0)  # the largest parts come first
        if len(own) < 2 * DRAWN:
            continue
        part = points[own]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        cut = float(np.median(part[:, axis]))
        under = part[:, axis] < cut
        if not under.any():
            continue
        nodes[at] = (axis, cut, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), own[under]), (len(nodes) + 1, own[~under])]
        nodes += [(-1, 0.0, x, x) for x in (len(nodes), len(nodes) + 1)]
    return nodes


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Adds shard (long) to rows (id, v)."""
    spark = rows.sparkSession
    leaves = min(-(-n // SHARD), SAMPLE // DRAWN)
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) < F.lit(int(share * (1 << 53)))).select("v").limit(2 * SAMPLE) if leaves > 1 else None
    nodes = splits(stacked(drawn), leaves) if drawn is not None else [(-1, 0.0, 0, 0)]
    sent = spark.sparkContext.broadcast(tuple(np.array(x) for x in zip(*nodes)))  # at most two nodes for each leaf
    schema = "id long, v array<double>, leaf int"

    def run(frames):
        axis, cut, low, high = sent.value
        for pdf in frames:
            at = np.zeros(len(pdf), dtype=np.int64)
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            while (open_ := axis[at] >= 0).any():
                under = x[np.arange(len(x)), np.maximum(axis[at], 0)] < cut[at]
                at = np.where(open_, np.where(under, low[at], high[at]), at)
            yield pdf.assign(leaf=at.astype(np.int32))

    placed = stored(rows.mapInPandas(run, schema), "dealt")
    parts = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")))  # a row for each leaf
    return placed.join(parts, "leaf").select((F.col("leaf").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))).alias("shard"), "id", "v")


def stacked(drawn: DataFrame) -> np.ndarray:
    vectors = [r.v for r in drawn.toLocalIterator()]
    return np.array(vectors) if vectors else np.zeros((0, 1))


def boxes_of(held: DataFrame) -> DataFrame:
    """(shard, low, high) of every shard: bounds of a batch first, then of all."""

    def run(frames):
        for pdf in frames:
            out = []
            for shard, own in pdf.groupby("shard"):
                x = np.stack(own["v"].to_numpy())
                out.append((shard, x.min(axis=0), x.max(axis=0)))
            yield pd.DataFrame(out, columns=["shard", "low", "high"])

    partial = held.select("shard", "v").mapInPandas(run, "shard long, low array<double>, high array<double>")
    ends = partial.select("shard", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("shard", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(c)
    return ends.groupBy("shard").agg(in_order("low"), in_order("high"))


def reached(asks: DataFrame, boxes: DataFrame, blocks: int, groups: int) -> DataFrame:
    """(shard, block, id) of every query and other shard whose box reaches the query's kth score."""
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    boxes = boxes.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    asks = asks.select("block", "id", "v", "least", F.col("shard").alias("home")).withColumn("part", every(groups))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"shard": pd.Series(dtype="int64"), "block": pd.Series(dtype="int32"), "id": pd.Series(dtype="int64")})
        q, low, high = (np.stack(x.to_numpy()) for x in (left["v"], right["low"], right["high"]))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        near = bounds >= np.nan_to_num(left["least"].to_numpy(float), nan=-np.inf)[:, None]
        near &= left["home"].to_numpy()[:, None] != right["shard"].to_numpy()[None, :]
        i, j = np.nonzero(near)
        return pd.DataFrame({"shard": right["shard"].to_numpy()[j], "block": left["block"].to_numpy()[i], "id": left["id"].to_numpy()[i]})

    return asks.groupBy("block", "part").cogroup(boxes.groupBy("block", "part")).applyInPandas(run, "shard long, block int, id long")


def top_k(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """For each row whose key is divisible by ``every``: query_id, rank from 1, vec_id and score of its k best others."""
    rows = stored(whole_vectors(df, key, vector, scale), "vectors")
    n = rows.count()
    held = stored(dealt(rows, n), "shards")
    blocks = max(1, -(-n // (every * BLOCK)))
    none = F.lit(None).cast("double").alias("least")
    asks = stored(held.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("shard", "v")).alias("one")).select("id", "one.*"), "queries")
    asks = asks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # first round: its own shard, whose kth score is a bound for all the others
    home = held.select("shard", F.lit(0).alias("block"), "id", "v", F.lit(False).alias("ask"), none)
    begun = stored(search_shards(home.unionByName(asks.select("shard", F.lit(0).alias("block"), "id", "v", F.lit(True).alias("ask"), none)), k), "first-shard")
    kth = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("kth")).alias("least"))
    boxes = stored(boxes_of(held), "boxes")
    shards, found = boxes.count(), begun
    if shards > 1:
        bounded = stored(asks.join(kth, "id", "left"), "bounded")
        pairs = stored(reached(bounded, boxes, blocks, -(-shards // BOXES)), "reached")
        wanted = held.join(pairs.select("shard", "block").distinct(), "shard").select("shard", "block", "id", "v", F.lit(False).alias("ask"), none)
        asked = pairs.join(bounded.select("id", "v", "least"), "id").select("shard", "block", "id", "v", F.lit(True).alias("ask"), "least")
        found = begun.unionByName(search_shards(wanted.unionByName(asked), k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
