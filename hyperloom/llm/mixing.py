"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. The sources, in code-point order with null last, have weights that repeat in a cycle, and share the sum of
all sizes; no target exceeds a multiple of its source's size (the excess is shared again by weight). A source is first
taken whole as often as its target holds it. For what remains, documents are counted by exact size; every size gives about
its share of documents, and a bounded-knapsack dynamic program over the counts left picks the sizes that bring the sum
closest to the budget. Last, the picked number of each size is filled by documents in seeded order.

Rows move twice: counts (pre-aggregated) by source and size, and (id, size) rows by source, size and a slice of the seeded
order, so a source or a size that holds most rows is spread over many tasks.

Defined results: null texts and texts without words have size 0, are never taken and leave targets as they are; null
sources are a source of their own; repeated rows (also of one id) are rows of their own, taken in one order; an empty
table gives no rows; a table without any words has targets 0. Reruns agree: the order is a hash of id, text and seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.llm.common import set_apart, stored, text_or_empty, words_of

#: Twice the words of a source's budget that are left to the dynamic program at least.
FITTED = 1 << 13
#: Steps of the program between sums that are held.
SEGMENT = 64
#: Rows of one source and size that are ranked together.
RANKED = 256


def numbered(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 0, of the source in code-point order, null last: ranges of sources are ranked each on their own."""
    parts = stored(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct(F.col("source").isNull(), "source")).alias("least")).orderBy("least").collect()  # one row for each partition
    before, total = {}, 0
    for r in counts:
        before[r["_part"]], total = total, total + r["n"]
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<int,int>")
    own = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").isNull(), "source")) - 1
    return parts.withColumn("rank", own + F.element_at(offsets, F.col("_part"))).drop("_part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """From (source, source_size), one row per source, the same with target.

    Capped sharing has one level L with sum(min(most * size, L * weight)) = total. It rises from the level without caps: what
    the sources capped at a level leave is shared by the others, until no more are capped. Each round is one sum over sources.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = numbered(sizes).select("source", "source_size", cycle.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    weighed = stored(weighed, "weights")
    total, every = (x or 0 for x in weighed.agg(F.sum("source_size"), F.sum("weight")).first())
    level, capped = (total / every if every else 0.0), -1
    while True:
        held = weighed.filter(F.col("cap") <= F.lit(level) * F.col("weight")).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if held[0] == capped or (held[2] or 0) == every:
            break
        capped, level = held[0], (total - (held[1] or 0)) / (every - (held[2] or 0))
    return weighed.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sum comes closest to the budget (not above, if equal).

    Walking down the sizes, each gets its proportional share, less what would overrun the share of all sizes so far; a
    last part of the budget is left to the program. It has reachable sums as bits of one integer, one step for each power of
    two of a size's count, and is walked back to read the picks. Only the sums of every SEGMENT steps are held.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    taken, share, held, wanted = np.zeros_like(counts), max(0, budget - FITTED // 2) / total, 0, 0.0
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(counts[i])
        wanted += share * size * n
        taken[i] = k = min(n, int(wanted - held) // size) if size else 0
        held += k * size
    left = budget - held
    room = min(2 * left, left + int(sizes.max()))  # a sum beyond twice the rest is no closer than none
    mask, steps, held_sums = (1 << (room + 1)) - 1, [], [1]
    sums = 1
    for i, (size, free) in enumerate(zip(sizes.tolist(), (counts - taken).tolist(), strict=True)):
        k = 1
        while size and free > 0 and size * min(k, free) <= room:
            k = min(k, free)
            steps.append((i, k * size, k))
            sums |= (sums << size * k) & mask
            free, k = free - k, 2 * k
            if len(steps) % SEGMENT == 0:
                held_sums.append(sums)
        if sums >> left & 1:
            break
    below, above = sums & ((1 << (left + 1)) - 1), sums >> (left + 1)
    best = below.bit_length() - 1
    if above and (above & -above).bit_length() < left - best:
        best = left + (above & -above).bit_length()
    for start in range((len(steps) - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):  # the sums between held ones are made again
        own, before = steps[start : start + SEGMENT], [held_sums[start // SEGMENT]]
        for _, size, _ in own[:-1]:
            before.append(before[-1] | (before[-1] << size) & mask)
        for (i, size, k), reached in zip(reversed(own), reversed(before)):
            if not reached >> best & 1:
                taken[i] += k
                best -= size
    return taken


def hashed(key: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), text_or_empty(text), F.lit(seed))


def mix(df: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 42) -> DataFrame:
    """One row per row of the input: its key, source, size, source_size, target, times (how often the mix takes it) and order (the
    hash of its key and text)."""
    words = words_of(text_or_empty(text))
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(words).cast("long").alias("size"), hashed(key, text, seed).alias("order"))
    rows = stored(rows, "sizes")  # texts are read once
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    whole = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = int(target // total) if total else 0
        picked = fitted(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), round(target - times * total))
        return pdf.assign(times=times, picked=picked)[["source", "size", "n", "source_size", "target", "times", "picked"]]

    joined = counted.alias("c").join(whole.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source"))).select("c.source", "size", "n", "source_size", "target")
    plan = joined.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, times long, picked long")
    return chosen(rows, plan)


def chosen(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their plan, the first ``picked`` of each source and size in seeded order taken once more.

    The order is cut in slices of about RANKED rows: all slices before the one where the count is reached are taken
    whole, and ranks are needed only inside a slice.
    """
    spread = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")))
    share = (F.shiftrightunsigned(F.col("order"), 33) / F.lit(float(1 << 31))) * F.ceil(F.col("n") / RANKED)
    spread = spread.select("key", "r.source", "r.size", "order", "source_size", "target", "times", "picked", F.floor(share).alias("slice"))
    place = ["source", "size", "slice"]
    held = spread.groupBy(*place).agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = spread.withColumn("nth", F.row_number().over(W.partitionBy(*place).orderBy("order", "key")))
    both = ranked.alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.slice") == F.col("b.slice")))
    times = F.when(F.col("r.size") > 0, F.col("times") + F.when(F.col("before") + F.col("nth") <= F.col("picked"), 1).otherwise(0)).otherwise(0)
    return both.select("key", "r.source", "r.size", "source_size", "target", times.cast("long").alias("times"), "r.order")


def taken_rows(df: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42, **options) -> DataFrame:
    """The rows, in their columns, each as often as the mix takes it. Rows meet their count by the hash of their key and text;
    those that share it are equal in both, and take its counts in any order."""
    df, names = set_apart(df, text, source, key)
    columns = df.columns
    place = ["_source", "_size", "_order"]
    nth = lambda by: F.row_number().over(W.partitionBy(*place).orderBy(by))
    plan = mix(df, text=text, source=source, key=key, seed=seed, **options).filter("times > 0")
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("order").alias("_order"), "times").withColumn("_nth", nth("times")).alias("p")
    words = F.size(words_of(text_or_empty(text))).cast("long")
    rows = df.withColumns({"_source": F.col(source), "_size": words, "_order": hashed(key, text, seed)})
    rows = rows.withColumn("_nth", nth(F.lit(0))).alias("r")
    met = rows.join(plan, F.col("r._source").eqNullSafe(F.col("p._source")) & (F.col("r._size") == F.col("p._size")) & (F.col("r._order") == F.col("p._order")) & (F.col("r._nth") == F.col("p._nth")))
    copies = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*[F.col(f"r.{c}").alias(c) for c in columns]).withColumnsRenamed(names)
