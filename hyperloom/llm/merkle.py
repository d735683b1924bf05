"""Merkle dataset manifest: a tree of digests over the rows of each source and one over the sources, by checkpoint and
recompute.

A node is the sha256 of its children's hexadecimal digests, FANOUT of them at most. Only every LEVELS-th level is stored, the
leaves and then the tops of aligned subtrees of FANOUT ** LEVELS nodes each. A proof is put together from the top: of every
stored subtree the levels in between are made again from its stored nodes, each node's siblings on the way up are emitted in
front of those of the subtree's top, and the levels are forgotten. So what is stored is 1 / 26 of the leaves besides them, a
task holds one subtree, and the rounds grow with the logarithm of the largest source.

Leaves get their places without a group for a source: rows are dealt by ranges of (source, key, leaf), so a source that holds
most rows lies in many partitions; a place is that in its partition and source, and the counts of the partitions before.
Sources are numbered in the same way, however many there are. The driver sees the largest source's size and the root.

Defined results: a null value is `-` in a leaf; a null source is a source of its own, the first; null keys come first; rows
of one key follow each other by leaf, equal rows in any order (they are alike); every row is a leaf and gets a proof; a lone
leaf is its source's root; an empty table gives no rows. Columns that aren't named take no part and aren't returned. Texts
are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.llm.common import stored

#: Children of a node, and levels from one stored level to the next.
FANOUT, LEVELS = 3, 3
SPAN = FANOUT**LEVELS
#: Low bits of monotonically_increasing_id: the place in a partition. Those above number the partition.
PLACE = 33
NO_STEPS = "array<struct<left:string,right:string>>"


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def leaf_of(*values: Column) -> Column:
    """Of each value `-` if null, else its UTF-8 bytes' count, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return digest(F.concat(*parts))


def in_order(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """Stored by ranges, with part (the range) and nth (the place in it, from 0)."""
    at = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), label)
    return rows.withColumns({"part": F.shiftright("at", PLACE), "nth": F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1))}).drop("at")


def before(n: str, *by: str) -> Column:
    """The sum of n in the partitions before."""
    return F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (the number of their source), pos (their place in it) and size (its leaves); sources as (tree, size)."""
    rows = leaves.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    by = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("node"), F.col("file"), F.col("row")]
    rows = in_order(rows, "ordered", *by).drop("file", "row")
    counts = stored(rows.groupBy("source", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n")), "counts")
    sources = in_order(counts.groupBy("source").agg(F.sum("n").alias("size")), "sources", F.col("source").asc_nulls_first())
    parts = sources.groupBy("part").agg(F.count("*").alias("n")).withColumn("one", F.lit(0))  # one row for each partition
    parts = parts.select("part", before("n", "one").alias("before"))
    sources = stored(sources.join(parts, "part").select("source", "size", (F.col("before") + F.col("nth")).alias("tree")), "sources")
    a, b = counts.alias("a"), sources.alias("b")
    shift = (before("n", "tree") - F.col("first")).alias("shift")
    starts = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "part", "tree", "size", shift)
    r, s = rows.alias("r"), starts.alias("s")
    met = r.join(s, (F.col("r.part") == F.col("s.part")) & F.col("r.source").eqNullSafe(F.col("s.source")))
    return met.select("r.*", "tree", "size", (F.col("nth") + F.col("shift")).alias("pos")).drop("source", "part", "nth"), sources


def subtrees(nodes: DataFrame) -> DataFrame:
    """From (tree, size, pos, node, ...), the nodes of a level, one row per aligned subtree: (tree, size, block, kids)."""
    rest = [c for c in nodes.columns if c not in ("tree", "size", "pos", "node")]
    kids = F.array_sort(F.collect_list(F.struct("pos", "node", *rest)))
    return nodes.groupBy("tree", "size", F.floor(F.col("pos") / SPAN).alias("block")).agg(kids.alias("kids"))


def parents(nodes: Column) -> Column:
    """The level above some consecutive nodes, of which the first is a first child."""
    firsts = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(firsts, lambda i: digest(F.array_join(F.slice(nodes, i, FANOUT), "")))


def regenerated(blocks: DataFrame) -> DataFrame:
    """Adds n0 (the subtree's stored nodes), n1 ... (the levels above them, of one node once the tree ends) and levels."""
    levels = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        levels = F.when(F.col("size") <= FANOUT**k, k).otherwise(levels)
    out = blocks.withColumn("levels", levels).withColumn("n0", F.transform("kids", lambda x: x["node"]))
    for k in range(LEVELS):
        own = F.col(f"n{k}")
        out = out.withColumn(f"n{k + 1}", F.when(F.col("levels") > k, parents(own)).otherwise(own))
    return out


def tops(blocks: DataFrame) -> DataFrame:
    """The stored level above: (tree, size, pos, node)."""
    return regenerated(blocks).select("tree", F.ceil(F.col("size") / SPAN).alias("size"), F.col("block").alias("pos"), F.element_at(f"n{LEVELS}", 1).alias("node"))


def with_steps(blocks: DataFrame) -> DataFrame:
    """Nodes with steps, the siblings to their left and right on each level of their subtree: (tree, size, block, kid, own)."""

    def side(k: int, pos: Column) -> Column:
        i = F.floor((pos % SPAN) / FANOUT**k).cast("int")
        start, nodes = i - i % FANOUT, F.col(f"n{k}")
        join = lambda a, n: F.array_join(F.slice(nodes, a + 1, n), "")
        return F.struct(join(start, i - start).alias("left"), join(i + 1, start + FANOUT - 1 - i).alias("right"))

    steps = lambda x: F.slice(F.array(*[side(k, x["pos"]) for k in range(LEVELS)]), F.lit(1), F.col("levels"))
    kids = F.transform("kids", lambda x: F.struct(x.alias("kid"), steps(x).alias("own")))
    return regenerated(blocks).select("tree", "size", "block", F.inline(kids))


class Trees:
    """Stored levels of some trees: bands[k] has the subtrees whose nodes are on level k * LEVELS."""

    def __init__(self, lowest: DataFrame, most: int, label: str):
        self.bands, self.label, done = [lowest], label, []
        while True:
            level = stored(tops(self.bands[-1]), f"{label}-level")
            done.append(level.filter("size = 1"))
            if most <= SPAN:
                break
            most = -(-most // SPAN)
            self.bands.append(subtrees(level.filter("size > 1")))
        self.roots = done[0]
        for x in done[1:]:
            self.roots = self.roots.union(x)
        self.roots = self.roots.select("tree", F.col("node").alias("subroot"))

    def proofs(self, base: DataFrame) -> DataFrame:
        """The lowest nodes (kid, subroot, steps); base: (tree, subroot, steps) of the trees' roots."""
        above = None
        for band in reversed(self.bands):
            own = with_steps(band)
            met = own.filter(F.col("size") <= SPAN).join(base, "tree").select("tree", "kid", "subroot", F.concat("own", "steps").alias("steps"))
            if above is not None:
                upper = above.select("tree", F.col("kid.pos").alias("block"), "subroot", "steps")
                met = met.union(own.filter(F.col("size") > SPAN).join(upper, ["tree", "block"]).select("tree", "kid", "subroot", F.concat("own", "steps").alias("steps")))
            above = met
        return above


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def digest_of(steps: Column) -> Column:
    """The digest of a proof: all its siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(df: DataFrame, *, hashed: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", source: str = "source", carried: dict[str, Column] | None = None) -> DataFrame:
    """For each row its key, leaf, the root of its source (subroot), the root over all, and steps, its proof: on each level
    the digests of the siblings to its left and right. carried: columns computed with the leaves that come back with them."""
    carried = carried or {}
    own = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), leaf_of(*[F.col(c) for c in hashed]).alias("node"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carried.items()]).alias("more"))
    rows, sources = placed(stored(own, "leaves"))
    lowest = stored(subtrees(rows), "subtrees")
    most, n = (x or 0 for x in sources.agg(F.max("size"), F.count("*")).first())
    each = Trees(lowest, most, "trees")
    over = each.roots.select(F.lit(0).alias("tree"), F.lit(n).alias("size"), F.col("tree").alias("pos"), F.col("subroot").alias("node"))
    one = Trees(stored(subtrees(over), "subroots"), n, "root")
    top = one.roots.first()
    base = one.roots.withColumn("steps", F.array().cast(NO_STEPS))
    base = one.proofs(base).select(F.col("kid.pos").alias("tree"), F.col("kid.node").alias("subroot"), "steps")
    proofs = each.proofs(stored(base, "subroots"))
    root = F.lit(top["subroot"] if top else None).cast("string")
    return proofs.select(F.col("kid.key").alias(key), F.col("kid.node").alias("leaf"), "subroot", root.alias("root"), "steps", *[F.col(f"kid.more.{c}").alias(c) for c in carried])
