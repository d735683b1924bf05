"""Connected components by joins: labels spread along the links and jump along themselves until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of integer nodes, in either or both directions, the rows (node, component): the smallest node
    reachable. Nodes without a link don't appear; null nodes are dropped.

    Each round is joins of two stored tables, which Spark splits where a node has very many links. The rounds needed
    grow with the logarithm of the longest chain rather than its length.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).dropna().distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        reached = both.join(labels, both["a"] == labels["node"]).select(both["b"].alias("node"), "c")
        spread = stored(reached.union(labels).groupBy("node").agg(F.min("c").alias("c")), "labels")
        x, y = spread.alias("x"), spread.alias("y")
        jumped = stored(x.join(y, F.col("x.c") == F.col("y.node")).select("x.node", F.least("x.c", "y.c").alias("c")), "labels")
        if not changed(labels, jumped):
            return jumped.withColumnRenamed("c", "component")
        labels = jumped


def changed(old: DataFrame, new: DataFrame) -> bool:
    """Labels only fall, so equal sums mean equal labels (decimals: no overflow)."""
    total = lambda df: df.agg(F.sum(F.col("c").cast("decimal(20,0)"))).first()[0]
    return total(old) != total(new)
