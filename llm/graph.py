"""Connected components of a graph given as edges between 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut


def _stars(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Each node's neighbours are joined to the least of them (or the node): larger ones, or smaller ones and itself."""
    around = edges if only_smaller else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    both = around.join(least, "a")
    out = both.select(F.col("b").alias("a"), F.col("m").alias("b")) if only_smaller else both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if only_smaller:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node with an edge that is not the least of its component, and that least node.

    Alternates joining larger and smaller neighbours to the least one until nothing changes; the number of
    rounds grows with the logarithm of the longest path. Each round is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        after = now.agg(F.count("a"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == state or not after[0]:
            return now
        state = after
        now = cut(_stars(_stars(now, False), True))
