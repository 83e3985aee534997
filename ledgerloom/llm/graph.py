"""Connected components on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any comparable type).  One row per node that has a link: node, root, the least node it reaches.

    Alternating large-star and small-star contractions until nothing changes: each links a node's larger, then its
    smaller neighbours to its least one.  The least neighbour is pre-aggregated and met again by a join that Spark can
    split, so that a node with very many links isn't one task's.  Every round is checkpointed twice, after each contraction; nothing but two sums
    that tell whether a round changed anything goes to the driver."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _sums(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").unionByName(least.select(F.col("u").alias("v"), "m"))
        edges = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        after = _sums(edges)
        if after == before:
            break
        before = after
    # a star now: every node that isn't a root has one edge, to its root
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _sums(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.shiftrightunsigned(h, 7).cast("decimal(38,0)"))).first())
