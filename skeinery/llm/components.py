"""Connected components of a table of links, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any order).  Returns node, root (the smallest node reachable) of every node that has a link.

    Alternating large-star and small-star steps over distinct links; every step only
    keeps minima per node (combined before the shuffle), and a hot node's links meet
    in a join, which adaptive execution splits.  Each round is a table in the shared
    folder, so a lost executor costs one round.  Rounds grow with the logarithm of
    the longest chain.
    """
    e = scratch(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        # large star: every greater neighbour of a node hangs on the node's least
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every lesser neighbour of a node, and the node, hang on its least
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # a star forest has one link for each node that isn't a root, and roots have none
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
