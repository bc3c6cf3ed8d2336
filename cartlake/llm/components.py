"""Connected components of an edge table by alternating large and small
stars (every pass is a groupBy min and a join, nothing is collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable. Only
    nodes with an edge to another node are listed."""
    now = saved(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                .filter("lo < hi").distinct(), "cc")
    before = None
    while True:
        # large star: every larger neighbour of u points to the smallest neighbour of u
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")) \
            .filter("lo < hi").distinct()
        # small star: the smaller neighbours of u, and u, point to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .union(least.select("hi", F.col("m").alias("lo")))
        now = saved(small.select("lo", "hi").distinct(), "cc")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("h")).first()
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")) \
                .union(now.select(F.col("lo"), F.col("lo")).distinct())
        before = state
