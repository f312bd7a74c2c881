"""Connected components by alternating large-star and small-star rounds, as joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._scratch import dropped, written


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each v with the least of u and its neighbours, each u as well."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = pairs.join(least, "u")
    return both.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.v", "x.m").filter("v != m").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> node, component: the smallest node reachable, for every node that has an edge.

    Each round hangs nodes under smaller neighbours and is written to the shared folder, so neither the driver nor a
    task holds a component; rounds grow with the logarithm of the longest path.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now)
    seen = None
    while True:
        # large-star: neighbours above u move to the least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: u and its neighbours below move to the least of them
        small = _star(large.distinct()).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        dropped(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
