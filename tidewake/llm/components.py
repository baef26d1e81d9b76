"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, recorded, written


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in edges (columns a and b, longs).

    Large-star and small-star steps in turn until nothing changes. Each step takes a minimum for each node, with
    partial aggregation, and joins it back. The minima are a table, so that both sides of the join are plain exchanges and
    a node with very many edges is split over tasks; each turn's edges are one too, and go when the next are there.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, old = None, []
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        with recorded() as made:
            # large star: each larger neighbour of u goes to the least of u and its neighbours
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
            # small star: u and its smaller neighbours go to the least of them
            least = written(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
            now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(spark, old + made[:-1])
        old = made[-1:]
    roots = now.select("u", "v")
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
