"""Connected components of a link table, by rounds of least-label exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.scratch import Scratch


def least_reachable(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every identifier in ``links`` (a, b): the least one it reaches.

    Alternates large-star and small-star rounds: every round reconnects
    neighbours to the least identifier around, so that rounds grow with the
    logarithm of the longest chain and rows never exceed the links. Each
    round is written to the shared folder; only a count comes to the driver.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    step = 0
    while True:
        step += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct(), f"{name}-{step}-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = scratch.keep(hooked.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        counts = small.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        # A forest of stars: each node has one edge, and no target is itself a source.
        if counts["n"] == counts["d"] and small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(small.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
