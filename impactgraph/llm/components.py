"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node reachable, for every node of links (a, b), which may be in any order.

    Each round links nodes to the least node nearby and keeps one row per node and neighbour; groups are aggregated
    before they are shuffled, and rounds end when no row changes. Links are written between rounds, so that lost
    executors cost one round at most.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    turn = 0
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours go to the least of the neighbourhood; small star: the rest do.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = small.union(down.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        edges = scratch.write(edges, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))
