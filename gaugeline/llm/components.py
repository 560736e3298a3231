"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, spread


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(spread(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(spread(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Self loops are ignored. Each round is a written table, and only a row count
    and a checksum reach the driver. Rounds grow with the logarithm of the
    longest path.
    """
    state, now, k = None, scratch.keep(edges.where("u <> v").select("u", "v").distinct(), f"{label}-0"), 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not seen[0]:
            break
        state, k = seen, k + 1
        now = scratch.keep(_small_star(_large_star(now)), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
