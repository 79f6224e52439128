"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step; edges are (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    # Edges whose larger end keeps a smaller neighbour than the one it was moved to stay reachable through that neighbour.
    large = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
    floor = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    ``edges`` has two columns of one orderable type; self loops, nulls and repeats are ignored. Returns
    ``(node, component)``, one row per node with an edge (none for an empty table). Each round is written to the
    shared folder, so neither the links nor the components ever meet in the driver; it sees a count and a checksum.
    Hot nodes are joined by sort-merge joins, which adaptive execution splits. Raises if ``limit`` rounds do not settle
    (the number of rounds grows with the logarithm of the longest path).
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = scratch.save(now, "edges-0")
    seen = None
    for k in range(1, limit + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = scratch.save(_stars(now), f"edges-{k}")
        if k > 1:
            scratch.drop(f"edges-{k - 2}")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    # Settled: every edge leads to the root of a star.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
