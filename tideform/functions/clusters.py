"""Clusters of similar configurations: connected components over edges, and the medoid of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, component)``: the smallest node reachable, by rounds of neighbour minima with pointer jumping.

    Each round is written to the folder in ``spark.checkpoint.dir`` where one is set; the driver sees a count only.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u != v").distinct()
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    both = keep(both)
    now = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("low"))
        new = now.join(near, F.col("node") == F.col("u")).select("node", F.least("component", "low").alias("component"), F.col("component").alias("before"))
        jump = new.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = keep(new.join(jump, F.col("component") == F.col("to")).select("node", F.least("component", "further").alias("component"), "before"))
        moved = new.where("component != before").limit(1).count()
        now = new.select("node", "component")
        if not moved:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def medoids(edges: DataFrame) -> DataFrame:
    """Each component of (a, b, weight) edges: its size, and the node whose links weigh most (ties: the smallest)."""
    parts = components(edges.select("a", "b"))
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    sums = ends.groupBy("node").agg(F.round(F.sum("weight"), 6).alias("weight"))
    best = F.min_by("node", F.struct(-F.col("weight"), F.col("node")))
    return parts.join(sums, "node").groupBy("component").agg(F.count("*").alias("members"), best.alias("medoid"), F.max("weight").alias("weight"))
