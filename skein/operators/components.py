"""Connected components of an edge table in rounds of joins: every node takes the smallest label among its own and its neighbours', and labels jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (a, b) to (node, component), the component's smallest node. Each round is written, so lineage stays short; with jumps the rounds grow with the logarithm of a path's length. Labels that still change after `rounds` raise."""
    e = scratch.staged(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = scratch.staged(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = e.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        low = now.join(near, "node").select("node", "component", F.least("component", "low").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = scratch.staged(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("component"), F.col("component").alias("before")), "labels")
        done = new.where("component <> before").isEmpty()
        now = new.select("node", "component")
        if done:
            return now
    raise RuntimeError(f"labels still change after {rounds} rounds")
