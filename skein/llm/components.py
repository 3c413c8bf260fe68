"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014), in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (node, component), component being the smallest node of its component. Nodes without edges are absent.

    Minima are aggregated and joined back, so a hub is a skewed join, which Spark splits, and never a list."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.staged(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        e = common.staged(small, "edges")
        # done when every edge points at a root: no target is itself a source, and no source has two targets
        open_ends = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").limit(1).count() or e.groupBy("u").count().where("count > 1").limit(1).count()
        if not open_ends:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
