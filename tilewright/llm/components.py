"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014), each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node reachable. Every round is written to the shared folder; a hub's edges aren't gathered, they meet its minimum in a join whose heavy keys Spark can split."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: each node links its larger neighbours to the smallest node around it.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        # Small star: each node links its smaller neighbours, and itself, to the smallest of them.
        lowest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.withColumnRenamed("a", "u").join(lowest, "u")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "small-star")
        # Settled when every node has one edge, to a root that has none of its own: then another round changes nothing.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
