"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, remove


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: each node sends its larger neighbours to its least one; small: its smaller ones and itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node with an edge, root being the least node of its component. edges: columns a, b (long)."""
    spark = edges.sparkSession
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("d"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        # a fixed point: every node has one edge, to its root, and a step changed nothing
        if state.n == 0 or state == mark:
            break
        mark = state
        after = cut(_stars(_stars(now, True), False), "edges")
        remove(spark, now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
