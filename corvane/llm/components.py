"""Connected components of an edge table, by large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) of all nodes but the roots; `edges` has columns a, b (long).

    Each round hangs every node's larger neighbours, then its smaller ones, on the least neighbour; after
    O(log n) rounds all paths are one long. Minima are aggregated in the tasks first and the joins are plain
    equi-joins, so a node with very many neighbours is no bottleneck. Self-loops and repeated edges do no
    harm.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        # done when each node hangs on one other, which hangs on none
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least")).where("hangs > 1 OR (hangs = 1 AND least = 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(small.where("u <> v").distinct())
    raise RuntimeError(f"no end after {most_rounds} rounds")
