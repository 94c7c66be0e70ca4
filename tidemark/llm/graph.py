"""Connected components by hooking and pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

def light(df: DataFrame) -> DataFrame:
    """A table of ids, much smaller than the texts, written in an eighth of the session's partitions (six at least)."""
    return materialize(df.coalesce(max(6, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 8)))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over undirected edges (a, b), for nodes that have an edge.

    Each round hooks every root to its smallest neighbouring root, follows the hooks to their ends by pointer
    jumping, and relabels the edges; only edges between different roots go on. Steps are written tables.
    """
    edges = light(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        parent = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        while True:
            parent = light(parent)
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            further = above.select(F.col("up").alias("top"), F.col("top").alias("peak"))
            ahead = parent.join(above, "up", "left").join(further, "top", "left")
            parent = light(ahead.select("node", F.coalesce("peak", "top", "up").alias("up"), F.col("peak").isNotNull().alias("moved")))
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        hook = parent.select("node", "up")
        labels = light(labels.join(hook.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        edges = light(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
