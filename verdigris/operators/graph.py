"""Bounded path search over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paths(edges: DataFrame, starts: DataFrame, depth: int = 2, per_hop: int = 50, most: int = 5) -> DataFrame:
    """edges (src, dst, confidence), starts (node) -> start, path, confidence, hops: simple paths of up to `depth` hops, the `per_hop` best
    edges of a node only, the `most` best paths of a start (confidence, then length, then text)."""
    order = Window.partitionBy("src").orderBy(F.col("confidence").desc(), "dst")
    edges = edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_hop).drop("_n")
    step = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(1.0).alias("conf"))
    found = None
    for _ in range(depth):
        step = step.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("conf") * F.col("confidence")).alias("conf"))
        found = step if found is None else found.union(step)
    rank = Window.partitionBy("start").orderBy(F.col("conf").desc(), F.size("path"), F.array_join("path", ">"))
    rows = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    return rows.select("start", "path", F.col("conf").alias("confidence"), (F.size("path") - 1).alias("hops"), "rank")
