"""Rank fusion: reciprocal ranks, with weights, and by documents' groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lanes: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """lanes (query_id, id, rank) -> query_id, id, score, lanes (lane -> rank). Ties keep the first lane's order."""
    rows = reduce(DataFrame.unionByName, [d.select("query_id", "id", "rank", F.lit(n).alias("lane"), F.lit(i).alias("at"), F.lit(float((weights or {}).get(n, 1.0))).alias("weight")) for i, (n, d) in enumerate(lanes.items())])
    fused = rows.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", "rank")))).alias("lanes"), F.min(F.struct("at", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen.at", "seen.rank")
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def best_groups(hits: DataFrame, group: str, most: int = 5, k: int = 60) -> DataFrame:
    """query_id, group, score of the groups with the highest sums of reciprocal ranks; the first stage of a two-stage search."""
    scored = hits.groupBy("query_id", group).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), group)
    return scored.withColumn("group_rank", F.row_number().over(order)).where(F.col("group_rank") <= most)
