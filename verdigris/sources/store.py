"""Writing: replacing documents by source in generations, and the ledger of what is embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_by_source(stored: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """stored without the sources that are new, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unchanged(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows whose source and content hash are stored already: to be skipped."""
    return new.join(stored.select("source", "content_hash").distinct(), ["source", "content_hash"], "left_semi")


def write_generation(rows: DataFrame, path: str, generation: int) -> None:
    """One immutable partition per generation."""
    rows.drop("generation_id").write.mode("overwrite").parquet(f"{path}/generation_id={generation}")


def activate(spark: SparkSession, path: str, generation: int) -> None:
    """Makes a generation the active one: a new pointer is committed beside the older ones, none is written over. A job that dies leaves
    the greatest committed pointer as it was."""
    spark.range(1).select(F.lit(generation).cast("long").alias("generation")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_pointers/at={generation}")


def active_generation(spark: SparkSession, path: str) -> int:
    return int(spark.read.parquet(f"{path}/_pointers").agg(F.max("generation")).first()[0])


def read_active(spark: SparkSession, path: str) -> DataFrame:
    active = active_generation(spark, path)
    return spark.read.parquet(f"{path}/generation_id={active}").withColumn("generation_id", F.lit(active))


def sync_actions(desired: DataFrame, ledger: DataFrame) -> DataFrame:
    """desired, ledger (id, content_hash) -> id, action: prune, skip or upsert."""
    d, e = desired.select("id", F.col("content_hash").alias("want")), ledger.select("id", F.col("content_hash").alias("have"))
    action = F.when(F.col("want").isNull(), "prune").when(F.col("want") == F.col("have"), "skip").otherwise("upsert")
    return d.join(e, "id", "full").select("id", action.alias("action"))


def upsert_points(stored: DataFrame, new: DataFrame, foreign: str) -> DataFrame:
    """stored and new points (id, label) -> all points: new ones replace those of the same id, but for points that the column foreign marks as another's."""
    kept = stored.select(F.col("id").alias("i"), F.col("label").alias("old"), F.coalesce(F.col(foreign), F.lit(False)).alias("theirs"))
    rows = kept.join(new, F.col("i") == F.col("id"), "full")
    return rows.select(F.coalesce("i", "id").alias("id"), F.when(F.col("id").isNull() | F.coalesce("theirs", F.lit(False)), F.col("old")).otherwise(F.col("label")).alias("label"))
