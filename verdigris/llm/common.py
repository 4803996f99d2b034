"""Helpers shared by the training-data operators: shared folders, size-checked joins, connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import new_path, shared_dir, ship, stage, table  # noqa: F401

#: The class of white space that the contracts name, and its complement's words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a dimension table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def lean(run):
    """A function over Arrow batches whose worker, kept for other tasks, gives freed memory back when it ends."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return held


def uniform(*cols: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) from the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def small_join(big: DataFrame, dim: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Joins a staged dimension table: broadcast if its counted rows are few, else a shuffled join that AQE may split."""
    return big.join(F.broadcast(dim) if dim.count() <= BROADCAST_ROWS else dim, on, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has one of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (node, root) for every node in an edge; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are a star forest. Every aggregate combines
    before its shuffle, and the joins' hub keys are left to AQE's skew split. Lineage is cut each round.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stage(edges, name)
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        edges = stage(small.select(pair.alias("e")).select("e.*").where("u <> v").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
