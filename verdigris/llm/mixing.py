"""Mixing sources to target weights by Pareto order sampling.

Every document's expected copies e are its source's target words over its source's words, times its own
relative weight. floor(e) copies are certain; the rest, pi = e - floor(e), is an inclusion probability. Documents
are ranked by q = (u / (1 - u)) / (pi / (1 - pi)) with u a reproducible uniform number, and the smallest q are
selected until the sample has its fixed size, counted in words. A last document, the one nearest in size to what
is still missing, closes the gap.

The ranking never sorts a source in one task: q is mapped to (0, 1) and counted in 4096 bins of 4096 bins, and
only the rows of the one inner bin in which the target is reached are ordered.

Defined cases: null text counts no words; a null source is a source of its own, last in order; an empty table gives
an empty result; a source without words has target 0 and no copies beyond the certain ones; equal ids are told
apart by their text and equal rows share one decision; null ids are ordered first; columns of any name pass
through `mix_copies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, small_join, stage, table, uniform, word_count  # noqa: F401

#: Bins in each of the two levels.
BINS = 4096


def source_targets(slim: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """slim (source, size) -> (source, source_size, target): shares by cycled weights, capped, the excess reshared.

    One row per source; only that summary table is ordered as a whole.
    """
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_copies))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = per.withColumn("rest", F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("level", F.col("rest") / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))).withColumn("at", F.row_number().over(fill))
    per = per.withColumn("level", F.min_by("level", F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("at"))).over(whole))
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _cut(rows: DataFrame, keys: list[str], bin_col: str, prefix: str) -> DataFrame:
    """Of each source, the bin in which the running words pass what is wanted, and the words before it."""
    per = rows.groupBy(*keys, bin_col).agg(F.sum("size").alias("n"), F.first("want").alias("want"))
    run = Window.partitionBy(*keys).orderBy(bin_col)
    per = per.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > F.col("want"))
    return per.groupBy(*keys).agg(F.min(bin_col).alias(prefix), F.min_by(F.col("upto") - F.col("n"), bin_col).alias(f"{prefix}_before"))


def _expected(target: Column, source_size: Column, weight: Column, mean: Column, max_copies: float) -> Column:
    e = F.when(source_size > 0, F.least(F.lit(float(max_copies)), target / source_size * weight / mean)).otherwise(0.0)
    return F.coalesce(e, F.lit(0.0))


def _ranked(rows: DataFrame, seed: int, max_copies: float) -> DataFrame:
    """Adds sure (whole certain copies), r (the Pareto rank in (0, 1), null if nothing is left to draw) and key."""
    rows = rows.withColumn("e", _expected(F.col("target"), F.col("source_size"), F.col("weight"), F.col("mean"), max_copies))
    rows = rows.withColumn("sure", F.floor("e")).withColumn("pi", F.col("e") - F.col("sure"))
    u = uniform(F.col("id"), F.col("h"), seed=seed)
    q = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    rows = rows.withColumn("r", F.when(F.col("pi") > 0, q / (1 + q)))
    return rows.withColumn("key", F.struct("r", "id", "h"))


def plan_mix(slim: DataFrame, weights: Sequence[float], share: float, max_copies: float, seed: int) -> DataFrame:
    """slim (id, source, size, weight, h), staged -> one row per source with the thresholds that decide its documents."""
    mean = slim.groupBy("source").agg((F.sum(F.col("size") * F.col("weight")) / F.sum("size")).alias("mean"))
    targets = source_targets(slim, weights, share, max_copies)
    targets = targets.join(mean, targets.source.eqNullSafe(mean.source), "left").drop(mean.source).fillna(1.0, ["mean"])
    targets = stage(targets, "mix_targets")
    rows = small_join(slim, targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = _ranked(rows, seed, max_copies).withColumn("g", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sure = rows.groupBy("g").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("want"), F.first("source").alias("source"))
    sure = stage(sure.where("want > 0"), "mix_want")
    drawn = small_join(rows.where("r is not null").drop("source"), sure.withColumnRenamed("g", "g2"), F.col("g") == F.col("g2"), "inner").drop("g2")
    at = F.col("r") * BINS
    drawn = drawn.withColumn("b1", F.floor(at)).withColumn("b2", F.floor((at - F.col("b1")) * BINS))
    one = stage(_cut(drawn, ["g"], "b1", "c1"), "mix_bins").withColumnRenamed("g", "g2")
    inner = small_join(drawn, one, F.col("g") == F.col("g2"), "inner").where("b1 = c1").withColumn("want", F.col("want") - F.col("c1_before"))
    two = stage(_cut(inner, ["g"], "b2", "c2"), "mix_bins").withColumnRenamed("g", "g3")
    last = small_join(inner.drop("g2"), two, F.col("g") == F.col("g3"), "inner").where("b2 = c2").withColumn("want", F.col("want") - F.col("c2_before"))
    run = Window.partitionBy("g").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.sum("size").over(run)).where("upto <= want").groupBy("g").agg(F.max("key").alias("k"))
    edge = F.struct(((F.col("c1") + F.col("c2") / BINS) / BINS).alias("r"), F.lit(None).cast(slim.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("h"))
    cuts = one.join(two, F.col("g2") == F.col("g3")).drop("g3").join(last, F.col("g2") == F.col("g"), "left")
    cuts = stage(cuts.select(F.col("g2"), F.coalesce("k", edge).alias("cut")), "mix_cuts")
    drawn = small_join(drawn, cuts, F.col("g") == F.col("g2"), "left").drop("g2")
    inside = F.coalesce(F.col("key") <= F.col("cut"), F.lit(True))
    got = drawn.groupBy("g").agg((F.first("want") - F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0))).alias("gap"))
    got = stage(got, "mix_gap").withColumnRenamed("g", "g2")
    near = F.abs(F.col("size") - F.col("gap"))
    spare = small_join(drawn, got, F.col("g") == F.col("g2"), "inner").where(~inside & (near < F.col("gap")))
    extra = spare.groupBy("g").agg(F.min(F.struct(near.alias("near"), "key")).alias("x")).select(F.col("g").alias("g3"), F.col("x.key").alias("extra"))
    plan = targets.withColumn("g", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    plan = plan.join(cuts, F.col("g") == F.col("g2"), "left").drop("g2").join(extra, F.col("g") == F.col("g3"), "left").drop("g3")
    return stage(plan.join(sure.select(F.col("g").alias("g4"), "want"), F.col("g") == F.col("g4"), "left").drop("g4", "g"), "mix_plan")


def slim_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), weight.alias("weight"), F.xxhash64(text).alias("h"))


def decided(rows: DataFrame, plan: DataFrame, seed: int, max_copies: float) -> DataFrame:
    """rows with id, source, weight and h -> with source_size, target and copies."""
    plan = plan.withColumnRenamed("source", "s")
    rows = _ranked(small_join(rows, plan, F.col("source").eqNullSafe(F.col("s"))).drop("s"), seed, max_copies)
    inside = F.col("r").isNotNull() & F.col("want").isNotNull() & F.coalesce(F.col("key") <= F.col("cut"), F.lit(True))
    extra = F.coalesce(F.col("key") == F.col("extra"), F.lit(False))
    return rows.withColumn("copies", (F.col("sure") + (inside | extra).cast("int")).cast("int"))


def mix_plan_rows(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weight_col: str | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: float = 2, seed: int = 20231) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies."""
    slim = stage(slim_rows(docs, id_col, text_col, source_col, weight_col), "mix_slim")
    plan = plan_mix(slim, weights, share, max_copies, seed)
    return decided(slim, plan, seed, max_copies).select("id", "source", "size", "source_size", "target", "copies")


def mix_copies(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weight_col: str | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: float = 2, seed: int = 20231) -> DataFrame:
    """The mix itself: docs' own columns, each document as often as it is taken. Texts are not shuffled."""
    slim = stage(slim_rows(docs, id_col, text_col, source_col, weight_col), "mix_slim")
    plan = plan_mix(slim, weights, share, max_copies, seed)
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), weight.alias("weight"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = decided(own, plan, seed, max_copies).where("copies > 0")
    return rows.select("own", F.explode(F.sequence(F.lit(1), "copies"))).select("own.*")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_plan_rows(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
