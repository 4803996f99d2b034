"""Answer gates: a candidate against a baseline by rules that nothing makes up for, and the runs of each case that no other beats.

Metrics are rows (run, case, metric, value). A metric that is missing counts as its worst; a rule allows a share of loss or none. A run beats another in
a case if it is as good in every metric and better in one. A case's runs are few; they meet by case, metric by metric, never run by run over all cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each metric's better direction, what a candidate and a baseline without it count as, and the share of the baseline that it may be worse.
RULES = (
    ("required_fact_rate", "up", -1.0, -1.0, 0.0), ("answer_fact_coverage", "up", -1.0, -1.0, 0.0), ("recall@5", "up", -1.0, -1.0, 0.0), ("forbidden_source_violations", "down", 1.0, 0.0, 0.0),
    ("forbidden_version_violations", "down", 1.0, 0.0, 0.0), ("unsupported_claim_violations", "down", 1.0, 0.0, 0.0), ("insufficient_false_success_rate", "down", 1.0, 0.0, 0.0),
    ("median_visible_tokens", "down", float("inf"), float("inf"), 0.0), ("retrieval_projection_p95_ms", "down", float("inf"), 0.0, 0.1),
)
#: Metrics that must be whole, whatever the baseline had; the metrics of each group.
WHOLE = ("citation_validity_rate",)
GROUP_METRICS = {k: tuple(r[0] for r in RULES if r[0] != "recall@5") + WHOLE for k in ("docs_answer", "patch_context")} | {"holdout": ("recall@5", "answer_fact_coverage")}


def rules(spark, groups: dict[str, tuple[str, ...]] = GROUP_METRICS) -> DataFrame:
    """A row for each rule: group, metric, better, and what stands for a missing value."""
    known = {r[0]: r[1:] for r in RULES}
    rows = [(g, m, *(known[m] if m in known else ("whole", 0.0, 1.0, 0.0))) for g, metrics in groups.items() for m in metrics]
    return spark.createDataFrame(rows, "group string, metric string, better string, missing double, base_missing double, slack double").coalesce(1)


def regressions(candidate: DataFrame, baseline: DataFrame, rule: DataFrame) -> DataFrame:
    """candidate, baseline (group, metric, value) -> group, metric, now, before of every rule that the candidate breaks. NaN counts as missing."""
    value = lambda df, name: df.select(F.col("group").alias(f"{name}_g"), F.col("metric").alias(f"{name}_m"), F.when(~F.isnan("value"), F.col("value")).alias(name))
    met = lambda name: (F.col("group") == F.col(f"{name}_g")) & (F.col("metric") == F.col(f"{name}_m"))
    rows = rule.join(value(candidate, "now"), met("now"), "left").join(value(baseline, "before"), met("before"), "left")
    now, before = F.coalesce("now", "missing"), F.coalesce("before", "base_missing")
    broken = F.when(F.col("better") == "up", now < before).when(F.col("better") == "down", now > F.when(F.col("slack") > 0, before * (1 + F.col("slack"))).otherwise(before)).otherwise(now < 1.0)
    return rows.where(broken).select("group", "metric", "now", "before")


def lost_cases(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidate, baseline (case_id, passed) -> case_id, reason: cases that are gone, and those that passed and do not."""
    now = candidate.select(F.col("case_id").alias("c"), F.coalesce("passed", F.lit(False)).alias("now"))
    rows = baseline.select("case_id", F.coalesce("passed", F.lit(False)).alias("before")).join(now, F.col("case_id") == F.col("c"), "left")
    reason = F.when(F.col("c").isNull(), "missing_case").when(F.col("before") & ~F.col("now"), "protected_case_regressed")
    return rows.select("case_id", reason.alias("reason")).where("reason is not null")


def skyline(metrics: DataFrame, better: dict[str, str]) -> DataFrame:
    """metrics (case_id, run, metric, value), better (metric: up or down) -> case_id, run, beaten_by (runs that beat it, in order; none on the skyline), best_in (metrics in which no run is better)."""
    # Every run has every metric, as a number that is better the higher it is.
    wanted = F.explode(F.array(*[F.struct(F.lit(m).alias("w"), F.lit(d).alias("better")) for m, d in better.items()])).alias("x")
    full = metrics.select("case_id", "run").distinct().select("case_id", "run", wanted).select("case_id", "run", "x.*")
    given = metrics.groupBy(F.col("case_id").alias("c"), F.col("run").alias("r"), F.col("metric").alias("m")).agg(F.max(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
    sign = F.when(F.col("better") == "up", 1.0).otherwise(-1.0)
    full = full.join(given, (F.col("case_id") == F.col("c")) & (F.col("run") == F.col("r")) & (F.col("w") == F.col("m")), "left").select("case_id", "run", "w", F.coalesce(F.col("value") * sign, F.lit(float("-inf"))).alias("v"))
    scores = full.groupBy("case_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("v"))
    other = scores.select(F.col("case_id").alias("oc"), F.col("run").alias("o"), F.col("v").alias("ov"))
    pairs = scores.join(other, (F.col("case_id") == F.col("oc")) & (F.col("run") != F.col("o")), "left")
    beats: Column = F.coalesce(F.forall(F.zip_with("ov", "v", lambda a, b: a >= b), lambda x: x) & F.exists(F.zip_with("ov", "v", lambda a, b: a > b), lambda x: x), F.lit(False))
    best = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: F.get("v", k))
    seen = pairs.groupBy("case_id", "run").agg(F.array_sort(F.collect_set(F.when(beats, F.col("o")))).alias("beaten_by"), F.first(best).alias("v"), F.collect_list("ov").alias("others"))
    names = F.array(*[F.lit(m) for m in sorted(better)])
    top = F.filter(F.transform(names, lambda m, k: F.when(~F.exists("others", lambda o: F.get(o, k) > F.get("v", k)), m)), lambda m: m.isNotNull())
    return seen.select("case_id", "run", "beaten_by", top.alias("best_in"))
