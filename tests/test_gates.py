"""Gates: each rule broken alone, ties and missing metrics, skylines against a loop."""

import itertools
import random

from verdigris.operators import gates as G

GOOD = {("docs_answer", m): 1.0 for m in G.GROUP_METRICS["docs_answer"]} | {("patch_context", m): 1.0 for m in G.GROUP_METRICS["patch_context"]} | {("holdout", m): 0.5 for m in G.GROUP_METRICS["holdout"]}


def broken(spark, now, before):
    frame = lambda d: spark.createDataFrame([(*k, float(v)) for k, v in d.items()], "group string, metric string, value double")
    return {(r.group, r.metric) for r in G.regressions(frame(now), frame(before), G.rules(spark)).collect()}


def test_rules_stand_alone(spark):
    assert broken(spark, GOOD, GOOD) == set()
    worse = {m: 0.9 if better == "up" else 1.05 if slack else 1.1 for m, better, _, _, slack in G.RULES}
    for metric, value in worse.items():
        group = "holdout" if metric == "recall@5" else "docs_answer"
        got = broken(spark, GOOD | {(group, metric): value if group != "holdout" else 0.4, ("patch_context", "required_fact_rate"): 2.0}, GOOD)
        assert got == (set() if metric == "retrieval_projection_p95_ms" else {(group, metric)})
    assert broken(spark, GOOD | {("docs_answer", "retrieval_projection_p95_ms"): 1.2}, GOOD) == {("docs_answer", "retrieval_projection_p95_ms")}
    assert broken(spark, GOOD | {("docs_answer", "citation_validity_rate"): 0.99}, GOOD | {("docs_answer", "citation_validity_rate"): 0.5}) == {("docs_answer", "citation_validity_rate")}


def test_what_is_missing_is_worst(spark):
    assert broken(spark, {}, GOOD) == set(GOOD) - {(g, m) for g, m in GOOD if "violations" in m or m == "insufficient_false_success_rate"}  # these are 1 at worst, as here before
    assert broken(spark, GOOD, {}) == {(g, m) for g, m in GOOD if "violations" in m or m in ("insufficient_false_success_rate", "retrieval_projection_p95_ms")}
    assert ("docs_answer", "answer_fact_coverage") in broken(spark, GOOD | {("docs_answer", "answer_fact_coverage"): float("nan")}, GOOD)


def test_lost_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, "case_id string, passed boolean")
    got = G.lost_cases(frame([("a", True), ("b", False), ("c", True), ("e", None)]), frame([("a", True), ("b", True), ("c", False), ("d", False), ("e", True), ("f", None)]))
    assert {tuple(r) for r in got.collect()} == {("b", "protected_case_regressed"), ("d", "missing_case"), ("e", "protected_case_regressed"), ("f", "missing_case")}


def test_skyline_equals_a_loop(spark):
    rng = random.Random(7)
    better = {"a": "up", "b": "down", "c": "up"}
    rows = {(case, f"r{run}", m): rng.choice([0.0, 1.0, 2.0, float("nan"), None]) for case in range(40) for run in range(rng.randint(1, 5)) for m in better if rng.random() < 0.9}
    got = {(r.case_id, r.run): (r.beaten_by, r.best_in) for r in G.skyline(spark.createDataFrame([(*k, v) for k, v in rows.items()], "case_id long, run string, metric string, value double"), better).collect()}
    score = lambda case, run: tuple((v if better[m] == "up" else -v) if (v := rows.get((case, run, m))) is not None and v == v else float("-inf") for m in sorted(better))
    runs = {(k[0], k[1]) for k in rows}
    assert set(got) == runs
    for case, run in runs:
        others = [r for c, r in runs if c == case and r != run]
        me = score(case, run)
        beaten = sorted(o for o in others if score(case, o) != me and all(x >= y for x, y in zip(score(case, o), me)))
        best = [m for k, m in enumerate(sorted(better)) if not any(score(case, o)[k] > me[k] for o in others)]
        assert got[case, run] == (beaten, best)
    assert any(b for b, _ in got.values()) and list(itertools.islice(got, 1))
