"""Searches in several lanes: budgets, merge and packing against loops; one read of the postings for all lanes."""

import random
import re

import pytest

from verdigris.operators import lanes as L

HITS = "query_id int, lane string, n int, rank int, id long, source string, cost long"


def made(seed, queries=6):
    rng = random.Random(seed)
    hits, texts, supplements = [], {}, []
    for q in range(queries):
        lanes = [("main", 0, 6)] * (q != 5) + [("authority", 0, 8)] + [("supplement", n, 4) for n in range(1, rng.randint(1, 4))]
        for lane, n, most in lanes:
            ids = rng.sample(range(30), rng.randint(1, most))
            hits += [(q, lane, n, k + 1, i, f"s{i % 3}", 10 * (i % 7) + 5) for k, i in enumerate(ids)]
        supplements += [(q, f"word{rng.randint(0, 5)} Term-{rng.randint(0, 5)} x", n, n < 3) for n in range(1, 4)] if q else []
    for i in range(30):
        texts[i] = " ".join(rng.choice([f"WORD{k}" for k in range(6)] + [f"term-{k}" for k in range(6)]) for _ in range(4)) if i % 9 else None
    return hits, texts, supplements


def plain(hits, texts, supplements, budget, limit, in_turns):
    fitted = []
    for q, lane, n in {h[:3] for h in hits}:
        own = min(budget, max(128, budget // 4)) if lane == "supplement" else budget
        used, some = 0, False
        for h in sorted(x for x in hits if x[:3] == (q, lane, n)):
            if not some or used + h[6] <= own:
                fitted.append(h)
                used, some = used + h[6], True
    merged, picked = {}, {}
    for q in {h[0] for h in fitted}:
        of = lambda lane: sorted((h for h in fitted if h[0] == q and h[1] == lane), key=lambda h: (h[2], h[3]))  # noqa: B023, E731
        if in_turns:
            order = []
            queues = [of("main"), of("supplement"), of("authority")]
            while any(queues):
                order += [queue.pop(0) for queue in queues if queue]
        else:
            order = of("supplement") + of("authority") + of("main")
        probes = {t.lower() for s in supplements if s[0] == q and s[3] for t in re.findall(r"[A-Za-zА-Яа-я0-9_.:/+-]{3,}", s[1])}
        order.sort(key=lambda h: -sum(t in (texts[h[4]] or "").lower() for t in probes))
        merged[q] = [(h[1], h[2], h[3], h[4]) for h in order]
        chosen, used = [], 0
        for h in order:
            if h[4] in [c[4] for c in chosen] or used + h[6] > budget:
                continue
            if len(chosen) >= limit and not (h[5] == chosen[0][5] and len(chosen) < max(limit, 4)):
                continue
            chosen.append(h)
            used += h[6]
        picked[q] = [c[4] for c in chosen]
    return merged, picked


@pytest.mark.parametrize("in_turns", [False, True])
@pytest.mark.parametrize(("seed", "budget", "limit"), [(1, 120, 2), (2, 1000, 3), (3, 30, 6)])
def test_merge_and_packing_equal_loops(spark, seed, budget, limit, in_turns):
    hits, texts, supplements = made(seed)
    ranked = L.merged(L.within_budget(spark.createDataFrame(hits, HITS), budget), spark.createDataFrame(supplements, "query_id int, text string, n int, probe boolean"), spark.createDataFrame(list(texts.items()), "id long, text string"), in_turns=in_turns).cache()
    merged, picked = plain(hits, texts, supplements, budget, limit, in_turns)
    got = {}
    for r in ranked.orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.lane, r.n, r.rank, r.id))
    assert got == merged
    out = {}
    for r in L.packed(ranked, limit=limit, budget=budget).orderBy("query_id", "pick").collect():
        out.setdefault(r.query_id, []).append(r.id)
    assert out == {q: v for q, v in picked.items() if v}


def test_lanes_take_all_terms_or_any_and_share_one_read(spark, tmp_path):
    from verdigris.operators import index as X

    docs = spark.createDataFrame([(1, "red ring"), (2, "red"), (3, "ring red ring"), (4, "blue"), (5, "red ring blue"), (6, None)], "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "i"))
    meta = spark.createDataFrame([(1, "a", 5, True, None), (2, "a", 5, True, True), (3, "b", 5, False, True), (4, "b", 5, None, True), (5, "b", 5, True, False)], "id long, source string, cost long, authority boolean, allowed boolean")
    requests = spark.createDataFrame([(7, "red ring"), (8, "blue green")], "query_id int, text string")
    further = spark.createDataFrame([(7, "blue", 2, True), (7, "blue", 1, True), (7, " ", 0, False), (8, "none", 1, False)], "query_id int, text string, n int, probe boolean")
    hits = L.lane_hits(index, L.lane_queries(requests, further), meta, limit=5)
    got = {}
    for r in hits.orderBy("query_id", "lane", "n", "rank").collect():
        got.setdefault((r.query_id, r.lane, r.n), []).append(r.id)
    assert got == {(7, "main", 0): [3, 1], (7, "authority", 0): [1], (7, "supplement", 1): [4], (8, "main", 0): [4]}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"postings", plan)) <= 2  # one scan, and at most its reuse
