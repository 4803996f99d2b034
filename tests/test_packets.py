"""Packets: consistency and budgets against loops that take out one thing after the other."""

import random

import pytest

from verdigris.operators import packets as P


def made(seed, n=40):
    rng = random.Random(seed)
    rows, citations, sources = [], [], []
    for p in range(n):
        for e in range(rng.randint(0, 6)):
            sources.append((p, f"e{e}", rng.choice([5, 20, 40]), rng.random() < 0.15, rng.choice([None, None, f"e{rng.randint(0, 8)}"]) if e else None))
        for r in range(rng.randint(0, 8)):
            rows.append((p, f"r{r}", rng.choice(P.GIVES_WAY), rng.randint(0, 3), rng.randint(1, 30), rng.random() < 0.2))
            citations += [(p, f"r{r}", f"e{e}") for e in rng.sample(range(8), rng.choice([0, 1, 1, 1, 2]))]
    return rows, citations, sources


def consistent(rows, citations, sources):
    while True:
        there = {(s[0], s[1]) for s in sources}
        cites = {}
        for p, r, e in citations:
            cites.setdefault((p, r), set()).add((p, e))
        kept = [r for r in rows if cites.get(r[:2]) and cites[r[:2]] <= there]
        used = {e for r in kept for e in cites[r[:2]]} | {(s[0], s[4]) for s in sources if s[4]}
        held = [s for s in sources if (not s[4] or (s[0], s[4]) in there) and (s[3] or (s[0], s[1]) in used)]
        if (kept, held) == (rows, sources):
            return rows, [c for c in citations if c[:2] in {r[:2] for r in rows}], sources
        rows, sources = kept, held


def fitted(p, rows, citations, sources, budget):
    """Takes out rows one by one; sources go when nothing cites them."""
    left = sorted(rows, key=lambda r: (r[5], P.GIVES_WAY.index(r[2]), -r[3], [-ord(c) for c in r[1]]))

    def held():
        names = {s[1] for s in sources if s[3] or any(c[2] == s[1] and c[1] in {r[1] for r in left} for c in citations)}
        while more := {s[4] for s in sources if s[1] in names and s[4]} - names:
            names |= more
        return [s for s in sources if s[1] in names]

    gone = []
    while left and sum(r[4] for r in left) + sum(s[2] for s in held()) > budget:
        gone.append(left.pop(0))
    bad = any(r[2] in P.CRITICAL or r[5] for r in gone) or not held() or not left
    return {r[1] for r in left}, {s[1] for s in held()}, "insufficient_evidence" if bad else "truncated" if gone else "ok"


def frames(spark, rows, citations, sources):
    return (
        spark.createDataFrame(rows, "packet_id long, row_id string, field string, pos int, cost long, required boolean"), spark.createDataFrame(citations, "packet_id long, row_id string, evidence_id string"),
        spark.createDataFrame(sources, "packet_id long, evidence_id string, cost long, required boolean, parent string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_equals_a_loop(spark, seed):
    data = made(seed)
    rows, citations, sources = P.whole(*frames(spark, *data))
    want = consistent(*data)
    assert {(r.packet_id, r.row_id) for r in rows.collect()} == {r[:2] for r in want[0]}
    assert {(s.packet_id, s.evidence_id) for s in sources.collect()} == {s[:2] for s in want[2]}
    assert {tuple(c) for c in citations.collect()} == set(want[1])


@pytest.mark.parametrize("budget", [0, 25, 60, 120, 10_000])
def test_fit_equals_a_loop(spark, budget):
    rows, citations, sources = consistent(*made(3))
    kept, held, state = P.fit(*frames(spark, rows, citations, sources), budget)
    got_rows, got_sources, got_state = {}, {}, {r.packet_id: r for r in state.collect()}
    for r in kept.collect():
        got_rows.setdefault(r.packet_id, set()).add(r.row_id)
    for s in held.collect():
        got_sources.setdefault(s.packet_id, set()).add(s.evidence_id)
    for p in {r[0] for r in rows}:
        of = lambda xs: [x for x in xs if x[0] == p]  # noqa: B023, E731
        stay, cited, status = fitted(p, of(rows), of(citations), of(sources), budget)
        assert (got_rows.get(p, set()), got_sources.get(p, set())) == (stay, cited)
        assert got_state[p].status == status
        assert got_state[p].cost == sum(r[4] for r in of(rows) if r[1] in stay) + sum(s[2] for s in of(sources) if s[1] in cited)
        assert sum(x.n for x in got_state[p].omitted) == len(of(rows)) - len(stay)
    assert P.errors(kept, frames(spark, rows, citations, sources)[1], held).where("error <> 'source_without_citation'").count() == 0  # a source may be there for one made from it


def test_errors_are_named(spark):
    rows = [(1, "a", "tests", 0, 1, False), (1, "b", "tests", 1, 1, False), (1, "b", "compile", 1, 1, False), (1, "c", "tests", 2, 1, False)]
    citations = [(1, "a", "x"), (1, "b", "lost"), (1, "b", "x"), (1, "gone", "y")]
    sources = [(1, "x", 1, False, None), (1, "x", 2, False, None), (1, "y", 1, False, None), (1, "z", 1, True, None)]
    got = {(r.error, r.id) for r in P.errors(*frames(spark, rows, citations, sources)).collect()}
    assert got == {("row_without_citation", "c"), ("citation_without_source", "lost"), ("source_without_citation", "y"), ("repeated_evidence", "x"), ("repeated_row", "b")}


@pytest.mark.parametrize("budget", [0, 25, 60, 120, 10_000])
@pytest.mark.parametrize("staged", [False, True])
def test_packed_equals_a_loop(spark, budget, staged):
    data = made(4, 60)
    data = (data[0] + [(0, None, "tests", 0, 1, False)], data[1] + [(0, None, "e0"), (1, "r0", None)], [(*s[:4], None) for s in data[2]])
    rows, citations, sources = consistent([r for r in data[0] if r[1]], [c if c[2] else (*c[:2], "none") for c in data[1] if c[1]], data[2])
    frame = frames(spark, *data)
    kept, cites, held, state = P.packed(frame[0], frame[1], frame[2].drop("parent"), budget, staged=staged)
    assert {tuple(c) for c in cites.collect()} == set(citations)
    got_rows, got_sources, got_state = kept.collect(), held.collect(), {r.packet_id: r for r in state.collect()}
    assert set(got_state) == {r[0] for r in rows}
    for p in got_state:
        of = lambda xs: [x for x in xs if x[0] == p]  # noqa: B023, E731
        stay, cited, status = fitted(p, of(rows), of(citations), of(sources), budget)
        assert ({r.row_id for r in got_rows if r.packet_id == p}, {r.evidence_id for r in got_sources if r.packet_id == p}) == (stay, cited)
        assert got_state[p].status == status and (got_state[p].rows, got_state[p].sources) == (len(stay), len(cited))
        assert got_state[p].cost == sum(r[4] for r in of(rows) if r[1] in stay) + sum(s[2] for s in of(sources) if s[1] in cited)
        assert {x.field: x.n for x in got_state[p].omitted} == {f: n for f in P.GIVES_WAY if (n := sum(r[2] == f and r[1] not in stay for r in of(rows)))}


def test_packets_are_dealt_out_once(spark):
    rows, citations, sources = frames(spark, *made(5))
    kept, _, _, state = P.packed(rows, citations, sources.drop("parent"), 60)
    for df in (kept, state, P.errors(rows, citations, sources)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
