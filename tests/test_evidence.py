"""Candidate selection against brute force."""

import random

from verdigris.operators.evidence import fill, keep_unlike


def test_keep_unlike(spark):
    sh = [f"s{i}" for i in range(20)]
    rows = [(1, 10, "a", 1, sh), (1, 11, "a", 2, sh[:18]), (1, 12, "b", 3, sh), (1, 13, "a", 4, sh[:10]), (1, 14, "a", 5, []), (1, 15, "a", 6, []), (2, 10, "a", 1, sh)]
    got = keep_unlike(spark.createDataFrame(rows, "query_id int, id int, source string, rank int, sh array<string>"))
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 10), (1, 12), (1, 13), (1, 14), (1, 15), (2, 10)]


def test_guards_keep_like_candidates(spark):
    """Another version or polarity, a new symbol, a new covered term: each keeps a candidate that is like a better one."""
    sh = [f"s{i}" for i in range(20)]
    rows = [(1, 1, "a", 1, sh, ["x"], ["S"], "neutral", "1", "p", "h"), (1, 2, "a", 2, sh, ["x"], ["S"], "neutral", "1", "q", "i"), (1, 3, "a", 3, sh, ["x", "y"], ["S"], "neutral", "1", "q", "j"), (1, 4, "a", 4, sh, ["x"], ["T"], "neutral", "1", "q", "k"), (1, 5, "a", 5, sh, ["x"], ["S"], "required", "1", "q", "l"), (1, 6, "a", 6, sh, ["x"], ["S"], "neutral", "2", "q", "m"), (1, 7, "b", 7, [], ["x", "z"], ["S"], "neutral", "1", "p", "h")]
    got = keep_unlike(spark.createDataFrame(rows, "query_id int, id int, source string, rank int, sh array<string>, covers array<string>, symbols array<string>, polarity string, version string, parent string, text_hash string"))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5, 6]


def test_fill(spark):
    rng = random.Random(5)
    rows = [(q, i, rng.choice("abc"), i, rng.randint(0, 90), rng.randint(0, 1000), rng.sample("xyz", rng.randint(0, 3)), rng.sample([f"w{k}" for k in range(30)], rng.randint(0, 12))) for q in range(3) for i in range(15)]
    schema = "query_id int, id int, source string, rank int, cost int, relevance int, covers array<string>, terms array<string>"
    got = {(r.query_id, r.id): (r.position, r.reason) for r in fill(spark.createDataFrame(rows, schema), budget=300, sources=2, per_source=4, threshold=200).collect()}
    assert len(got) == len(rows)
    for q in range(3):
        left, have, spent, used, n = [r for r in rows if r[0] == q], set(), 0, {}, 0
        while left:
            worth = lambda r: 180 * len(r[6]) + min(100, r[5] // 10) + min(80, 4 * len(set(r[7]) - have))
            left.sort(key=lambda r: (-(worth(r) * 100 // max(1, r[4])), -worth(r), r[3], r[1]))
            r = left.pop(0)
            if used.get(r[2], 0) >= 4 or (r[2] not in used and len(used) == 2):
                want = "source_cap"
            elif worth(r) * 100 // max(1, r[4]) < 200:
                want = "zero_marginal_utility"
            elif spent + r[4] > 300:
                want = "budget"
            else:
                want, n, spent, have = "selected", n + 1, spent + r[4], have | set(r[7])
                used[r[2]] = used.get(r[2], 0) + 1
            assert got[q, r[1]] == (n if want == "selected" else None, want)
