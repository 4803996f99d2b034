"""Vector codes against plain loops over whole numbers, on odd rows and on the given table."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import gnat

SCHEMA = "vec_id long, embedding array<double>, label int, id long, part int, error string, key int, v string"


def plain(rows, width, parts=4, entries=256, rounds=4):
    """rows: (id, vector or None, label) -> {(id, vector): (code, error)}, digest."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        kept.append((i, [max(-(2**62), min(2**62, math.floor(1024 * x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = -(-width // parts)
    cut = lambda v, p: (v + [0] * (parts * step - len(v)))[p * step : (p + 1) * step]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        own = [cut(v, p) for _, v, _ in kept]
        book = own[:entries]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))  # noqa: E731, B023
        for _ in range(rounds):
            at = [near(x)[1] for x in own]
            for k in range(len(book)):
                mine = [x for x, a in zip(own, at) if a == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for n, x in enumerate(own):
            d, k = near(x)
            codes[n].append(f"{k:02x}")
            errors[n] += d
        books += [str(c) for e in book for c in e]
    return sorted(((r[0], r[2], "".join(c), e) for r, c, e in zip(kept, codes, errors)), key=repr), hashlib.sha256(",".join(books).encode()).hexdigest()


def odd_vectors(n, width, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rng.normal(0, spread, width).round(3)], int(k) % 3 if k % 5 else None) for k in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [0.5] * (width - 1) + [None], 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] + [0.0] * (width - 1), 1)]
    rows += [(n + 4, rows[0][1], 2), (n + 5, rows[0][1], 2), rows[3], (rows[4][0], rows[5][1], 0), (None, rows[6][1], None), (n + 6, [-0.0001] * width, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "extra"), [(40, []), (400, []), (300, [(5_000, [1e300] * 3, 1), (5_001, [-3e14, 2.5] + [0.1] * 6, 2), (5_002, [3e9] * 8, 0), (-1, [1e12] * 8, 0)])])
def test_codes_equal_a_plain_loop(spark, n, extra):
    rows = odd_vectors(n, 8, n) + extra
    coded, books = gnat.compress(frame(spark, rows))
    got = sorted(((r.vec_id, r.label, r.code, int(r.error)) for r in coded.collect()), key=repr)
    want, digest = plain(rows, 8)
    assert got == want
    assert gnat.books_digest(books) == digest
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert {(r.vec_id, r.label, int(r.label_error)) for r in gnat.label_errors(coded).collect()} == {(i, label, sums[label]) for i, label, _, _ in want}


def test_other_widths_and_empty_tables(spark):
    rows = [(1, [0.5, 0.25, 1.0], 1), (2, [0.5], None), (3, [], 1), (4, [0.1, 0.2, 0.3, 0.4, 0.5], 2)]
    coded, books = gnat.compress(frame(spark, rows))
    want, digest = plain(rows, 5)
    assert sorted(((r.vec_id, r.label, r.code, int(r.error)) for r in coded.collect()), key=repr) == want
    assert gnat.books_digest(books) == digest
    for none in ([], [(1, None, 1)]):
        coded, books = gnat.compress(frame(spark, none))
        assert gnat.label_errors(coded).count() == 0
    coded, _ = gnat.compress(frame(spark, [(1, [], 1), (2, [], 1)]))
    assert sorted((r.vec_id, r.code, int(r.error)) for r in coded.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]


def test_trees_leave_out_whole_children_and_lose_no_tie():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 16))
    book = centres[rng.integers(0, 12, 256)] + rng.integers(-20, 20, (256, 16))
    book[200], book[7] = book[3], book[3]  # equal entries: the lowest is named
    q = centres[rng.integers(0, 12, 500)] + rng.integers(-30, 30, (500, 16))
    q[0] = book[3]
    at, d, computed = gnat.Book(book).nearest(q)
    every = ((q[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == at).all()
    assert (every.min(axis=1) == d).all()
    assert computed < 0.35 * every.size
    line = np.arange(0, 512, 2)[:, None]  # every odd query lies between two entries
    at, d, _ = gnat.Book(line).nearest(np.arange(-1, 513)[:, None])
    assert at.tolist() == [max(0, min(255, (x - (x % 2)) // 2)) for x in range(-1, 513)]
    same = np.zeros((256, 3), dtype=np.int64)
    assert (gnat.Book(same).nearest(np.ones((5, 3), dtype=np.int64))[0] == 0).all()


def test_given_table_is_covered(spark):
    sf = "/root/testdata/sf0.001"
    got = gnat.op11_gnat_codes(spark, sf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain(rows, 64)
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=repr) == [(i, c, e) for i, _, c, e in want]
    assert {r.codebooks_sha256 for r in got.select("codebooks_sha256").distinct().collect()} == {digest}
    assert got.where(F.col("label_error") < F.col("error")).count() == 0
