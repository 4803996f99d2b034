"""Personal data: base spans against the patterns as they stand, planted looser spans, the models on made votes."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = ["email", "ip", "card", "phone"]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), ORDER.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found)


TEXTS = [
    "a@b@c.com x@y.com_foo@bar.com @z.org a@.b.c a@b. q@w.e.r@t.y",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.2.3.4 .1.2.3.4. 12.34.56.78x é9.9.9.9",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111 41111111111111112 4111  1111 0000000000000000 12 3456",
    "+1 (377) 555-0271 +49 30 1234567 +1234567890123456 +1 +12 +1-(-2 +1 2 3 4 5 6 7 8 9 0 . +33.1.22.33.44.55)",
    "é ü +1 (377) 555-0271 mañana@x.example.com 10.0.0.1 𝔘 5500005555555559",
    "", " ", "@", "+", "....", "1", "a@b.c",
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice(["@", ".", "a", "b1", "+1", " ", "-", "4", "25", "(", ")", "12.3", "411111", "_", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(20_000)]:
        assert personal.base_spans(text) == plain(text), text


def test_more_spans_overlap_none():
    rng = random.Random(2)
    pieces = ["@", ".", "a", "+1 ", " ", "-", "4", "25 30", "(030) ", "12.3", "411111 ", "John Smith", " (at) ", "x", ":", "ab:12"]
    for _ in range(5000):
        base, more = personal.candidates("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))))
        every = sorted([(a, b, 1) for a, _, b in more] + [(a, b, 0) for a, _, b in base])
        for (_, b, x), (c, _, y) in zip(every, every[1:]):
            assert b <= c or not (x or y)


def test_time_follows_the_text():
    for piece in ("a", "1", "1 ", "1.", "1-", "+", "+1", "(1)", "@", "a@", "a@b", "a@b.", "A", "Ab ", "at(at)", "a(at)", "1:", "a(at)b(dot)", "+1 ", "1x ", "1 2x"):
        text = piece * (200_000 // len(piece))
        began = time.perf_counter()
        base, more = personal.candidates(text)
        for s in more[:10]:
            personal.votes(text, s, False)
        assert time.perf_counter() - began < 6, piece


def corpus():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "tion", "often", "goes", "by", "water", "and", "stone"]) for _ in range(n))
    rows, planted, plainly = [], {}, set()
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))

    def card():
        head = "4" + number(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    for k in range(400):
        mark, kind = [
            (f"Tel: 0{number(2)} {number(4)} {number(4)}", "phone"), (f"my email is {rng.choice('abc')}{k} (at) gmail (dot) com", "email"), (f"Dear {rng.choice(['John', 'Mary', 'Peter'])} {rng.choice(['Smith', 'Miller'])}", None),
            (f"version {k}.{k}.2", None), (f"page 12 of {number(8)} copies", None), (f"on 2021-03-{10 + k % 20} then", None), (f"write to u{k}@mail.example.com", "base"), (f"call +1 (377) 555-{number(4)}", "base"), (f"from 10.1.2.{k % 200} on", "base"), (f"card {card()}", "base"), (f"total {number(9)}", None), ("nothing", None),
        ][k % 12]
        rows.append((k, f"{prose(5)} {mark} {prose(5)}"))
        if kind in ("phone", "email"):
            planted[k] = kind
        elif kind is None and k % 12 != 2:
            plainly.add(k)
    return rows, planted, plainly


def test_planted_spans_are_added_and_others_are_not(spark):
    rows, planted, plainly = corpus()
    got = {r.id: r.spans for r in personal.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    hit = [k for k, kind in planted.items() if any(personal.EVERY[s.kind] == kind and not s.base for s in got[k])]
    assert len(hit) >= 0.9 * len(planted)
    assert not [k for k in plainly if got[k]]
    for k, text in rows:
        assert [(s.start, s.kind, s.end) for s in got[k] if s.base] == plain(text)
        assert all(s.p > 0.5 for s in got[k])


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.column_stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < r) == truth, 1, -1)) for r in right])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    kind = np.zeros(len(n), dtype=int)
    model = personal.Reliabilities().fit(kind, patterns, n.astype(float))
    says = model.share[0, :, 1, 2] / (model.share[0, :, 1, 2] + model.share[0, :, 1, 0])
    assert (np.diff(says) < 0).all()
    assert abs(model.prior[0] - 0.3) < 0.12
    p = model.posterior(np.zeros(len(truth), dtype=int), votes)
    odds = np.log(0.3 / 0.7) + sum(votes[:, k] * np.log(r / (1 - r)) for k, r in enumerate(right))  # what is best with the true shares
    assert ((p > 0.5) == truth).mean() > ((odds > 0) == truth).mean() - 0.01
    for size in (1, 1000):  # the models' answers do not hang on the corpus's size
        again = personal.Reliabilities().fit(kind, patterns, n * float(size))
        assert np.allclose(again.share, model.share, atol=0.02)


def test_odd_rows_and_masks(spark, odd_docs, odd_rows, no_docs):
    assert personal.scan(no_docs).count() == 0
    got = personal.scan(odd_docs).collect()
    want = lambda t: [(s[0], s[1], s[2]) for s in plain(t or "")]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.id, [(s.start, s.kind, s.end) for s in r.spans if s.base]) for r in got), key=key) == sorted(((r[0], want(r[1])) for r in odd_rows), key=key)
    docs = spark.createDataFrame([(1, "é mail x@y.org, +1 (377) 555-0271.", 1), (2, None, 2), (3, "none", 3), (4, "10.0.0.1", 4)], "doc_id long, text string, key int")
    hidden = {r.doc_id: r.text for r in personal.masked(docs, personal.scan(docs)).collect()}
    assert hidden == {1: "é mail <EMAIL>, <PHONE>.", 2: None, 3: "none", 4: "<IP>"}


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in personal.op13_weak_labels(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        base = plain(r.text or "")
        text = ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in base)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(row.spans.split(","))
    assert spark.createDataFrame(list(got.values())).where(F.col("n_email") > 0).count() >= 1
