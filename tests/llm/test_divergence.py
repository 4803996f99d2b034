"""The source divergence audit against plain loops, in one block and in many."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from verdigris.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    """rows: (text, lang, source) -> the audit's rows."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
        count[lang].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: price(count[lang, s]) for s in sources}, price(count[lang])
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice([5, 20, 120])]) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([" ", ", ", "\n", "1"]).join(words), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "B", "é", "src1", "src10", None, ""]) if rng.random() < 0.6 else "hot"))
    rows += [(None, "en", "null text"), ("", "en", "no text"), ("12 34", "fr", "no terms"), ("Word " * 5000, "en", "hot"), ("only one", "de", "alone"), (None, None, None), ("zz", "it", "x"), ("zz", "it", "y")]
    return rows + rows[:5]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, term string, n string, p string, gb string, value string, terms string"
    return spark.createDataFrame([(k % 50, *r, *["x"] * 6) for k, r in enumerate(rows)], schema).repartition(3)


@pytest.mark.parametrize(("seed", "blocks"), [(1, None), (2, (7, 2, 5)), (3, (1, 1, 1)), (4, (50, 3, 64))])
def test_audit_equals_plain_loops(spark, monkeypatch, seed, blocks):
    if blocks:
        monkeypatch.setattr(divergence, "TERMS", blocks[0])
        monkeypatch.setattr(divergence, "GROUPS", blocks[1])
    rows = rows_of(seed)
    got = divergence.audit(frame(spark, rows), least_docs=6, top_terms=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 7)


def test_columns_come_in_parts(monkeypatch):
    import pandas as pd

    rng = random.Random(9)
    rows = [(0, f"s{g}", f"t{t}", n, 100 * g + n) for g in range(6) for t in range(20) if (n := rng.randint(0, 5))]
    rows += [(0, f"s{g}", None, 0, 100 * g) for g in range(6)]
    frame = pd.DataFrame(rows, columns=["gb", "source", "term", "n", "p"]).assign(lang="en", a=0, b=0)
    whole = divergence.priced_products(frame)
    monkeypatch.setattr(divergence, "COLUMNS", 3)
    assert divergence.priced_products(frame).equals(whole)
    assert len(whole) == 15


def test_held_terms_are_passed_on(spark, monkeypatch):
    import pyarrow as pa

    rows = [r for r in rows_of(5, 80)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows]), pa.array([r[2] or "" for r in rows]), pa.array([r[0] or "" for r in rows])], ["lang", "source", "text"])
    add = lambda out: Counter({}) + sum((Counter({(x["lang"], x["source"], x["term"]): x["n"]}) for b in out for x in b.to_pylist()), Counter())
    whole = add(divergence._counted(iter([batch])))
    monkeypatch.setattr(divergence, "HELD", 5)
    assert add(divergence._counted(iter([batch]))) == whole


def test_empty_tables(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    none = divergence.audit(frame(spark, [(None, None, None), ("a few words", "en", "x"), ("none kept", "en", "y")]))
    assert sorted(map(tuple, none.collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_given_table_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(divergence.OP12_SQL).fetchall())
    assert sorted(map(tuple, divergence.op12_level_products(spark, sf).collect())) == want
