"""The stages on odd rows: columns, decisions, empty tables; and each stage against its operator on the given tables."""

import itertools
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F
from verdigris.llm import decontaminate, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def shingle_set(t):
    w = (t or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_stages_keep_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, f in P.STAGES[:-1]:
            out = f(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = P.stage(out, name)
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in P.toxicity(spark, docs, SF).select("doc_id").collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    kept = {r.doc_id for r in P.simhash_dedup(spark, docs, SF).select("doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, prints, parent = {i: shingle_set(t) for i, t in rows}, {i: simhash.fingerprint((t or "").encode(), 5) % 2**64 for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {find(i) for i in sets}
    kept = {r.doc_id for r in P.decontamination(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0").collect()}


def test_near_duplicates_are_dropped_by_document(spark):
    """Null ids, one id with several texts, repeated rows: one document of each component stays, whatever its id."""
    a, b, c, d, e = ("".join(f"{x}{k} " for k in range(40)) for x in "abcde")
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, c, "s"), (None, c, "t"), (2, d, "s"), (2, e, "s"), (3, e, "s"), (1, a, "s"), (3, b + "x", "s"), (0, d, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [(r.doc_id, r.text) for r in P.simhash_dedup(spark, docs, SF).select("doc_id", "text").collect()]
    want = [(1, a), (3, b + "x"), (None, c), (0, d), (2, e)]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def test_stages_one_after_another(spark):
    """run()'s documents are those that the stages' decisions leave, each decision taken by its operator on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    left = {i: r for i, r in left.items() if scores[i] < 0.5}
    sets, prints = {i: shingle_set(r.text) for i, r in left.items()}, {i: simhash.fingerprint((r.text or "").encode(), 5) % 2**64 for i, r in left.items()}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(left), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0:
            root[max(find(a), find(b))] = min(find(a), find(b))
    left = {i: r for i, r in left.items() if find(i) == i}
    hit = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    left = {i: r for i, r in left.items() if i not in hit}
    copies = {r.id: r.copies for r in mixing.mix_plan_rows(docs.where(F.col("doc_id").isin(list(left)))).collect()}
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == Counter({i: c for i, c in copies.items() if c})


def test_run(spark):
    rows = P.run(spark, SF).orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
