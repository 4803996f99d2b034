"""The index of a few questions' terms: the same answers as the whole index, and no other postings."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import index as X
from verdigris.plans import evidence_queries, retrieval_queries

SF = "/root/testdata/sf0.001"


def test_same_answers_as_the_whole_index(spark, tmp_path):
    docs = [(k, f"Title {w}", f"{w} body {w} x{k}", "src") for k, w in enumerate(["alpha", "beta", "alpha Beta", "gamma", "delta alpha"])] + [(9, None, None, "src"), (10, "beta", "", None)]
    frame = spark.createDataFrame(docs, "id int, title string, text string, source string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha nowhere"), (3, "title")], "query_id int, text string")
    record = {"title": F.col("title"), "source": F.col("source")}
    every = X.build(frame, str(tmp_path / "whole"), id_col="id", buckets=4, **record)
    terms = X.terms_of(asked)
    few = X.build_for(X.counted(frame, terms, **record), str(tmp_path / "few"), terms, id_col="id", store=frame, buckets=4)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for search in (lambda i: X.bm25(i, asked, flag=True), lambda i: X.bm25(i, asked, conjunctive=True), lambda i: X.weighted_bm25(i, asked)):
        assert rows(search(every)) == rows(search(few)) != []
    assert {r.id for r in X.fetch(few, spark.createDataFrame([(3,), (9,), (77,)], "id int"), "id").collect()} == {3, 9}
    with pytest.raises(ValueError, match="gamma"):
        X.bm25(few, spark.createDataFrame([(1, "gamma")], "query_id int, text string"))


def test_queries_store_only_what_is_asked(spark, monkeypatch):
    terms = set(X.terms_of(retrieval_queries.questions(spark)))
    assert {r.term for r in retrieval_queries.index_of(spark, SF).table("postings").select("term").distinct().collect()} <= terms
    staged = []
    monkeypatch.setattr(evidence_queries, "stage", lambda df, name: staged.append(df.columns) or df)
    evidence_queries.packed_search(spark, SF)
    assert staged and "search_text" not in staged[0]
