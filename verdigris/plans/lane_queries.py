"""Queries of searches in several lanes. A question's further questions are its pairs of words; documents labelled good are the authorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import lanes as L
from ..runtime import stage, table
from .retrieval_queries import _BM25, _Q, WORDS, index_of, questions

QUERIES, SQL = {}, {}
LIMIT, BUDGET = 6, 2000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def word_pairs(spark):
    words = T.tokens(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), " "))
    rows = questions(spark).select("query_id", words.alias("w")).where("size(w) > 1").select("query_id", F.posexplode(pairs).alias("n", "text"))
    return rows.withColumn("probe", F.col("n") < 8)


def _meta(spark, sf):
    good = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.ceil(F.octet_length("text") / 4).cast("long").alias("cost"))
    return rows.join(good, F.col("id") == F.col("l_id"), "left").select("id", "source", "cost", (F.col("quality") == 1).alias("authority"), (F.coalesce("toxic", F.lit(0)) == 0).alias("allowed"))


def _hits(spark, sf):
    return stage(L.lane_hits(index_of(spark, sf), L.lane_queries(questions(spark), word_pairs(spark)), _meta(spark, sf), limit=LIMIT), "lane_hits")


_LANED = _BM25.replace(
    _Q,
    _Q.replace("q as", "asked as") + rf""", w as (select query_id, regexp_extract_all(lower(text), '{WORDS}') w from asked), pairs as (select query_id, w[i] || ' ' || w[i + 1] text, min(i) i from w, unnest(range(1, len(w))) t(i) group by 1, 2),
    few as (select query_id, row_number() over (partition by query_id order by i, text) n, text from pairs), q as (select query_id * 100 query_id, text from asked union all select query_id * 100 + n, text from few where n <= 12)""",
)


@query(
    f"""with {_LANED}, f as (select doc_id, max(quality) quality, max(toxic) toxic from labels group by 1),
    a as (select query_id // 100 query_id, query_id % 100 n, doc_id, round(score, 9) score, hit = terms whole, unnest(case when query_id % 100 > 0 then ['supplement'] when quality = 1 then ['main', 'authority'] else ['main'] end) lane from s left join f using (doc_id) where coalesce(toxic, 0) = 0),
    b as (select *, bool_or(whole) over (partition by query_id, lane, n) any_whole from a),
    r as (select *, row_number() over (partition by query_id, lane, n order by score desc, doc_id) "rank" from b where whole or not any_whole)
    select query_id::int query_id, lane, n::int n, "rank"::int "rank", doc_id from r where "rank" <= case lane when 'main' then {LIMIT} when 'authority' then 20 else 4 end"""
)
def search_lanes(spark, sf):
    """LEX-2, LEX-11, RNK-4: the best of the question, of the question among authorities, and of its further questions, from one read of the postings."""
    return _hits(spark, sf).select("query_id", "lane", "n", "rank", F.col("id").alias("doc_id"))


def _merged(spark, sf, in_turns):
    hits = L.within_budget(_hits(spark, sf), BUDGET)
    texts = X.fetch(index_of(spark, sf), hits, "doc_id").select(F.col("doc_id").alias("id"), "text")
    return L.merged(hits, word_pairs(spark), texts, in_turns=in_turns)


@query()
def search_merged(spark, sf):
    """LEX-3, LEX-11: the lanes merged by position, what shows more of the probes first; tested against a loop."""
    return _merged(spark, sf, False).select("query_id", "position", "lane", "n", "rank", F.col("id").alias("doc_id"), "shown")


@query()
def search_packed(spark, sf):
    """LEX-11: the merged list under a limit and a token budget, lanes taken in turns; tested against a loop."""
    return L.packed(_merged(spark, sf, True), limit=LIMIT, budget=BUDGET).select("query_id", "pick", F.col("id").alias("doc_id"), "source", "cost")
