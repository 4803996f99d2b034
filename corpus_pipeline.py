"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. No SQL: model scores and hash ranks are not in it.

Defined cases, beside those of the operators: documents with null texts score the model's leak, form one group with blank ones, and hold no
benchmark window; null or shared ids are kept apart by text; an empty table gives an empty result at each stage; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.common import stage, table
from verdigris.llm.decontaminate import drop_contaminated
from verdigris.llm.mixing import mix_copies
from verdigris.llm.simhash import drop_near_duplicates
from verdigris.llm.tokens import token_output
from verdigris.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained model does not reject."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is taken."""
    return mix_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token files."""
    return token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
