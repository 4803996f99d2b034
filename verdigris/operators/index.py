"""A stored lexical index: postings by bucket of their term, document frequencies, statistics, and the documents by bucket of their id.

`build` writes it once per generation of a corpus; a search then reads the row groups of its own terms, and `fetch` those of the documents that it
found, whatever the corpus holds. A term's postings are parted by id ranges as well, so that no task writes a frequent term alone.

`build_for` is the index of a corpus that is asked a few questions once: it holds all postings of the questions' terms, and nothing of others. It reads the texts once, shuffles
only those postings, and copies no document. A search for a term that it was not built for is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import tokens
from .retrieval import K1, LISTED_TERMS, B, query_terms

#: Buckets of terms and of documents; a larger corpus wants more.
BUCKETS = 32
#: Weights of the columns of a text's record.
WEIGHTS = {"title": 6.0, "body": 2.0, "source": 0.5}


#: Columns of the stored tables; those of the store are the documents' own.
SCHEMAS = {"postings": "id {id}, len int, record_len int, term string, tf int, weighted double, bucket int", "terms": "term string, df bigint, record_df bigint, bucket int", "stats": "docs bigint, len double, record_len double"}


@dataclass
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    id_type: str = "bigint"
    store_schema: StructType | None = None
    #: The terms that it was built for, all if None; and the documents, where they lie in a table of their own.
    only: frozenset[str] | None = None
    docs: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        """A stored table; its schema is known, so that an empty one can be read too."""
        if name == "store" and self.docs is not None:
            return self.docs
        schema = self.store_schema if name == "store" else SCHEMAS[name].format(id=self.id_type)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def _bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, *, id_col="doc_id", body: Column | None = None, title: Column | None = None, source: Column | None = None, buckets: int = BUCKETS, store: bool = True) -> Index:
    """Writes under path: store (docs' columns; not where the documents lie in a table of their own), postings (term, id, tf of the body, weighted frequency, lengths), terms, stats."""
    spark = docs.sparkSession
    body, title, source = (F.col("text") if body is None else body), (F.lit("") if title is None else title), (F.lit("") if source is None else source)
    rows = docs.withColumn("_id", F.col(id_col)).withColumn("_body", tokens(body)).withColumn("_title", tokens(title)).withColumn("_source", tokens(source.cast("string")))
    if store:
        kept = docs.withColumn("bucket", _bucket(F.col(id_col), buckets)).repartition("bucket", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(4)))
        kept.sortWithinPartitions("bucket", id_col).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/store")
    field = lambda name, number: F.transform(F.coalesce(F.col(f"_{name}"), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(number).alias("field")))
    every = F.concat(field("body", 0), field("title", 1), field("source", 2))
    length = F.coalesce(F.size("_body"), F.lit(0)) + F.coalesce(F.size("_title"), F.lit(0)) + F.coalesce(F.size("_source"), F.lit(0))
    words = rows.select(F.col("_id").alias("id"), F.size("_body").alias("len"), length.alias("record_len"), F.explode(every).alias("x")).select("id", "len", "record_len", "x.*")
    weight = F.when(F.col("field") == 0, WEIGHTS["body"]).when(F.col("field") == 1, WEIGHTS["title"]).otherwise(WEIGHTS["source"])
    postings = words.groupBy("id", "len", "record_len", "term").agg(F.count_if(F.col("field") == 0).cast("int").alias("tf"), F.sum(weight).alias("weighted"))
    postings = postings.withColumn("bucket", _bucket(F.col("term"), buckets))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    postings.repartitionByRange(parts, "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(spark, path, buckets, dict(rows.dtypes)["_id"], StructType([*docs.schema.fields, StructField("bucket", IntegerType())]))
    counts = index.table("postings").groupBy("bucket", "term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.count("*").alias("record_df"))
    counts.repartition(max(1, buckets // 8), "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    lengths = rows.agg(F.count("*").alias("docs"), F.avg(F.size("_body")).alias("len"), F.avg(length).alias("record_len"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return index


def counted(docs: DataFrame, terms: list[str], *, body: Column | None = None, title: Column | None = None, source: Column | None = None) -> DataFrame:
    """docs with _len, _record_len and _found (array of term, tf, weighted): what `build_for` stores, counted in the row."""
    body, title, source = (F.col("text") if body is None else body), (F.lit("") if title is None else title), (F.lit("") if source is None else source)
    names = {"_body": body, "_title": title, "_source": source.cast("string")}
    rows = docs.withColumns({k: tokens(v) for k, v in names.items()})
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    mine = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isin(terms))
    rows = rows.select(*docs.columns, F.size("_body").alias("_len"), (size("_body") + size("_title") + size("_source")).alias("_record_len"), *[mine(F.col(k)).alias(k) for k in names])
    times = lambda k, t: F.size(F.filter(k, lambda x: x == t))
    every = F.array_distinct(F.concat(*names))
    weighted = lambda t: times("_body", t) * WEIGHTS["body"] + times("_title", t) * WEIGHTS["title"] + times("_source", t) * WEIGHTS["source"]
    found = F.transform(every, lambda t: F.struct(t.alias("term"), times("_body", t).alias("tf"), weighted(t).alias("weighted")))
    return rows.withColumn("_found", found).drop(*names)


def build_for(docs: DataFrame, path: str, terms: list[str], *, id_col="doc_id", store: DataFrame | None = None, buckets: int = BUCKETS) -> Index:
    """docs (of `counted`, which is computed once) -> the index of these terms under path; documents are fetched from store."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), "_len", "_record_len", "_found")
    rows.write.mode("overwrite").parquet(f"{path}/counted")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/counted")
    words = rows.select("id", F.col("_len").alias("len"), F.col("_record_len").alias("record_len"), F.explode("_found").alias("x")).select("id", "len", "record_len", "x.*")
    postings = words.groupBy("id", "len", "record_len", "term").agg(F.sum("tf").cast("int").alias("tf"), F.sum("weighted").alias("weighted"))
    postings.withColumn("bucket", _bucket(F.col("term"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(spark, path, buckets, dict(rows.dtypes)["id"], only=frozenset(terms), docs=store)
    counts = index.table("postings").groupBy("bucket", "term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.count("*").alias("record_df"))
    counts.coalesce(1).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    lengths = rows.agg(F.count("*").alias("docs"), F.avg("_len").alias("len"), F.avg("_record_len").alias("record_len"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return index


def terms_of(queries: DataFrame) -> list[str]:
    """The distinct terms of a few queries, in order."""
    return sorted(r.term for r in query_terms(queries).select("term").distinct().collect())


def _of_terms(index: Index, name: str, terms: DataFrame) -> DataFrame:
    """Rows of a table that belong to the terms (column term): by their buckets, and by value where they can be listed."""
    named = [(r.term, r.bucket) for r in terms.select("term").distinct().withColumn("bucket", _bucket(F.col("term"), index.buckets)).limit(LISTED_TERMS + 1).collect()]
    if index.only is not None and (more := {t for t, _ in named} - index.only):
        raise ValueError(f"the index was not built for {sorted(more)[:5]}")
    rows = index.table(name)
    if len(named) > LISTED_TERMS:
        return rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.where(F.col("bucket").isin(sorted({b for _, b in named})) & F.col("term").isin([t for t, _ in named]))


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, qf, terms, df, record_df, and the postings of every query's terms."""
    terms = query_terms(queries)
    known = terms.join(_of_terms(index, "terms", terms).select("term", "df", "record_df"), "term")
    return _of_terms(index, "postings", terms).drop("bucket").join(F.broadcast(known), "term")


def bm25(index: Index, queries: DataFrame, *, conjunctive: bool = False, flag: bool = False) -> DataFrame:
    """query_id, id, score of every document whose body holds any (all, if conjunctive) of a query's terms; with flag also whether it holds all."""
    stats = index.table("stats").first()
    idf = F.log(1 + (F.lit(float(stats.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(stats.len or 1.0))))
    found = matches(index, queries).where("tf > 0").groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("hit"), F.first("terms").alias("terms"))
    found = found.where("hit = terms") if conjunctive else found
    return found.select("query_id", "id", "score", *([(F.col("hit") == F.col("terms")).alias("full")] if flag else []))


def weighted_bm25(index: Index, queries: DataFrame, *, fall_back: bool = True) -> DataFrame:
    """query_id, id, cost (lower is better), full of records that hold all of a query's terms in any column; a query that none
    holds all of takes those with any. Title, body and source count by WEIGHTS, lengths are the records'."""
    stats = index.table("stats").first()
    idf = F.greatest(F.log((F.lit(float(stats.docs)) - F.col("record_df") + 0.5) / (F.col("record_df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("weighted") * (K1 + 1) / (F.col("weighted") + K1 * (1 - B + B * F.col("record_len") / F.lit(float(stats.record_len or 1.0))))
    found = matches(index, queries).groupBy("query_id", "id").agg((-F.sum(part)).alias("cost"), (F.count("*") == F.first("terms")).alias("full"))
    if not fall_back:
        return found.where("full")
    whole = found.where("full").select(F.col("query_id").alias("q")).distinct()
    return found.join(F.broadcast(whole), F.col("query_id") == F.col("q"), "left").where("full or q is null").drop("q")


def fetch(index: Index, ids: DataFrame, id_col: str) -> DataFrame:
    """The stored documents of a bounded set of ids (column id): their buckets alone are read."""
    wanted = ids.select("id").distinct()
    known = [r.id for r in wanted.limit(LISTED_TERMS + 1).collect()]
    store = index.table("store")
    if len(known) > LISTED_TERMS:
        return store.join(wanted, F.col(id_col) == F.col("id"), "left_semi").drop("bucket")
    if index.docs is not None:
        return store.where(F.col(id_col).isin(known))
    of = [r.b for r in wanted.select(_bucket(F.col("id"), index.buckets).alias("b")).distinct().collect()]
    return store.where(F.col("bucket").isin(of) & F.col(id_col).isin(known)).drop("bucket")
