"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores a posting (term, document, position) for every occurrence, in the training documents, of a term
that the test items hold; segments, one per task, are sorted by term, so that a term's lists are read without the
others. A document's length is kept as a posting of the empty term. Phrases are found by intersecting lists
whose positions are adjusted by the term's offset: each window of consecutive item words starts from its rarest term's list
(its second rarest next), and only the alignments that survive meet the lists of the remaining terms. Windows with a term
that no document holds are dropped at once.

Everything is DataFrame functions. Test-side tables are broadcast only if a count of their rows allows it; else the same
joins are shuffled.

Defined cases: null and empty texts have no words; items without words have no window, items of fewer words than a window
are one window; equal items hit alike; rows that share id and text share a result; null document ids keep their row; items
with a null id make hits but are in no list of items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_join, stage, table, unused

#: What separates words (before or after lower-casing A-Z, which are word characters here), and A-Z to a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)
#: The document-length list's term.
LENGTH = -1


def words(text: Column) -> Column:
    """Words of a text, not yet in lower case."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


@dataclass
class Index:
    """vocabulary (term, tid), postings (tid, d, h, pos): a document is its id and its text's hash."""

    vocabulary: DataFrame
    postings: DataFrame


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """it, item_id, n, p, term: a row for each word of each item."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).distinct()
    rows = stage(rows.where(F.size("w") > 0).withColumn("it", F.monotonically_increasing_id()), "leak_items")
    return rows.select("it", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word")).select("it", "item_id", "n", "p", lower_ascii(F.col("word")).alias("term"))


def build_index(docs: DataFrame, terms: DataFrame, *, id_col="doc_id", text_col="text") -> Index:
    """Postings of docs for the terms (column term), and the lengths of all docs."""
    vocabulary = terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id())
    vocabulary = stage(vocabulary.union(docs.sparkSession.createDataFrame([("", LENGTH)], "term string, tid long").coalesce(1)), "leak_terms")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col(text_col)).alias("h"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    rows = rows.select("d", "h", F.posexplode("w").alias("pos", "word")).select("d", "h", "pos", lower_ascii(F.col("word")).alias("word"))
    postings = small_join(rows, vocabulary, F.col("word") == F.col("term"), "inner").select("tid", "d", "h", "pos")
    return Index(vocabulary, stage(postings.sortWithinPartitions("tid", "d", "pos"), "leak_postings"))


def windows(items: DataFrame, index: Index, size: int) -> DataFrame:
    """it, item_id, n, l, s, p1, t1, p2, t2, inside (p, tid, cf of its words): for each window that can occur, its rarest and second rarest term."""
    counts = index.postings.where(F.col("tid") != LENGTH).groupBy("tid").agg(F.count("*").alias("cf"))
    counts = stage(counts, "leak_counts")
    known = index.vocabulary.where(F.col("tid") != LENGTH).join(counts, "tid", "left").withColumnRenamed("term", "known")
    rows = small_join(items, stage(known, "leak_known"), F.col("term") == F.col("known"))
    size_ = F.least(F.lit(size), F.col("n"))
    # A window is a frame over the item's words, so that a long item is not copied for each of its windows.
    frame = Window.partitionBy("it").orderBy("p").rowsBetween(0, size - 1)
    rows = rows.select("it", "item_id", "n", size_.alias("l"), F.col("p").alias("s"), F.collect_list(F.struct("p", "tid", "cf")).over(frame).alias("inside")).where(F.size("inside") == F.col("l"))
    inside = F.col("inside")
    rare = F.array_sort(F.transform(inside, lambda x: F.struct(x.cf.alias("cf"), x.p.alias("p"), x.tid.alias("tid"))))
    rows = rows.where(~F.exists(inside, lambda x: x.cf.isNull())).withColumn("rare", rare)
    second = F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))
    return rows.select("it", "item_id", "n", "l", "s", F.get("rare", F.lit(0)).p.alias("p1"), F.get("rare", F.lit(0)).tid.alias("t1"), second.p.alias("p2"), second.tid.alias("t2"), "inside")


def phrase_hits(index: Index, items: DataFrame, size: int = 10) -> DataFrame:
    """d, h, it, item_id, starts (item positions of windows that occur), shift (document position minus item position)."""
    found = stage(windows(items, index, size), "leak_windows")
    postings = index.postings
    # The rarest term's list, adjusted by its offset in the item: below zero where a document begins inside an item.
    first = stage(found.select("t1", "it", "p1").distinct(), "leak_first")
    aligned = small_join(postings, first, F.col("tid") == F.col("t1"), "inner").select("d", "h", "it", "p1", (F.col("pos") - F.col("p1")).alias("shift"))
    # Intersected with the second rarest's.
    second = stage(found.select("t2", "it", "p1", "p2").distinct(), "leak_second")
    other = small_join(postings, second.select("t2", F.col("it").alias("it2"), F.col("p1").alias("q1"), "p2"), F.col("tid") == F.col("t2"), "inner")
    other = other.select(F.col("d").alias("d2"), F.col("h").alias("h2"), "it2", "q1", "p2", (F.col("pos") - F.col("p2")).alias("shift2"))
    both = aligned.join(other, (F.col("d") == F.col("d2")) & (F.col("shift") == F.col("shift2")) & (F.col("it") == F.col("it2")) & (F.col("p1") == F.col("q1")) & (F.col("h") == F.col("h2")))
    both = stage(both.select("d", "h", "it", "shift", "p1", "p2").distinct(), "leak_aligned")
    # The survivors meet the lists of the other terms of their windows.
    parts = found.select(F.col("it").alias("i"), F.col("p1").alias("a"), F.col("p2").alias("b"), F.explode("inside").alias("x")).select("i", "a", "b", F.col("x.p").alias("p"), F.col("x.tid").alias("want")).distinct()
    wanted = small_join(both, stage(parts, "leak_parts"), (F.col("it") == F.col("i")) & (F.col("p1") == F.col("a")) & (F.col("p2") == F.col("b")), "inner")
    wanted = wanted.select("d", "h", "it", "shift", "p", "want", (F.col("p") + F.col("shift")).alias("at")).distinct()
    seen = stage(both.select(F.col("d").alias("sd"), F.col("h").alias("sh")).distinct(), "leak_seen")
    lists = small_join(postings, seen, (F.col("d") == F.col("sd")) & (F.col("h") == F.col("sh")), "left_semi").select(F.col("d").alias("d2"), F.col("h").alias("h2"), "tid", "pos").distinct()
    met = wanted.join(lists, (F.col("d") == F.col("d2")) & (F.col("at") == F.col("pos")) & (F.col("want") == F.col("tid")) & (F.col("h") == F.col("h2")))
    runs = met.groupBy("d", "h", "it", "shift").agg(F.collect_set("p").alias("ps"))
    sizes = items.select(F.col("it").alias("i"), "item_id", F.least(F.lit(size), F.col("n")).alias("l")).distinct()
    runs = small_join(runs, stage(sizes, "leak_sizes"), F.col("it") == F.col("i"), "inner").drop("i")
    # Of ascending positions, those begin a whole window whose l-1st successor is l-1 words on.
    whole = F.filter("ps", lambda s, i: F.coalesce(F.get("ps", i + F.col("l") - 1) == s + F.col("l") - 1, F.lit(False)))
    return runs.withColumn("ps", F.array_sort("ps")).withColumn("starts", whole).where(F.size("starts") > 0).select("d", "h", "it", "item_id", "l", "shift", "starts")


def proximity_matches(index: Index, phrases: DataFrame, slop: int, *, id_col="item_id", text_col="text") -> DataFrame:
    """item_id, doc_id, pos: places of a phrase's rarest term with all its other distinct terms at most slop words away."""
    terms = item_terms(phrases, id_col, text_col).select("it", "item_id", "term").distinct()
    counts = index.postings.groupBy("tid").agg(F.count("*").alias("cf"))
    terms = small_join(terms, stage(index.vocabulary.join(counts, "tid", "left").withColumnRenamed("term", "known"), "near_known"), F.col("term") == F.col("known"))
    all_of = Window.partitionBy("it")
    terms = terms.withColumn("m", F.count("*").over(all_of)).withColumn("rank", F.row_number().over(all_of.orderBy(F.coalesce("cf", F.lit(0)), "term")))
    terms = stage(terms.select("it", "item_id", "tid", "m", "rank"), "near_terms")
    lists = small_join(index.postings, terms.withColumnRenamed("tid", "t"), F.col("tid") == F.col("t"), "inner")
    anchors = lists.where("rank = 1").select("it", "item_id", "m", "d", "h", "pos", F.explode(F.array(*[(F.floor(F.col("pos") / (slop + 1)) + k) for k in (-1, 0, 1)])).alias("cell"))
    others = lists.select(F.col("it").alias("it2"), F.col("d").alias("d2"), F.col("h").alias("h2"), "rank", F.col("pos").alias("pos2"), F.floor(F.col("pos") / (slop + 1)).alias("cell2"))
    near = anchors.join(others, (F.col("it") == F.col("it2")) & (F.col("d") == F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("cell") == F.col("cell2")) & (F.abs(F.col("pos") - F.col("pos2")) <= slop))
    near = near.groupBy("it", "item_id", "m", "d", "h", "pos").agg(F.count_distinct("rank").alias("got")).where("got = m")
    return near.select("item_id", F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "pos")


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 10, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text") -> DataFrame:
    """d, h, doc_id, n_words, n_hit, items (sorted ids of items with windows in the document), for every row of docs."""
    items = stage(item_terms(items, item_id_col, item_text_col), "leak_item_terms")
    index = build_index(docs, items, id_col=id_col, text_col=text_col)
    hits = stage(phrase_hits(index, items, size), "leak_hits")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s + F.col("shift"), s + F.col("shift") + F.col("l") - 1))))
    spots = hits.select("d", "h", F.explode(covered).alias("at")).distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    which = hits.groupBy("d", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per = spots.join(which, ["d", "h"]).select(F.col("d").alias("d2"), F.col("h").alias("h2"), "n_hit", "items")
    lengths = index.postings.where(F.col("tid") == LENGTH).select("d", "h", F.col("pos").cast("long").alias("n_words"))
    rows = small_join(lengths, stage(per, "leak_found"), (F.col("d") == F.col("d2")) & (F.col("h") == F.col("h2"))).drop("d2", "h2")
    return rows.select("d", "h", F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs' own rows and columns without the documents that hold a window of an item."""
    d, h = unused(docs, "bad_d", "bad_h")
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select(F.col("d").alias(d), F.col("h").alias(h)).distinct()
    mine = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(d)) & (F.xxhash64(F.col(text_col)) == F.col(h))
    return small_join(docs, stage(bad, "leak_bad"), mine, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Split points of the character class are spelled out: DuckDB's regular expressions know the same escapes.
OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bl as (select *, least(len(w), 10) l from b where len(w) > 0),
bw as (select item_id, l, array_to_string(w[s:s + l - 1], ' ') g from (select *, unnest(range(1, len(w) - l + 2)) s from bl)),
sizes as (select distinct l from bw),
dw as (select doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) s from d, sizes where len(w) >= l)),
hit as (select doc_id, s, dw.l, item_id from dw join bw on dw.g = bw.g and dw.l = bw.l),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + l)) p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hit group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
