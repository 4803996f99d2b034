"""Source divergence audit: how far the smoothed word frequencies of each language's sources lie apart, and by which terms.

The distance of two sources depends, for each term, only on its two counts. So a block of terms is written as a one-hot matrix: a column
for each (group, count level), level zero included, with one 1 for each term and group. Its transpose times itself holds the joint table of every two groups:
how many terms have count c in one and d in the other. The tables are priced cell by cell with the exact frequencies of their levels, and the
priced sums of all blocks add up to the distances; no table leaves its block. Products are of 0/1 numbers in blocks of `TERMS` terms,
of `GROUPS` by `GROUPS` groups and of `COLUMNS` columns, so they are exact and a task's memory has a bound whatever the vocabulary, the number of groups and
their counts are. A term that no group of a block pair has is priced at level zero by its number.

Words are counted within the tasks before anything is shuffled, groups without terms included; every later table is of terms, groups or pairs of groups.

Defined cases: null texts, languages and sources count as empty strings; every row is a document of its own, repeated rows too; a language without kept
terms has distances of 0 and no term rows; a language's only source has no pairs; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_join, stage, table

#: A kept term's documents, what smoothing adds to a count, the scale of frequencies, and the ranks of terms that are reported.
LEAST_DOCS, PRIOR, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block, groups of a block, columns of a product.
TERMS, GROUPS, COLUMNS = 256, 64, 4096
#: Terms that a task holds before it passes them on.
HELD = 400_000
#: Terms are runs of ASCII letters, lower-cased, and of everything beyond ASCII: all other bytes become blanks.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: A term's count and its documents are added up in one number.
DOCS = 1 << 40


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            words = pa.array([None, *terms], pa.binary()).cast(pa.string())
            both = [0, *terms.values()]
            numbers = [pa.array([x >> 40 for x in both], pa.int64()), pa.array([x & (DOCS - 1) for x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(both)), pa.array([source] * len(both)), words, *numbers], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            own = held.setdefault((lang, source), {})
            before = len(own)
            for term, n in Counter(text.as_py().translate(LETTERS).split(b" ")).items():
                own[term] = own.get(term, 0) + n * DOCS + 1
            own.pop(b"", None)
            size += len(own) - before
            if size > HELD:
                yield from passed_on()
                size = 0
    yield from passed_on()


def term_counts(docs: DataFrame, *, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term; a row with a null term for each group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    rows = rows.mapInArrow(lean(_counted), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact."""
    return F.expr(f"1 + ({SCALE} * (cast({n} as decimal(20,0)) + {PRIOR})) div (cast({total} as decimal(20,0)) + {PRIOR} * {terms})")


def priced_products(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of terms, for the group blocks a and b: rows gb, source, term, n, p, where a row without term stands for the group, p being that of level zero -> lang, source, item, value, terms."""
    own = frame["term"].isna().to_numpy()
    groups = frame[own].drop_duplicates("source").sort_values(["gb", "source"], kind="stable")
    names, side = groups["source"].tolist(), groups["gb"].to_numpy()
    of = pd.Index(names).get_indexer(frame["source"])
    term, universe = pd.factorize(frame["term"])
    # Columns: the (group, level) that occur, by group and level; a group's first is level zero.
    level = frame["n"].to_numpy(dtype=np.int64)
    order = np.lexsort((level, of))
    new = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (level[order][1:] != level[order][:-1])))
    column = np.empty(len(frame), dtype=np.int64)
    column[order] = np.cumsum(new) - 1
    firsts = order[new]
    price, group = frame["p"].to_numpy(dtype=np.int64)[firsts], of[firsts]
    starts = np.searchsorted(group, np.arange(len(names)))
    hot = np.zeros((len(universe), len(price)), dtype=np.float32)
    hot[:, starts] = 1
    hot[term[~own], starts[of[~own]]] = 0
    hot[term[~own], column[~own]] = 1
    ends, out = np.append(starts, len(price))[1:], []
    first, second = frame["a"].iloc[0], frame["b"].iloc[0]
    for g in np.flatnonzero(side == first).tolist():
        others = np.flatnonzero(side == second) if first != second else np.arange(g + 1, len(names))
        if not len(others):
            continue
        sums, at = [], int(starts[others[0]])
        left, left_price = hot[:, starts[g] : ends[g]].T, price[starts[g] : ends[g], None]
        for a in range(at, len(price), COLUMNS):
            joint = left @ hot[:, a : a + COLUMNS]
            sums.append((joint.astype(np.int64) * np.abs(left_price - price[None, a : a + COLUMNS])).sum(axis=0))
        values = np.add.reduceat(np.concatenate(sums), starts[others] - at)
        out += [(names[g], names[h], int(v)) for h, v in zip(others.tolist(), values.tolist())]
    return pd.DataFrame(out, columns=["source", "item", "value"]).astype({"value": "int64"}).assign(lang=frame["lang"].iloc[0], terms=len(universe))[["lang", "source", "item", "value", "terms"]]


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """counts (lang, source, term, n, p) of kept terms, groups (lang, source, terms, p0), both staged -> lang, source, item, value: for all ordered pairs of groups."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).alias("gbs"), F.ceil(F.max("terms") / TERMS).alias("tbs")).withColumnRenamed("lang", "l")
    blocks = stage(blocks, "audit_blocks")
    in_block = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.col(n), F.lit(1))).cast("int")
    known = small_join(counts, blocks, F.col("lang") == F.col("l")).select("lang", "gbs", in_block("term", "tbs").alias("tb"), in_block("source", "gbs").alias("gb"), "source", "term", "n", "p")
    zero = small_join(groups, blocks, F.col("lang") == F.col("l")).where("tbs > 0")
    zero = zero.select("lang", "gbs", F.explode(F.sequence(F.lit(0), F.col("tbs").cast("int") - 1)).alias("tb"), in_block("source", "gbs").alias("gb"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"))
    dealt = known.union(zero).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gbs").cast("int") - 1)))
    dealt = dealt.select("lang", "tb", F.least("gb", "other").alias("a"), F.greatest("gb", "other").alias("b"), "gb", "source", "term", "n", "p")
    sums = dealt.groupBy("lang", "tb", "a", "b").applyInPandas(priced_products, "lang string, source string, item string, value long, terms long")
    sums = stage(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("met")), "audit_sums")
    both = sums.union(sums.select("lang", "item", "source", "value", "met")).toDF("l", "s", "i", "v", "met")
    other = groups.select(F.col("lang").alias("l2"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = small_join(groups, other, (F.col("lang") == F.col("l2")) & (F.col("source") != F.col("item")), "inner")
    pairs = pairs.join(both, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")) & (F.col("item") == F.col("i")), "left")
    rest = (F.col("terms") - F.coalesce("met", F.lit(0))) * F.abs(F.col("p0") - F.col("q0"))
    return pairs.select("lang", "source", "item", (F.coalesce("v", F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value"))


def audit(docs: DataFrame, *, text_col="text", lang_col="lang", source_col="source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all distances to the language's other sources (part pair), and the terms that a source uses most above its language (part term)."""
    counts = stage(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "audit_counts")
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stage(of_lang.where(F.col("docs") >= least_docs).select(F.col("lang").alias("kl"), F.col("term").alias("kt"), F.col("n").alias("kn")), "audit_kept")
    langs = stage(kept.groupBy(F.col("kl").alias("l")).agg(F.count("*").alias("terms"), F.sum("kn").alias("lang_total")), "audit_langs")
    own = stage(counts.join(kept, (F.col("lang") == F.col("kl")) & (F.col("term") == F.col("kt"))).select("lang", "source", "term", "n", "kn"), "audit_own")
    totals = own.groupBy(F.col("lang").alias("tl"), F.col("source").alias("ts")).agg(F.sum("n").alias("total"))
    groups = small_join(counts.where("term is null").select("lang", "source"), langs, F.col("lang") == F.col("l"))
    groups = groups.join(totals, (F.col("lang") == F.col("tl")) & (F.col("source") == F.col("ts")), "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"), "lang_total")
    groups = stage(groups.withColumn("p0", F.when(F.col("terms") > 0, frequency("0", "total", "terms"))), "audit_groups")
    right = groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "terms", "total", "lang_total")
    priced = small_join(own, right, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs")), "inner")
    priced = stage(priced.select("lang", "source", "term", "n", frequency("n", "total", "terms").alias("p"), frequency("kn", "lang_total", "terms").alias("q")), "audit_priced")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(distances(priced.drop("q"), groups.select("lang", "source", "terms", "p0")), "pair")
    above = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.union(ranked(above, "term").where(F.col("rank") <= top_terms))


def op12_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as materialized (select row_number() over () row, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms from documents),
t as materialized (select row, lang, source, unnest(terms) term from d),
k as materialized (select lang, term, count(*) n from t group by all having count(distinct row) >= 30),
v as materialized (select lang, count(*) v, sum(n) n from k group by all),
g as materialized (select distinct d.lang, d.source, v.v, v.n lang_n from d left join v using (lang)),
o as materialized (select lang, source, term, count(*) n from t semi join k using (lang, term) group by all),
s as materialized (select lang, source, sum(n) n from o group by all),
p as materialized (select g.lang, g.source, k.term, coalesce(o.n, 0) c,
  1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * g.v) p, 1 + (1000000000::hugeint * (k.n + 5)) // (g.lang_n + 5 * g.v) q
  from g join k using (lang) left join o using (lang, source, term) left join s using (lang, source)),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.f, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
every as (select *, row_number() over (partition by lang, source order by "value" desc, item) "rank" from pairs
  union all select * from (select lang, source, 'term' part, term item, (p - q)::bigint "value", row_number() over (partition by lang, source order by p - q desc, term) "rank" from p where c > 0 and p > q) where "rank" <= 50)
select lang, source, part, item, "value", "rank"::int "rank" from every
"""
