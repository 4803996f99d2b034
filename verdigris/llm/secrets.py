"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over ASCII characters are estimated from labelled samples, one from random strings and one
from ordinary identifiers; a candidate is a secret if the log-likelihood ratio of its character pairs is high enough in
all and per pair. In `scan` the labelled samples come from the corpus itself: the distinct strings that the patterns
matched are random, all other words of all documents are ordinary, so counts grow with the corpus. Words are counted
before their pairs are. The models are two tables of 128 x 128 numbers, whatever the input. All work is done with
DataFrame functions.

Offsets are code points, ends exclusive. They are found without a user function: the strings between the matches of a
pattern (split) and the matches themselves (regexp_extract_all) alternate, so running sums of their lengths, taken block by block, are
offsets. The base patterns decide the base spans, which are scored by the models too; the models alone decide the added ones.

Defined cases: null and empty texts have no spans; without labelled samples both models are uniform and the method adds
nothing; repeated rows are scanned alike; texts are scanned whole.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: The base patterns. An assign match is dropped after matching if its value is shorter than 8.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")
#: What the models judge: whole runs of these characters. Runs of at least so many.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
LEAST = 16
ORDINARY = r"[A-Za-z0-9+/_=-]{3,}"
#: Log-likelihood ratio from which a candidate is a secret: in all, and per pair of characters.
TOTAL, PER_PAIR = 12.0, 0.5
CODES, SYMBOLS, MOST = 128, 67, (1 << 31) - 1


#: Elements of a block of a running fold.
BLOCK = 256


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: within a lambda an expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _before(a: Column, zero: Column, fold) -> Column:
    """For each element of an array the fold of those before it: folds of whole blocks, then of the rest of its own block.

    So an array of n elements takes n * (BLOCK + n / BLOCK**2) steps, not n * n.
    """

    def within(x: Column) -> Column:
        folded = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), zero, fold))
        bases = _bound(folded, lambda blocks: F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), zero, fold)))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return _bound(bases, lambda base: F.transform(x, lambda _, i: fold(F.get(base, block(i)), F.aggregate(F.slice(x, block(i) * BLOCK + 1, i % BLOCK), zero, fold))))

    return _bound(a, within)


def found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, rank, end, value>> of a pattern's leftmost non-overlapping matches, value being a group of them."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    parts = F.struct(lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(whole).alias("ml"), values.alias("values"))

    def span(m: Column, before: Column, value: Column, i: Column) -> Column:
        start = F.get(before, i) + F.get(m.gaps, i)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.get(m.ml, i)).alias("end"), value.alias("value"))

    def spans_of(m: Column) -> Column:
        both = F.zip_with(m["ml"], m["gaps"], lambda x, gap: F.coalesce(x, F.lit(0)) + gap)
        return _bound(_before(both, F.lit(0), lambda s, x: s + x), lambda before: F.transform(m["values"], lambda v, i: span(m, before, v, i)))

    spans = _bound(parts, spans_of)
    if least:
        spans = F.filter(spans, lambda s: F.length(s.value) >= least)
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def apart(base: Column, more: Column) -> Column:
    """Those of the model's candidates that overlap no base span: no earlier one ends, and no later one begins, within them."""
    model = KINDS.index("model")

    def kept(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(s.rank == model, 0).otherwise(s.end))
        starts = F.reverse(F.transform(every, lambda s: F.when(s.rank == model, MOST).otherwise(s.start)))
        upto = _before(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        after = F.reverse(_before(starts, F.lit(MOST), lambda a, b: F.least(a, b)))
        limits = F.struct(upto.alias("upto"), after.alias("after"))
        return _bound(limits, lambda m: F.filter(every, lambda s, i: (s.rank == model) & (F.get(m["upto"], i) <= s.start) & (F.get(m["after"], i) >= s.end)))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(_bound(F.array_sort(F.concat(base, more)), kept))


def pair_counts(samples: DataFrame) -> DataFrame:
    """samples (value, label, and times if not each once) -> label, pair (first code x 128 + second code), n: at most 2 x 128 x 128 rows."""
    samples = samples if "times" in samples.columns else samples.withColumn("times", F.lit(1))
    codes = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    rows = samples.where(F.length("value") > 1).select("label", "times", codes.alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * CODES + F.get("c", i + 1))
    return rows.select("label", "times", F.explode(pairs).alias("pair")).where(F.col("pair").between(0, CODES * CODES - 1)).groupBy("label", "pair").agg(F.sum("times").alias("n"))


def train(samples: DataFrame, prior: float = 20.0) -> np.ndarray:
    """Log ratio of each pair of characters, random over ordinary: 128 x 128 numbers. A character's successors are smoothed
    towards the model's characters in general, those towards uniform."""
    counts = np.zeros((2, CODES, CODES))
    for r in pair_counts(samples).collect():
        counts[int(r.label), r.pair // CODES, r.pair % CODES] = r.n
    general = counts.sum(axis=1, keepdims=True)
    general = (general + 1) / (general.sum(axis=2, keepdims=True) + SYMBOLS)
    p = (counts + prior * general) / (counts.sum(axis=2, keepdims=True) + prior)
    return np.log(p[1]) - np.log(p[0])


def score(value: Column, ratios: np.ndarray) -> Column:
    """The log-likelihood ratio of value's pairs of characters."""
    known = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios.ravel())), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    successors = lambda cs: F.transform(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))), lambda c, i: c * CODES + F.get(cs, i + 1))
    pairs = F.get(F.transform(F.array(codes), successors), F.lit(0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(F.get(known, p), F.lit(0.0)))


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", least: int = LEAST, total: float = TOTAL, per_pair: float = PER_PAIR, ratios: np.ndarray | None = None) -> DataFrame:
    """id, base and spans: array<struct<start, rank, end, value, llr>>, spans being the base ones and the model's, in order. llr is the
    log-likelihood ratio of a span's value, of base spans too."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = F.concat(found(F.col("text"), ASSIGN, "assign", 2, 8), found(F.col("text"), ACCESS, "access"), found(F.col("text"), HEX, "hex"))
    rows = stage(rows.select("id", base.alias("base"), found(F.col("text"), CANDIDATE % least, "model").alias("more")), "secret_candidates")
    ratios = train(samples(docs, rows, text_col)) if ratios is None else ratios
    scored = lambda spans: F.transform(spans, lambda s: s.withField("llr", score(s.value, ratios)))
    likely = F.filter(scored(apart(F.col("base"), F.col("more"))), lambda s: (s.llr >= total) & (s.llr >= per_pair * (F.length(s.value) - 1)))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string,llr:double>>)")
    rows = rows.select("id", F.when(F.size("base") > 0, F.array_sort(scored(F.col("base")))).otherwise(none).alias("base"), F.when(F.size("more") > 0, likely).otherwise(none).alias("more"))
    return rows.select("id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def samples(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """value, label, times: distinct strings that the patterns matched are 1, words outside those 0, as often as they occur."""
    random = rows.where(F.size("base") > 0).select(F.explode("base.value").alias("value")).distinct()
    text = F.col(text_col)
    for p in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, p, " ")
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("value"))
    plain = words.groupBy("value").agg(F.count("*").alias("times"))
    return random.select("value", F.lit(1).alias("label"), F.lit(1).cast("long").alias("times")).union(plain.select("value", F.lit(0).alias("label"), "times"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.rank), s.start.cast("string"), s.end.cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    n = [F.size(F.array_remove(F.transform("base", lambda s: F.when(s.rank == k, k).otherwise(-1)), -1)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select(F.col("id").alias("doc_id"), *n, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
