"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's probability is logistic in the words, and beginnings of words, that it holds; a document is toxic unless none of its sentences is, with
a leak for what words do not explain: 1 - (1 - leak) * prod(1 - p_s). Only documents are labelled; the likelihood of
their labels trains the sentence weights, which then locate offending sentences.

The labelled rows that train are at most `TRAIN_DOCS`, taken by a hash of the id. Words that become features are found
by counting over those in Spark (`FEATURES` at most); bags of feature numbers, no texts, come to the driver, where a
few hundred gradient steps fit the model. Scoring is one pass over all documents.

Defined cases: null and empty texts have no sentence and score the leak; without labelled rows of both kinds every score
is the share of toxic ones (0 for none); ids that are null are scored, never learnt from; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, uniform

#: Bound of the labelled rows that train, and of the words that become features.
TRAIN_DOCS = 20_000
FEATURES = 400
#: Documents that a word is in at least, and its z-score at least.
LEAST_DOCS, LEAST_Z = 8, 4.0
RUN = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of a longer word that are features besides the word: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers; a full memory is emptied.
REMEMBERED = 100_000


def sentences(text: str) -> list[re.Match]:
    """Runs between the marks that end sentences, but those of white space alone."""
    return [m for m in RUN.finditer(text) if not m[0].isspace()]


def forms(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if k < len(word))]


def bucket(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, id_col: str, text_col: str) -> DataFrame:
    """text, y of at most about `bound` labelled documents outside the held-out fold. The labels' sample is broadcast: it is bounded."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("l_id").isNotNull() & F.col("y").isNotNull() & (bucket(F.col("l_id"), folds) != held))
    known = known.where(uniform(F.col("l_id"), seed=11) < min(1.0, bound / max(known.count(), 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("text", "y")


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, toxic = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            words = {f for w in set(WORD.findall((text.as_py() or "").lower())) for f in forms(w)}
            words.add("")  # counts the documents
            (toxic if y else n).update(words)
        if len(n) + len(toxic) > 150_000:
            yield _counted(n, toxic)
            n, toxic = Counter(), Counter()
    yield _counted(n, toxic)


def _counted(n: Counter, toxic: Counter) -> pa.RecordBatch:
    words = list(n.keys() | toxic.keys())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([n[w] for w in words], pa.int64())], ["word", "toxic", "clean"])


def choose_words(rows: DataFrame, features: int = FEATURES) -> list[str]:
    """The words that toxic documents hold more often, by the z-score of the log odds ratio; a bounded list."""
    counts = rows.mapInArrow(lean(_document_words), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    every = counts.where("word = ''").first()
    if not every or not every.a or not every.b:
        return []
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (every.a - F.col("a") + 0.5)) - F.log(b / (every.b - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = counts.where("word <> ''").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "word").limit(features)
    return [r.word for r in best.select("word").collect()]


def _bags(words: list[str]):
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, bags = [], []
            for text in batch.column(0):
                found = [sorted({number[f] for w in WORD.findall(m[0].lower()) for f in forms(w) if f in number}) for m in sentences(text.as_py() or "")]
                plain.append(sum(not f for f in found))
                bags.append([f for f in found if f])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(plain, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["y", "plain", "bags"])

    return run


def fit(bags: list[tuple[int, int, list[list[int]]]], features: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """(y, sentences without a feature, features of the others) -> weights, bias and leak by Adam on the noisy-or likelihood."""
    y = np.array([b[0] for b in bags], dtype=float)
    plain = np.array([b[1] for b in bags], dtype=float)
    doc_of = np.array([d for d, b in enumerate(bags) for _ in b[2]], dtype=np.int64)
    sentence_of = np.array([s for s, f in enumerate(f for b in bags for f in b[2]) for _ in f], dtype=np.int64)
    feature = np.array([x for b in bags for f in b[2] for x in f], dtype=np.int64)
    n, m = len(bags), len(doc_of)
    mean = min(max(y.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    theta = np.concatenate((np.full(features, 1.0), [-6.0, np.log(mean / (1 - mean))]))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, leak = theta[:features], theta[-2], theta[-1]
        z = bias + np.bincount(sentence_of, weights=w[feature], minlength=m)
        # log(1 - p) = -softplus(z); d/dz = -p
        p = 1 / (1 + np.exp(-z))
        p0, pl = 1 / (1 + np.exp(-bias)), 1 / (1 + np.exp(-leak))
        log_none = -np.logaddexp(0, leak) - plain * np.logaddexp(0, bias) - np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=n)
        none = np.exp(log_none)
        # likelihood: y log(1 - none) + (1 - y) log none; slope against log_none
        slope = (1 - y) - y * none / np.maximum(1 - none, 1e-9)
        gz = -slope[doc_of] * p
        grad = np.concatenate((np.bincount(feature, weights=gz[sentence_of], minlength=features), [gz.sum() - (slope * plain).sum() * p0, -slope.sum() * pl])) / max(n, 1)
        grad[:features] -= ridge * w / max(features, 1)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return {"weights": theta[:features].tolist(), "bias": float(theta[-2]), "leak": float(1 / (1 + np.exp(-theta[-1])))}


def train(docs: DataFrame, labels: DataFrame, *, label="toxic", folds: int = 5, held: int = 0, bound: int = TRAIN_DOCS, features: int = FEATURES, id_col="doc_id", text_col="text") -> dict:
    rows = training_rows(docs, labels, label, folds, held, bound, id_col, text_col)
    words = choose_words(rows, features)
    if not words:
        share = rows.agg(F.avg("y")).first()[0] or 0.0
        return {"words": [], "weights": [], "bias": -50.0, "leak": float(share)}
    bags = rows.mapInArrow(lean(_bags(words)), "y int, plain int, bags array<array<int>>").collect()
    return {"words": words} | fit([(b.y, b.plain, b.bags) for b in bags], len(words))


class Scorer:
    def __init__(self, model: dict):
        self.weight = dict(zip(model["words"], model["weights"]))
        self.bias, self.leak = model["bias"], model["leak"]
        self.plain = float(-np.logaddexp(0, self.bias))
        self.known: dict[str, tuple[str, ...]] = {}

    def features(self, words: set[str]) -> set[str]:
        known, out = self.known, set()
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                f = known[w] = tuple(x for x in forms(w) if x in self.weight)
            if f:
                out.update(f)
        return out

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        """A document's probability, and its sentences that are likelier toxic than not."""
        spans, log_none, weight = [], float(np.log1p(-min(self.leak, 1 - 1e-12))), self.weight
        if not self.features(set(WORD.findall(text.lower()))):
            return -float(np.expm1(log_none + self.plain * len(sentences(text)))), spans
        for m in sentences(text):
            z = self.bias + sum(weight[f] for f in sorted(self.features(set(WORD.findall(m[0].lower())))))
            log_none -= float(np.logaddexp(0, z))
            if z >= 0:
                spans.append({"start": m.start(), "end": m.end(), "score": float(1 / (1 + np.exp(-z)))})
        return -float(np.expm1(log_none)), spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([min(max(f[0], 0.0), 1.0) for f in found], pa.float64()), pa.array([f[1] for f in found], SPANS)], ["id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: dict, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, score, sentences (start, end, score of those likelier toxic than not) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(lean(_scores(model)), f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: dict, *, text_col="text", threshold: float = 0.5) -> DataFrame:
    """docs without the documents whose score reaches the threshold; columns are passed on, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py() or "")[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(bucket(F.col("id"), 5) == 0, F.lit(False))
    return rows.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
