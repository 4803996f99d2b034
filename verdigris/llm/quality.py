"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another; each visit fits a shallow tree to the residuals' histogram over that
feature's bins and adds it, shrunk, to the feature's lookup table. The pairs of features that explain most of what is left
get tables of two dimensions the same way. A score is a sum of bins' values, added up for whole batches at once.

Features are counts over a whole text's bytes, words and lines. They are computed once for all documents and
written; at most `TRAIN_DOCS` labelled rows of them come to the driver to fit the model.

Defined cases: null and empty texts have features 0 and a score; without labelled rows of both kinds the score is the share
of label 1 (0.5 for no rows); null ids are scored, never learnt from; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table, uniform
from .toxicity import bucket

TRAIN_DOCS = 20_000
#: Bins of a feature, of each side of a pair, pairs, rounds of boosting, shrinkage.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 10, 150, 60, 0.1
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "space", "stops", "beyond_ascii", "distinct_words", "lines", "repeated_lines", "top_word", "shouts", "bars", "longest_word", "marked_words", "words_a_stop", "distinct_grams")

_SETS = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\=+_/", b" \t\n\r\x0b\x0c", b".,;:?", bytes(range(128, 256)), b"\n", b"!", b"|")):
    _SETS[list(_chars), _k] = 1


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.zeros(256)
    for at in range(0, n, 1 << 20):  # bincount takes eight bytes for each byte
        hist += np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, n - at), at), minlength=256)
    upper, digits, symbols, space, stops, beyond, feeds, shouts, bars = (hist @ _SETS).tolist()
    words = text.split()
    w = len(words)
    counts, lines = Counter(words), [x for x in text.split(b"\n") if x.strip()]
    solid = max(n - space, 1)
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?" for x in words)
    grams = len(set(zip(words, words[1:], words[2:])))
    ends = hist[46] + hist[63] + hist[33]
    return [
        float(np.log1p(n)), float(np.log1p(w)), solid / max(w, 1), upper / solid, digits / solid, symbols / solid, space / n, stops / solid, beyond / solid,
        len(counts) / max(w, 1), feeds / max(w, 1), 1 - len(set(lines)) / max(len(lines), 1), max(counts.values(), default=0) / max(w, 1), shouts / max(w, 1), bars / max(w, 1),
        float(np.log1p(max(map(len, words), default=0))), marked / max(w, 1), float(np.log1p(w / max(ends, 1))), grams / max(w - 2, 1),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], ["id", "x"])


def feature_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_features), f"id {dict(rows.dtypes)['id']}, x array<float>")


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, int]:
    """Gain and last bin on the left of a histogram's best split; -1 if none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[k]), k) if k >= 0 and gain[k] > 1e-9 else (0.0, -1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
    """A tree of so many leaves on a histogram, as a value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if k < 0:
            break
        parts.remove((a, b))
        parts += [(a, a + k + 1), (a + k + 1, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _square_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Two levels on a square histogram: a cut of one side, then of the other side within each half."""
    out, best = np.zeros_like(g), -1.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, k = _best_cut(a.sum(axis=1), b.sum(axis=1))
        k = k if k >= 0 else len(a) // 2 - 1
        value, gain = np.zeros_like(a), 0.0
        for rows in (slice(0, k + 1), slice(k + 1, None)):
            gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
            _, c = _best_cut(gs, hs)
            for cols in (slice(0, c + 1), slice(c + 1, None)):
                leaf_g, leaf_h = gs[cols].sum(), hs[cols].sum()
                gain += leaf_g**2 / (leaf_h + ridge)
                value[rows, cols] = leaf_g / (leaf_h + ridge)
        if gain > best:
            best, out = gain, value if axis == 0 else value.T
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Edges, lookup tables, pairs and their tables."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return {"base": float(np.log(p / (1 - p))), "edges": [], "tables": [], "pairs": [], "pair_edges": [], "pair_tables": []}
    n, k = x.shape
    grid = lambda bins: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    edges, coarse = grid(BINS), grid(PAIR_BINS)
    at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(k)]
    wide = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log(y.mean() / (1 - y.mean())))
    f_x = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-f_x))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[f], g, len(tables[f])), np.bincount(at[f], h, len(tables[f])))
            tables[f] += step
            f_x += step[at[f]]
    g, h = slopes()
    flat = lambda a, b: wide[a] * (len(coarse[b]) + 1) + wide[b]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)

    def square(a, b, v):
        r, c = shape(a, b)
        return np.bincount(flat(a, b), v, r * c).reshape(r, c)

    gains = []
    for a in range(k):
        for b in range(a + 1, k):
            gs, hs = square(a, b, g), square(a, b, h)
            gains.append((float((_square_tree(gs, hs) * gs).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _square_tree(square(a, b, g), square(a, b, h))
            pair_tables[i] += step
            f_x += step.ravel()[flat(a, b)]
    return {"base": base, "edges": edges, "tables": tables, "pairs": pairs, "pair_edges": coarse, "pair_tables": pair_tables}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model["base"])
    for f, (e, t) in enumerate(zip(model["edges"], model["tables"])):
        total += t[np.searchsorted(e, x[:, f], side="right")]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model["pair_edges"])]
    for (a, b), t in zip(model["pairs"], model["pair_tables"]):
        total += t[wide[a], wide[b]]
    return 1 / (1 + np.exp(-total))


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(model, x))], ["id", "score"])

    return run


def train(rows: DataFrame, labels: DataFrame, *, label="quality", folds: int = 3, held: int = 1, bound: int = TRAIN_DOCS, id_col="doc_id") -> dict:
    """rows (id, x), staged. The labels' sample is broadcast and collected: it is bounded."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("l_id").isNotNull() & F.col("y").isNotNull() & (bucket(F.col("l_id"), folds) != held))
    known = known.where(uniform(F.col("l_id"), seed=13) < min(1.0, bound / max(known.count(), 1)))
    got = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "x", "y").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def score(rows: DataFrame, model: dict) -> DataFrame:
    return rows.mapInArrow(lean(_scores(model)), f"id {dict(rows.dtypes)['id']}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(feature_rows(table(spark, sf_dir, "documents")), "quality_features")
    scored = score(rows, train(rows, table(spark, sf_dir, "labels")))
    held = F.coalesce(bucket(F.col("id"), 3) == 1, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
