"""Nearest vectors of a set of queries, by blocks: packed chunks of rows meet packed blocks of queries, each meeting is one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a chunk, and queries of a block.
CHUNK, BLOCK = 2048, 256


def pack(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """rows (id, v array<double>) -> chunks of up to so many vectors of one width: ids and matrix as bytes. Nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[int, list] = {}

        def chunk(width: int) -> pd.DataFrame:
            ids, v = zip(*left.pop(width))
            return pd.DataFrame([(width, np.array(ids, np.int64).tobytes(), np.array(v, np.float64).tobytes())], columns=[f"{prefix}_width", f"{prefix}_ids", f"{prefix}_v"])

        for frame in frames:
            for i, v in zip(frame["id"], frame["v"]):
                left.setdefault(len(v), []).append((i, v))
                if len(left[len(v)]) == size:
                    yield chunk(len(v))
        for width in list(left):
            yield chunk(width)

    return rows.where("id is not null and v is not null and size(v) > 0").mapInPandas(run, f"{prefix}_width int, {prefix}_ids binary, {prefix}_v binary")


def _scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    product = q @ v.T
    squares = lambda a: (a * a).sum(axis=1)
    if metric == "dot":
        return product
    if metric == "cosine":
        norm = np.sqrt(squares(q))[:, None] * np.sqrt(squares(v))[None, :]
        return np.divide(product, norm, out=np.zeros_like(product), where=norm > 0)
    return -np.sqrt(np.array([squares(v - row) for row in q]))  # by differences: near vectors stay exact


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """vectors, queries (id, v array<double>) -> query_id, id, score, rank: the k highest scores (cosine, dot, or the negated distance l2) of each query
    among the vectors of its width; ties, to nine decimals, go to smaller ids. Each meeting of a chunk and a block passes k rows a query on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                qi, vi = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.x_ids, np.int64)
                s = _scores(metric, np.frombuffer(r.q_v).reshape(len(qi), -1), np.frombuffer(r.x_v).reshape(len(vi), -1))
                n = min(k, len(vi))
                best = np.array([np.lexsort((vi, -np.round(row, 9)))[:n] for row in s])
                yield pd.DataFrame({"query_id": np.repeat(qi, n), "id": vi[best.ravel()], "score": np.take_along_axis(s, best, axis=1).ravel()})

    # A stated set of queries against all rows: every chunk is to meet every block.
    met = pack(vectors, CHUNK, "x").join(F.broadcast(pack(queries, BLOCK, "q")) if queries.count() <= 16 * BLOCK else pack(queries, BLOCK, "q"), F.col("x_width") == F.col("q_width"))
    found = met.mapInPandas(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
