"""Exact top-k search by best-first search of M-trees.

Integer vectors are searched for the highest inner products. A node covers its rows with a ball: a routing vector c and a covering
radius r, the greatest Euclidean distance of a row to c. No row x of the ball has a higher inner product with a query q than
<q, c> + |q| r, since <q, x - c> is at most |q| |x - c|; nor than |q| times the ball's greatest norm. The stored distance of an entry to its node's routing
vector p gives by the triangle inequality the same bound without the entry's vector: <q, p> + |q| (d(p, c) + r).

The rows are dealt to trees of about `TREE_ROWS` by their nearest of a few pivots, which are taken from a bounded sample
(`PIVOT_SAMPLE` rows); a pivot with more rows has several trees. Each tree is loaded in bulk, by groups around means, and written as pages: a node
is a row with its routing vector, covering radius, and its entries' vectors, radii and distances to the routing vector. A query is
first searched in the tree of the highest bound; its k-th best score then bounds every other tree, and trees whose
root's bound is lower are not visited. Within a tree nodes are visited in the order of their bounds, and an entry's
inner product is not computed where its stored parent distance already excludes it.
Bounds only exclude; scores are exact integers, ties go to smaller ids.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count as padded
with zeros; equal vectors and rows are all candidates; fewer candidates than k give all; an empty table gives nothing; null ids
take no part, they could not be named. Components beyond 2**62 count as 2**62 (with their sign); scores are compared exactly, those that a long cannot
hold are returned as its greatest or least value.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

TREE_ROWS, PIVOT_SAMPLE, MOST_PIVOTS = 8192, 4096, 1024
#: Entries of a page; queries that one task searches a tree for.
PAGE, QUERY_BLOCK = 96, 256
NODE = "tree string, node int, leaf boolean, routing binary, radius double, norm double, ids binary, vectors binary, radii binary, norms binary, to_parent binary"
#: Components, and results, are held within these; float64 is exact up to EXACT.
LARGEST, LONG, EXACT = 1 << 62, (1 << 63) - 1, float(1 << 53)
#: What rounding may add to a bound, as a part of the numbers that make it.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = 1024) -> DataFrame:
    """id, v: floor(scale * x) of the usable vectors."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))), F.lit(-LARGEST)), F.lit(LARGEST))
    return rows.select("id", F.transform("x", held).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of a's rows to b's, rounded: they only deal rows out."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _to(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of a's rows to one vector, by differences: exact but for a few last digits."""
    d = a - c
    return np.sqrt((d * d).sum(axis=1))


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=1))


def exact_scores(vectors: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of integer vectors as whole numbers of any size."""
    f, g = vectors.astype(float), q.astype(float)
    if len(f) and float((np.abs(f) @ np.abs(g)).max()) < EXACT:
        return np.rint(f @ g).astype(np.int64).tolist()
    own = q.tolist()
    return [sum(x * y for x, y in zip(v, own)) for v in vectors.tolist()]


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of n groups of the sample: a few rounds of k-means, from rows each far from those before."""
    least, centres = _to(sample, sample[0]), [sample[0]]
    while len(centres) < n and least.max() > 0:
        centres.append(sample[int(least.argmax())])
        least = np.minimum(least, _to(sample, centres[-1]))
    centres = np.array(centres)
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


def _dealt(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _distances(_matrix(batch.column(1).to_pylist(), width).astype(float), pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64())], ["id", "v", "pivot"])

    return run


class _Loader:
    """Bulk loading: groups around means, until a group fits a page."""

    def __init__(self, tree: str, ids: np.ndarray, v: np.ndarray):
        self.tree, self.ids, self.v, self.f, self.rows = tree, ids, v, v.astype(float), []

    def load(self, mine: np.ndarray) -> tuple[int, np.ndarray, float, float]:
        """Writes the node of the rows, and all below it; its number, routing vector, covering radius and greatest norm."""
        v = self.f[mine]
        routing = v[np.argmin(_to(v, v.mean(axis=0)))]
        d = _to(v, routing)
        radius, norm, number = float(d.max()), float(_norms(v).max()), len(self.rows)
        self.rows.append(None)
        if len(mine) <= PAGE or radius == 0:
            order = np.argsort(d, kind="stable")
            self.rows[number] = (self.tree, number, True, routing.tobytes(), radius, norm, self.ids[mine[order]].tobytes(), self.v[mine[order]].tobytes(), b"", _norms(v[order]).tobytes(), d[order].tobytes())
            return number, routing, radius, norm
        near = _distances(v, choose_pivots(v, min(PAGE, math.ceil(len(mine) / (PAGE // 2))), 3)).argmin(axis=1)
        if (near == near[0]).all():  # centres that do not part the rows
            near = (np.argsort(np.argsort(d, kind="stable")) >= len(d) // 2).astype(int)
        below = [self.load(mine[near == g]) for g in np.unique(near)]
        vectors = np.array([b[1] for b in below])
        self.rows[number] = (self.tree, number, False, routing.tobytes(), radius, norm, np.array([b[0] for b in below], dtype=np.int64).tobytes(), vectors.tobytes(), np.array([b[2] for b in below]).tobytes(), np.array([b[3] for b in below]).tobytes(), _to(vectors, routing).tobytes())
        return number, routing, radius, norm


def _load(width: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        loader = _Loader(key[0], rows["id"].to_numpy(dtype=np.int64), _matrix(rows["v"].tolist(), width))
        loader.load(np.arange(len(rows)))
        return pd.DataFrame(loader.rows, columns=[x.split()[0] for x in NODE.split(", ")])

    return run


@dataclass
class Page:
    leaf: bool
    routing: np.ndarray
    radius: float
    norm: float
    ids: np.ndarray
    vectors: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    to_parent: np.ndarray

    @classmethod
    def of(cls, r, width: int) -> Page:
        ids, to_parent = np.frombuffer(r.ids, np.int64), np.frombuffer(r.to_parent)
        vectors = np.frombuffer(r.vectors, np.int64 if r.leaf else np.float64).reshape(len(ids), width)
        return cls(r.leaf, np.frombuffer(r.routing), r.radius, r.norm, ids, vectors, np.zeros(len(ids)) if r.leaf else np.frombuffer(r.radii), np.frombuffer(r.norms), to_parent)


def upper(product, size: float, radius, norm):
    """The highest inner product with a query of norm size in a ball, from that with its centre: never too low by rounding."""
    return np.minimum(product + size * radius, size * norm) + SLACK * (size * norm + np.abs(product) + 1)


def search_tree(nodes: dict[int, Page], q: np.ndarray, own: int, k: int, bound: float, seen: dict | None = None) -> list[tuple[int, int]]:
    """The (score, id) of up to k best rows of a tree for a query, none that is surely below the bound. seen counts pages and products."""
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
    f = q.astype(float)
    size = float(np.sqrt(f @ f))
    least = lambda: bound if len(best) < k else max(bound, float(best[0][0]))
    root = nodes[0]
    product = float(root.routing @ f)
    queue = [(-float(upper(product, size, root.radius, root.norm)), 0, product)]
    while queue:
        high, number, product = heapq.heappop(queue)
        limit = least()
        if -high < limit:
            break
        page = nodes[number]
        keep = np.flatnonzero(upper(product, size, page.to_parent + page.radii, page.norms) >= limit)
        if seen is not None:
            seen["pages"] = seen.get("pages", 0) + 1
            seen["products"] = seen.get("products", 0) + len(keep)
        if not len(keep):
            continue
        if page.leaf:
            for s, i in zip(exact_scores(page.vectors[keep], q), page.ids[keep].tolist()):
                if i != own and (len(best) < k or (s, -i) > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
        else:
            products = page.vectors[keep] @ f
            highs = upper(products, size, page.radii[keep], page.norms[keep])
            for h, i, x in zip(highs.tolist(), page.ids[keep].tolist(), products.tolist()):
                if h >= limit:
                    heapq.heappush(queue, (-h, i, x))
    return [(s, -i) for s, i in best]


def _search(width: int, k: int):
    def run(key: tuple, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(pages) and len(queries):
            nodes = {r.node: Page.of(r, width) for r in pages.itertuples()}
            for r in queries.itertuples():
                found += [(r.id, i, str(s)) for s, i in search_tree(nodes, _matrix([r.v], width)[0], r.id, k, r.bound)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def _meet(nodes: DataFrame, pairs: DataFrame, width: int, k: int) -> DataFrame:
    """pairs (tree, id, v, bound), staged: each tree's pages meet its queries, in blocks of them."""
    blocks = pairs.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    pages = nodes.join(blocks, "tree").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")
    asked = pairs.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    found = pages.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(_search(width, k), "query_id long, vec_id long, score string")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(roots: list[tuple], vs: list, width: int) -> np.ndarray:
    """Of each query in each tree the highest inner product that its root allows."""
    centres, radii, norms = np.array([np.frombuffer(r[1]) for r in roots]), np.array([r[2] for r in roots]), np.array([r[3] for r in roots])
    q = _matrix(vs, width).astype(float)
    return upper(q @ centres.T, _norms(q)[:, None], radii[None, :], norms[None, :])


def _likeliest(roots: list[tuple], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = _bounds(roots, batch.column(1).to_pylist(), width)
            best = high.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([roots[t][0] for t in best]), pa.array(high[np.arange(len(best)), best])], ["id", "v", "home", "high"])

    return run


def _other_trees(roots: list[tuple], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs, bounds, homes = (batch.column(k).to_pylist() for k in range(4))
            rows = [(roots[t][0], i, v, b) for i, v, b, home, high in zip(ids, vs, bounds, homes, _bounds(roots, vs, width)) for t in np.flatnonzero(high >= b) if roots[t][0] != home]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.float64()))], ["tree", "id", "v", "bound"])

    return run


def build_trees(vectors: DataFrame, width: int) -> DataFrame:
    """vectors (id, v), staged -> the pages of all trees, written to the shared folder."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    pivots = choose_pivots(_matrix(sample.tolist(), width).astype(float), min(MOST_PIVOTS, math.ceil(n / TREE_ROWS)))
    dealt = stage(vectors.mapInArrow(_dealt(pivots, width), "id long, v array<long>, pivot long"), "mtree_dealt")
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / TREE_ROWS).alias("trees")).withColumnRenamed("pivot", "p")  # MOST_PIVOTS rows at most
    dealt = dealt.join(F.broadcast(sizes), F.col("pivot") == F.col("p"))
    dealt = dealt.withColumn("tree", F.concat_ws("/", F.col("pivot").cast("string"), F.pmod(F.xxhash64("id"), F.col("trees")).cast("string")))
    return stage(dealt.select("tree", "id", "v").groupBy("tree").applyInPandas(_load(width), NODE), "mtree_pages")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries (id, v) -> query_id, rank, vec_id, score: for each query the k highest inner products with other ids."""
    spark = vectors.sparkSession
    vectors = stage(vectors, "mtree_vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    nodes = build_trees(vectors, width)
    trees = nodes.where("node = 0").select("tree", "routing", "radius", "norm")
    queries = stage(queries.where(F.size("v") <= width), "mtree_queries")
    # Roots are one small row for each TREE_ROWS vectors; they go to the tasks in parts, so that no part grows with the input.
    every = trees.select(F.pmod(F.xxhash64("tree"), F.lit(max(1, trees.count() // 4096))).alias("part"), "*")
    parts = [r.part for r in every.select("part").distinct().collect()]
    roots_of = lambda part: [tuple(r) for r in every.where(F.col("part") == part).select("tree", "routing", "radius", "norm").collect()]
    homes = None
    for part in parts:
        near = queries.mapInArrow(_likeliest(roots_of(part), width), "id long, v array<long>, home string, high double")
        homes = near if homes is None else homes.union(near)
    homes = stage(homes.groupBy("id", "v").agg(F.max_by("home", F.struct("high", "home")).alias("home")), "mtree_homes")
    first = stage(_meet(nodes, homes.select(F.col("home").alias("tree"), "id", "v", F.lit(float("-inf")).alias("bound")), width, k), "mtree_first")
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("got"))
    bound = F.when(F.col("got") >= k, F.col("kth")).otherwise(float("-inf"))
    asked = stage(homes.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", bound.alias("bound"), "home"), "mtree_asked")
    pairs = None
    for part in parts:
        more = asked.mapInArrow(_other_trees(roots_of(part), width), "tree string, id long, v array<long>, bound double")
        pairs = more if pairs is None else pairs.union(more)
    rest = _meet(nodes, stage(pairs, "mtree_pairs"), width, k)
    held = F.greatest(F.least(F.col("score"), F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long")
    return _best(first.union(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", held.alias("score"))


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("id % 100 = 0"))


OP10_SQL = """
with v as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] e from embeddings
  where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::bigint score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as "rank" from s)
select query_id, "rank"::int as "rank", vec_id, score from r where "rank" <= 10
"""
