"""Vector code compression: product codes whose nearest codebook entries are found by GNATs over the entries.

Integer vectors are cut into equal parts; each part position has a codebook of up to 256 entries, fitted by a few rounds of
assignment and componentwise floor means. A part's nearest entry is found in a geometric near-neighbour access tree: a node has
split points, its other entries hang below their nearest split point, and for each child and split point it stores the least and greatest distance
of the child's entries, the child's own split point included, to that split point. With a query's distance d to a split point and the least distance r found
so far, a child whose range lies strictly beyond [d - r, d + r] holds no nearer and no equal entry and is left out as a whole, split point included.

Squared distances are exact integers and alone decide, ties to the lower index; square roots serve the ranges only. They are rounded, so a child is left
out only if it is farther by more than `SLACK` of the numbers that are compared: an equal distance is never lost.

Rows are dealt as the table lies: codebooks go out to the tasks (4 x 256 entries), each task returns one partial sum for each part, entry and component,
and these meet by key. Nothing of the rows comes to the driver but the first codebook and the sums.

Defined cases: vectors that are null or hold null or non-finite components take no part; a null id keeps its row, after all others in the order of
ids, equal ids are ordered by their vectors; shorter vectors count as padded with zeros, and the width is rounded up to whole parts; with fewer rows than entries the
codebook is smaller; empty vectors have the code of the first entries and error 0; an empty table gives an empty result. Components beyond 2**62 count
as 2**62 with their sign; errors are added exactly, those that a long cannot hold are returned as its greatest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_join, stage, table, unused
from .mtree import LARGEST, LONG

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Split points of a node; entries up to which a node is a leaf.
DEGREE, LEAF = 8, 6
#: What rounding may add to distances, as a part of the numbers that are compared.
SLACK = 1e-9
#: Rows that are searched at once.
BLOCK = 4096
SUMS = "part int, entry int, pos int, n long, high long, low long"
CODED = "vec_id long, label int, code string, error decimal(38,0)"


def integer_rows(rows: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", scale: int = 1024) -> DataFrame:
    """id, label, v: floor(scale * x) of the usable vectors."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), x.alias("x")).where("x is not null")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))), F.lit(-LARGEST)), F.lit(LARGEST))
    return rows.select("id", "label", F.transform("x", held).alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column as rows of width, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _exact(a: np.ndarray, greatest: int) -> np.ndarray:
    """a in a type whose squared distances are exact: floats while they are whole numbers below 2**53, else Python's integers."""
    return a.astype(np.float64) if 4 * greatest * greatest * max(1, a.shape[-1]) < 1 << 53 else a.astype(object)


def _squares(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    d = q - e
    return (d * d).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class _Found:
    """The least squared distance of each query, and the lowest entry at it."""

    def __init__(self, q: np.ndarray):
        self.q, self.d, self.at, self.computed = q, np.full(len(q), np.inf, dtype=q.dtype), np.full(len(q), ENTRIES), 0

    def offer(self, rows: np.ndarray, d: np.ndarray, entry: int) -> None:
        self.computed += len(rows)
        better = (d < self.d[rows]) | ((d == self.d[rows]) & (entry < self.at[rows]))
        self.d[rows[better]], self.at[rows[better]] = d[better], entry


class Gnat:
    """A tree over the rows of a codebook; entries are named by their indexes there."""

    def __init__(self, entries: np.ndarray, mine: np.ndarray | None = None):
        mine = np.arange(len(entries)) if mine is None else mine
        self.entries, self.leaf = entries, mine if len(mine) <= LEAF else None
        if self.leaf is not None:
            return
        chosen, least = [int(mine[0])], _squares(entries[mine], entries[mine[0]])
        while len(chosen) < DEGREE and least.max() > 0:  # each far from those before
            chosen.append(int(mine[int(least.argmax())]))
            least = np.minimum(least, _squares(entries[mine], entries[chosen[-1]]))
        if len(chosen) == 1:  # equal entries only: the lowest is the nearest of them
            self.leaf = mine[:1]
            return
        apart = np.array([_squares(entries[mine], entries[s]) for s in chosen])
        near = apart.argmin(axis=0)
        near[np.searchsorted(mine, chosen)] = np.arange(len(chosen))
        self.splits, distances = chosen, _root(apart)
        self.low = np.array([[distances[i, near == j].min() for j in range(len(chosen))] for i in range(len(chosen))])
        self.high = np.array([[distances[i, near == j].max() for j in range(len(chosen))] for i in range(len(chosen))])
        below = [np.setdiff1d(mine[near == j], chosen) for j in range(len(chosen))]
        self.children = [Gnat(entries, b) if len(b) else None for b in below]

    def search(self, found: _Found, rows: np.ndarray) -> None:
        if self.leaf is not None:
            for e in self.leaf.tolist():
                found.offer(rows, _squares(found.q[rows], self.entries[e]), e)
            return
        k = len(self.splits)
        open_, known = np.ones((len(rows), k), dtype=bool), np.full((len(rows), k), np.nan)
        for i, s in enumerate(self.splits):
            asked = np.flatnonzero(open_[:, i])
            d = _squares(found.q[rows[asked]], self.entries[s])
            found.offer(rows[asked], d, s)
            known[asked, i] = _root(d)
            open_[asked] &= ~self._beyond(i, known[asked, i], _root(found.d[rows[asked]]))
        home = np.where(np.isnan(known), np.inf, known).argmin(axis=1)
        for first in (True, False):  # the nearest split point's child, then the others that are left
            for j, child in enumerate(self.children):
                asked = np.flatnonzero(open_[:, j] & ((home == j) == first))
                if child is None or not len(asked):
                    continue
                r = _root(found.d[rows[asked]])
                out = np.zeros(len(asked), dtype=bool)
                for i in range(k):
                    d = known[asked, i]
                    out |= ~np.isnan(d) & self._beyond(i, d, r)[:, j]
                child.search(found, rows[asked[~out]])

    def _beyond(self, i: int, d: np.ndarray, r: np.ndarray) -> np.ndarray:
        """For each query and child, whether the child's distances to split point i are strictly beyond d - r and d + r, whatever rounding did."""
        low, high, d, r = self.low[i][None, :], self.high[i][None, :], d[:, None], r[:, None]
        slack = SLACK * (d + r + high)
        return (d - r > high + slack) | (d + r < low - slack)


def _greatest(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


class Book:
    """A codebook with its tree, which is made once and goes out to the tasks."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.greatest = entries, _greatest(entries)
        self.tree = Gnat(_exact(entries, self.greatest))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row of q the nearest entry and the squared distance to it; and how many distances were computed."""
        greatest = max(self.greatest, _greatest(q))
        found, held = _Found(_exact(q, greatest)), _exact(self.entries, greatest)
        (self.tree if self.tree.entries.dtype == held.dtype else Gnat(held)).search(found, np.arange(len(q)))
        return found.at, found.d, found.computed


def _parts(batch: pa.RecordBatch, column: int, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors; rows of very large components are apart, so that others keep the fast numbers."""
    parts, _, width = books.shape
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(at, BLOCK)
        v = matrix(rows.column(column), parts * width)
        large = (v > 1 << 22).any(axis=1) | (v < -(1 << 22)).any(axis=1)
        for some in (np.flatnonzero(~large), np.flatnonzero(large)):
            if len(some):
                yield rows.take(pa.array(some)), v[some]


def _sums(books: np.ndarray):
    parts, n, width = books.shape
    own_books = [Book(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, n), dtype=np.int64)
        high, low = np.zeros((2, parts, n, width), dtype=np.int64)
        for batch in batches:
            for _, v in _parts(batch, 0, books):
                for p in range(parts):
                    own = v[:, p * width : (p + 1) * width]
                    at = own_books[p].nearest(own)[0]
                    count[p] += np.bincount(at, minlength=n)
                    np.add.at(high[p], at, own >> 31)
                    np.add.at(low[p], at, own & ((1 << 31) - 1))
        p, e = np.nonzero(count)
        if len(p):
            # An entry without components still has its count, at position -1.
            pos = np.arange(-1, width)
            sums = [np.concatenate((np.zeros((len(p), 1), dtype=np.int64), x[p, e]), axis=1).ravel() for x in (high, low)]
            columns = [np.repeat(p, width + 1).astype(np.int32), np.repeat(e, width + 1).astype(np.int32), np.tile(pos, len(p)).astype(np.int32), np.repeat(count[p, e], width + 1), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "pos", "n", "high", "low"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape
    own_books = [Book(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for rows, v in _parts(batch, 2, books):
                found = [own_books[p].nearest(v[:, p * width : (p + 1) * width])[:2] for p in range(parts)]
                code = ["".join(f"{x:02x}" for x in row) for row in np.column_stack([f[0] for f in found]).tolist()]
                error = [Decimal(sum(int(x) for x in row)) for row in zip(*(f[1].tolist() for f in found))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code), pa.array(error, pa.decimal128(38, 0))], ["vec_id", "label", "code", "error"])

    return run


def updated(books: np.ndarray, sums: list) -> np.ndarray:
    """Entries replaced by the componentwise floor means of their parts; those without parts stay. sums: rows part, entry, pos, n, high, low."""
    books = books.copy()
    for r in sums:
        if r.pos >= 0:
            books[r.part, r.entry, r.pos] = ((int(r.high) << 31) + int(r.low)) // int(r.n)
    return books


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width of a part: the vectors of the smallest ids, cut."""
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    width = -(-width // parts)
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    v = matrix(pa.array([r.v for r in rows], pa.list_(pa.int64())), parts * width)
    return np.ascontiguousarray(v.reshape(len(rows), parts, width).transpose(1, 0, 2))


def fit(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of vectors (id, v), staged: parts x entries x width."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        sums = vectors.select("v").mapInArrow(lean(_sums(books)), SUMS).groupBy("part", "entry", "pos").agg(total("n"), total("high"), total("low"))
        books = updated(books, sums.collect())  # a row for each component of an entry, whatever the input
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of the usable vectors, staged; and the codebooks. error is the squared distance, a decimal."""
    vectors = stage(integer_rows(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale), "gnat_vectors")
    books = fit(vectors.select("id", "v"), parts=parts, entries=entries, rounds=rounds)
    if not books.shape[1]:
        return rows.sparkSession.createDataFrame([], CODED), books
    return stage(vectors.select("id", "label", "v").mapInArrow(lean(_codes(books)), CODED), "gnat_codes"), books


def label_errors(coded: DataFrame, *, label_col="label", error_col="error") -> DataFrame:
    """coded and label_error: the errors added over equal labels, nulls together. Sums are made before any row is moved."""
    key, total = unused(coded, "key", "label_error")
    sums = stage(coded.groupBy(F.col(label_col).alias(key)).agg(F.sum(error_col).alias(total)), "gnat_labels")
    return small_join(coded, sums, F.col(label_col).eqNullSafe(F.col(key))).drop(key)


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    held = lambda c: F.least(F.col(c), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias(c)
    return label_errors(coded).select("vec_id", "code", held("error"), held("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Assignments and means in turn, each a common table."""
    assign = """a{k} as materialized (select p.vec_id, p.part, arg_min(b.entry, (d, b.entry)) entry, min(d) d from p join b{k} b using (part),
  lateral (select (list_inner_product(p.e, p.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(p.e, b.e))::bigint d) group by all)"""
    means = """b{j} as materialized (select part, entry, coalesce(m.e, b{k}.e) e from b{k} left join (select part, entry, list(floor(s / c)::double order by pos) e from
  (select a.part, a.entry, u.pos, sum(p.e[u.pos])::double s, count(*) c from a{k} a join p using (vec_id, part), lateral (select unnest(range(1, len(p.e) + 1)) pos) u group by all) group by all) m using (part, entry))"""
    steps = [assign.format(k=0)]
    for k in range(ROUNDS):
        steps += [means.format(k=k, j=k + 1), assign.format(k=k + 1)]
    return f"""
with v as materialized (select vec_id, label, [floor(1024 * x::double)::double for x in embedding] e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
p as materialized (select vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] e from v, (select unnest(range({PARTS})) part)),
b0 as materialized (select part, rank() over (partition by part order by vec_id) - 1 entry, e from p where vec_id in (select vec_id from v order by vec_id limit {ENTRIES})),
{",".join(steps)},
c as (select vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) code, sum(d)::bigint error from a{ROUNDS} group by all),
h as (select sha256(string_agg(array_to_string([x::bigint for x in e], ','), ',' order by part, entry)) h from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from c join v using (vec_id), h
"""


OP11_SQL = _sql()
