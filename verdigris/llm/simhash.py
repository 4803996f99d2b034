"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most tau bits agree, for any thresholds e_1..e_m of m disjoint partitions of the bits
with sum(e_i + 1) = tau + 1, to within e_i bits in some partition i (e_i = -1: never looked at). Correlated bits
are grouped into one partition, so that the skew they cause can be given no threshold at all. Dynamic
programming allocates the thresholds on estimated candidate counts, for each of a few m, and the cheapest plan
is used: every distinct fingerprint is indexed under its partitions' values, probes are the values within e_i bits,
and candidates that meet are verified on all bits.

Equal fingerprints are one class before any search. A bucket whose probes times entries pass `BUCKET_PAIRS` is not
paired: its members are linked exactly by another way, through the values within half of tau bits of them (for two bits the 65 values
within one bit: two fingerprints are within two bits if and only if they share such a value, and a value has at most 65
owners; so tau is at most `GREATEST_TAU`, beyond which a value would have too many). The links' components are the same either way; no group is expanded into all its pairs and no partner is lost.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer than three words are
one shingle; an empty table gives an empty result; rows with equal ids share a component through that id only if
their fingerprints do; null ids take part but never name a component with other ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, lean, stage, table, unused
from .similar import band_keys
from .similar import links as similar_links

WIDTH = 64
#: Probes times entries of a bucket up to which its pairs are verified one by one.
BUCKET_PAIRS = 1024
#: Greatest radius: a fingerprint has 2,081 values within half of 4 bits, and 43,745 within half of 6.
GREATEST_TAU = 4
#: Numbers of partitions that are tried.
PARTITIONS = (2, 3, 4)


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of a whole text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[: 1 - size or None].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer."""
    n, ones = len(hashes), np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text's word shingles; zero without words."""
    return majority(shingle_hashes(text, size, seed))


def _fingerprints(size: int, seed: int, hashed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for t in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", size, seed)
                fps.append(majority(hashes))
                if hashed:
                    keys.append(band_keys(hashes))
            more = [batch.column(2), pa.array(keys, pa.list_(pa.int64()))] if hashed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *more], ["id", "fp", "h", "keys"][: 2 + len(more)])

    return run


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 3, seed: int = 42, hashed: bool = False) -> DataFrame:
    """id, fp of every row, and if hashed its text's hash h and its band keys."""
    hashes = [F.xxhash64(F.col(text_col)).alias("h")] if hashed else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *hashes)
    return rows.mapInArrow(lean(_fingerprints(size, seed, hashed)), "id long, fp long" + ", h long, keys array<long>" * hashed)


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((WIDTH, WIDTH), dtype=np.int64), 0
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, WIDTH).astype(np.float64)
        both += (bits.T @ bits).astype(np.int64)
        n += len(fp)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(WIDTH), WIDTH)), pa.array(np.tile(np.arange(WIDTH), WIDTH)), pa.array(both.ravel())], ["i", "j", "n"])


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown from a bit by the highest mean correlation."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(WIDTH)), []
    for k in range(m):
        size = WIDTH // m + (k < WIDTH % m)
        rest = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(rest.sum(axis=1)))]]
        while len(group) < size:
            pool = [b for b in left if b not in group]
            group.append(pool[int(np.argmax(corr[np.ix_(pool, group)].mean(axis=1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Credits e_i + 1 for each partition, total in all, at the least sum of costs[i][credits]: dynamic programming."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for credit in range(total - used + 1):
                if (x := c + cost[credit]) < step.get(used + credit, (float("inf"),))[0]:
                    step[used + credit] = (x, [*chosen, credit])
        best = step
    return best[total]


def _mask(group: list[int]) -> int:
    m = sum(1 << b for b in group)
    return m - (1 << 64) if m >> 63 else m


def _signed(b: int) -> int:
    return -(1 << 63) if b == 63 else 1 << b


def plan_partitions(distinct: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, e) of the partitions that are looked at. 4096 counts and a few sums come to the driver, no fingerprints."""
    counts = distinct.mapInArrow(lean(_co_occurrence), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((WIDTH, WIDTH))
    for r in counts:
        both[r.i, r.j] = r.n
    n = distinct.count()
    tried = {m: group_bits(both, n, m) for m in PARTITIONS}
    masks = [(m, k, _mask(g)) for m, groups in tried.items() for k, g in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for m, k, x in masks]))
    squares = distinct.select(keys.alias("x")).select("x.*").groupBy("m", "k", "key").count().groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("n")).collect()
    exact = {(r.m, r.k): r.n for r in squares}
    p = np.diag(both) / max(n, 1)
    plans = []
    for m, groups in tried.items():
        costs = []
        for k, group in enumerate(groups):
            # Probability that two fingerprints differ in 0, 1, .. bits of the group, if bits were independent: it scales the exact count.
            differ = np.zeros(tau + 1)
            differ[0] = 1
            for b in group:
                d = 2 * p[b] * (1 - p[b])
                differ = differ * (1 - d) + np.concatenate(([0], differ[:-1])) * d
            upto = np.cumsum(differ) / max(differ[0], 1e-300)
            ball = np.cumsum([comb(len(group), e) for e in range(tau + 1)])
            costs.append([0.0] + [min(exact.get((m, k), 0.0) * upto[e], float(n) * n) + float(n) * ball[e] for e in range(tau + 1)])
        cost, credits = allocate(costs, tau + 1)
        plans.append((cost, [(g, c - 1) for g, c in zip(groups, credits) if c]))
    return min(plans, key=lambda x: x[0])[1]


def _ball(bits: list[int], e: int) -> list[int]:
    """Differences of up to e of the bits, as masks."""
    from itertools import combinations

    out = []
    for k in range(e + 1):
        for chosen in combinations(bits, k):
            x = 0
            for b in chosen:
                x ^= _signed(b)
            out.append(x)
    return out


def _neighbours(fps: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within tau bits, without their pairs: by shared values.

    Two fingerprints are within tau bits if and only if a value is within tau // 2 bits of one and tau - tau // 2 of the other. All that are within
    the wider radius of a value are linked to one within the narrower.
    """
    wide, narrow = tau - tau // 2, tau // 2
    near = lambda e: F.transform(F.array(*[F.lit(x) for x in _ball(list(range(WIDTH)), e)]), lambda x: x.bitwiseXOR(F.col("fp")))
    owners = fps.select("fp", F.explode(near(wide)).alias("value"))
    if narrow == wide:
        owners = owners.withColumn("centre", F.lit(True))
    else:
        owners = owners.withColumn("centre", F.bit_count(F.col("fp").bitwiseXOR(F.col("value"))) <= narrow)
    owners = owners.groupBy("value").agg(F.collect_list("fp").alias("all"), F.min(F.when(F.col("centre"), F.col("fp"))).alias("a")).where("size(`all`) > 1 and a is not null")
    return owners.select("a", F.explode("all").alias("b")).where("a <> b")


def links(distinct: DataFrame, tau: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, staged) whose components are those of all pairs within tau bits."""
    if not 0 <= tau <= GREATEST_TAU:
        raise ValueError(f"tau is {tau}; it can be 0 to {GREATEST_TAU}")
    parts = plan_partitions(distinct, tau)
    entry = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for k, (g, _) in enumerate(parts)]
    probe = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).bitwiseXOR(F.lit(x)).alias("key")) for k, (g, e) in enumerate(parts) for x in _ball(g, e)]
    entries = distinct.select("fp", F.explode(F.array(*entry)).alias("x")).select("fp", "x.*")
    probes = distinct.select("fp", F.explode(F.array(*probe)).alias("x")).select(F.col("fp").alias("q"), "x.*")
    both = entries.select("part", "key", F.lit(1).alias("n"), F.lit(0).alias("p")).union(probes.select("part", "key", F.lit(0), F.lit(1)))
    size = both.groupBy("part", "key").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    hot = stage(size.where(F.col("n") * F.col("p") > BUCKET_PAIRS).select("part", "key"), "simhash_hot")
    found = None
    if hot.count():
        members = entries.join(hot, ["part", "key"], "left_semi").select("fp").union(probes.join(hot, ["part", "key"], "left_semi").select(F.col("q")))
        found = _neighbours(stage(members.distinct(), "simhash_members"), tau)
        entries, probes = entries.join(hot, ["part", "key"], "left_anti"), probes.join(hot, ["part", "key"], "left_anti")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("q")))
    e, q = entries.alias("e"), probes.alias("q")
    pairs = e.join(q, (F.col("e.part") == F.col("q.part")) & (F.col("e.key") == F.col("q.key")) & (F.col("q") < F.col("fp")) & (apart <= tau))
    pairs = pairs.select(F.col("q.q").alias("a"), F.col("fp").alias("b"))
    return pairs.union(found) if found is not None else pairs


def _classes(rows: DataFrame, tau: int, more: DataFrame | None = None) -> DataFrame:
    """f, r, component_id: each distinct fingerprint of rows, the root of its component, and the component's smallest id. more: further links."""
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash_distinct")
    edges = links(distinct.select("fp"), tau)
    roots = stage(connected_components(edges.union(more) if more is not None else edges, "simhash_links"), "simhash_roots")
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return stage(grouped.select(F.col("fp").alias("f"), F.col("root").alias("r")).join(least, F.col("r") == F.col("root")).select("f", "r", "component_id"), "simhash_classes")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 3, seed: int = 42, tau: int = 2) -> DataFrame:
    """id, fp, component_id of every row: the smallest id among those reachable over links of at most tau bits."""
    rows = stage(fingerprints(docs, id_col, text_col, size, seed), "simhash_fp")
    return rows.join(_classes(rows, tau), F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def _one_of_each(docs: DataFrame, key: list[Column], repeated: DataFrame) -> DataFrame:
    """docs with one row for each key in repeated (staged, columns k0, ..): the least by a hash of all its columns."""
    if not repeated.count():
        return docs
    names = unused(docs, *repeated.columns, "key", "row", "order")
    repeated, (key_, row, order) = repeated.toDF(*names[:-3]), names[-3:]
    same = [k.eqNullSafe(F.col(n)) for n, k in zip(names, key)]
    rows = docs.join(repeated, same, "left_semi").select(F.struct(*key).alias(key_), F.struct(*docs.columns).alias(row), F.xxhash64(*docs.columns).alias(order))
    return docs.join(repeated, same, "left_anti").union(rows.groupBy(key_).agg(F.min_by(row, order).alias(row)).select(f"{row}.*"))


def drop_near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 5, seed: int = 42, tau: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """docs' own rows and columns, one document of each component: that with the smallest id (null is last), fingerprint and text hash.

    Documents link if their fingerprints differ in at most tau bits, or if their sets of shingles have a Jaccard similarity of at least `similarity`
    (None: by fingerprints alone). SimHash distance can't find the latter: texts at 0.8 differ in some ten of 64 bits, where a pigeonhole search leaves no
    bits to select by. So their candidates share the least shingles under several hashes (`similar.links`), and all are verified.
    Documents that share an id are several: the survivor is told by id and text. Of rows equal in both the least by a hash of all columns stays.
    """
    rows = stage(fingerprints(docs, id_col, text_col, size, seed, hashed=True), "simhash_fp")
    more = similar_links(docs, rows, text_col, size, seed, similarity) if similarity is not None else None
    classes = _classes(rows, tau, more)
    found = stage(rows.join(classes, F.col("fp") == F.col("f")).select("id", "h", "r", F.struct(F.col("id").isNull().alias("last"), "id", "fp", "h").alias("me")), "simhash_found")
    best = stage(found.groupBy("r").agg(F.min("me").alias("best")), "simhash_best").withColumnRenamed("r", "root")
    both = found.join(best, F.col("r") == F.col("root"))
    names = unused(docs, "k0", "k1")
    lost = both.where(~F.col("me").eqNullSafe(F.col("best"))).select("id", "h").distinct().toDF(*names)
    key = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))]
    kept = docs.join(lost, [k.eqNullSafe(F.col(n)) for n, k in zip(names, key)], "left_anti")
    repeated = stage(found.groupBy("id", "h").count().where("count > 1").select(F.col("id").alias("k0"), F.col("h").alias("k1")), "simhash_repeated")
    return _one_of_each(kept, key, repeated)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
