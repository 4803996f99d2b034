"""Documents whose sets of word shingles are alike, for the near-duplicate stage: links that connect what a pair-by-pair check would.

Each text has `BANDS` keys, each made of its `ROWS` least shingle hashes under as many hash functions: texts of similarity s share a
key with probability 1 - (1 - s^ROWS)^BANDS, 0.99 at 0.8. Texts that share a key are compared exactly, as sets, and a bucket of up to `BLOCK` texts returns
a spanning forest of its links, not its pairs.

The texts of larger buckets (many pages of one template, a large group of copies) meet in neighbourhoods instead: alike sets share one of their rarest
shingles (prefix filtering, exact), so texts are connected through these, and texts that have only a template in common have no partner and end there.
In a neighbourhood of more than one block every text is first compared with one leader. Those alike to it are linked by it and need not meet each other; only
the others meet all, in pairs of blocks. So a template of unlike texts costs as much as its texts, and so does a group of copies; what is left, texts of one neighbourhood that are
unlike its leader, meets in pairs of blocks of `CROWD` texts, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, small_join, stage

BANDS, ROWS = 12, 5
#: Texts of a block, and codes of shingles that are counted at once.
BLOCK, CODES = 256, 4096
#: Texts, and bytes of sets, of a block of a large neighbourhood.
CROWD, BYTES = 1024, 1 << 23
_rng = np.random.default_rng(2024)
FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A text's keys from its shingles' hashes; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * FACTORS[None, :]).min(axis=0))
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def _sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import shingle_hashes

        for batch in batches:
            sets = [np.unique((shingle_hashes(t.as_py() or b"", size, seed) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["h", "s"])

    return run


def similarities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets' pairwise intersections, and of the sets."""
    sizes, m = np.array([len(s) for s in sets]), len(sets)
    codes = np.concatenate(sets)
    of = np.repeat(np.arange(m), sizes)
    order = np.argsort(codes, kind="stable")
    codes, of = codes[order], of[order]
    new = np.concatenate(([True], codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    kept = shared[number]
    of, number = of[kept], (np.cumsum(shared) - 1)[number[kept]]
    both = np.zeros((m, m), dtype=np.float64)
    for at in range(0, int(shared.sum()), CODES):
        a, b = np.searchsorted(number, (at, at + CODES))
        held = np.zeros((m, CODES), dtype=np.float32)
        held[of[a:b], number[a:b] - at] = 1
        both += held @ held.T
    return both, sizes


def forest(alike: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric relation."""
    left = np.ones(len(alike), dtype=bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        edge = [root]
        while edge:
            new = alike[edge].any(axis=0) & left
            left &= ~new
            edge = np.flatnonzero(new).tolist()
            yield from ((root, k) for k in edge)


def _forests(similarity: float):
    def linked(group: pd.DataFrame) -> list[tuple[int, int]]:
        both, sizes = similarities([np.frombuffer(s, "<u4") for s in group["s"]])
        alike = both * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
        fp = group["fp"].tolist()
        return [(fp[a], fp[b]) for a, b in forest(alike) if fp[a] != fp[b]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last group of a batch may go on in the next
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = rest[["band", "key", "i", "j"]]
            cuts = [0, *(np.flatnonzero((key.iloc[1:].to_numpy() != key.iloc[:-1].to_numpy()).any(axis=1)) + 1).tolist()]
            out = [e for a, b in zip(cuts, cuts[1:]) for e in linked(rest.iloc[a:b])]
            rest = rest.iloc[cuts[-1] :]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(linked(rest), columns=["a", "b"], dtype="int64")

    return run


def _with_leader(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alike = []
            for s, leader in zip(frame["s"], frame.pop("leader_s")):
                a, b = np.frombuffer(s, "<u4"), np.frombuffer(leader, "<u4")
                alike.append(len(np.intersect1d(a, b, assume_unique=True)) * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-6)
            yield frame.assign(alike=alike)

    return run


def links(docs: DataFrame, rows: DataFrame, text_col: str, size: int, seed: int, similarity: float) -> DataFrame:
    """rows (fp, h, keys), staged -> links (a, b) between the fingerprints of alike texts."""
    texts = rows.where(F.size("keys") > 0).groupBy("h").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    keyed = stage(texts.select("h", "fp", F.posexplode("keys").alias("band", "key")), "similar_keys")
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("b"), F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = stage(small_join(keyed, stage(shared, "similar_shared"), (F.col("band") == F.col("b")) & (F.col("key") == F.col("k")), "inner").drop("b", "k"), "similar_members")
    wanted = stage(members.select(F.col("h").alias("w")).distinct(), "similar_wanted")
    own = small_join(docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")), wanted, F.col("h") == F.col("w"), "left_semi")
    sets = own.mapInArrow(lean(_sets(size, seed)), "h long, s binary").groupBy("h").agg(F.min("s").alias("s")).withColumnRenamed("h", "w")
    sets = stage(sets, "similar_sets")
    rows_ = members.where("blocks = 1").join(sets, F.col("h") == F.col("w")).drop("w")
    one = rows_.select("band", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "s")
    found = _compared(one, similarity)
    crowded = members.where("blocks > 1").select("h", "fp").distinct().join(sets, F.col("h") == F.col("w")).drop("w")
    crowded = stage(crowded, "similar_crowded")
    return found.union(_crowded_links(crowded, similarity)) if not crowded.isEmpty() else found


def _compared(dealt: DataFrame, similarity: float) -> DataFrame:
    """dealt (band, key, i, j, fp, s) -> links (a, b): a spanning forest of those within each group."""
    parted = dealt.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return parted.mapInPandas(_forests(similarity), "a long, b long")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(s, "<u4") for s in part.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            columns = [np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes), np.concatenate(sets).astype(np.int64), np.repeat(sizes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "code", "size"])


def neighbourhoods(crowded: DataFrame, similarity: float) -> DataFrame:
    """crowded (h, s), staged -> node, root: texts that could be alike, by prefix filtering; a text without a possible partner is not in it.

    Ordered by rarity, alike sets share a shingle among the first (1 - similarity) of each. Texts are connected through those shingles; what
    a template gives to all of its texts is frequent, comes last, and connects none of them.
    """
    codes = stage(crowded.select("h", "s").mapInArrow(lean(_codes), "h long, code long, size long"), "similar_codes")
    frequent = stage(codes.groupBy(F.col("code").alias("c")).agg(F.count("*").alias("n")).where("n > 1"), "similar_frequent")
    shared = codes.join(frequent, F.col("code") == F.col("c")).groupBy("h").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "code"))).alias("all"))
    # A set's shingles that no other has come before those that are shared.
    first = F.floor(F.col("size") * (1 - similarity) + 1e-9) + 1 - (F.col("size") - F.size("all"))
    heads = stage(shared.select("h", F.explode(F.slice("all", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("h", "x.code"), "similar_heads")
    least = heads.groupBy(F.col("code").alias("c")).agg(F.min("h").alias("a"), F.count("*").alias("n")).where("n > 1")
    return connected_components(heads.join(least, F.col("code") == F.col("c")).select("a", F.col("h").alias("b")), "similar_near")


def _crowded_links(crowded: DataFrame, similarity: float) -> DataFrame:
    """Links of texts in buckets of more than one block: within neighbourhoods, large ones by a leader first, then in pairs of blocks."""
    near = stage(neighbourhoods(crowded, similarity), "similar_neighbourhoods")
    sizes = stage(near.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n")).where("n > 1"), "similar_sizes")
    placed = small_join(near, sizes, F.col("root") == F.col("r"), "inner").select("node", "root", "n")
    rows = stage(crowded.join(placed, F.col("h") == F.col("node")).drop("node"), "similar_placed")
    one = rows.where(F.col("n") <= BLOCK).select(F.lit(0).alias("band"), F.col("root").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "s")
    hot = rows.where(F.col("n") > BLOCK)
    leaders = hot.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("h", "fp", "s")).alias("leader"))
    led = hot.join(leaders, F.col("root") == F.col("r")).select("root", "h", "fp", "s", F.col("leader.fp").alias("leader_fp"), F.col("leader.s").alias("leader_s"))
    led = stage(led.mapInPandas(_with_leader(similarity), "root long, h long, fp long, s binary, leader_fp long, alike boolean"), "similar_led")
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / CROWD), F.ceil(F.sum(F.when(of, F.length("s")).otherwise(0)) / BYTES)).cast("int")
    counts = stage(led.groupBy(F.col("root").alias("r")).agg(blocks(~F.col("alike")).alias("apart"), blocks(F.col("alike")).alias("linked")), "similar_counts")
    led_ = small_join(led, counts, F.col("root") == F.col("r"), "inner").where("apart > 0")
    at = F.when(F.col("alike"), F.col("apart") + F.pmod(F.xxhash64("h"), F.greatest("linked", F.lit(1)))).otherwise(F.pmod(F.xxhash64("h"), F.col("apart"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("alike"), F.col("apart")).otherwise(F.col("apart") + F.col("linked")) - 1)
    pairs = F.transform(others, lambda x: F.struct(F.least(x, F.col("at")).alias("i"), F.greatest(x, F.col("at")).alias("j")))
    several = led_.withColumn("at", at).select(F.lit(1).alias("band"), F.col("root").alias("key"), F.explode(pairs).alias("p"), "fp", "s").select("band", "key", "p.*", "fp", "s")
    by_leader = led.where("alike and fp <> leader_fp").select(F.col("leader_fp").alias("a"), F.col("fp").alias("b"))
    return _compared(one.union(several), similarity).union(by_leader)
