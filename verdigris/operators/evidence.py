"""Evidence selection: coverage by greedy set cover, diversity by marginal relevance. A group is one question's candidates: every one of them is looked at, so the caller bounds them by a rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_cover(candidates: DataFrame) -> DataFrame:
    """candidates (group_id, id, cost, covers array<string>, rank) -> group_id, id, step, gained: the most new coverage first,
    ties to lower cost, then rank, then id; ends when nothing is gained."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = {r.id: (set(r.covers), r.cost, r.rank) for r in rows.itertuples()}
        seen: set = set()
        out = []
        while left:
            best = min(left, key=lambda i: (-len(left[i][0] - seen), left[i][1], left[i][2], i))
            gained = left.pop(best)[0] - seen
            if not gained:
                break
            seen |= gained
            out.append((key[0], best, len(out) + 1, sorted(gained)))
        return pd.DataFrame(out, columns=["group_id", "id", "step", "gained"])

    kind = dict(candidates.dtypes)
    return candidates.groupBy("group_id").applyInPandas(run, f"group_id {kind['group_id']}, id {kind['id']}, step int, gained array<string>")


def marginal_relevance(candidates: DataFrame, weight: float = 0.7, per_source: int = 2) -> DataFrame:
    """candidates (group_id, id, source, relevance, terms array<string>, rank) -> group_id, id, position: a full ordering in which a
    winner of an exhausted source is dropped."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pool = [(r.id, r.source, r.relevance, set(r.terms), r.rank) for r in rows.sort_values("rank").itertuples()]
        chosen, used, out = [], {}, []
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        while pool:
            best = max(pool, key=lambda c: (weight * c[2] - (1 - weight) * max((jaccard(c[3], s) for s in chosen), default=0.0), -c[4]))
            pool.remove(best)
            if used.get(best[1], 0) >= per_source:
                continue
            used[best[1]] = used.get(best[1], 0) + 1
            chosen.append(best[3])
            out.append((key[0], best[0], len(out) + 1))
        return pd.DataFrame(out, columns=["group_id", "id", "position"])

    kind = dict(candidates.dtypes)
    return candidates.groupBy("group_id").applyInPandas(run, f"group_id {kind['group_id']}, id {kind['id']}, position int")


def keep_unlike(candidates: DataFrame, millis: int = 850) -> DataFrame:
    """candidates (query_id, id, source, rank, sh array<string>, ...) without those that repeat a kept, better one of their query.

    A candidate repeats one that has its text hash and parent, or its source and so many of 1000 runs of words. It never does so if it is of another version or polarity, or brings a
    symbol or covers a requirement that the other does not (columns version, polarity, symbols, covers, parent, text_hash, where there are such). A group is one query's bounded candidates; they are folded in
    order of rank.
    """
    columns = [c for c in candidates.columns if c != "query_id"]
    has = lambda *names: all(n in columns for n in names)

    def repeats(x: Column, k: Column) -> Column:
        near = (k.source == x.source) & (F.size(F.array_intersect(k.sh, x.sh)) * 1000 >= millis * F.size(F.array_union(k.sh, x.sh))) & (F.size(x.sh) > 0)
        if has("covers"):
            near = near & (F.size(F.array_except(x.covers, k.covers)) == 0)
        same = near
        if has("parent", "text_hash"):
            same = same | F.coalesce((x.parent == k.parent) & (x.text_hash == k.text_hash), F.lit(False))
        if has("symbols"):
            same = same & (F.size(F.array_except(x.symbols, k.symbols)) == 0)
        if has("polarity"):
            same = same & (x.polarity == k.polarity)
        if has("version"):
            same = same & ~F.coalesce((x.version != "") & (k.version != "") & (F.lower(x.version) != F.lower(k.version)), F.lit(False))
        return same

    items = F.array_sort(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"])))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: repeats(x, k)), kept).otherwise(F.concat(kept, F.array(x)))
    grouped = candidates.groupBy("query_id").agg(items.alias("items"))
    kept = F.aggregate("items", F.filter("items", lambda x: F.lit(False)), step)
    return grouped.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.*")


def fill(candidates: DataFrame, *, budget: int = 4000, sources: int = 12, per_source: int = 3, threshold: int = 1) -> DataFrame:
    """candidates (query_id, id, source, rank, cost, relevance, covers, terms) -> query_id, id, position (null if left out), utility, reason.

    Each step takes the candidate with the most utility per hundred tokens; new words count only while they are new. A candidate over
    the budget, under the threshold or beyond a source's cap is left out with that reason, and the search goes on.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pool = {r.id: r for r in rows.itertuples()}
        words, used, spent, out = set(), {}, 0, []
        while pool:
            value = {i: 180 * len(r.covers) + min(100, max(0, r.relevance // 10)) + min(80, 4 * len(set(r.terms) - words)) for i, r in pool.items()}
            best = min(pool, key=lambda i: (-(value[i] * 100 // max(1, pool[i].cost)), -value[i], pool[i].rank, i))
            r = pool.pop(best)
            capped = used.get(r.source, 0) >= per_source or (r.source not in used and len(used) >= sources)
            reason = "source_cap" if capped else "zero_marginal_utility" if value[best] * 100 // max(1, r.cost) < threshold else "budget" if spent + r.cost > budget else None
            if reason is None:
                spent, used[r.source] = spent + r.cost, used.get(r.source, 0) + 1
                words |= set(r.terms)
            out.append((key[0], best, sum(o[4] == "selected" for o in out) + 1 if reason is None else None, value[best], reason or "selected"))
        frame = pd.DataFrame(out, columns=["query_id", "id", "position", "utility", "reason"])
        return frame.astype({"position": "Int32"})

    kind = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, position int, utility int, reason string")
