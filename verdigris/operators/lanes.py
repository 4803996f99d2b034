"""Search in several lanes: the question, the question among authorities, and a few further questions, merged to one short list.

All lanes are one scoring of the stored index: each further question is a question of its own, and the authority lane takes the question's own scores, so the postings of
all lanes' terms are read once. A lane takes what holds all of its terms, or, if nothing does, what holds any. Lanes are merged by position, never by
score, since their scales differ: one lane behind the other or in turns; then, stably, what shows more of the probes' terms comes first. The list is
packed in this order under a limit and a token budget; an item that does not fit is left out, the first one too, and the first item's source may go on to `ANCHORED` items.

What reaches the merge is bounded by the lanes' limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import index as X

#: Further questions of one question, items of each, items of the authority lane at least, items of the first item's source, share of the budget of a further question and its least.
MOST_SUPPLEMENTS, SUPPLEMENT_LIMIT, AUTHORITY_LIMIT, ANCHORED, SUPPLEMENT_SHARE, SUPPLEMENT_TOKENS = 12, 4, 20, 4, 4, 128
#: Words of a probe that count as shown.
PROBE_TERM = r"[A-Za-zА-Яа-я0-9_.:/+-]{3,}"
LANES = ("main", "supplement", "authority")


def lane_queries(requests: DataFrame, supplements: DataFrame) -> DataFrame:
    """requests (query_id, text), supplements (query_id, text, n, probe) -> query_id (struct of the question's and n), text: n 0 is the question, the others its first
    MOST_SUPPLEMENTS further questions in order of n, each text once."""
    once = supplements.where("trim(text) <> ''").groupBy("query_id", "text").agg(F.min("n").alias("n"))
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "text")).cast("int")).where(F.col("n") <= MOST_SUPPLEMENTS)
    both = requests.select("query_id", F.lit(0).alias("n"), "text").union(few.select("query_id", "n", "text"))
    return both.select(F.struct("query_id", "n").alias("query_id"), "text")


def lane_hits(index: X.Index, queries: DataFrame, meta: DataFrame, *, limit: int) -> DataFrame:
    """queries (of `lane_queries`), meta (id, source, cost, authority, allowed) -> query_id, lane, n, rank, id, source, cost: the best allowed items of every lane."""
    scored = X.bm25(index, queries, flag=True).select("query_id.query_id", "query_id.n", "id", F.round("score", 9).alias("score"), "full")
    facts = meta.select(F.col("id").alias("m_id"), "source", "cost", F.coalesce("authority", F.lit(False)).alias("authority"), F.coalesce("allowed", F.lit(True)).alias("allowed"))
    rows = scored.join(facts, F.col("id") == F.col("m_id")).where("allowed").drop("m_id", "allowed")
    own = F.when(F.col("n") > 0, F.array(F.lit("supplement"))).when(F.col("authority"), F.array(F.lit("main"), F.lit("authority"))).otherwise(F.array(F.lit("main")))
    rows = rows.select("*", F.explode(own).alias("lane"))
    whole = rows.where("full").select(F.col("query_id").alias("q"), F.col("n").alias("k"), F.col("lane").alias("l")).distinct()
    rows = rows.join(whole, (F.col("query_id") == F.col("q")) & (F.col("n") == F.col("k")) & (F.col("lane") == F.col("l")), "left").where("full or q is null")
    most = F.when(F.col("lane") == "main", limit).when(F.col("lane") == "authority", max(limit, AUTHORITY_LIMIT)).otherwise(SUPPLEMENT_LIMIT)
    best = Window.partitionBy("query_id", "lane", "n").orderBy(F.col("score").desc(), "id")
    # A constant bound lets the ranks be cut before the shuffle.
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(limit, AUTHORITY_LIMIT)).where(F.col("rank") <= most)
    return rows.select("query_id", "lane", "n", "rank", "id", "source", "cost")


def within_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Each lane's items that fit its own budget, in order; the first stays, later ones that overflow are passed over."""
    own = F.when(F.col("lane") == "supplement", F.lit(min(budget, max(SUPPLEMENT_TOKENS, budget // SUPPLEMENT_SHARE)))).otherwise(F.lit(budget))
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "source", "cost"))).alias("items")
    kept = F.struct(F.lit(0).cast("long").alias("used"), F.filter("items", lambda x: F.lit(False)).alias("out"))
    fits = lambda s, x: (F.size(s["out"]) == 0) | (s["used"] + x["cost"] <= F.col("own"))
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    packed = hits.groupBy("query_id", "lane", "n").agg(items).withColumn("own", own).select("query_id", "lane", "n", F.explode(F.aggregate("items", kept, step, lambda s: s["out"])).alias("x"))
    return packed.select("query_id", "lane", "n", "x.*")


def _order(in_turns: bool) -> list[Column]:
    """Of the lanes' items: all supplements in order, then authorities, then the question's own; or one of each lane in turn, the question's own first."""
    if in_turns:
        at = F.row_number().over(Window.partitionBy("query_id", "lane").orderBy("n", "rank"))
        return [at, F.array_position(F.array(*[F.lit(x) for x in LANES]), F.col("lane"))]
    return [F.array_position(F.array(F.lit("supplement"), F.lit("authority"), F.lit("main")), F.col("lane")), F.col("n"), F.col("rank")]


def merged(hits: DataFrame, supplements: DataFrame, texts: DataFrame, *, in_turns: bool = False) -> DataFrame:
    """hits, texts (id, text) -> hits with their position in the merged list: more of the probes' terms shown is better, the lanes' order decides the rest."""
    probes = supplements.where("probe").groupBy(F.col("query_id").alias("q")).agg(F.array_distinct(F.flatten(F.collect_list(F.transform(F.regexp_extract_all("text", F.lit(PROBE_TERM), F.lit(0)), lambda t: F.lower(t))))).alias("probes"))
    rows = hits.withColumns({f"_o{k}": c for k, c in enumerate(_order(in_turns))})
    keys = [c for c in rows.columns if c.startswith("_o")]
    rows = rows.join(probes, F.col("query_id") == F.col("q"), "left").join(texts.select(F.col("id").alias("t_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low")), F.col("id") == F.col("t_id"))
    shown = F.size(F.filter(F.coalesce("probes", F.array().cast("array<string>")), lambda p: F.contains(F.col("low"), p)))
    rows = rows.withColumn("shown", shown)
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("shown").desc(), *keys))
    return rows.withColumn("position", position).drop("q", "t_id", "low", "probes", *keys)


def packed(ranked: DataFrame, *, limit: int, budget: int) -> DataFrame:
    """ranked (query_id, position, id, source, cost) -> query_id, pick, id, source, cost: each id once, up to the limit, and of the first item's source up to ANCHORED."""
    items = F.array_sort(F.collect_list(F.struct("position", "id", "source", "cost"))).alias("items")
    kept = F.struct(F.lit(0).cast("long").alias("used"), F.filter("items", lambda x: F.lit(False)).alias("out"))
    more = lambda s, x: (F.size(s["out"]) < limit) | (F.get(s["out"], F.lit(0))["source"].eqNullSafe(x["source"]) & (F.size(s["out"]) < max(limit, ANCHORED)))
    takes = lambda s, x: ~F.exists(s["out"], lambda k: k["id"] == x["id"]) & more(s, x) & (s["used"] + x["cost"] <= budget)
    step = lambda s, x: F.when(takes(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    rows = ranked.groupBy("query_id").agg(items).select("query_id", F.posexplode(F.aggregate("items", kept, step, lambda s: s["out"])).alias("pick", "x"))
    return rows.select("query_id", (F.col("pick") + 1).alias("pick"), "x.id", "x.source", "x.cost")
