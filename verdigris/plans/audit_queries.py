"""Aggregates, audits, set operations, registries and relational conveniences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import paths
from ..runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select source, count(*) docs, count(*) filter (where trim(text) = '') empty, count(*) filter (where n_chars < 80) sparse, count(l.doc_id) labelled, max(n_chars) longest, case when count(l.doc_id) = 0 then 'none' when count(l.doc_id) < count(*) then 'drift' else 'ok' end labels from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source")
def source_card(spark, sf):
    """JN-7, AGG-4, AGG-5: the ledger is made unique before the join, so nothing is counted twice."""
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars", (F.trim("text") == "").alias("blank")).join(labels, "doc_id", "left")
    card = rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("blank").alias("empty"), F.count_if(F.col("n_chars") < 80).alias("sparse"), F.count("known").alias("labelled"), F.max("n_chars").alias("longest"))
    return card.withColumn("labels", F.when(F.col("labelled") == 0, "none").when(F.col("labelled") < F.col("docs"), "drift").otherwise("ok"))


@query("select lang, count(*) missing, sum(n_chars)::bigint chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) group by lang")
def unlabelled_audit(spark, sf):
    """JN-2, JN-4, JN-5: anti-join, then sums."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return rows.groupBy("lang").agg(F.count("*").alias("missing"), F.sum("n_chars").alias("chars"))


@query("(select page_id id, 'page_only' side from pages except select doc_id, 'page_only' from documents) union all (select doc_id, 'document_only' from documents except select page_id, 'document_only' from pages)")
def id_drift(spark, sf):
    """SET-2: symmetric difference by one full join."""
    a, b = table(spark, sf, "pages").select("page_id").distinct(), table(spark, sf, "documents").select("doc_id").distinct()
    rows = a.join(b, F.col("page_id") == F.col("doc_id"), "full").where("page_id is null or doc_id is null")
    return rows.select(F.coalesce("page_id", "doc_id").alias("id"), F.when(F.col("doc_id").isNull(), "page_only").otherwise("document_only").alias("side"))


@query("select d.doc_id, case when l.doc_id is null then 'ignored' when quality = 1 then 'current' else 'stale' end state from documents d left join (select doc_id, max(quality) quality from labels group by 1) l using (doc_id)")
def partition_state(spark, sf):
    """SET-3."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("seen", F.lit(True))
    rows = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("seen").isNull(), "ignored").when(F.col("quality") == 1, "current").otherwise("stale").alias("state"))


@query("select coalesce(nullif(lang, ''), 'unknown') format, count(*) docs, count(distinct source) sources from documents group by 1")
def format_counts(spark, sf):
    """AGG-1, AGG-2, AGG-3."""
    return table(spark, sf, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("format")).agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))


@query("with t as (select source, greatest(1, ceil(length(text) / 4.0)) tok, greatest(1, ceil(least(length(text), 800) / 4.0)) cut from documents) select source, sum(tok)::bigint raw_tokens, sum(cut)::bigint tokens, round(100.0 * (sum(tok) - sum(cut)) / sum(tok), 4) savings, round(sum(tok) / sum(cut), 4) runway from t group by source")
def token_savings(spark, sf):
    """AGG-9."""
    n = F.char_length("text")
    est = lambda c: F.greatest(F.lit(1), F.ceil(c / 4))
    rows = table(spark, sf, "documents").groupBy("source").agg(F.sum(est(n)).cast("long").alias("raw_tokens"), F.sum(est(F.least(n, F.lit(800)))).cast("long").alias("tokens"))
    return rows.select("source", "raw_tokens", "tokens", F.round(100.0 * (F.col("raw_tokens") - F.col("tokens")) / F.col("raw_tokens"), 4).alias("savings"), F.round(F.col("raw_tokens") / F.col("tokens"), 4).alias("runway"))


@query("with h as (select source, greatest(1, ceil(length(text) / 4.0)) tok, row_number() over (partition by sha256(text) order by doc_id) n from documents) select source, floor(1000 * coalesce(sum(tok) filter (where n > 1), 0) / sum(tok))::bigint redundant_millis from h group by source")
def redundant_tokens(spark, sf):
    """AGG-13: copies of earlier texts, per thousand tokens of a source."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), T.estimate_tokens(F.col("text")).alias("tok"))
    first = rows.groupBy(F.col("h").alias("h1")).agg(F.min("doc_id").alias("keep"))
    rows = rows.join(first, F.col("h") == F.col("h1"))
    return rows.groupBy("source").agg(F.floor(1000 * F.coalesce(F.sum(F.when(F.col("doc_id") != F.col("keep"), F.col("tok"))), F.lit(0)) / F.sum("tok")).alias("redundant_millis"))


@query("with p as (select event_type, value, row_number() over (partition by event_type order by value) n, count(*) over (partition by event_type) c from events) select event_type, max(value) filter (where n = greatest(1, ceil(0.95 * c))) p95_ceil, round(any_value(m), 6) p50 from p join (select event_type, median(value) m from events group by 1) using (event_type) group by event_type")
def percentiles(spark, sf):
    """EVL-2, EVL-3: counts per value are ranked, not rows."""
    e = table(spark, sf, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("value")
    e = e.withColumn("upto", F.sum("n").over(w)).withColumn("c", F.sum("n").over(Window.partitionBy("event_type")))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    return e.groupBy("event_type").agg(at(F.greatest(F.lit(1), F.ceil(0.95 * F.col("c")))).alias("p95_ceil"), F.round((at(F.floor((F.col("c") + 1) / 2)) + at(F.floor(F.col("c") / 2) + 1)) / 2, 6).alias("p50"))


@query("select user_id, count(*) doomed, max(ts) newest_doomed from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n > 5 group by user_id")
def retention(spark, sf):
    """GEN-5, JOB-3: all but the newest five of each user. A user's rows are counted; only six a user are ordered, in each map task already."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    sixth = e.withColumn("n", F.row_number().over(w)).where("n <= 6").where("n = 6").select(F.col("user_id").alias("u"), F.col("ts").alias("newest_doomed"))
    counts = e.groupBy("user_id").agg((F.count("*") - 5).alias("doomed"))
    return counts.join(sixth, F.col("user_id").eqNullSafe(F.col("u"))).select("user_id", "doomed", "newest_doomed")


@query("select count(*) filter (where quality = 1 and toxic = 0) tp, count(*) filter (where quality = 1 and toxic = 1) fp, count(*) filter (where quality = 0 and toxic = 0) fn, round(count(*) filter (where quality = 1 and toxic = 0) / count(*) filter (where quality = 1), 6) \"precision\", round(count(*) filter (where quality = 1 and toxic = 0) / count(*) filter (where toxic = 0), 6) recall from labels")
def precision_recall(spark, sf):
    """IMP-3: quality as the forecast of what is not toxic."""
    tp, yes, real = (F.count_if(F.expr(x)) for x in ("quality = 1 and toxic = 0", "quality = 1", "toxic = 0"))
    return table(spark, sf, "labels").agg(tp.alias("tp"), F.count_if(F.expr("quality = 1 and toxic = 1")).alias("fp"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("fn"), F.round(tp / yes, 6).alias("precision"), F.round(tp / real, 6).alias("recall"))


@query("with s as (select source, count(*)::double n, avg(toxic) p from documents join labels using (doc_id) group by 1) select source, n::bigint n, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) high from s")
def wilson_intervals(spark, sf):
    """EVL-18."""
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    s = rows.groupBy("source").agg(F.count("*").cast("double").alias("n"), F.avg("toxic").alias("p"))
    n, p, z = F.col("n"), F.col("p"), 1.96
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return s.select("source", n.cast("long").alias("n"), F.round((mid - half) / scale, 6).alias("low"), F.round((mid + half) / scale, 6).alias("high"))


@query(r"""with l as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"#?]+)"', 1)) href from pages) select host, count(*) links, count(distinct href) targets, count(*) filter (where starts_with(href, '/')) internal from l group by host""")
def link_edges(spark, sf):
    """Link edges of pages, by host."""
    rows = table(spark, sf, "pages").select(T.url_host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"#?]+)"'), F.lit(1))).alias("href"))
    return rows.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.count_if(F.col("href").startswith("/")).alias("internal"))


@query()
def supply_paths(spark, sf):
    """GRF-4: bounded paths from regions over nations to suppliers; tested on a fixture."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    nations = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit(1.0).alias("confidence"))
    suppliers = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit(0.5).alias("confidence"))
    return paths(nations.union(suppliers), r.select(F.concat(F.lit("r"), "r_regionkey").alias("node")))


@query("select conv_id, count(*) turns, max(turn) last_turn, string_agg(role, '>' order by turn, role) shape from conversations group by conv_id")
def conversation_shapes(spark, sf):
    """Ordered groups: the roles of each conversation in turn."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("all"))
    return rows.select("conv_id", "turns", "last_turn", F.array_join("all.role", ">").alias("shape"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum((l_extendedprice * (1 - l_discount))::decimal(18, 4)), 2)::double sum_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, sf):
    """Prices are summed as decimals: a sum of doubles depends on the order of rows, and some sums lie halfway between two cents."""
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")), 2).cast("double").alias("sum_disc"), F.count("*").alias("n"))


@query("select r_name, n_name, count(*) suppliers from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def supplier_rollup(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("select event_id, ts, ts <= timestamp '2024-02-01' - interval 30 days stale, event_type in ('error', 'click') listed from events")
def stale_flags(spark, sf):
    """FLT-7, FLT-8, REG-4: age against a fixed day, status in a set; unknown times are stale."""
    cutoff = F.lit("2024-02-01").cast("timestamp") - F.expr("interval 30 days")
    return table(spark, sf, "events").select("event_id", "ts", F.coalesce(F.col("ts") <= cutoff, F.lit(True)).alias("stale"), F.col("event_type").isin("error", "click").alias("listed"))


@query("select event_id, event_type, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 200")
def latest_jobs(spark, sf):
    """JOB-1, SRT-1: the newest 200 of a status."""
    rows = table(spark, sf, "events").where(F.col("event_type") == "error")
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "event_type", "user_id")


@query("with h as (select source, text, greatest(1, ceil(length(text) / 4.0)) tok, count(*) over (partition by sha256(text)) same from documents) select source, count(*) filter (where trim(text) = '') empty, count(*) filter (where tok < 20) short, count(*) filter (where same > 1) duplicated from h group by source")
def health_report(spark, sf):
    """AGG-8: copies are counted per hash, then joined to the slim rows; AQE may split a hash with very many rows."""
    rows = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"), (F.trim("text") == "").alias("blank"), T.estimate_tokens(F.col("text")).alias("tok"))
    many = rows.groupBy(F.col("h").alias("h1")).agg(F.count("*").alias("same")).where("same > 1")
    rows = rows.join(many, F.col("h") == F.col("h1"), "left")
    return rows.groupBy("source").agg(F.count_if("blank").alias("empty"), F.count_if(F.col("tok") < 20).alias("short"), F.count("same").alias("duplicated"))


@query("select conv_id, min(turn) filter (where role = 'assistant') first_answer, max(length(text)) filter (where role = 'user') longest_question, count(*) filter (where role = 'user') questions from conversations group by conv_id")
def conversation_rollup(spark, sf):
    """Conditional aggregates per group."""
    is_user = F.col("role") == "user"
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_answer"), F.max(F.when(is_user, F.char_length("text"))).alias("longest_question"), F.count_if(is_user).alias("questions"))
