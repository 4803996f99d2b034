"""Registry, synchronisation, link resolution, state and comparison queries, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.retrieval import first_wins
from ..runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """select coalesce(d.doc_id, e.vec_id) id, case when d.doc_id is null then 'prune' when e.vec_id is null then 'upsert' else 'skip' end "action"
    from (select distinct doc_id from documents) d full join (select distinct vec_id from embeddings) e on d.doc_id = e.vec_id"""
)
def vector_sync(spark, sf):
    """VEC-5, VEC-6, SET-2: what a vector index must do to hold the documents: one full join of the wanted and the stored ids."""
    wanted, stored = table(spark, sf, "documents").select("doc_id").distinct(), table(spark, sf, "embeddings").select("vec_id").distinct()
    rows = wanted.join(stored, F.col("doc_id") == F.col("vec_id"), "full")
    return rows.select(F.coalesce("doc_id", "vec_id").alias("id"), F.when(F.col("doc_id").isNull(), "prune").when(F.col("vec_id").isNull(), "upsert").otherwise("skip").alias("action"))


@query(
    """with h as (select doc_id, source, sha256(text) h from documents), l as (select min(doc_id) keep, source, h from h group by source, h)
    select source, count(*) seen, count(*) filter (where doc_id = keep) added, count(*) filter (where doc_id <> keep) skipped from h join l using (source, h) group by source"""
)
def skip_known(spark, sf):
    """JN-11: a row whose source and content hash an earlier row had is skipped. The first is found by an aggregate with a map-side
    step, so skipped copies are not joined: a source's rows less its distinct hashes."""
    rows = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h")).groupBy("source", "h").agg(F.count("*").alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("seen"), F.count("*").alias("added"), (F.sum("n") - F.count("*")).alias("skipped"))


@query(
    r"""with l as (select page_id, 'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) base, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host,
        unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"#?]+)"', 1)) href from pages),
    t as (select 'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) target, count(*) n from pages group by 1),
    r as (select page_id, href, case when href like '/%' then 'https://' || host || href when href like 'http%' then regexp_replace(href, '^http://', 'https://') else base || '/' || href end target from l)
    select page_id, href, count(*) times, case when max(n) is null then 'unresolved' when max(n) > 1 then 'ambiguous' else 'resolved' end state from r left join t using (target) group by page_id, href"""
)
def link_resolution(spark, sf):
    """A link with one target is resolved, with several ambiguous, with none unresolved. Targets are counted before
    the join, so that a target with many pages does not multiply the rows."""
    p = table(spark, sf, "pages")
    base = F.concat(F.lit("https://"), T.url_host(F.col("url")), T.url_path(F.col("url")))
    targets = p.select(base.alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    links = p.select("page_id", T.url_host(F.col("url")).alias("host"), base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"#?]+)"'), F.lit(1))).alias("href"))
    href = F.col("href")
    target = F.when(href.startswith("/"), F.concat(F.lit("https://"), "host", href)).when(href.startswith("http"), F.regexp_replace(href, "^http://", "https://")).otherwise(F.concat("base", F.lit("/"), href))
    links = links.select("page_id", "href", target.alias("target")).groupBy("page_id", "href", "target").agg(F.count("*").alias("times"))
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return links.join(targets, "target", "left").select("page_id", "href", "times", state.alias("state"))


@query(
    """with e as (select *, lag(ts) over w before, row_number() over w n from events window w as (partition by user_id, event_type order by ts, event_id))
    select user_id, event_type, count(*) calls, count(*) filter (where before is null or ts - before >= interval 1 day) fresh, min(ts) first_ts, max(ts) last_ts from e group by user_id, event_type"""
)
def rate_gaps(spark, sf):
    """Calls of a key, and those that a day or more separates from the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", F.lag("ts").over(w).alias("before"))
    fresh = F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr("interval 1 day"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.count_if(fresh).alias("fresh"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    """with recursive h as (select user_id, date_trunc('hour', ts) t, count(*) c from events group by 1, 2), s as (select *, row_number() over (partition by user_id order by t) n from h),
    r as (select user_id, t, n, t kept, 1::bigint made from s where n = 1
      union all select s.user_id, s.t, s.n, case when s.t >= r.kept + interval 7 days then s.t else r.kept end, case when s.t >= r.kept + interval 7 days then 1::bigint else 0::bigint end from r join s on s.user_id = r.user_id and s.n = r.n + 1)
    select user_id, sum(made)::bigint keys_made, (sum(c) - sum(made))::bigint reused from r join h using (user_id, t) group by user_id"""
)
def idempotency_keys(spark, sf):
    """STM-3: a key lives seven days from the hour it was made in, whatever reuses it. Which hour makes a key depends on the last key's,
    so a user's hours are folded in order; events are counted by hour first, which bounds the fold by the hours of the log."""
    hours = table(spark, sf, "events").groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("t")).agg(F.count("*").alias("c"))
    start = F.struct(F.lit(None).cast("long").alias("kept"), F.lit(0).cast("long").alias("made"))
    step = lambda s, t: F.when(s.kept.isNull() | (t >= s.kept + 7 * 24), F.struct(t.alias("kept"), (s.made + 1).alias("made"))).otherwise(s)
    rows = hours.groupBy("user_id").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list("t")).alias("times"))
    rows = rows.select("user_id", "n", F.aggregate("times", start, step).made.alias("keys_made"))
    return rows.select("user_id", "keys_made", (F.col("n") - F.col("keys_made")).alias("reused"))


@query(
    """select user_id, string_agg(event_type, ',' order by n desc) last_events from (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n <= 10 group by user_id"""
)
def last_events(spark, sf):
    """STM-4, SNK-9: the last ten events of each key, oldest first. A window with a rank limit keeps ten rows a key in each map task."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = table(spark, sf, "events").select("user_id", "event_type", F.row_number().over(w).alias("n")).where("n <= 10")
    got = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type"))).alias("all"))
    return got.select("user_id", F.array_join("all.event_type", ",").alias("last_events"))


@query(
    r"""with p as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) path from pages)
    select page_id, case when regexp_matches(path, '(^|/)(test|tests|fixtures?)(/|$)') then 'test' when regexp_matches(path, '(^|/)(changelog|releases?|history|news)([./-]|$)') then 'changelog'
      when regexp_matches(path, '(^|/)(api|reference)([./-]|$)') then 'reference' when regexp_matches(path, '(^|/)(docs?|guides?|tutorials?|wiki)([./-]|$)') then 'guide' when path in ('', '/') then 'root' else 'other' end kind,
      case when regexp_matches(path, '(^|/)(api|reference|docs?|guides?)([./-]|$)') then 'canonical' else 'supporting' end authority, len(string_split(trim(path, '/'), '/'))::int depth from p"""
)
def path_taxonomy(spark, sf):
    """A page path's kind, authority and depth; the first rule that matches counts."""
    path = F.lower(T.url_path(F.col("url")))
    kind = F.when(path.rlike(r"(^|/)(test|tests|fixtures?)(/|$)"), "test").when(path.rlike(r"(^|/)(changelog|releases?|history|news)([./-]|$)"), "changelog")
    kind = kind.when(path.rlike(r"(^|/)(api|reference)([./-]|$)"), "reference").when(path.rlike(r"(^|/)(docs?|guides?|tutorials?|wiki)([./-]|$)"), "guide").when(path.isin("", "/"), "root").otherwise("other")
    authority = F.when(path.rlike(r"(^|/)(api|reference|docs?|guides?)([./-]|$)"), "canonical").otherwise("supporting")
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"), authority.alias("authority"), F.size(F.split(F.btrim(path, F.lit("/")), "/")).alias("depth"))


@query(
    r"""select conv_id, turn, regexp_matches(lower(text), '\b(how|setup|install|configure|create|build|start)\b') how_to, regexp_matches(lower(text), '\b(error|fail|failed|broken|exception|bug)\b') troubleshoot,
      regexp_matches(lower(text), '\b(what|why|explain|define|meaning)\b') explain, regexp_matches(lower(text), '\b(add|change|remove|rename|fix|update|write)\b') mutates,
      case when regexp_matches(lower(text), '\b(error|fail|failed|broken|exception|bug)\b') then 'source' when regexp_matches(lower(text), '\b(how|setup|install|configure|create|build|start)\b') then 'guides'
        when regexp_matches(lower(text), '\b(what|why|explain|define|meaning)\b') then 'reference' else 'lexical' end stage from conversations where role = 'user'"""
)
def question_intents(spark, sf):
    """Words of a question set its flags; the first flag in order names the stage that it is sent to."""
    t = F.lower("text")
    rule = {k: t.rlike(rf"\b({w})\b") for k, w in {"how_to": "how|setup|install|configure|create|build|start", "troubleshoot": "error|fail|failed|broken|exception|bug", "explain": "what|why|explain|define|meaning", "mutates": "add|change|remove|rename|fix|update|write"}.items()}
    stage = F.when(rule["troubleshoot"], "source").when(rule["how_to"], "guides").when(rule["explain"], "reference").otherwise("lexical")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", *[c.alias(k) for k, c in rule.items()], stage.alias("stage"))


@query(
    """with d as (select d.doc_id, source, n_chars, case when text is null or trim(text) = '' then 'invalid_identity' when quality = 0 and toxic = 1 then 'risk' when quality = 0 then 'stale' when n_chars < 80 then 'navigation' end reason
      from documents d left join (select doc_id, max(quality) quality, max(toxic) toxic from labels group by 1) l using (doc_id))
    select coalesce(reason, 'eligible') reason, source, count(*) n, sum(n_chars)::bigint chars from d group by 1, 2"""
)
def eligibility(spark, sf):
    """AGG-12: the first reason that applies keeps a document out; they are counted by reason and source."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    blank = F.col("text").isNull() | (F.trim("text") == "")
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars", blank.alias("blank")).join(labels, "doc_id", "left")
    reason = F.when(F.col("blank"), "invalid_identity").when((F.col("quality") == 0) & (F.col("toxic") == 1), "risk").when(F.col("quality") == 0, "stale").when(F.col("n_chars") < 80, "navigation").otherwise("eligible")
    return rows.groupBy(reason.alias("reason"), "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """select doc_id, case when n_chars >= 1000 and quality = 1 then 'high' when quality = 1 then 'medium' when quality is null then 'unknown' else 'low' end confidence,
      case when toxic = 1 then 'rejected' when quality = 0 then 'risky' else 'selected' end trust from documents left join (select doc_id, max(quality) quality, max(toxic) toxic from labels group by 1) l using (doc_id)"""
)
def trust_partition(spark, sf):
    """Labelled documents as selected, risky or rejected, each with a confidence."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    good = F.col("quality") == 1
    confidence = F.when((F.col("n_chars") >= 1000) & good, "high").when(good, "medium").when(F.col("quality").isNull(), "unknown").otherwise("low")
    return rows.select("doc_id", confidence.alias("confidence"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "risky").otherwise("selected").alias("trust"))


@query(
    """with o as (select o_custkey task, year(o_orderdate) r, sum(o_totalprice) cost from orders group by 1, 2), p as (select b.task, b.r, a.cost base, b.cost - a.cost delta from o b join o a on a.task = b.task and a.r = b.r - 1)
    select r::int as "repeat", count(*) pairs, round(median(delta), 2) median_delta, round(avg(delta), 2) mean_delta, count(*) filter (where delta > 0) worse from p group by r"""
)
def paired_deltas(spark, sf):
    """Each task's cost against the same task's in the round before: both sides are aggregated on the join's key."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task"), F.year("o_orderdate").alias("r")).agg(F.sum("o_totalprice").alias("cost"))
    base = o.select("task", (F.col("r") + 1).alias("r"), F.col("cost").alias("base"))
    rows = o.join(base, ["task", "r"]).select("r", (F.col("cost") - F.col("base")).alias("delta"))
    return rows.groupBy(F.col("r").alias("repeat")).agg(F.count("*").alias("pairs"), F.round(F.expr("percentile(delta, 0.5)"), 2).alias("median_delta"), F.round(F.avg("delta"), 2).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("worse"))


@query(
    """select source, lang, count(*) docs, sum(strlen(text))::bigint bytes, max(strlen(text)) largest, sum(greatest(1, ceil(strlen(text) / 4.0)))::bigint tokens, count(*) - count(distinct sha256(text)) duplicates from documents group by source, lang"""
)
def footprint(spark, sf):
    """EVL-14: sizes of each group. Copies are counted by hash first, so the distinct count needs no second pass over texts."""
    rows = table(spark, sf, "documents").select("source", "lang", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b"))
    per = rows.groupBy("source", "lang", "h").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.max("b").alias("m"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("b") / 4))).alias("t"))
    copies = F.sum("n") - F.count("h")
    return per.groupBy("source", "lang").agg(F.sum("n").alias("docs"), F.sum("b").alias("bytes"), F.max("m").alias("largest"), F.sum("t").alias("tokens"), copies.alias("duplicates"))


@query(
    """with r as (select lang, source, avg(quality) recall, min(quality)::int worst, count(*) n from documents join labels using (doc_id) group by 1, 2), a as (select avg(quality) overall from labels)
    select lang, source, n, round(recall, 6) recall, worst, recall >= overall - 0.05 passes from r, a"""
)
def group_gates(spark, sf):
    """Each group's mean and worst value against the whole with a tolerance; the whole is one row."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    overall = labels.agg(F.avg("quality").alias("overall"))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id")
    rows = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("quality").alias("recall"), F.min("quality").cast("int").alias("worst"))
    return rows.crossJoin(F.broadcast(overall)).select("lang", "source", "n", F.round("recall", 6).alias("recall"), "worst", (F.col("recall") >= F.col("overall") - 0.05).alias("passes"))


@query(
    """select p_partkey part, coalesce(q.qty, 0)::double qty, case when q.p is null then 'unused' when q.qty < 600 then 'review' else 'must_update' end "action", coalesce(n, 0) mentions
    from part left join (select l_partkey p, sum(l_quantity) qty, count(distinct l_orderkey) n from lineitem group by 1) q on p_partkey = q.p"""
)
def mention_impact(spark, sf):
    """Every changed key with what mentions it; keys without a mention stay. Mentions are aggregated before the join."""
    m = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q")).groupBy("l_partkey").agg(F.sum("q").alias("qty"), F.count("*").alias("mentions"))
    rows = table(spark, sf, "part").select("p_partkey").join(m, F.col("p_partkey") == F.col("l_partkey"), "left")
    action = F.when(F.col("l_partkey").isNull(), "unused").when(F.col("qty") < 600, "review").otherwise("must_update")
    return rows.select(F.col("p_partkey").alias("part"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"), action.alias("action"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query(
    """with c as (select source, doc_id, sha256(text) h from documents), g as (select source, count(*) n, bit_xor(('0x' || substr(h, 1, 15))::bigint) x, count(distinct h) texts from c group by source) select source, n, x "digest", texts from g"""
)
def corpus_digest(spark, sf):
    """AGG-11, GEN-4: a digest that no order of rows changes, so that two stores compare without a sort."""
    rows = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    per = rows.groupBy("source", "h").agg(F.count("*").alias("n"))
    bits = F.when(F.col("n") % 2 == 1, F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.bit_xor(bits).alias("digest"), F.count("h").alias("texts"))


@query(
    """with m as (select doc_id, count(*) n, count(*) filter (where toxic = 1) bad from labels group by 1), s as (select source, count(*) rows, count(n) covered, coalesce(sum(bad), 0)::bigint bad from documents left join m using (doc_id) group by 1)
    select source, rows, covered, bad, case when covered = 0 then 'missing' when covered < rows then 'partial' else 'full' end coverage from s"""
)
def manifest_coverage(spark, sf):
    """JN-8, GEN-6: how much of each source the ledger covers."""
    m = table(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("b"))
    s = table(spark, sf, "documents").select("doc_id", "source").join(m, "doc_id", "left").groupBy("source")
    s = s.agg(F.count("*").alias("rows"), F.count("n").alias("covered"), F.coalesce(F.sum("b"), F.lit(0)).alias("bad"))
    return s.withColumn("coverage", F.when(F.col("covered") == 0, "missing").when(F.col("covered") < F.col("rows"), "partial").otherwise("full"))


@query(
    r"""with n as (select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9_]+', '-', 'g'), '-') as "name", c_nationkey eco, c_acctbal from customer), a as (select "name", eco, max(c_custkey) latest, count(*) versions, max(c_acctbal) best from n group by 1, 2)
    select "name", eco, latest, versions, round(best, 2) best from a"""
)
def registry_latest(spark, sf):
    """Names are normalised, then each name of an ecosystem resolves to its latest entry."""
    rows = table(spark, sf, "customer").select("c_custkey", T.library_name(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("eco"), "c_acctbal")
    return rows.groupBy("name", "eco").agg(F.max("c_custkey").alias("latest"), F.count("*").alias("versions"), F.round(F.max("c_acctbal"), 2).alias("best"))


@query(
    """select source, doc_id, n_chars, lang from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) n from documents) where n <= 3"""
)
def prune_keep_versions(spark, sf):
    """The three longest of each group stay."""
    w = Window.partitionBy("source", "lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf, "documents").select("source", "doc_id", "n_chars", "lang", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query(
    r"""select page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), '[A-Za-z0-9]+')::varchar[] parts_raw,
      lower(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), '[A-Za-z0-9]+'), ' ')) phrase from pages"""
)
def identifier_parts(spark, sf):
    """STR-30 in part: identifiers in paths, cut at case changes and signs."""
    spaced = F.regexp_replace(F.regexp_replace(T.url_path(F.col("url")), r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    parts = F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", parts.alias("parts_raw"), F.lower(F.array_join(parts, " ")).alias("phrase"))


@query(
    r"""with s as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, url, html, page_id id2, sha256(html) h from pages) select min(page_id) page_id, h, count(*) copies, count(distinct host) hosts from s group by h"""
)
def page_first_wins(spark, sf):
    """DDP-2, DDP-5, DDP-7: the first page of each content, how many copies it has, and on how many hosts."""
    rows = table(spark, sf, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), F.sha2("html", 256).alias("h"))
    per = rows.groupBy("h", "host").agg(F.min("page_id").alias("p"), F.count("*").alias("n"))
    return per.groupBy("h").agg(F.min("p").alias("page_id"), F.sum("n").alias("copies"), F.count("*").alias("hosts"))


@query(
    """with f as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn, role) nxt from conversations) select role, nxt next_role, count(*) times, count(distinct conv_id) conversations from f where nxt is not null group by 1, 2"""
)
def role_transitions(spark, sf):
    """Which turn follows which, and in how many conversations."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, sf, "conversations").select("conv_id", "role", F.lead("role").over(w).alias("next_role")).where("next_role is not null")
    per = rows.groupBy("role", "next_role", "conv_id").agg(F.count("*").alias("n"))
    return per.groupBy("role", "next_role").agg(F.sum("n").alias("times"), F.count("*").alias("conversations"))


@query("select sha256(array_to_string([floor(x::double * 1000000 + 0.5)::bigint for x in embedding], ',')) h, min(vec_id) first_id, count(*) n from embeddings group by 1")
def embedding_hashes(spark, sf):
    """Vectors by the hash of their components in millionths; equal ones share a cache entry."""
    text = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000 + 0.5).cast("string")), ",")
    return table(spark, sf, "embeddings").groupBy(F.sha2(text, 256).alias("h")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))


@query(
    """with d as (select source, lang, doc_id, sha256(text) h, n_chars from documents), k as (select source, lang, h, min(doc_id) doc_id from d group by 1, 2, 3) select doc_id, source, lang from k"""
)
def guarded_dedupe(spark, sf):
    """DDP-4, FLT-11: first-wins on a key of several columns."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    return first_wins(rows, F.struct("source", "lang", "h"), [F.col("doc_id")]).select("doc_id", "source", "lang")
