"""Queries of the rules: questions, section quality, context and filters, registry, candidates, snippets, hydration, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions import quality as Q
from ..functions import questions as A
from ..functions import text as T
from ..operators import registry as G
from ..operators import rules as R
from ..operators.chunking import sections_by_strategy
from ..operators.fusion import best_groups, reciprocal_rank_fusion
from ..operators import index as X
from ..operators.markdown import markdown_chunks as chunk_rows
from ..operators.retrieval import budget_prefix, query_terms, top_k
from ..runtime import stage, table
from ..sources.store import sync_actions, upsert_points
from .retrieval_queries import _LANES, _Q, _TOP, QUESTIONS, WORDS, _lanes, _ranked, _with_source, index_of, questions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _turns(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query(
    f"""with t as (select conv_id, turn, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+') w from conversations where role = 'user'),
    f as (select *, len(list_filter(w, lambda x: lower(x) in ({_listed(A.ANSWER_FORMAT)}))) > 0 fmt from t),
    k as (select *, list_filter(w, lambda x: lower(x) not in ({_listed(A.QUERY_STOPWORDS)}) and not (fmt and lower(x) in ({_listed(A.FORMAT_WORDS)}))) kept from f)
    select conv_id, turn, case when len(kept) > 0 then array_to_string(kept, ' ') else t end asked from k"""
)
def questions_without_stopwords(spark, sf):
    """STR-22: a question's words that search for something, all of it if none does."""
    return _turns(spark, sf).select("conv_id", "turn", A.without_stopwords(F.col("text")).alias("asked"))


@query()
def question_plans(spark, sf):
    """STR-19, STR-20, STR-21, QRY-1: exact terms by kind, the one document that is pointed at, the other words; tested on examples and by a plain loop."""
    rows = _turns(spark, sf).select("conv_id", "turn", A.query_plan(F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", "p.query_hash", F.array_join(F.transform("p.terms", lambda t: F.concat_ws(":", t.kind, t.normalized)), "|").alias("terms"), "p.concept", "p.locator")


@query()
def section_quality(spark, sf):
    """STR-24: does a text look like code, is it trivial, how noisy is it, does it name code symbols? Tested against plain patterns."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", Q.looks_like_code(t).alias("code"), Q.is_trivial(t, F.lit(""), F.lit("")).alias("trivial"), F.round(Q.noise_score(t), 6).alias("noise"), Q.has_code_symbol(F.coalesce(t, F.lit(""))).alias("symbol"))


@query()
def code_blocks(spark, sf):
    """STR-23: a turn's code, fenced or line by line; tested on examples."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", Q.code_snippets(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("snippets"), F.sha2(F.array_join("s.code", "\x1f"), 256).alias("code_hash"))


@query()
def clean_sections(spark, sf):
    """STR-26: texts without anchors, emoji and lines of a user interface; tested against a plain loop."""
    t = Q.clean_section(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).alias("chars"), F.sha2(t, 256).alias("clean_hash"))


_TERMS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: length(w) > 1), lambda w: lower(w)))"


@query(f"""with {_TOP}, c as (select r.query_id, r.doc_id, r."rank", {_TERMS.format("q.text")} qt, {_TERMS.format("documents.text")} dt from r join documents using (doc_id) join q on q.query_id = r.query_id where "rank" <= 20)
    select query_id, doc_id, "rank", round(case when len(qt) = 0 or len(dt) = 0 then 0 else len(list_intersect(qt, dt)) / (len(qt) + len(dt) - len(list_intersect(qt, dt))) end, 6)::double similarity, round(len(list_intersect(qt, dt)) / len(qt), 6)::double relevance from c""")
def term_similarity(spark, sf):
    """STR-28: Jaccard similarity of a question's and a candidate's terms, and the candidate's relevance, whose code counts besides."""
    rows = _with_source(_ranked(spark, sf, 20), spark, sf).join(questions(spark).withColumnRenamed("text", "question"), "query_id")
    asked, none = Q.terms(F.col("question")), F.expr("cast(array() as array<struct<language:string,code:string>>)")
    return rows.select("query_id", F.col("id").alias("doc_id"), "rank", F.round(Q.similarity(asked, Q.terms(F.col("text"))), 6).alias("similarity"), F.round(Q.relevance(asked, F.col("text"), none), 6).alias("relevance"))


@query(f"""with {_TOP}, t as (select distinct query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) term from q)
    select r.query_id, r.doc_id, term, regexp_matches(lower(documents.text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{N}}_])') visible from r join documents using (doc_id) join t on t.query_id = r.query_id where "rank" <= 10""")
def visible_values(spark, sf):
    """STR-29: which of a question's terms stand in a candidate as words."""
    rows = _with_source(_ranked(spark, sf, 10), spark, sf).join(query_terms(questions(spark)).select("query_id", "term"), "query_id")
    return rows.select("query_id", F.col("id").alias("doc_id"), "term", Q.value_visible(F.col("term"), F.col("text")).alias("visible"))


def _worded(pattern: str) -> str:
    return pattern.replace("(?i)", "").replace(r"\b", "").replace("\\", "\\")


_W = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"


@query(
    "select doc_id, array_to_string(list_filter(["
    + ", ".join(f"case when regexp_matches(lower(text), '{_W}(?:{_worded(Q.QUALIFIERS[k])}){_E}') then '{k}' end" for k in sorted(Q.QUALIFIERS))
    + f"], lambda x: x is not null), ',') qualifiers, case when regexp_matches(lower(text), '{_W}(?:{_worded(Q.FORBIDDEN)}){_E}') then 'forbidden' when regexp_matches(lower(text), '{_W}(?:{_worded(Q.REQUIRED)}){_E}') then 'required' else 'neutral' end polarity from documents where text is not null"
)
def clause_qualifiers(spark, sf):
    """STR-31: what a text says about its statements: negated, conditional, proposed and so on, required or forbidden."""
    rows = table(spark, sf, "documents").where("text is not null")
    low = F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "x")  # a letter beyond ASCII is part of its word
    return rows.select("doc_id", F.array_join(Q.qualifiers(low), ",").alias("qualifiers"), Q.polarity(low).alias("polarity"))


@query()
def context_prefixes(spark, sf):
    """CHK-16, STR-17, STR-18: a page's bounded prefix of title, place and symbols; tested against a plain loop."""
    p = table(spark, sf, "pages").withColumn("text", T.main_content(F.coalesce("html", F.lit(""))))  # a column: each pattern of symbols would make the text anew
    p = p.withColumn("aliases", F.array_join(C.symbol_aliases(F.col("text")), ", "))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    fields = {"document_title": title, "canonical_location": C.canonical_url(F.coalesce("url", F.lit(""))), "library": T.url_host(F.coalesce("url", F.lit(""))), "source_class": F.lit("page"), "symbol_aliases": F.col("aliases")}
    x = C.context_prefix(fields)
    return p.select("page_id", x.alias("x")).select("page_id", F.col("x.text").alias("prefix"), F.array_join("x.fields", ",").alias("fields"), F.col("x.truncated"))


#: Values that filters may name, made of a document's own: there are no others in the given tables.
_META_SQL = """m as (select doc_id, source library_id, case doc_id % 5 when 0 then 'source_of_truth' when 1 then 'community' when 2 then 'unknown' when 3 then 'official' else 'unknown' end authority,
    case doc_id % 3 when 0 then '' when 1 then 'v' || lang else 'v1' end resolved_version, case doc_id % 4 when 0 then 'active' when 1 then 'superseded' when 2 then 'historical' else 'active' end lifecycle_status,
    case when doc_id % 4 in (1, 2) then 'historical' else 'current' end temporal_relevance, case doc_id % 2 when 0 then 1 end docs_snapshot_exact from documents)"""


def _metadata(spark, sf):
    k = F.col("doc_id")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    version = F.when(k % 3 == 0, "Latest").when(k % 3 == 1, F.concat(F.lit("v"), "lang")).otherwise("v1")
    values = {"library_id": F.col("source"), "authority": pick(5, "Source-Of-Truth", "community", "", "OFFICIAL", "made up"), "resolved_version": version, "lifecycle_status": pick(4, "", "Superseded", "historical", "odd"), "docs_snapshot_exact": pick(2, " True ", "maybe"), "source": F.col("source")}
    return table(spark, sf, "documents").select("doc_id", "source", F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("m"))


@query(f"with {_META_SQL} select * from m")
def filter_columns(spark, sf):
    """CHK-17: the typed columns that filters may name; unknown values fall back to their defaults."""
    return _metadata(spark, sf).select("doc_id", C.filter_metadata(F.col("m")).alias("x")).select("doc_id", "x.library_id", "x.authority", "x.resolved_version", "x.lifecycle_status", "x.temporal_relevance", "x.docs_snapshot_exact")


@query(f"with {_META_SQL} select doc_id from m where authority in ('verified', 'project_rule', 'source_of_truth', 'project_owned', 'official') and lifecycle_status in ('active', 'current') and temporal_relevance = 'current' and library_id not in ('src0', 'src2')")
def metadata_filters(spark, sf):
    """FLT-2, FLT-3, FLT-4: a least authority, states, and forbidden sources over normalized columns with their defaults."""
    names = ("library_id", "authority", "lifecycle_status", "temporal_relevance")
    clean = T.bind(C.filter_metadata(F.col("m")), lambda x: F.create_map(*[c for n in names for c in (F.lit(n), x[n])]))
    wanted = {"minimum_authority": "verified", "lifecycle_statuses": ["active", "current"], "temporal_relevance": "current", "forbidden_sources": ["SRC0", " src2"]}
    return _metadata(spark, sf).where(T.bind(clean, lambda m: C.passes(m, wanted))).select("doc_id")


_ROUTERS = [(r"(^|\s)(der|die|das)(\s|$)", {"lang": "de"}), (r"(^|\s)(le|la|les)(\s|$)", {"lang": "fr"}), (r"(^|\s)(the|of)(\s|$)", {"lang": "en", "doc_scope": "prose"})]


@query("select conv_id, turn, " + " ".join(["case", *[f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{f['lang']}'" for p, f in _ROUTERS], "end"]) + " lang from conversations where role = 'user'")
def routed_questions(spark, sf):
    """FLT-6: the first router whose pattern a question holds gives it default filters."""
    return _turns(spark, sf).select("conv_id", "turn", F.try_element_at(C.routed(F.col("text"), _ROUTERS), F.lit("lang")).alias("lang"))


@query(
    r"""with p as (select page_id, ltrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') path from pages)
    select page_id, (starts_with(path, 'en/') and regexp_matches(string_split(path, '/')[-1], '^.*\.html$')) or regexp_matches(path, '^docs/.*$') or regexp_matches(path, '^fr/[1-3].*$') included,
      list_contains(string_split(path, '/')[:-2], 'de') or path = 'es' or starts_with(path, 'es/') excluded from p"""
)
def glob_paths(spark, sf):
    """FLT-13, SRC-1: paths that include and exclude globs name."""
    path = F.ltrim(T.url_path(F.col("url")), F.lit("/"))
    return table(spark, sf, "pages").select("page_id", C.glob_matches(path, ["en/**/*.html", "docs/*", "fr/[1-3]*"]).alias("included"), C.excluded(path, ["de", "./es"]).alias("excluded"))


@query(
    r"""with p as (select page_id, lower(trim(ltrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'))) p from pages), n as (select *, list_filter(string_split(p, '/'), lambda x: x <> '') a from p),
    m as (select *, coalesce(a[-1], '') nm, coalesce(a[1], '') f, coalesce(a[1], '') in ('packages', 'apps', 'services', 'modules', 'libs', 'crates', 'plugins', 'components') md from n),
    k as (select page_id, case when contains(p, 'patch-review') then 'patch_review_artifact' when contains(p, 'dogfood') then 'dogfood_artifact' when starts_with(p, 'docs/research/') or contains(p, '/research/') then 'research'
      when nm in ('changelog', 'changelog.md', 'changes', 'changes.md', 'history', 'history.md') or starts_with(nm, 'changelog.') then 'changelog'
      when starts_with(nm, 'architecture.') or nm in ('arch.md', 'arch.mdx') or list_contains(a, 'architecture') then case when md then 'package_architecture' else 'architecture' end
      when len(a) = 2 and f in ('docs', 'doc') and starts_with(nm, 'index.') then 'index' when list_has_any(a, ['adr', 'adrs']) then 'adr' when list_has_any(a, ['runbook', 'runbooks']) then 'runbook'
      when ends_with(nm, 'readme.md') or starts_with(nm, 'readme.') then case when md then 'package_readme' else 'readme' end
      when starts_with(p, 'docs/') or contains(p, '/docs/') then 'docs' when starts_with(p, 'wiki/') or contains(p, '/wiki/') then 'wiki' else 'project_doc' end source_type from m)
    select page_id, source_type, case when source_type in ('patch_review_artifact', 'dogfood_artifact') then 'artifact' when source_type = 'research' then 'research' when source_type = 'changelog' then 'historical' when source_type like 'package_%' then 'secondary'
      when source_type in ('architecture', 'index', 'adr', 'runbook', 'readme') then 'primary' else 'supporting' end authority from k"""
)
def source_taxonomy(spark, sf):
    """RNK-6: a document's kind and authority by its path; also tested on examples."""
    x = C.path_taxonomy(F.ltrim(T.url_path(F.col("url")), F.lit("/")))
    return table(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", "x.source_type", "x.authority")


def _registry(spark, sf):
    """Libraries made of parts: a third without a version, a third latest."""
    k, name = F.col("p_partkey"), F.col("p_name")
    version = F.when(k % 3 == 1, F.col("p_size").cast("string")).when(k % 3 == 2, "latest")
    system = F.when(k % 2 == 0, F.lower("p_type"))
    return table(spark, sf, "part").select(
        F.concat_ws("#", T.library_id(name, F.coalesce(system, F.lit("")), F.coalesce(version, F.lit("")), F.lit("api")), k.cast("string")).alias("library_id"), T.library_name(name).alias("normalized_name"), system.alias("ecosystem"), version.alias("version"), F.lit(None).cast("string").alias("source_type"),
        F.array("p_brand").alias("aliases"), F.array(F.concat(F.lit("part-"), k.cast("string"))).alias("legacy_ids"), name.alias("name"), k.alias("k"),
    )


@query()
def registry_resolution(spark, sf):
    """REG-1: names, versions, brands and old ids of parts, resolved step by step; tested against a plain loop."""
    r = _registry(spark, sf)
    asked = r.select(F.col("k").alias("ask"), F.when(F.col("k") % 5 == 0, F.get("aliases", F.lit(0))).when(F.col("k") % 5 == 1, F.get("legacy_ids", F.lit(0))).when(F.col("k") % 5 == 2, F.replace("name", F.lit(" "), F.lit(""))).otherwise(F.col("name")).alias("library"), F.when(F.col("k") % 3 == 0, F.col("ecosystem")).alias("ecosystem"), F.when(F.col("k") % 4 == 0, F.col("version")).alias("version"), F.lit(None).cast("string").alias("source_type"))
    return G.resolve(r, asked)


@query()
def registry_candidates(spark, sf):
    """REG-2: all records that a name fits; the names asked are the distinct ones. Tested against a plain loop."""
    r = _registry(spark, sf)
    asked = r.select(F.col("normalized_name").alias("library")).distinct().select(F.col("library").alias("ask"), "library", F.lit(None).cast("string").alias("ecosystem"), F.lit("latest").alias("version"), F.lit(None).cast("string").alias("source_type"))
    return G.candidates(r, asked).groupBy("ask").agg(F.count("*").alias("records"), F.min("library_id").alias("first"))


@query("select o_orderkey from orders where not o_orderpriority in ('1-URGENT', '2-HIGH') and (o_orderstatus = 'F' or o_orderdate <= timestamp '1996-01-01 00:00:00')")
def prunable_records(spark, sf):
    """REG-3: failed or old records go, but kept versions."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("version"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ready").alias("status"), F.lit(None).cast("timestamp").alias("last_refreshed_at"), F.col("o_orderdate").cast("timestamp").alias("last_checked_at"), F.lit(None).cast("timestamp").alias("added_at"))
    return G.prunable(o, F.lit("1996-01-01 00:00:00").cast("timestamp"), ["1-URGENT", " 2-high"]).select("o_orderkey")


@query()
def redirect_patterns(spark, sf):
    """STM-2: addresses of translated pages and of their English ones, by domain: the pattern from one to the other, once seen three times; tested
    against a plain loop."""
    address = _address()
    final = F.regexp_replace(address, r"^(https?://[^/]+)/(?:fr|de|es)/", "$1/en/")
    return G.learn_redirects(table(spark, sf, "pages").select(address.alias("original"), final.alias("final"), F.col("page_id").alias("at")))


def _address():
    """A page's path at its registered domain."""
    return F.concat(T.url_scheme(F.col("url")), F.lit("://"), F.regexp_extract(T.url_host(F.col("url")), r"([^.]+\.[^.]+)$", 1), T.url_path(F.col("url")))


@query()
def redirect_predictions(spark, sf):
    """STM-2: where the learnt patterns send each page's address."""
    patterns = stage(redirect_patterns(spark, sf), "redirects")
    urls = table(spark, sf, "pages").select(_address().alias("url")).distinct()
    return G.predict_redirects(urls, patterns)


_CAND = """c as (select d.doc_id, source, text, n_chars, lang, case when d.doc_id % 4 = 0 then 'ok' || d.doc_id end stable_id, quality, toxic from documents d left join (select doc_id, max(quality) quality, max(toxic) toxic from labels group by 1) l on l.doc_id = d.doc_id)"""


@query(f"""with {_CAND} select doc_id, case when coalesce(source, '') = '' or coalesce(text, '') = '' or (stable_id is not null and doc_id % 8 = 0) then 'invalid_identity' end invalid, case when quality = 1 then 'canonical' else 'supporting' end authority,
    case doc_id % 3 when 0 then 0 when 1 then 2 else 1 end version_rank, coalesce(stable_id, 'legacy') like 'ok%' child, greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::bigint token_estimate from c""")
def candidate_identity(spark, sf):
    """EVS-2: candidates with their defaults; a child needs a parent and its text's hash, others get an id of path and text."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("path"), "text").join(labels, "doc_id", "left")
    rows = rows.select("doc_id", "path", "text", F.when(k % 4 == 0, F.concat(F.lit("ok"), k.cast("string"))).alias("stable_id"), F.when(k % 8 != 0, F.lit("p")).alias("parent_id"), F.when(k % 4 == 0, F.sha2("text", 256)).alias("content_hash"), F.when(F.col("quality") == 1, "official").otherwise("odd").alias("authority"), F.when(k % 3 == 0, "Exact-Version").when(k % 3 == 1, "latest").otherwise("2.1").alias("version_binding"))
    got = R.normalized_candidates(rows)
    return got.select("doc_id", "invalid", "authority", "version_rank", (F.col("identity_kind") == "stable_child").alias("child"), "token_estimate")


@query(f"""with {_CAND} select doc_id, case when source = 'src1' then 'forbidden_source' when quality = 0 then 'stale' when toxic = 1 then 'instruction_risk' when lang <> 'en' then 'outside_scope' when doc_id % 3 = 1 then 'unknown_version' when doc_id % 3 = 2 then 'wrong_version'
    when n_chars < 200 then 'navigation_only' when doc_id % 11 = 0 then 'query_intent_mismatch' end reason from c""")
def candidate_reasons(spark, sf):
    """FLT-9, AGG-12: the first reason in order that rules a candidate out; labels and sizes stand for a candidate's state."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars", "lang").join(labels, "doc_id", "left")
    rows = rows.select(
        "doc_id", F.array(F.coalesce("source", F.lit(""))).alias("aliases"), F.when(F.col("quality") == 0, "Stale").otherwise("current").alias("freshness"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
        F.when(k % 11 == 0, "Legal").otherwise("project_doc").alias("source_class"), F.col("lang").alias("project_identity"), F.lit("m").alias("module_id"), F.when(k % 3 == 1, "latest").otherwise("exact").alias("version_binding"), F.when(k % 3 == 0, "1.0").otherwise("2.0").alias("resolved_version"), (F.col("n_chars") < 200).alias("navigation_only"), "text",
    )
    return R.eligibility(rows, forbidden=["src1"], exact_versions=["1.0"], project="en").select("doc_id", "reason")


@query("with k as (select source || '/' || split_part(coalesce(text, ''), ' ', 1) key, coalesce(text, '') t, lang from documents where source is not null) select key from k group by key having count(distinct t || chr(31) || coalesce(lang, '')) > 1")
def identity_collisions(spark, sf):
    """SET-5: identities that different texts claim; all their rows would be dropped."""
    rows = table(spark, sf, "documents").where("source is not null").select(F.concat("source", F.lit("/"), F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1))).alias("key"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("lang", F.lit("")).alias("l"))
    return R.identity_collisions(rows, "key", ["t", "l"])


@query("select 'the ' || lower(p_name) || ' set' statement, count(*) filter (p_size % 3 = 0) required, count(*) filter (p_size % 3 = 1) forbidden from part group by 1 having required > 0 and forbidden > 0")
def policy_conflicts(spark, sf):
    """EVS-8: statements that one line demands and another forbids. Each part's text demands or forbids its name, or says neither."""
    rule = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), "p_name", F.lit(" must be set."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Never: the "), "p_name", F.lit(" set"))).otherwise(F.concat(F.lit("The "), "p_name", F.lit(" may be set.")))
    rows = table(spark, sf, "part").select(F.concat(F.lit("# About\n"), rule, F.lit("\nNothing else.")).alias("text"))
    return R.conflicts(R.policy_lines(rows, "text"))


@query()
def cover_repair(spark, sf):
    """EVS-6: the three best candidates, exchanged for a cheaper cover of the question's terms; tested against brute force."""
    rows = _with_source(_ranked(spark, sf, 10), spark, sf)
    words = query_terms(questions(spark)).groupBy("query_id").agg(F.collect_set("term").alias("asked"))
    rows = rows.join(words, "query_id").select(F.col("query_id").alias("group_id"), "id", (F.col("rank") <= 3).alias("selected"), F.array_intersect("asked", T.tokens(F.col("text"))).alias("covers"), F.lit("supporting").alias("authority"), F.lit(2).alias("version_rank"), T.estimate_utf8_tokens(F.col("text")).alias("cost"))
    best = rows.where("selected").select("group_id", F.explode("covers").alias("t")).groupBy("group_id").agg(F.collect_set("t").alias("mandatory"))
    return R.cheaper_cover(rows.join(best, "group_id"))


@query(
    f"""with {_LANES}, f as (select query_id, doc_id, row_number() over (partition by query_id order by round(sum(1 / (60.0 + "rank")), 12) desc, doc_id) n from l group by 1, 2),
    b as (select query_id, doc_id, n from f where n <= 8), x as (select query_id, doc_id, 0 later, n, 0 k from b union all select query_id, near, 1, n, k from (select query_id, n, unnest([doc_id - 1, doc_id + 1]) near, unnest([1, 2]) k from b) where near in (select doc_id from documents)),
    o as (select query_id, doc_id, min((later, n, k)) m from x group by 1, 2) select query_id, doc_id section_id, row_number() over (partition by query_id order by m)::int pos from o qualify pos <= 24"""
)
def hydrated_ranking(spark, sf):
    """FUS-6, FUS-7, FUS-8, EXP-3, JN-6: the best fused documents, then their neighbours, each once and in order, as ids to be fetched."""
    fused = reciprocal_rank_fusion(_lanes(spark, sf))
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")))
    own = stage(fused.where("rank <= 60"), "fused")
    near = own.select("id").distinct().select(F.col("id").alias("section_id"), F.posexplode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("n", "near"))
    there = table(spark, sf, "documents").select("doc_id").join(F.broadcast(near.select("near").distinct()), F.col("doc_id") == F.col("near"), "left_semi")  # two neighbours of sixty ids a question
    near = near.join(there, F.col("near") == F.col("doc_id")).drop("doc_id")
    return R.hydration_ids(own, own.select("id").distinct().withColumn("section_id", F.col("id")), limit=8, neighbours=near).select("query_id", "section_id", "pos")


@query()
def fetched_prefix(spark, sf):
    """JN-6, PCK-2: the hydrated ids' documents in their order, up to a budget; tested against a loop."""
    ids = stage(hydrated_ranking(spark, sf), "hydrated")
    docs = X.fetch(index_of(spark, sf), ids.select(F.col("section_id").alias("id")), "doc_id")
    rows = ids.join(docs, F.col("section_id") == F.col("doc_id")).withColumn("cost", T.estimate_tokens(F.col("text")))
    return budget_prefix(rows, "query_id", "pos", F.col("cost"), 2400).select("query_id", "pos", "doc_id", "used")


_NOISE_SQL = " + ".join(f"regexp_matches(code, '(?i){p}')::int" for p in Q.NOISE)
_ANY_NOISE = " or ".join(f"regexp_matches(x, '(?i){p}')" for p in Q.NOISE)
_SNIP = rf"""{_TOP}, c as (select r.query_id, r.doc_id, r."rank", r.source, q.text qtext, documents.text[1:1200] code, split_part(documents.text, '.', 1) title from r join documents using (doc_id) join q on q.query_id = r.query_id where "rank" <= 20),
t as (select *, {_TERMS.format("qtext")} qt, {_TERMS.format("code")} ct, {_TERMS.format("title")} tt, {_NOISE_SQL} hits, list_filter(string_split(code, chr(10)), lambda x: trim(x) <> '') ls from c),
n as (select *, case when hits = 0 then 0.0 else least(1.0, 0.35 * hits + len(list_filter(ls, lambda x: {_ANY_NOISE})) / greatest(len(ls), 1)) end noise, least(1.0, 0.55 * len(list_intersect(qt, list_distinct(ct || tt))) / greatest(len(qt), 1) + 0.05 + 0.10 * len(list_intersect(qt, tt)) / greatest(len(qt), 1)) rel,
  lower(title || ' ' || source || '  ' || code) hay, lower(qtext) asks from t),
z as (select *, greatest(0.0, 0.30 * rel + 0.14 * 0.7 + 0.10 * 0.5 + 0.10 + 0.08 * case when length(code) between 20 and 1200 then 1.0 when length(code) < 20 then 0.35 else 0.45 end
  + 0.10 * greatest({", ".join("case when " + " or ".join(f"contains(asks, '{w}')" for w in ws) + " then case when " + " or ".join(f"contains(hay, '{a}')" for a in answers) + " then 1.0 " + ("when contains(hay, 'architecture') then 0.25 " if "module" in ws else "") + "else 0.0 end else 0.0 end" for ws, answers in R.INTENTS)})
  - noise * 0.2 - case when length(trim(code)) < 8 then 0.25 else 0 end) score from n)"""


def _snippets(spark, sf):
    rows = _with_source(_ranked(spark, sf, 20), spark, sf).join(questions(spark).withColumnRenamed("text", "question"), "query_id")
    none, empty = F.expr("cast(array() as array<string>)"), F.lit("")
    code, title = F.substring("text", 1, 1200), F.split_part("text", F.lit("."), F.lit(1))
    score = R.snippet_score(F.col("question"), code, title, source=F.col("source"), url=empty, source_class=F.lit("project_doc"), symbols=none, language=empty, languages=none, exact_version=F.lit(None).cast("boolean"), version=empty, requested=empty, complete=F.lit(True))
    return rows.select("query_id", F.col("id").alias("doc_id"), "rank", "source", code.alias("code"), empty.alias("language"), score.alias("score"))


@query(f'with {_SNIP} select query_id, doc_id, "rank", round(score, 6)::double score from z')
def snippet_scores(spark, sf):
    """RNK-8: the weighted score of each candidate's beginning as a snippet."""
    return _snippets(spark, sf).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query()
def snippet_presentation(spark, sf):
    """RNK-9: the primary snippet and those that support it, one a source, with a confidence; tested against a loop."""
    return R.present_snippets(_snippets(spark, sf).withColumnRenamed("rank", "block")).withColumn("score", F.round("score", 6))


@query()
def stage_fit(spark, sf):
    """PCK-5: of the candidates in order those that fit whole, eight and 12,000 bytes at most; tested against a loop."""
    rows = _with_source(_ranked(spark, sf, 20), spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return rows.select("query_id", F.transform(R.stage_items(F.col("x.text"), 8, 12_000), lambda t: F.sha2(t, 256)).alias("kept"))


@query(
    f"""with {_LANES}, g as (select distinct doc_id from labels where quality = 1), m as (select case lane when 0 then 'lexical' else 'frequency' end "mode", query_id, max(("rank" <= 5 and l.doc_id in (select doc_id from g))::int) r5, max(("rank" <= 10 and l.doc_id in (select doc_id from g))::int) r10 from l group by 1, 2)
    select "mode", round(sum(r5) / 5, 6)::double recall5, round(sum(r10) / 5, 6)::double recall10 from m group by 1"""
)
def recall_by_mode(spark, sf):
    """EVL-11, EVL-8: of all questions the share with a good document among the best five and ten, by lane."""
    lanes = _lanes(spark, sf)
    rows = None
    for name, lane in lanes.items():
        part = lane.where("rank <= 10").select(F.lit(name).alias("mode"), "query_id", "id", "rank")
        rows = part if rows is None else rows.union(part)
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("g")).distinct()
    hit = good.join(stage(rows, "lanes"), F.col("g") == F.col("id"), "right")
    per = hit.groupBy("mode", "query_id").agg(F.max((F.col("g").isNotNull() & (F.col("rank") <= 5)).cast("int")).alias("r5"), F.max(F.col("g").isNotNull().cast("int")).alias("r10"))
    n = float(questions(spark).count())
    return per.groupBy("mode").agg(F.round(F.sum("r5") / n, 6).alias("recall5"), F.round(F.sum("r10") / n, 6).alias("recall10"))


@query(
    f"""with {_TOP}, c as (select r.query_id, r."rank", r.source, lower(source || chr(10) || split_part(documents.text, '.', 1) || chr(10) || documents.text) t from r join documents using (doc_id, source) where "rank" <= 10), f as (select distinct query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) fact from q)
    select query_id, (select count(*) from f where f.query_id = c.query_id) facts, (select count(*) from f where f.query_id = c.query_id and exists (select 1 from c c2 where c2.query_id = f.query_id and contains(c2.t, fact))) met, count(*) filter (where contains(source, 'src1')) forbidden, count(*) filter (where contains(source, 'src0')) expected from c group by query_id"""
)
def fact_checks(spark, sf):
    """EVL-5, EVL-6: how many required facts the ten best documents hold between them, and how many are expected or forbidden sources."""
    rows = stage(_with_source(_ranked(spark, sf, 10), spark, sf), "judged")
    facts = query_terms(questions(spark)).select("query_id", "term")
    text = F.lower(F.concat_ws("\n", "source", F.split_part("text", F.lit("."), F.lit(1)), "text"))
    met = rows.select("query_id", text.alias("t")).join(facts, "query_id").groupBy("query_id", "term").agg(F.max(F.contains("t", "term").cast("int")).alias("met"))
    met = met.groupBy("query_id").agg(F.count("*").alias("facts"), F.sum("met").alias("met"))
    seen = rows.groupBy("query_id").agg(F.count_if(F.contains("source", F.lit("src1"))).alias("forbidden"), F.count_if(F.contains("source", F.lit("src0"))).alias("expected"))
    return met.join(seen, "query_id").select("query_id", "facts", "met", "forbidden", "expected")


@query("with d as (select doc_id id, sha256(coalesce(text, '')) h from documents), e as (select doc_id id, case when doc_id % 3 = 0 then sha256(source) else sha256(coalesce(text, '')) end h from documents where doc_id % 5 <> 0 union all select vec_id + 1000000000, 'x' from embeddings) select coalesce(d.id, e.id) id, case when d.id is null then 'prune' when d.h = e.h then 'skip' else 'upsert' end \"action\" from d full join e on d.id = e.id")
def embedding_plan(spark, sf):
    """VEC-5, VEC-6: what to prune, skip and embed anew, by content hash; the ledger knows four of five documents, a third of them by an old hash."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "source")
    old = d.where("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.sha2("source", 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    gone = table(spark, sf, "embeddings").select((F.col("vec_id") + 1_000_000_000).alias("id"), F.lit("x").alias("content_hash"))
    return sync_actions(d.drop("source"), old.union(gone))


@query(
    r"""with t as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1)) r from pages), c as (select page_id, list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda x: trim(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), e' \t\n\r')) a from t)
    select page_id, count(*) filter (where len(list_filter(a, lambda x: x <> '')) > 0) table_rows, sum(case when len(list_filter(a, lambda x: x <> '')) > 0 then length(array_to_string(a, ' | ')) else 0 end)::bigint chars from c group by 1"""
)
def html_tables(spark, sf):
    """STR-9: a page's table rows as cells parted by bars; empty rows are none."""
    return table(spark, sf, "pages").select("page_id", F.explode(T.table_lines(F.coalesce("html", F.lit("")))).alias("r")).groupBy("page_id").agg(F.count_if(F.regexp_replace("r", r"[ |]", "") != "").alias("table_rows"), F.sum(F.when(F.regexp_replace("r", r"[ |]", "") != "", F.length("r")).otherwise(0)).cast("long").alias("chars"))


@query(
    r"""with l as (select distinct page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="(/[^"#?]+)"', 1)) href from pages),
    t as (select distinct lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages),
    c as (select page_id, host, href, unnest([href, href || '.html', href || '/index.html', regexp_replace(href, '/+$', '')]) path, unnest([0, 1, 2, 3]) k from l),
    m as (select page_id, href, count(distinct t.path) n, min(k) filter (where t.path is not null) k from c left join t using (host, path) group by 1, 2)
    select page_id, href, case when n = 1 and k = 0 then 'exact' when n = 1 then 'heuristic' when n > 1 then 'ambiguous' else 'unresolved' end state from m"""
)
def import_resolution(spark, sf):
    """A link's candidates are its path and the path with endings; one that exists resolves it, exactly or by rule, several are ambiguous."""
    p = table(spark, sf, "pages")
    there = p.select(T.url_host(F.col("url")).alias("host"), T.url_path(F.col("url")).alias("path")).distinct()
    links = p.select("page_id", T.url_host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="(/[^"#?]+)"'), F.lit(1))).alias("href")).distinct()
    href = F.col("href")
    tried = links.select("page_id", "host", "href", F.posexplode(F.array(href, F.concat(href, F.lit(".html")), F.concat(href, F.lit("/index.html")), F.regexp_replace(href, "/+$", ""))).alias("k", "path"))
    met = tried.join(there.withColumn("found", F.col("path")), ["host", "path"], "left").groupBy("page_id", "href").agg(F.count_distinct("found").alias("n"), F.min(F.when(F.col("found").isNotNull(), F.col("k"))).alias("k"))
    state = F.when((F.col("n") == 1) & (F.col("k") == 0), "exact").when(F.col("n") == 1, "heuristic").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return met.select("page_id", "href", state.alias("state"))


@query()
def markdown_chunks(spark, sf):
    """CHK-5, CHK-7, CHK-8, CHK-10: chunks of the older Markdown chunker; tested on examples, and that they hold every word."""
    rows = chunk_rows(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "chunk_index", F.length("text").alias("chars"), F.sha2("text", 256).alias("chunk_hash"))


@query("select distinct d.source, d.lang from documents d where source is not null and lang is not null and not exists (select 1 from documents x join labels l on l.doc_id = x.doc_id where x.source = d.source and x.lang = d.lang)")
def backfilled_pairs(spark, sf):
    """SET-4: the distinct pairs that a ledger of labelled documents lacks."""
    d = table(spark, sf, "documents").where("source is not null and lang is not null")
    have = d.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("source", "lang").distinct()
    return d.select("source", "lang").distinct().join(have, ["source", "lang"], "left_anti")


@query("select vec_id from embeddings where vec_id not in (select doc_id from documents where doc_id is not null)")
def orphaned_vectors(spark, sf):
    """GEN-7: stored artefacts that no document refers to."""
    return table(spark, sf, "embeddings").select("vec_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("select doc_id, case when doc_id in (select doc_id from labels) then 'current' else 'legacy' end generation, greatest(1, ceil(length(coalesce(text, '')) / 4.0))::bigint tokens, sha256(coalesce(text, '')) content_hash from documents where length(trim(coalesce(text, ''))) > 0")
def sections_for_embedding(spark, sf):
    """GEN-8: what is to be embedded, from the active generation and the legacy one."""
    known = table(spark, sf, "labels").select("doc_id").distinct().withColumn("g", F.lit("current"))
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").where(F.length(F.trim(text)) > 0).join(known, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("g", F.lit("legacy")).alias("generation"), T.estimate_tokens(text).alias("tokens"), F.sha2(text, 256).alias("content_hash"))


@query("select vec_id, case when vec_id % 10 = 0 and label <> 3 then label + 100 else label end label from embeddings union all select vec_id + 1000000000, label from embeddings where vec_id % 50 = 0")
def vector_upsert(spark, sf):
    """SNK-5, SNK-6: points inserted or replaced by id; a point of another owner (here the label 3) stays as it is."""
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("label") == 3).alias("foreign"))
    new = stored.where("id % 10 = 0").select("id", (F.col("label") + 100).alias("label")).union(stored.where("id % 50 = 0").select(F.col("id") + 1_000_000_000, "label"))
    return upsert_points(stored, new, "foreign").select(F.col("id").alias("vec_id"), "label")


@query("select doc_id, source || '/' || lang path_prefix, sha256(lower(trim(split_part(coalesce(text, ''), '.', 1)))) title_hash, strlen(coalesce(text, '')) bytes from documents where source is not null and lang is not null")
def vector_payloads(spark, sf):
    """VEC-7: a point's payload: the path above it, its title's hash, its size."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").where("source is not null and lang is not null").select("doc_id", F.concat_ws("/", "source", "lang").alias("path_prefix"), F.sha2(F.lower(F.trim(F.split_part(text, F.lit("."), F.lit(1)))), 256).alias("title_hash"), F.octet_length(text).cast("long").alias("bytes"))


@query(f"""with {_TOP}, c as (select r.query_id, r.source, documents.lang, sha256(documents.text) h from r join documents using (doc_id) where "rank" <= 5)
    select query_id, count(distinct source) unique_sources, round(1 - count(distinct h) / count(*), 6)::double duplicate_rate, round(count(*) filter (where lang <> 'en') / count(*), 6)::double other_locales from c group by query_id""")
def redundancy_at_5(spark, sf):
    """EVL-7: of the five best the sources, the share of repeated texts, and the share in other languages."""
    rows = stage(_ranked(spark, sf, 5), "ranking")
    docs = X.fetch(index_of(spark, sf), rows, "doc_id").select(F.col("doc_id").alias("id"), "source", "lang", F.sha2("text", 256).alias("h"))
    per = rows.join(docs, "id").groupBy("query_id")
    return per.agg(F.count_distinct("source").alias("unique_sources"), F.round(1 - F.count_distinct("h") / F.count("*"), 6).alias("duplicate_rate"), F.round(F.count_if(F.col("lang") != "en") / F.count("*"), 6).alias("other_locales"))


@query(
    f"""with {_LANES}, g as (select distinct doc_id from labels where quality = 1), k as (select * from (values (1), (3), (5), (20)) v(k)),
    m as (select query_id, k, max((lane = 0 and "rank" <= k and l.doc_id in (select doc_id from g))::int) cand, max((lane = 1 and "rank" <= k and l.doc_id in (select doc_id from g))::int) base from l, k group by 1, 2)
    select k, round(avg(cand), 6) candidate, round(avg(base), 6) baseline, avg(cand) < avg(base) regressed, count(*) filter (where cand < base) worse from m group by k"""
)
def recall_gates(spark, sf):
    """EVL-9, EVL-10: hits within 1, 3, 5 and 20, compared with a baseline lane: is the mean lower, and for how many questions?"""
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("g")).distinct()
    rows = None
    for name, lane in _lanes(spark, sf).items():
        part = lane.where("rank <= 20").select("query_id", "id", "rank", F.lit(name == "lexical").alias("new"))
        rows = part if rows is None else rows.union(part)
    rows = good.join(stage(rows, "lanes"), F.col("g") == F.col("id"), "right").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 20)])))
    hit = (F.col("g").isNotNull() & (F.col("rank") <= F.col("k"))).cast("int")
    per = rows.groupBy("query_id", "k").agg(F.max(F.when(F.col("new"), hit).otherwise(0)).alias("cand"), F.max(F.when(~F.col("new"), hit).otherwise(0)).alias("base"))
    return per.groupBy("k").agg(F.round(F.avg("cand"), 6).alias("candidate"), F.round(F.avg("base"), 6).alias("baseline"), (F.avg("cand") < F.avg("base")).alias("regressed"), F.count_if(F.col("cand") < F.col("base")).alias("worse"))


@query(
    r"""with p as (select * from (values (400, 50), (800, 100), (1200, 200)) v(size, overlap)), d as (select length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) n from documents where text is not null)
    select size, overlap, sum(case when n = 0 then 0 when n <= size then 1 else ceil((n - size) / (size - overlap)::double) + 1 end)::bigint windows, count(*) filter (where n > size) split_documents from p, d group by 1, 2"""
)
def window_grid(spark, sf):
    """Variants of the window size and overlap side by side, from one pass over the texts' lengths."""
    n = F.length(T.stripped(F.regexp_replace("text", T.SPACES, " ")))
    lengths = table(spark, sf, "documents").where("text is not null").select(n.alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap")) for a, b in ((400, 50), (800, 100), (1200, 200))]))
    rows = lengths.select("n", "times", grid.alias("g")).select("n", "times", "g.*")
    windows = F.when(F.col("n") == 0, 0).when(F.col("n") <= F.col("size"), 1).otherwise(F.ceil((F.col("n") - F.col("size")) / (F.col("size") - F.col("overlap"))) + 1)
    return rows.groupBy("size", "overlap").agg(F.sum(windows * F.col("times")).cast("long").alias("windows"), F.sum(F.when(F.col("n") > F.col("size"), F.col("times")).otherwise(0)).alias("split_documents"))


@query(
    """with c as (select sha256(text) h, count(*) copies, min(doc_id) first_id from documents where text is not null group by 1 having count(*) > 1), o as (select *, row_number() over (order by copies desc, first_id) n, count(*) over () total from c)
    select n, first_id, copies, total, case when total > 10 then 10 end next_offset from o where n between 6 and 10"""
)
def report_page(spark, sf):
    """IMP-4, PCK-6: one page of a report, five rows from the sixth on, with the total and where to go on. A page is taken by a top-k, the whole is only counted."""
    rows = table(spark, sf, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    rows = stage(rows, "report")
    total = rows.count()
    page = rows.orderBy(F.desc("copies"), "first_id").limit(10).withColumn("n", F.row_number().over(Window.orderBy(F.desc("copies"), "first_id"))).where("n > 5")
    return page.select("n", "first_id", "copies", F.lit(total).cast("long").alias("total"), F.lit(10 if total > 10 else None).cast("int").alias("next_offset"))


@query(
    r"""with b as (select page_id, regexp_extract(coalesce(html, ''), '(?is)<(?:nav|ol|ul|div)[^>]*(?:aria-label=["'']breadcrumb["'']|class=["''][^"'']*breadcrumbs?[^"'']*["''])[^>]*>(.*?)</(?:nav|ol|ul|div)>', 1) s from pages)
    select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(s, '(?is)<(?:a|li|span)[^>]*>([^<]*)</', 1), lambda x: trim(x)), lambda x: x <> '' and x not in ('›', '>', '/', '»')), ' > ') section_path from b"""
)
def section_paths(spark, sf):
    """STR-14: the breadcrumbs of a page."""
    return table(spark, sf, "pages").select("page_id", F.array_join(T.breadcrumbs(F.coalesce("html", F.lit(""))), " > ").alias("section_path"))


@query(
    r"""with l as (select distinct page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="(/[^"#?]+)"', 1)) href from pages),
    t as (select distinct lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages),
    h as (select distinct page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)), '<[^>]+>', '', 'g')) name from pages)
    select 'page:' || page_id src, case when t.path is null then 'stub:' || l.host || href else 'path:' || l.host || href end dst, case when t.path is null then 'unresolved_import' else 'imports' end kind from l left join t on t.host = l.host and t.path = l.href
    union all select 'page:' || page_id, 'symbol:' || page_id || ':' || name, 'contains' from h where name <> ''"""
)
def page_graph(spark, sf):
    """Pages contain headings, and link to others; a target that is not there is a stub."""
    p = table(spark, sf, "pages")
    host, me = T.url_host(F.col("url")), F.concat(F.lit("page:"), "page_id")
    links = p.select(me.alias("src"), host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="(/[^"#?]+)"'), F.lit(1))).alias("href")).distinct()
    there = p.select(host.alias("h"), T.url_path(F.col("url")).alias("path")).distinct()
    links = links.join(there, (F.col("host") == F.col("h")) & (F.col("href") == F.col("path")), "left")
    found = F.col("path").isNotNull()
    edges = links.select("src", F.concat(F.when(found, "path:").otherwise("stub:"), "host", "href").alias("dst"), F.when(found, "imports").otherwise("unresolved_import").alias("kind"))
    names = p.select("page_id", me.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))).alias("name"))
    names = names.select("page_id", "src", F.trim(F.regexp_replace("name", "<[^>]+>", "")).alias("name")).where("name <> ''").distinct()
    return edges.union(names.select("src", F.concat(F.lit("symbol:"), "page_id", F.lit(":"), "name"), F.lit("contains")))


def _any(column: str, phrases) -> str:
    return f"regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in phrases).replace("doesn't", "doesn''t") + "')"


@query(
    f"""with r as (select conv_id, turn, replace(lower(coalesce(text, '')), '_', ' ') raw, replace(replace(lower(coalesce(text, '')), '_', ' '), '-', ' ') t from conversations where role = 'user'),
    f as (select *, {_any("t", A.DOCS_TOOLS)} docs, {_any("t", A.PACK_TOOLS)} or {_any("raw", A.PACK_TOOLS)} or (contains(t, 'mcp') and regexp_matches(t, '\\bpacks\\b')) packs, {_any("t", A.HOW_TO)} how, {_any("t", A.ARCHITECTURE)} build, {_any("t", A.INGESTION)} ingest from r)
    select conv_id, turn, case when {_any("t", A.EXPLICIT_RELEASE)} or ({_any("t", A.RELEASE)} and not how and not build) then 'release_history' when docs and not packs then 'docs_mcp' when packs and not docs then 'packs_mcp' when contains(t, 'mcp') or (docs and packs) then 'mcp_disambiguation'
      when ingest and how then 'ingestion_how_to' when ingest then 'ingestion_internals' when build then 'architecture' when {_any("t", A.TROUBLE)} then 'troubleshooting' when how then 'how_to' else 'general' end intent, {_any("t", A.CODE_SYMBOLS)} code_symbols from f"""
)
def project_intents(spark, sf):
    """QRY-2: what each turn is after, by the first rule that holds; also tested on examples."""
    return _turns(spark, sf).select("conv_id", "turn", A.intent(F.col("text")).alias("x")).select("conv_id", "turn", F.col("x.name").alias("intent"), "x.code_symbols")


_EXPANDED = [(i, t + "".join(f" {w}" for word in t.split() for w in A.SYNONYMS.get(word, ()))) for i, t in QUESTIONS]


@query(_TOP.replace(_Q, "q as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in _EXPANDED) + ") v(query_id, text))").join(["with ", ' select query_id, doc_id, round(score, 6) score, "rank" from r where "rank" <= 20']))
def lex_synonyms(spark, sf):
    """LEX-8: BM25 of the questions with their words' synonyms."""
    asked = questions(spark).select("query_id", A.with_synonyms(F.col("text")).alias("text"))
    return top_k(X.bm25(index_of(spark, sf, asked), asked), 20).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {_TOP}, g as (select query_id, source, sum(1 / (60.0 + "rank")) g from r where "rank" <= 40 group by 1, 2), b as (select *, row_number() over (partition by query_id order by round(g, 12) desc, source) n from g),
    w as (select s.query_id, s.doc_id, s.source, score, row_number() over (partition by s.query_id order by round(score, 9) desc, s.doc_id)::int place from s join b on b.query_id = s.query_id and b.source = s.source and n <= 5) select query_id, doc_id, source, round(score, 6) score, place from w where place <= 20"""
)
def hierarchical_retrieval(spark, sf):
    """FUS-5, FUS-6: the best sources of a first ranking, then a second retrieval among all documents of those."""
    first = _with_source(_ranked(spark, sf), spark, sf).select("query_id", "id", "rank", "source")
    best = stage(best_groups(first, "source"), "best_sources").select("query_id", "source")
    own = index_of(spark, sf).table("store").select(F.col("doc_id").alias("id"), "source")
    rows = X.bm25(index_of(spark, sf), questions(spark)).join(own, "id").join(F.broadcast(best), ["query_id", "source"])  # five sources a question
    return top_k(rows, 20).select("query_id", F.col("id").alias("doc_id"), "source", F.round("score", 6).alias("score"), F.col("rank").alias("place"))


@query()
def strategy_sections(spark, sf):
    """CHK-10: sections by heading, by paragraph or as one, as each document asks; tested on examples."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "heading").when(F.col("doc_id") % 3 == 1, "paragraph").alias("strategy"))
    return sections_by_strategy(d).select(F.col("id").alias("doc_id"), "section_index", "title", F.length("text").alias("chars"))
