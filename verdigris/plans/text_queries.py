"""Scalar, HTML, URL and chunk queries, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import paragraph_chunks, section_rows
from ..operators.retrieval import first_wins, rank_by_range
from ..runtime import table

QUERIES, SQL = {}, {}
#: The white space that both engines collapse, and a normalised text, in SQL.
WS = r"[ \t\n\x0B\f\r]+"
NORM = rf"lower(regexp_replace(regexp_replace(text, '{WS}', ' ', 'g'), '^{WS}|{WS}$', '', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select doc_id, greatest(1, ceil(length(text) / 4.0))::bigint tokens, greatest(1, ceil(strlen(text) / 4.0))::bigint byte_tokens from documents")
def token_estimates(spark, sf):
    """STR-1, STR-2."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"), T.estimate_utf8_tokens(t).alias("byte_tokens"))


@query(f"select sha256({NORM}) content_hash, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def content_hash_dups(spark, sf):
    """STR-3, DDP-6."""
    d = table(spark, sf, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1")


@query(f"select doc_id, lang, source from (select *, row_number() over (partition by sha256({NORM}) order by doc_id) n from documents) where n = 1")
def first_wins_dedupe(spark, sf):
    """DDP-1, DDP-2: texts are not shuffled, only their hashes."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", T.content_hash(F.col("text")).alias("h"))
    return first_wins(d, F.col("h"), [F.col("doc_id")]).select("doc_id", "lang", "source")


@query("select doc_id, (('0x' || substr('01234567', 1 + ((instr('0123456789abcdef', h[1]) - 1) % 8), 1) || substr(h, 2, 15))::bigint) id63 from (select doc_id, sha256(text) h from documents)")
def stable_ids(spark, sf):
    """Identity rule: 63 bits of sha256."""
    return table(spark, sf, "documents").select("doc_id", T.stable_int63(F.col("text")).alias("id63"))


@query("""
select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) h,
  trim(regexp_replace(lower(trim(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))), '[^a-z0-9_]+', '-', 'g'), '-') name,
  regexp_extract(html, 'lang="([a-z]+)"', 1) || ':' || trim(regexp_replace(lower(trim(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))), '[^a-z0-9_]+', '-', 'g'), '-') || '@1.0:api' library_id,
  contains(lower(url), '1.0') and not contains(lower(url), '/latest') and not contains(lower(url), '/stable') and not contains(lower(url), '/main') and not contains(lower(url), '/master') and not contains(lower(url), '/beta') and not contains(lower(url), '/next') exact from pages""")
def library_ids(spark, sf):
    """STR-5, STR-6, STR-7."""
    u, host = F.col("url"), T.url_host(F.col("url"))
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    return table(spark, sf, "pages").select("page_id", host.alias("h"), T.library_name(host).alias("name"), T.library_id(host, lang, F.lit("1.0"), F.lit("api")).alias("library_id"), T.snapshot_is_exact(F.lit("1.0"), u).alias("exact"))


@query("select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-')[1:72] || '-' || sha1(url)[1:12] slug from pages")
def slugs(spark, sf):
    """STR-4."""
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


_STRIP = r"""regexp_replace(regexp_replace({x}, '(?is)<(?:script|style|head|nav|footer|header|noscript|svg)\b[^>]*>.*?</(?:script|style|head|nav|footer|header|noscript|svg)>', '', 'g'), '<[^>]+>', '', 'g')"""


def _clean_sql(x: str) -> str:
    s = _STRIP.format(x=x)
    for entity, char in T.ENTITIES:
        quoted = char.replace("'", "''")
        s = f"replace({s}, '{entity}', '{quoted}')"
    return rf"regexp_replace(regexp_replace({s}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}|{WS}$', '', 'g')"


@query(f"with a as (select page_id, html, case when regexp_matches(html, '(?is)<article[^>]*>.*?</article>') then regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) when regexp_matches(html, '(?is)<main[^>]*>.*?</main>') then regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1) else html end x from pages) select page_id, case when contains(x, '<') then {_clean_sql('x')} else x end main_text from a")
def html_main_text(spark, sf):
    """STR-8, STR-11."""
    return table(spark, sf, "pages").select("page_id", T.main_content(F.col("html")).alias("main_text"))


@query(r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) lang,
  len(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1))::int links,
  starts_with(lower(ltrim(html[1:500])), '<!doctype') or starts_with(lower(ltrim(html[1:500])), '<html') or contains(lower(html[1:500]), '<head>') is_html from pages""")
def html_metadata(spark, sf):
    """STR-10, STR-13."""
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))).alias("links"), T.looks_like_html(h).alias("is_html"),
    )


_URL = r"""
u as (select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) sch, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) p0, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) q from pages),
k as (select *, case when p0 = '' then '/' else p0 end p, list_sort([x for x in string_split(q, '&') if x <> '' and regexp_extract(x, '^([^=]*)', 1) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'from', 'source', 'fbclid', 'gclid')]) kept from u),
n as (select *, case when p <> '/' and len(kept) = 0 then regexp_replace(p, '/+$', '') else p end np,
  sch || '://' || host || (case when p <> '/' and len(kept) = 0 then regexp_replace(p, '/+$', '') else p end) || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end normal from k)
"""
_SCOPE = "|".join(f"(?:{p})" for p in T.OUT_OF_SCOPE)
_LOCALES = ", ".join(f"'{x}'" for x in T.LOCALES)


@query(f"with {_URL} select page_id, normal from n")
def url_normalize(spark, sf):
    """STR-15."""
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normal"))


@query(rf"""with {_URL} select page_id, case when not regexp_matches(url, '^https?://') then null
  when regexp_matches(np, '/llms(-full)?\.txt$') then sch || '://' || host || regexp_replace(np, '/llms(-full)?\.txt$', '') when regexp_matches(host, '^(docs|doc|api)\.') then sch || '://' || host
  when lower(regexp_extract(np, '^/+([^/]+)', 1)) in ('docs', 'doc', 'documentation', 'api', 'reference', 'sdk', 'cli') then sch || '://' || host || '/' || regexp_extract(np, '^/+([^/]+)', 1) else sch || '://' || host end root,
  regexp_matches(url, '^https?://') and not (replace(lower(regexp_extract(p0, '^/+([^/]+)', 1)), '_', '-') in ({_LOCALES})) and not regexp_matches(p0 || case when q <> '' then '?' || q else '' end, '{_SCOPE}') in_scope from n""")
def docs_scope(spark, sf):
    """STR-16, FLT-5, against each page's own host."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.docset_root(u).alias("root"), T.in_docs_scope(u, T.url_host(u), F.lit(False)).alias("in_scope"))


@query(f"with {_URL}, f as (select page_id, normal, host, len(string_split(np, '/')) depth, row_number() over (partition by normal order by page_id) c from n) select page_id, normal, row_number() over (partition by host order by depth, normal)::int as \"rank\" from f where c = 1")
def frontier_rank(spark, sf):
    """RNK-10 in part: one page per normalised URL, each host's by depth."""
    u = F.col("url")
    rows = table(spark, sf, "pages").select("page_id", T.normalize_url(u).alias("normal"))
    rows = first_wins(rows, F.col("normal"), [F.col("page_id")])
    rows = rows.withColumn("host", T.url_host(F.col("normal"))).withColumn("depth", F.size(F.split(T.url_path(F.col("normal")), "/")))
    return rank_by_range(rows, "host", ["depth", "normal"]).drop("host", "depth")


@query("select doc_id, array_to_string([f for f in [" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in T.RISKS.items()) + "] if f is not null], ',') flags from documents")
def risk_flags(spark, sf):
    """STR-25."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.risk_flags(F.col("text")), ",").alias("flags"))


@query(r"""select doc_id, md5(regexp_replace(text, '(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[:=]\s*)[^\s,;]+', '\1\2[redacted]', 'g')) masked from documents""")
def masked_secrets(spark, sf):
    """STR-37."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.mask_secrets(F.col("text"))).alias("masked"))


@query(rf"""with x as (select doc_id, regexp_replace(regexp_replace(text, '{WS}', ' ', 'g'), '^ | $', '', 'g') t from documents),
w as (select doc_id, t, unnest(range(0, case when length(t) = 0 then 0 when length(t) <= 800 then 1 else ceil((length(t) - 800) / 700.0)::bigint + 1 end)) i from x),
c as (select doc_id, i, trim(substr(t, (i * 700 + 1)::bigint, 800)) s from w)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int chunk_index, md5(s) chunk_md5, length(s)::int chars from c where s <> ''""")
def sliding_windows(spark, sf):
    """CHK-1."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sliding_windows(F.col("text"))).alias("chunk_index", "s"))
    return rows.select("doc_id", "chunk_index", F.md5("s").alias("chunk_md5"), F.char_length("s").alias("chars"))


@query(r"with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents) select doc_id, count(*) lines, count(*) filter (where trim(line) <> '') solid, max(length(line))::int longest from l group by doc_id")
def line_profile(spark, sf):
    """Lines of each text, counted in the row without a shuffle."""
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("solid"), F.array_max(F.transform(lines, lambda x: F.char_length(x))).alias("longest"))


@query("select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn)::bigint section_id from conversations")
def turn_sections(spark, sf):
    """A section begins with each turn of a user."""
    from pyspark.sql import Window

    run = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(run).alias("section_id"))


@query("select event_id, (props::json ->> '$.k')::int k from events where (props::json ->> '$.k')::int in (7, 11, 13)")
def json_filter(spark, sf):
    """FLT-1, JOB-1: a filter on a promoted key of a JSON column."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where(F.col("k").isin(7, 11, 13))


@query()
def paragraph_chunking(spark, sf):
    """CHK-2: tested against fixtures."""
    return paragraph_chunks(table(spark, sf, "documents"), "doc_id", "text").select("id", "chunk_index", F.md5("text").alias("chunk_md5"))


@query()
def section_spans(spark, sf):
    """CHK-11: tested against fixtures; spans tile each text."""
    return section_rows(table(spark, sf, "documents"), "doc_id", "text").drop("display_text")
