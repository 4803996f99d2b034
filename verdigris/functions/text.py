"""Column expressions: identities, estimates, HTML, URLs, quality and risk predicates. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that are stripped, path hints of documentation roots, locale prefixes, paths out of scope.
STRIPPED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "from", "source", "fbclid", "gclid")
ROOT_HINTS = ("docs", "doc", "documentation", "api", "reference", "sdk", "cli")
LOCALES = ("ar", "bn", "de", "es", "fr", "id", "it", "ja", "ko", "nl", "pl", "pt", "pt-br", "ru", "tr", "uk", "vi", "zh-hans", "zh-hant")
OUT_OF_SCOPE = (
    r"/blog(/|$)", r"/changelog(/|$)", r"/release-notes(/|$)", r"/status(/|$)", r"/pricing(/|$)", r"/login(/|$)", r"/signup(/|$)", r"/register(/|$)", r"/sign-in(/|$)",
    r"/sign-up(/|$)", r"/account(/|$)", r"/settings(/|$)", r"/search(\?|$)", r"[?&]print", r"/_print(/|$)", r"/print\.html",
    r"\.(pdf|zip|tar|gz|png|jpg|jpeg|gif|svg|mp4|mp3|woff|woff2|ttf|eot|ico)$",
)
#: Patterns of text that asks a reader to act, by flag.
RISKS = {
    "fake_policy_message": r"(?i)\b(system|developer)\s+(message|prompt)\b",
    "tool_execution_request": r"(?i)\b(call|invoke|run|execute)\s+(the\s+)?(tool|shell|terminal|command)\b",
    "credential_exfiltration_request": r"(?is)\b(send|upload|print|reveal|exfiltrate)\b.{0,80}\b(password|credential|secret|token|api[_ -]?key)\b",
    "policy_override_request": r"(?is)\b(ignore|override|bypass)\b.{0,60}\b(previous|system|developer|safety|policy|instruction)\b",
}
#: Versions that name no snapshot, and the entities that are decoded.
MOVING = ("latest", "stable", "main", "master", "beta", "next")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
NOISE = r"(?is)<(?:script|style|head|nav|footer|header|noscript|svg)\b[^>]*>.*?</(?:script|style|head|nav|footer|header|noscript|svg)>"
WORDS = r"[\p{L}\p{N}_]+"
SPACES = r"[ \t\n\x0B\f\r]+"


def bind(x: Column, f) -> Column:
    """f of x with x computed once, where f uses it within another function's lambda."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{SPACES}|{SPACES}$", "")


def estimate_tokens(t: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(t) / 4)).cast("long")


def estimate_utf8_tokens(t: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(t) / 4)).cast("long")


def content_hash(t: Column) -> Column:
    """sha256 of the text with white space collapsed and letters lower-cased."""
    return F.sha2(F.lower(stripped(F.regexp_replace(t, SPACES, " "))), 256)


def stable_int63(t: Column) -> Column:
    """The first 63 bits after the sign bit of sha256, 0 made 1."""
    h = F.sha2(t, 256)
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("int").bitwiseAND(7).cast("string")
    n = F.conv(F.concat(top, F.substring(h, 2, 15)), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(n == 0, 1).otherwise(n)


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORDS), F.lit(0))


def library_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(x)), r"[^a-z0-9_]+", "-"), r"^-+|-+$", "")


def library_id(name: Column, ecosystem: Column, version: Column, kind: Column) -> Column:
    v = F.nullif(F.lower(stripped(version)), F.lit(""))
    at = F.coalesce(F.concat(F.lit("@"), v), F.lit(""))
    with_system = F.concat(library_name(ecosystem), F.lit(":"), library_name(name), at, F.lit(":"), library_name(F.coalesce(kind, F.lit("api"))))
    return F.coalesce(F.when(F.nullif(library_name(ecosystem), F.lit("")).isNotNull(), with_system), F.concat(library_name(name), at))


def snapshot_is_exact(version: Column, url: Column) -> Column:
    v, u = F.lower(stripped(version)), F.lower(url)
    moving = F.lit(False)
    for m in MOVING:
        moving = moving | u.contains(f"/{m}")
    return F.coalesce((v != "") & ~v.isin(*MOVING) & ~moving & u.contains(v), F.lit(False))


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.substring(s, 1, 72), F.lit("-"), F.substring(F.sha1(x), 1, 12))


def looks_like_html(t: Column) -> Column:
    p = F.lower(F.regexp_replace(F.substring(t, 1, 500), rf"^{SPACES}", ""))
    return p.startswith("<!doctype") | p.startswith("<html") | p.contains("<head>")


def strip_html(t: Column) -> Column:
    """Noise blocks and tags dropped, six entities decoded, blank lines collapsed."""
    x = F.regexp_replace(F.regexp_replace(t, NOISE, ""), r"<[^>]+>", "")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.when(t.contains("<"), stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))).otherwise(t)


def main_content(html: Column) -> Column:
    """The first article's, else the first main's, else the whole page's text."""
    inner = [F.when(html.rlike(rf"(?is)<{t}[^>]*>.*?</{t}>"), F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) for t in ("article", "main")]
    return bind(F.coalesce(*inner, html), strip_html)


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def normalize_url(u: Column) -> Column:
    """Lower-case scheme and host, no fragment, sorted parameters without tracking ones, no trailing slash but the root's."""
    kept = F.array_sort(F.filter(F.split(url_query(u), "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*STRIPPED)))
    path = F.when(url_path(u) == "", "/").otherwise(url_path(u))
    path = F.when((path != "/") & (F.size(kept) == 0), F.regexp_replace(path, r"/+$", "")).otherwise(path)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(url_scheme(u), F.lit("://"), url_host(u), path, query)


def docset_root(u: Column) -> Column:
    """The documentation root that a URL belongs to; null for other schemes."""
    n = normalize_url(u)
    root, path = F.concat(url_scheme(n), F.lit("://"), url_host(n)), url_path(n)
    first = F.regexp_extract(path, r"^/+([^/]+)", 1)
    found = F.when(path.endswith("/llms-full.txt") | path.endswith("/llms.txt"), F.concat(root, F.regexp_replace(path, r"/llms(-full)?\.txt$", "")))
    found = found.when(url_host(n).rlike(r"^(docs|doc|api)\."), root).when(F.lower(first).isin(*ROOT_HINTS), F.concat(root, F.lit("/"), first)).otherwise(root)
    return F.when(u.rlike("^https?://"), found)


def in_docs_scope(u: Column, base_host: Column, base_has_locale: Column) -> Column:
    """Same host, no foreign locale at the start of the path, nothing out of scope. For bases at a host's root."""
    full = F.concat(url_path(u), F.when(url_query(u) != "", F.concat(F.lit("?"), url_query(u))).otherwise(""))
    first = F.replace(F.lower(F.regexp_extract(url_path(u), r"^/+([^/]+)", 1)), F.lit("_"), F.lit("-"))
    return u.rlike("^https?://") & (url_host(u) == base_host) & ~(first.isin(*LOCALES) & ~base_has_locale) & ~full.rlike("|".join(f"(?:{p})" for p in OUT_OF_SCOPE))


def risk_flags(t: Column) -> Column:
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in RISKS.items()]))


def mask_secrets(t: Column) -> Column:
    return F.regexp_replace(t, r"""(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[:=]\s*)[^\s,;]+""", "$1$2[redacted]")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, 0.0).otherwise(dot / (norm(a) * norm(b)))


def sliding_windows(t: Column, size: int = 800, overlap: int = 100) -> Column:
    """Stripped windows of the text with white space collapsed; the last one reaches the end."""
    step = size - overlap

    def windows(x: Column) -> Column:
        n = F.when(F.char_length(x) <= size, 1).otherwise(F.ceil((F.char_length(x) - size) / step) + 1)
        parts = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.trim(F.substr(x, (i * step + 1).cast("int"), F.lit(size))))
        return F.when(F.char_length(x) > 0, F.filter(parts, lambda p: p != "")).otherwise(F.expr("cast(array() as array<string>)"))

    return bind(stripped(F.regexp_replace(t, SPACES, " ")), windows)


def shingles(t: Column, size: int = 5) -> Column:
    """Distinct runs of `size` tokens; all tokens where there are fewer, none where there are none."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(every))

    return bind(tokens(t), runs)


def jaccard_millis(a: Column, b: Column) -> Column:
    """Floor of 1000 times the Jaccard similarity of two arrays of distinct values."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.floor(F.size(F.array_intersect(a, b)) * 1000 / union)).otherwise(0).cast("int")


def decoded(t: Column) -> Column:
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def table_lines(html: Column) -> Column:
    """The rows of a page's tables, cells parted by bars."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda c: stripped(decoded(F.regexp_replace(c, r"<[^>]+>", "")))
    return F.transform(rows, lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), cell), " | "))


def breadcrumbs(html: Column) -> Column:
    """The names in a page's breadcrumb list."""
    inner = F.regexp_extract(html, r"(?is)<(?:nav|ol|ul|div)[^>]*(?:aria-label=[\"']breadcrumb[\"']|class=[\"'][^\"']*breadcrumbs?[^\"']*[\"'])[^>]*>(.*?)</(?:nav|ol|ul|div)>", 1)
    names = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<(?:a|li|span)[^>]*>([^<]*)</"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(names, lambda x: (x != "") & ~x.isin("\u203a", ">", "/", "\u00bb"))
