"""Context that travels with a chunk: canonical places, symbol aliases, a bounded prefix, filter columns, and filters over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import one_line
from .text import bind, estimate_utf8_tokens, url_host, url_path, url_scheme

#: Authorities, and those that a minimum admits.
AUTHORITIES = ("official", "project_owned", "verified", "community", "stale", "unknown", "legal", "generated", "mirror", "external_generic", "project_rule", "source_of_truth", "supporting", "canonical")
MINIMUM = {
    "unknown": ("unknown", "stale", "external_generic", "mirror", "generated", "community", "supporting", "verified", "legal", "project_rule", "source_of_truth", "project_owned", "official"),
    "community": ("community", "supporting", "verified", "project_rule", "source_of_truth", "project_owned", "official"),
    "verified": ("verified", "project_rule", "source_of_truth", "project_owned", "official"),
    "project_rule": ("project_rule", "source_of_truth", "project_owned", "official"),
    "project_owned": ("source_of_truth", "project_owned", "official"),
    "official": ("official",),
    "legal": ("legal",),
}
#: Patterns of symbols, in order, and of plain words.
SYMBOLS = (
    r"(?U)(?<![\w.-])--[a-zA-Z][a-zA-Z0-9-]{1,118}", r"(?U)\b[A-Z][A-Z0-9_]{2,119}\b", r"(?U)\b[A-Za-z_]\w*(?:::[A-Za-z_]\w*)+\b", r"(?U)\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b",
    r"(?U)(?<![\w/])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+", r"(?U)\b[A-Za-z_]\w{2,119}(?=\s*\()",
)
PLAIN_WORD = "^[A-Za-z][a-z]{2,}$"
LIFECYCLES, FRESHNESS, RELEVANCE = ("active", "current", "completed", "superseded", "historical"), ("synchronized", "stale", "unknown"), ("current", "historical")
#: The prefix's fields in order of priority, with their labels.
FIELDS = {
    "document_title": "Document Title", "canonical_location": "Location", "heading_path": "Heading Path", "library": "Library", "resolved_version": "Resolved Version", "version_family": "Version Family",
    "project_module": "Project Module", "project_scope": "Project Scope", "source_class": "Source Class", "authority": "Authority", "symbol_aliases": "Symbol Aliases", "catalog_description": "Catalog Description",
}
ALIASES, ALIAS_BYTES, ALIAS_CHARS, FIELD_CHARS, PREFIX_BYTES, PREFIX_TOKENS = 16, 512, 120, 480, 1024, 192


def normalized_path(p: Column) -> Column:
    """A path without empty, dot and dot-dot segments; dot-dots that lead out of a relative path stay."""
    segments = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    rooted = p.startswith("/")

    def step(kept: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when((s == "..") & rooted, kept).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/")


def canonical_url(u: Column) -> Column:
    """Scheme, host, a port that is not the scheme's own, and the normalized path; empty for what is no web address."""
    host = F.regexp_replace(url_host(u), "^.*@", "")
    own = F.when(url_scheme(u) == "http", ":80").otherwise(":443")
    host = F.when(F.endswith(host, own), F.regexp_replace(host, ":[0-9]+$", "")).otherwise(F.regexp_replace(host, ":$", ""))
    return F.when(url_scheme(u).isin("http", "https") & (F.regexp_replace(host, ":.*$", "") != ""), F.concat(url_scheme(u), F.lit("://"), host, F.lit("/"), normalized_path(F.concat(F.lit("/"), url_path(u))))).otherwise("")


def canonical_relative_path(p: Column) -> Column:
    """A path below the project's root; of absolute paths the name alone."""
    n = F.trim(F.replace(p, F.lit("\\"), F.lit("/")))
    n = F.when(n.rlike("^[A-Za-z]:/|^/"), F.regexp_extract(n, "([^/]*)/*$", 1)).otherwise(n)
    return F.substring(F.regexp_replace(normalized_path(n), "^[./]+", ""), 1, FIELD_CHARS)


def symbol_aliases(t: Column) -> Column:
    """Up to sixteen symbols of a text, each once whatever its case, by pattern and then place; those beyond 512 bytes are passed over."""
    found = F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda a: F.substring(a, 1, ALIAS_CHARS)) for p in SYMBOLS]))
    start = F.expr("named_struct('bytes', 0, 'keys', cast(array() as array<string>), 'names', cast(array() as array<string>))")

    def step(s: Column, a: Column) -> Column:
        fits = (F.size(s.names) < ALIASES) & ~F.array_contains(s["keys"], F.lower(a)) & (s.bytes + F.octet_length(a) <= ALIAS_BYTES)
        return F.when(fits, F.struct((s.bytes + F.octet_length(a)).alias("bytes"), F.concat(s["keys"], F.array(F.lower(a))).alias("keys"), F.concat(s.names, F.array(a)).alias("names"))).otherwise(s)

    return F.aggregate(F.filter(found, lambda a: ~a.rlike(PLAIN_WORD)), start, step, lambda s: s.names)


def context_prefix(values: Mapping[str, Column], most_bytes: int = PREFIX_BYTES, most_tokens: int = PREFIX_TOKENS) -> Column:
    """struct<text, fields, truncated>: the fields that are known, by priority; one that would pass a budget is left out, later ones may still fit."""
    named = [F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"{label}: "), F.substring(one_line(F.coalesce(values[name], F.lit(""))), 1, FIELD_CHARS)).alias("line"), (one_line(F.coalesce(values[name], F.lit(""))) != "").alias("known")) for name, label in FIELDS.items() if name in values]
    start = F.expr("named_struct('text', '', 'fields', cast(array() as array<string>), 'truncated', false)")

    def step(s: Column, x: Column) -> Column:
        joined = F.when(s.text == "", x.line).otherwise(F.concat(s.text, F.lit("\n"), x.line))
        over = (F.octet_length(joined) > most_bytes) | (estimate_utf8_tokens(joined) > most_tokens)
        return F.when(over, F.struct(s.text.alias("text"), s.fields.alias("fields"), F.lit(True).alias("truncated"))).otherwise(F.struct(joined.alias("text"), F.concat(s.fields, F.array(x["name"])).alias("fields"), s.truncated.alias("truncated")))

    return F.aggregate(F.filter(F.array(*named), lambda x: x.known), start, step)


def _first(m: Column, *names: str) -> Column:
    """The first of a map's values that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def filter_metadata(m: Column) -> Column:
    """The columns that filters may name, from a map of strings: unknown values fall back to their defaults."""
    word = lambda v: F.replace(F.lower(v), F.lit("-"), F.lit("_"))
    line = lambda *names: F.substring(one_line(_first(m, *names)), 1, FIELD_CHARS)
    authority, version, exact = word(_first(m, "authority", "repository_authority", "project_doc_authority")), line("resolved_version"), F.lower(F.trim(_first(m, "docs_snapshot_exact")))
    lifecycle = word(line("lifecycle_status", "project_doc_lifecycle_status"))
    lifecycle = F.when(lifecycle.isin(*LIFECYCLES), lifecycle).otherwise("active")
    relevance, fresh = F.lower(line("temporal_relevance")), F.lower(line("index_freshness"))
    return F.struct(
        line("library_id").alias("library_id"), F.when(F.lower(version) == "latest", "").otherwise(version).alias("resolved_version"), line("version_family").alias("version_family"),
        line("project_identity", "repository_identity").alias("project_identity"), line("module_id", "module_name").alias("module_id"), line("doc_scope").alias("doc_scope"), line("source_class").alias("source_class"),
        F.when(authority.isin(*AUTHORITIES), authority).otherwise("unknown").alias("authority"), lifecycle.alias("lifecycle_status"),
        F.when(relevance.isin(*RELEVANCE), relevance).when(lifecycle.isin("active", "current"), "current").otherwise("historical").alias("temporal_relevance"),
        F.when(fresh == "", "synchronized").when(fresh.isin(*FRESHNESS), fresh).otherwise("unknown").alias("index_freshness"),
        F.when(exact.isin("true", "1"), 1).when(exact.isin("false", "0"), 0).alias("docs_snapshot_exact"),
    )


def _several(value: Any) -> list[str]:
    if isinstance(value, Mapping) and "in" in value:
        value = value["in"]
    if isinstance(value, str):
        return [value[:240]]
    return sorted({str(v).strip()[:240] for v in value if str(v).strip()})[:16] if isinstance(value, (list, tuple, set, frozenset)) else []


#: Names under which a filter of several values is given.
PLURALS = {"source_class": ("source_class", "source_classes"), "module_id": ("module_id", "module_ids"), "doc_scope": ("doc_scope", "doc_scopes"), "lifecycle_status": ("lifecycle_status", "lifecycle_statuses", "project_doc_lifecycle_status"), "temporal_relevance": ("temporal_relevance",), "index_freshness": ("index_freshness",)}
IDENTITIES = ("source", "source_identity", "canonical_url", "source_url", "library_id", "canonical_id", "path", "project_doc_path", "source_path")


def compile_filters(filters: Mapping[str, Any] | None) -> dict[str, Any]:
    """The public vocabulary as equalities and lists of one backend: forbidden sources are not among them, `passes` checks those."""
    raw = dict(filters or {})
    named = {k: next((v for v in (_several(raw.get(n)) for n in names) if v), []) for k, names in PLURALS.items()}
    exact, least = raw.get("exact_snapshot_required") in (True, 1, "1", "true", "yes", "on"), str(raw.get("minimum_authority") or "").strip()
    for name in ("source_classes", "module_ids", "doc_scopes", "minimum_authority", "lifecycle_statuses", "project_doc_lifecycle_status", "exact_snapshot_required", "forbidden_sources"):
        raw.pop(name, None)
    raw |= {k: {"in": v} for k, v in named.items() if v}
    if exact:
        raw["docs_snapshot_exact"] = True
    if least:
        raw["authority"] = {"in": list(MINIMUM.get(least.casefold().replace("-", "_"), ()))}
    return raw


def passes(m: Column, filters: Mapping[str, Any] | None) -> Column:
    """Do a record's values (a map of strings) meet all filters, with the defaults of absent ones, and name no forbidden source?"""
    at = lambda n: F.try_element_at(m, F.lit(n))
    status = F.coalesce(at("lifecycle_status"), F.nullif(at("project_doc_lifecycle_status"), F.lit("")), F.lit("active"))
    default = {
        "authority": F.coalesce(at("authority"), at("project_doc_authority")), "project_doc_path": F.coalesce(at("project_doc_path"), at("source_path")), "lifecycle_status": status,
        "temporal_relevance": F.coalesce(at("temporal_relevance"), F.when(F.lower(status).isin("active", "current"), "current").otherwise("historical")), "index_freshness": F.coalesce(at("index_freshness"), F.lit("synchronized")),
    }
    tests = [F.lit(True)]
    for name, wanted in compile_filters(filters).items():
        actual = default.get(name, at(name))
        if isinstance(wanted, Mapping) and "in" in wanted:
            wanted = wanted["in"]
        if isinstance(wanted, bool):
            tests.append(F.coalesce(F.lower(actual).isin("true", "1", "yes", "on"), F.lit(False)) == wanted)
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            tests.append(actual.isin([str(w) for w in wanted]) if wanted else F.lit(False))
        else:
            tests.append(actual == str(wanted))
    banned = [v.strip().casefold() for v in _several((filters or {}).get("forbidden_sources"))]
    if banned:
        own = F.array(*[F.lower(F.trim(F.coalesce(default.get(n, at(n)), F.lit("")))) for n in IDENTITIES])
        tests.append(~F.arrays_overlap(own, F.array(*[F.lit(b) for b in banned])))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def payload_matches(values: Column, wanted: list[str]) -> Column:
    """Does a list-valued field hold any of the wanted values?"""
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def routed(q: Column, routers: list[tuple[str, Mapping[str, str]]]) -> Column:
    """The default filters (a map) of the first router whose pattern a question holds; null for none."""
    out = None
    for pattern, given in routers:
        value = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        out = F.when(q.rlike(f"(?i){pattern}"), value) if out is None else out.when(q.rlike(f"(?i){pattern}"), value)
    return out


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for a whole name; a star passes slashes."""
    out, k = "", 0
    while k < len(glob):
        c, k = glob[k], k + 1
        end = glob.find("]", k + (glob[k : k + 1] == "!") + 1) if c == "[" else -1
        if c == "[" and end > 0:
            inner, k = glob[k:end], end + 1
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]"
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.[]{}()+^$|#-&~" else c)
    return f"(?s)^{out}$"


def glob_matches(path: Column, globs: list[str]) -> Column:
    """Any of the globs: one with **/ takes a prefix folder and the last name, another the whole path."""
    tests = [F.lit(False)]
    for g in globs:
        if "**/" in g:
            prefix, suffix = g.split("**/", 1)
            tests.append(F.startswith(path, F.lit(prefix.rstrip("/") + "/" if prefix.rstrip("/") else "")) & F.substring_index(path, "/", -1).rlike(glob_pattern(suffix)))
        else:
            tests.append(path.rlike(glob_pattern(g)))
    return reduce(lambda a, b: a | b, tests)


def _any_like(names: Column, pattern: str) -> Column:
    return F.exists(names, lambda f: f.rlike(pattern))


def excluded(path: Column, patterns: list[str]) -> Column:
    """A ./ pattern names a root, one with a slash or star a path or any folder above it, another a folder's name."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    above = F.transform(folders, lambda _, i: F.array_join(F.slice(folders, F.lit(1), i + 1), "/"))
    tests = [F.lit(False)]
    for p in (x.strip() for x in patterns):
        if p.startswith("./"):
            root = p[2:].strip("/")
            tests.append((path == root) | path.startswith(root + "/"))
        elif "/" in p or "*" in p:
            tests.append(path.rlike(glob_pattern(p)) | _any_like(above, glob_pattern(p)))
        elif p:
            tests.append(_any_like(folders, glob_pattern(p)))
    return reduce(lambda a, b: a | b, tests)


#: Names of change logs and generated reviews, and folders of modules.
CHANGELOGS, MODULE_ROOTS = ("changelog", "changelog.md", "changes", "changes.md", "history", "history.md"), ("packages", "apps", "services", "modules", "libs", "crates", "plugins", "components")
REVIEWS = ("review_summary.md", "constraints.md", "review_summary_quality.json", "review_summary_actions.json", "review_summary_manifest.json")


def path_taxonomy(path: Column, in_module: Column | None = None) -> Column:
    """struct<source_type, authority, risk_flags> of a project document by its path."""
    p = F.trim(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    name, first = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    research, dogfood, review, generated = p.startswith("docs/research/") | p.contains("/research/"), p.contains("dogfood"), p.contains("patch-review"), name.isin(*REVIEWS)
    flags = F.array_compact(F.array(F.when(research, F.lit("research_artifact")), F.when(dogfood, F.lit("dogfood_artifact")), F.when(review, F.lit("patch_review_artifact")), F.when(generated, F.lit("generated_review_output"))))
    module = first.isin(*MODULE_ROOTS) | (in_module if in_module is not None else F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    kind = lambda t, a, f=none: F.struct((F.lit(t) if isinstance(t, str) else t).alias("source_type"), (F.lit(a) if isinstance(a, str) else a).alias("authority"), f.alias("risk_flags"))
    ranked = F.when(module, "secondary").otherwise("primary")
    return (
        F.when(review, kind("patch_review_artifact", "artifact", flags)).when(dogfood, kind("dogfood_artifact", "artifact", flags)).when(research, kind("research", "research", flags))
        .when(name.isin(*CHANGELOGS) | name.startswith("changelog."), kind("changelog", "historical"))
        .when(name.startswith("architecture.") | name.isin("arch.md", "arch.mdx") | has("architecture"), kind(F.when(module, "package_architecture").otherwise("architecture"), ranked))
        .when((F.size(parts) == 2) & first.isin("docs", "doc") & name.startswith("index."), kind("index", "primary"))
        .when(has("adr", "adrs"), kind("adr", "primary")).when(has("runbook", "runbooks"), kind("runbook", "primary"))
        .when(name.endswith("readme.md") | name.startswith("readme."), kind(F.when(module, "package_readme").otherwise("readme"), ranked))
        .when(p.startswith("docs/") | p.contains("/docs/"), kind("docs", "supporting")).when(p.startswith("wiki/") | p.contains("/wiki/"), kind("wiki", "supporting"))
        .otherwise(kind("project_doc", "supporting"))
    )
