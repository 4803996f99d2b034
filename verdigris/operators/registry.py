"""A registry of libraries: resolving a name by steps, candidates by name, pruning; redirect patterns learnt from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import library_id, library_name, stripped, url_host, url_path, url_scheme

#: Observations from which a redirect pattern is learnt.
OBSERVATIONS = 3


def lookup_key(name: Column) -> Column:
    """A library's name with its separators taken out."""
    return F.regexp_replace(library_name(name), "[-_]+", "")


def _version(v: Column) -> Column:
    return F.nullif(F.lower(stripped(v)), F.lit(""))


def resolve(records: DataFrame, asked: DataFrame) -> DataFrame:
    """records (library_id, normalized_name, ecosystem, version, source_type, aliases, legacy_ids), asked (ask, library, ecosystem, version, source_type)
    -> ask, library_id, step: the first step that any record meets, ties to the smallest id.

    Steps: the id as given; the canonical id; the legacy id; name, ecosystem and version; the compact name and version; without a version the unversioned name, the
    latest one (with an ecosystem first), a compact unversioned name, an alias or an old id. Each step is an equi-join on one key, so that no step compares all
    records with all questions.
    """
    kind = lambda c: library_name(F.coalesce(c, F.lit("api")))
    a = asked.select("ask", "library", "ecosystem", _version(F.col("version")).alias("v"), kind(F.col("source_type")).alias("k"), library_name(F.col("library")).alias("name"), lookup_key(F.col("library")).alias("key"))
    canonical = library_id(F.col("library"), F.col("ecosystem"), F.col("v"), F.col("k"))
    legacy = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("@"), F.col("v")), F.lit("")))
    tagged = lambda step, *parts: F.when(F.lit(True), F.concat_ws("\x1f", F.lit(step), *parts))
    versioned, plain, system = F.col("v").isNotNull(), F.col("v").isNull(), F.col("ecosystem").isNotNull()
    at = lambda step, j: F.struct(F.lit(step).alias("step"), j.alias("j"))
    keys = F.array_compact(F.array(
        at(1, tagged("id", F.col("library"))), at(2, tagged("id", canonical)), at(3, tagged("id", legacy)),
        F.when(versioned & system, at(4, tagged("nev", F.col("name"), F.col("ecosystem"), F.col("v"), F.col("k")))).when(versioned, at(4, tagged("nv", F.col("name"), F.col("v"), F.col("k")))),
        F.when(versioned, at(5, tagged("cv", F.col("key"), F.col("v"), F.col("k")))),
        F.when(plain & system, at(6, tagged("ne", F.col("name"), F.col("ecosystem"), F.col("k")))).when(plain, at(6, tagged("n", F.col("name"), F.col("k")))),
        F.when(plain, at(7, tagged("nv", F.col("name"), F.lit("latest"), F.col("k")))), F.when(plain, at(8, tagged("c", F.col("key")))), F.when(plain, at(8, tagged("alias", F.col("key")))), F.when(plain, at(8, tagged("old", F.col("library")))),
    ))
    r = records.select("library_id", "ecosystem", F.col("version").alias("v"), F.coalesce("source_type", F.lit("api")).alias("k"), F.col("normalized_name").alias("name"), lookup_key(F.col("normalized_name")).alias("key"), "aliases", "legacy_ids")
    has, none = F.col("v").isNotNull(), F.col("v").isNull()
    own = F.concat(
        F.array_compact(F.array(
            tagged("id", F.col("library_id")), F.when(has & F.col("ecosystem").isNotNull(), tagged("nev", F.col("name"), F.col("ecosystem"), F.col("v"), F.col("k"))), F.when(has, tagged("nv", F.col("name"), F.col("v"), F.col("k"))), F.when(has, tagged("cv", F.col("key"), F.col("v"), F.col("k"))),
            F.when(none & F.col("ecosystem").isNotNull(), tagged("ne", F.col("name"), F.col("ecosystem"), F.col("k"))), F.when(none, tagged("n", F.col("name"), F.col("k"))), F.when(none, tagged("c", F.col("key"))),
        )),
        F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda x: F.concat_ws("\x1f", F.lit("alias"), lookup_key(x))), F.transform(F.coalesce("legacy_ids", F.expr("cast(array() as array<string>)")), lambda x: F.concat_ws("\x1f", F.lit("old"), x)),
    )
    left = a.select("ask", F.explode(F.array_distinct(keys)).alias("x")).select("ask", "x.step", "x.j")
    right = r.select("library_id", F.col("ecosystem").isNull().alias("bare"), F.explode(F.array_distinct(own)).alias("j"))
    # One row a key: a name that many records share does not multiply the questions.
    right = right.groupBy("j").agg(F.min("library_id").alias("least"), F.min(F.struct("bare", "library_id")).alias("first"))
    met = left.join(right, "j").select("ask", "step", F.when(F.col("step") == 7, F.col("first.library_id")).otherwise(F.col("least")).alias("library_id"))
    best = met.groupBy("ask").agg(F.min(F.struct("step", "library_id")).alias("x"))
    return best.select("ask", "x.library_id", "x.step")


def candidates(records: DataFrame, asked: DataFrame) -> DataFrame:
    """ask, library_id of every record that an asked name (and, where given, ecosystem, version, kind) fits by name, compact name, alias or id."""
    a = asked.select("ask", F.col("library").alias("lib"), F.col("ecosystem").alias("e"), _version(F.col("version")).alias("v"), F.col("source_type").alias("t"))
    wanted = a.select("*", F.explode(F.array_distinct(F.array(F.concat(F.lit("k"), lookup_key(F.col("lib"))), F.concat(F.lit("i"), "lib")))).alias("j"))
    old = F.coalesce("legacy_ids", F.expr("cast(array() as array<string>)"))
    ids = F.transform(F.concat(F.array("library_id"), old), lambda x: F.concat(F.lit("i"), x))
    names = F.transform(F.concat(F.array("normalized_name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))), lambda x: F.concat(F.lit("k"), lookup_key(x)))
    own = records.select("library_id", "ecosystem", "version", F.coalesce("source_type", F.lit("api")).alias("kind"), F.explode(F.array_distinct(F.concat(ids, names))).alias("j"))
    fits = (F.col("e").isNull() | (F.col("ecosystem") == F.col("e"))) & (F.col("v").isNull() | (F.col("version") == F.col("v"))) & (F.col("t").isNull() | (F.col("kind") == library_name(F.col("t"))))
    return wanted.join(own, "j").where(fits).select("ask", "library_id").distinct()


def prunable(records: DataFrame, cutoff: Column, keep_versions: list[str]) -> DataFrame:
    """Records that failed, or whose last refresh (check, addition) is not after the cutoff; kept versions and records without any date stay."""
    seen = F.coalesce("last_refreshed_at", "last_checked_at", "added_at")
    kept = F.coalesce(F.col("version").isin([v.strip().lower() for v in keep_versions]), F.lit(False)) if keep_versions else F.lit(False)
    return records.where(~kept & ((F.col("status") == "failed") | F.coalesce(seen <= cutoff, F.lit(False))))


def redirect_pattern(original: Column, final: Column) -> Column:
    """struct<old, new>: the prefixes up to the differing middle of two paths on one host; null where nothing differs or the host does."""
    segments = lambda u: F.filter(F.split(url_path(u), "/"), lambda s: s != "")
    a, b = segments(original), segments(final)
    base = F.concat(url_scheme(original), F.lit("://"), url_host(original))
    same = lambda x, y: F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.least(F.size(x), F.size(y)) - 1, F.lit(0))), lambda i: F.coalesce(F.slice(x, F.lit(1), i + 1) == F.slice(y, F.lit(1), i + 1), F.lit(False)) & (F.size(x) > i) & (F.size(y) > i)))
    head = same(a, b)
    rest_a, rest_b = F.slice(a, head + 1, F.greatest(F.size(a) - head, F.lit(0))), F.slice(b, head + 1, F.greatest(F.size(b) - head, F.lit(0)))
    tail = same(F.reverse(rest_a), F.reverse(rest_b))
    prefix = lambda x, n: F.array_join(F.concat(F.array(base), F.slice(x, F.lit(1), n)), "/")
    alike = (url_scheme(original) == url_scheme(final)) & (url_host(original) == url_host(final)) & ((F.size(a) > head + tail) | (F.size(b) > head + tail))
    return F.when(alike, F.struct(prefix(a, F.size(a) - tail).alias("old"), prefix(b, F.size(b) - tail).alias("new")))


def learn_redirects(observed: DataFrame, least: int = OBSERVATIONS) -> DataFrame:
    """observed (original, final, at) -> old, new, learnt_at: patterns seen often enough, with the time of the observation that made them so.

    Only the first few observations of a pattern are ordered, in each map task already, so a pattern seen a billion times costs no more.
    """
    rows = observed.select(redirect_pattern(F.col("original"), F.col("final")).alias("p"), "at").where("p is not null").select("p.old", "p.new", "at")
    nth = rows.withColumn("n", F.row_number().over(Window.partitionBy("old", "new").orderBy("at"))).where(F.col("n") <= least)
    return nth.where(F.col("n") == least).select("old", "new", F.col("at").alias("learnt_at"))


def predict_redirects(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """urls (url), patterns -> url, predicted: by the earliest learnt pattern whose old prefix begins the url; null for none.

    A pattern ends with a whole host or path segment or within one; prefixes are joined on scheme and host, so only a host's own patterns are tried.
    """
    site = lambda c: F.concat(url_scheme(c), F.lit("://"), url_host(c))
    p = patterns.select(site(F.col("old")).alias("site"), "old", "new", "learnt_at")
    met = urls.select("url").distinct().withColumn("site", site(F.col("url"))).join(p, "site").where(F.col("url").startswith(F.col("old")))
    best = met.groupBy("url").agg(F.min(F.struct("learnt_at", "old", "new")).alias("x"))
    found = best.select(F.col("url").alias("u"), F.concat(F.col("x.new"), F.expr("substr(url, length(x.old) + 1)")).alias("predicted"))
    return urls.join(found, F.col("url") == F.col("u"), "left").drop("u")
