"""Dependencies of projects: versions from lock files, wishes from manifests, and their join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names, their ecosystems and kinds.
LOCKS = {"Cargo.lock": "rust", "poetry.lock": "python", "uv.lock": "python", "package-lock.json": "node", "pubspec.lock": "dart", "go.mod": "go", "pom.xml": "java"}
MANIFESTS = {"Cargo.toml": "rust", "package.json": "node", "requirements.txt": "python", "pubspec.yaml": "dart"}
GROUPS = {"dev-dependencies": "dev", "build-dependencies": "build", "dev_dependencies": "dev", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"}


def _pairs(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<...>> of a pattern's groups, match by match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, file, text of every lock file and manifest below a path."""
    names = "{" + ",".join([*LOCKS, *MANIFESTS]) + "}"
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n", "\n").alias("text"))


def package_name(name: Column, ecosystem: Column) -> Column:
    """Python's names compare without case and with one sign for -, _ and dot."""
    return F.when(ecosystem == "python", F.regexp_replace(F.lower(name), r"[-_.]+", "-")).otherwise(name)


def locked(files: DataFrame) -> DataFrame:
    """folder, ecosystem, name, resolved."""
    kind = F.create_map(*[F.lit(x) for kv in LOCKS.items() for x in kv])
    t = F.col("text")
    field = lambda b, k: F.regexp_extract(b, rf'(?m)^{k}\s*=\s*"([^"]+)"', 1)
    tables = F.transform(F.slice(F.split(t, r"(?m)^\s*\[\[package\]\]\s*$"), 2, 1 << 30), lambda b: F.struct(field(b, "name").alias("name"), field(b, "version").alias("version")))
    node = F.transform(F.map_entries(F.from_json(t, "packages map<string,struct<version:string>>").packages), lambda e: F.struct(F.regexp_extract(e.key, r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"), e.value.version.alias("version")))
    as_pairs = lambda a, n, v: F.transform(a, lambda x: F.struct(x[f"g{n}"].alias("name"), x[f"g{v}"].alias("version")))
    dart = as_pairs(_pairs(t, r'(?m)^  "?([A-Za-z0-9_]+)"?:\n(?:    .*\n)*?    version: "([^"]+)"', 1, 2), 1, 2)
    go = as_pairs(_pairs(t, r"(?m)^\s*(?:require\s+)?([\w.~-]+\.[\w.~-]+(?:/[\w.~-]+)*)\s+(v\d\S*)", 1, 2), 1, 2)
    java = F.transform(_pairs(t, r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<$]+)</version>", 1, 2, 3), lambda x: F.struct(F.concat_ws(":", x.g1, x.g2).alias("name"), x.g3.alias("version")))
    found = F.when(F.col("file").isin("Cargo.lock", "poetry.lock", "uv.lock"), tables).when(F.col("file") == "package-lock.json", node).when(F.col("file") == "pubspec.lock", dart).when(F.col("file") == "go.mod", go).when(F.col("file") == "pom.xml", java)
    rows = files.select("folder", kind[F.col("file")].alias("ecosystem"), F.explode(found).alias("d")).where("d.name <> '' and d.version <> ''")
    return rows.groupBy("folder", "ecosystem", package_name(F.col("d.name"), F.col("ecosystem")).alias("name")).agg(F.max("d.version").alias("resolved"))


def declared(files: DataFrame) -> DataFrame:
    """folder, ecosystem, name, group, wish."""
    kind = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    group = lambda g: F.coalesce(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[g], F.lit("dependencies"))
    t = F.col("text")
    item = lambda g, n, w: F.struct(group(g).alias("group"), n.alias("name"), w.alias("wish"))
    sections = _pairs(t, r"(?m)^\[((?:dev-|build-)?dependencies)\][^\n]*((?:\n(?!\[)[^\n]*)*)", 1, 2)
    rust = F.flatten(F.transform(sections, lambda s: F.transform(_pairs(s.g2, r"""(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}\n]*?version\s*=\s*)?"([^"]*)\"""", 1, 2), lambda x: item(s.g1, x.g1, x.g2))))
    parts = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
    json = F.from_json(t, ", ".join(f"{p} map<string,string>" for p in parts))
    none = F.expr("cast(array() as array<struct<group:string,name:string,wish:string>>)")
    entries = lambda p: F.coalesce(F.transform(F.map_entries(json[p]), lambda e: item(F.lit(p), e.key, e.value)), none)
    node = F.concat(*[entries(p) for p in parts])
    python = F.transform(_pairs(t, r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*((?:[=<>~!]=?=?[^\s;#]+)?)", 1, 2), lambda x: item(F.lit("dependencies"), x.g1, x.g2))
    yaml = _pairs(t, r"(?m)^((?:dev_)?dependencies):[^\n]*((?:\n(?:[ \t#][^\n]*)?)*)", 1, 2)
    dart = F.flatten(F.transform(yaml, lambda s: F.transform(_pairs(s.g2, r"(?m)^  ([A-Za-z0-9_]+):[ \t]*([^\n#]*)", 1, 2), lambda x: item(s.g1, x.g1, F.trim(x.g2)))))
    found = F.when(F.col("file") == "Cargo.toml", rust).when(F.col("file") == "package.json", node).when(F.col("file") == "requirements.txt", python).when(F.col("file") == "pubspec.yaml", dart)
    rows = files.select("folder", kind[F.col("file")].alias("ecosystem"), F.explode(found).alias("d")).where("d.name <> ''")
    return rows.select("folder", "ecosystem", package_name(F.col("d.name"), F.col("ecosystem")).alias("name"), F.col("d.group").alias("group"), F.col("d.wish").alias("wish"))


def dependencies(files: DataFrame) -> DataFrame:
    """folder, ecosystem, name, group, wish, resolved, version_source: a locked version is exact, a wish alone is exact or a range."""
    rows = declared(files).join(locked(files), ["folder", "ecosystem", "name"], "full")
    exact = F.col("wish").rlike(r"^(=|==)?\s*v?\d[\w.+-]*$")
    source = F.when(F.col("resolved").isNotNull(), "lockfile_exact").when(exact, "manifest_exact").otherwise("manifest_range")
    return rows.select("folder", "ecosystem", "name", F.coalesce("group", F.lit("dependencies")).alias("group"), "wish", "resolved", source.alias("version_source"))


def read_sitemap(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """loc, lastmod, priority of a sitemap's entries (tag url) or of an index's sitemaps (tag sitemap)."""
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema("loc string, lastmod string, priority string").load(path)
    return rows.select(F.trim("loc").alias("loc"), F.try_to_timestamp("lastmod").alias("lastmod"), F.expr("try_cast(priority as double)").alias("priority")).where("loc <> ''")
