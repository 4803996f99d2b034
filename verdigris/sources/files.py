"""Reading: text files by format, XML records, stored pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.context import excluded, glob_matches
from ..functions.text import main_content
from ..runtime import stage

#: Suffixes and how their content becomes text.
TEXT_SUFFIXES, HTML_SUFFIXES = ("md", "markdown", "txt", "rst"), ("html", "htm")


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, *, include: list[str] | None = None, exclude: list[str] = (), formats: list[str] | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (source, format, title, content, content_hash), skipped (source, reason)) of a folder. Files are read and parsed once.

    include and exclude are globs of paths below the folder; formats are suffixes; known (source, content_hash) are left out as unchanged. Texts that are not UTF-8 are
    read as Latin-1. A Markdown file's title is that of its front matter, else its first heading.
    """
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).format("binaryFile").load(path)
    below = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").removeprefix("file:")) + "/", "")
    rows = rows.where(glob_matches(below, include)) if include else rows
    rows = rows.where(~excluded(below, list(exclude))) if exclude else rows
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    kind = F.when(suffix.isin(*TEXT_SUFFIXES), "text").when(suffix.isin(*HTML_SUFFIXES), "html")
    kind = F.when(suffix.isin(*[f.lower().lstrip(".") for f in formats]), kind) if formats else kind
    rows = rows.select(F.col("path").alias("source"), suffix.alias("format"), kind.alias("kind"), F.when(kind.isNotNull(), text).alias("text"))
    front, heading = F.regexp_extract("text", r"(?s)\A---\n(?:.*?\n)??title:[ \t]*[\"']?([^\n]*?)[\"']?[ \t]*\n.*?^?---", 1), F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    page = F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1)
    rows = rows.select("source", "format", "kind", F.nullif(F.trim(F.when(F.col("kind") == "html", page).when(front != "", front).otherwise(heading)), F.lit("")).alias("title"), F.when(F.col("kind") == "html", main_content(F.col("text"))).otherwise(F.col("text")).alias("content"))
    rows = rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("reason", F.when(F.col("kind").isNull(), "unsupported format").when(F.trim("content") == "", "empty"))
    if known is not None:
        old = known.select(F.col("source").alias("s"), F.col("content_hash").alias("h")).distinct()
        rows = rows.join(old, (F.col("source") == F.col("s")) & (F.col("content_hash") == F.col("h")), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("s").isNotNull(), "unchanged"))).drop("s", "h")
    rows = stage(rows.drop("kind"), "files")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("source", "reason")


CASE_FILE = "`serial-number` string, `case-file-header` struct<`filing-date`:string,`registration-number`:string,`status-code`:string,`mark-identification`:string>, classifications struct<classification:array<struct<`international-code`:array<string>>>>, `case-file-owners` struct<`case-file-owner`:array<struct<`party-name`:string>>>"


def read_case_files(spark: SparkSession, path: str, live_only: bool = True) -> DataFrame:
    """serial, mark, status, live, filed, classes, owners: one row per case-file element."""
    rows = spark.read.format("xml").option("rowTag", "case-file").option("mode", "PERMISSIVE").schema(CASE_FILE).load(path)
    status = F.expr("try_cast(`case-file-header`.`status-code` as int)")
    rows = rows.select(
        F.col("serial-number").alias("serial"), F.col("case-file-header.mark-identification").alias("mark"), status.alias("status"), F.coalesce((status >= 600) & (status < 900), F.lit(False)).alias("live"),
        F.try_to_date(F.col("case-file-header.filing-date"), "yyyyMMdd").alias("filed"), F.array_sort(F.array_distinct(F.flatten(F.col("classifications.classification.international-code")))).alias("classes"), F.col("case-file-owners.case-file-owner.party-name").alias("owners"),
    )
    return rows.where("live") if live_only else rows


def case_file_documents(cases: DataFrame) -> DataFrame:
    """read_case_files' rows as documents (source, title, content): one Markdown page a record, classes in order."""
    line = lambda label, v: F.when(F.nullif(v.cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(f"- {label}: "), v.cast("string")))
    title = F.coalesce("mark", F.concat(F.lit("Serial "), "serial"))
    parts = F.array(F.concat(F.lit("# "), title), line("Serial number", F.col("serial")), line("Status", F.col("status")), line("Filed", F.col("filed")), line("Classes", F.array_join("classes", ", ")), line("Owners", F.array_join("owners", ", ")))
    return cases.select(F.concat(F.lit("case-file:"), "serial").alias("source"), title.alias("title"), F.array_join(parts, "\n").alias("content"))
