"""WARC archives: writing, reading, and assembling captures from request, response, revisit and metadata records.

Records are made of column expressions and written by Spark's text sink, gzip-compressed, with the record separator
CR LF CR LF as its line separator: each part file is a valid archive, and commits and retries are Spark's. Archives are read
as binary files and cut by Content-Length. A capture's records name its response (or revisit) in
WARC-Concurrent-To; `captures` joins them and emits one nested row for each.

Of captures with equal payloads of at least `least` bytes the one with the largest id is stored; the others are
revisit records with the headers alone.

Defined cases: a null payload is empty; a null url is written as about:blank; rows that share an id are captures of
their own, told apart by an ordinal; null ids are captures whose id reads back as null, and are never chosen over others to
be stored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, new_path, ship, small_join, stage, table

BREAK = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: str, record_id: Column, date: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Date: "), date]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK), block)


def plan_captures(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, bytes, ordinal, stored (id of the capture that keeps the payload; null: this one)."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", ""), F.lit("about:blank")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    slim = stage(rows.select("id", "digest", "bytes"), "warc_slim")
    same = slim.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = small_join(slim.where(F.col("bytes") >= least), stage(same, "warc_same"), F.col("digest") == F.col("d"), "inner").where("stored is not null and not (id <=> stored)")
    revisits = stage(revisits.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "stored").distinct(), "warc_revisits")
    rows = small_join(rows, revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))).drop("r_id", "r_digest")
    if slim.count() == slim.select("id").distinct().count():
        return rows.withColumn("ordinal", F.lit(0))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")) - 1)


def write_warc(pages: DataFrame, path: str, *, least: int = 1000, id_col="page_id", url_col="url", payload_col="html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a request, a response (or revisit) and a metadata record for every row."""
    rows = plan_captures(pages, least, id_col, url_col, payload_col)
    key = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    own = _uuid(F.lit("response"), key, F.col("digest"), F.col("ordinal").cast("string"))
    other = _uuid(F.lit("response"), F.col("stored").cast("string"), F.col("digest"), F.lit("0"))
    day, uri = F.lit(date), [("WARC-Target-URI", F.col("url"))]
    host, target = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.regexp_replace("url", r"^[a-z]+://[^/?#]*|#.*$", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BREAK))
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    kind = [("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", own, day, uri + digest + kind, F.concat(http, F.col("payload")))
    profile = [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", other)]
    revisit = _record("revisit", own, day, uri + digest + profile + kind, http)
    request = _record("request", _uuid(F.lit("request"), key, F.col("digest"), F.col("ordinal").cast("string")), day, uri + [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK)))
    metadata = _record("metadata", _uuid(F.lit("metadata"), key, F.col("digest"), F.col("ordinal").cast("string")), day, uri + [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), key, F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, F.when(F.col("stored").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", BREAK).option("compression", "gzip").text(path)


def _pieces(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:  # members one after another
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, data[start:stop]
        at = stop + 4


RECORD = "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, digest string, payload_bytes long, actual_digest string, block binary"


def _records(blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "block" else pa.string() for n in names]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse(_pieces(content.as_py())):
                    kind, n, actual = f.get("warc-type"), None, None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            n, actual = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            n = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    keep = block if blocks or kind == "metadata" else None
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-date"), f.get("warc-target-uri"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, n, actual, keep))
                    size += len(keep or b"")
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_warc(spark: SparkSession, path: str, *, blocks: bool = True) -> DataFrame:
    """One row per record. Without blocks only those of metadata records are kept."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lean(_records(blocks)), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, request, metadata (structs) and refers_to_capture, joined by their identifiers."""
    part = lambda kinds, name: records.where(F.col("type").isin(kinds)).select(F.col("record_id" if name == "response" else "concurrent_to").alias(f"{name}_key"), F.struct(*records.columns).alias(name))
    got = part(["response", "revisit"], "response")
    for name in ("request", "metadata"):
        got = got.join(part([name], name), F.col("response_key") == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return got.withColumnRenamed("response_key", "capture")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = F.nullif(F.regexp_extract(F.col("metadata.block").cast("string"), r"page-id: (\S+)", 1), F.lit("none")).cast("long")
    records = stage(read_warc(spark, path, blocks=False), "warc_records")  # archives are parsed once, their slim records joined
    got = captures(records).select("capture", page.alias("page_id"), "response.payload_bytes", F.coalesce("response.actual_digest", "response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("other"))
    got = stage(got, "warc_captures")
    named = got.where("other is null").select(F.col("capture").alias("c"), F.col("page_id").alias("refers_to"))
    named = stage(named.join(got.select("other").distinct(), F.col("c") == F.col("other"), "left_semi"), "warc_stored")
    return small_join(got, named, F.col("other") == F.col("c")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha1(b) payload_digest from p),
m as (select payload_digest, max(page_id) keeper from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, d.payload_digest, case when keeper <> page_id then 'revisit' else 'response' end record_type,
  case when keeper <> page_id then keeper end refers_to
from d left join m on m.payload_digest = d.payload_digest and payload_bytes >= 1000
"""
