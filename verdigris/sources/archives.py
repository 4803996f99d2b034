"""XML records in plain, gzipped and zipped files: a data source with a partition for each archive entry.

An entry is read as a stream; a record is what stands between its start and end tags, and is parsed by itself. So a broken record costs itself alone: it is a row
that says why, and the next begins at the next start tag. Memory holds one record, of at most `MOST_BYTES`. Entries of a zip that are not XML are passed over; an archive that cannot be read is a row
too. Files are found and opened by pyarrow's file systems, so a path may be local or an address that they know.
"""

from __future__ import annotations

import gzip
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship, stage

TAG, MOST_BYTES, CHUNK, BATCH = "case-file", 1 << 26, 1 << 16, 1000
SCHEMA = (
    "source string, entry string, n long, malformed string, serial string, mark string, registration string, filed date, registered date, status int, status_date date, drawing string, "
    "classes array<struct<code:string,us:array<string>,description:string,first_use:date,first_commerce:date>>, owners array<struct<name:string,type:string,address:string,nationality:string>>, "
    "design_codes array<string>, pseudo_marks array<string>, prior array<string>"
)
FIELDS = len(SCHEMA.split(", ")) - 4
#: Fixed value: statements of goods and services begin so; three digits after it are their class.
GOODS = "GS"


def cut(stream, tag: str = TAG, most: int = MOST_BYTES) -> Iterator[tuple[bytes, str | None]]:
    """(record, what is wrong) of a stream of bytes."""
    begins, end = re.compile(rb"<" + tag.encode() + rb"(?=[\s>/])"), f"</{tag}>".encode()
    held, at = b"", 0
    while True:
        chunk = stream.read(CHUNK)
        held, at = held[at:] + chunk, 0
        while True:
            start = begins.search(held, at)
            if not start:
                at = max(at, len(held) - len(end)) if chunk else len(held)
                break
            stop, again = held.find(end, start.end()), begins.search(held, start.end())
            if again and (stop < 0 or again.start() < stop):
                yield held[start.start() : again.start()], "no end tag"
                at = again.start()
            elif stop >= 0:
                at = stop + len(end)
                yield held[start.start() : at], None
            elif len(held) - start.start() > most or not chunk:
                yield held[start.start() : start.start() + 200], "too long" if chunk else "no end tag"
                at = len(held)
            else:
                at = start.start()
                break
        if not chunk:
            return


def _date(text: str | None) -> date | None:
    if not text:
        return None
    try:
        if len(text) == 8 and text.isascii() and text.isdigit():
            return date(int(text[:4]), int(text[4:6]), int(text[6:]))
        return datetime.strptime((text or "").strip(), "%Y%m%d").date()
    except ValueError:
        return None


def case_file(record: bytes) -> tuple:
    """The fields of one record, in SCHEMA's order; ValueError says why it is none."""
    try:
        root = ElementTree.fromstring(record)
    except ElementTree.ParseError as e:
        raise ValueError(f"not well-formed: {e.msg.split(':')[0]}") from None
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
    text = lambda node, path: ((found.text or "").strip() or None) if node is not None and (found := node.find(path)) is not None else None
    texts = lambda found: [v for x in found if (v := (x.text or "").strip())]
    there = {child.tag for child in root}
    every = lambda path: root.findall(path) if path.partition("/")[0] in there else []  # noqa: E731  most records lack most parts
    serial, head = text(root, "serial-number"), root.find("case-file-header")
    if not serial:
        raise ValueError("no serial number")
    classes = [[text(c, "international-code") or "", texts(c.findall("us-code-list/us-code")), "", _date(text(c, "first-use-anywhere-date")), _date(text(c, "first-use-in-commerce-date"))] for c in every("classifications/classification")]
    for statement in every("case-file-statements/case-file-statement"):
        code, said = text(statement, "type-code") or "", text(statement, "text")
        if said and code.startswith(GOODS):
            of = code[2:] if re.fullmatch(r"\d{3}", code[2:]) else ""
            own = next((c for c in classes if c[0] == of), None)
            if own is None:
                classes.append(own := [of, [], "", None, None])
            own[2] = f"{own[2]}\n{said}" if own[2] else said
    owners = [(name, text(o, "party-type") or "", text(o, "address-1"), text(o, "nationality/country")) for o in every("case-file-owners/case-file-owner") if (name := text(o, "party-name"))]
    status = text(head, "status-code")
    return (
        serial, text(head, "mark-identification") or "", text(head, "registration-number"), _date(text(head, "filing-date")), _date(text(head, "registration-date")), int(status) if status and status.isascii() and status.isdigit() and len(status) < 10 else None,
        _date(text(head, "status-date")), text(head, "mark-drawing-code"), [tuple(c) for c in classes], owners, texts(every("design-searches/design-search/design-search-code")),
        texts(every("pseudo-marks/pseudo-mark/pseudo-mark-identification")), texts(every("prior-registration-applications/prior-registration-application/other-related-registration-number")),
    )


def open_files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Entry(InputPartition):
    def __init__(self, path: str, entry: str | None):
        self.path, self.entry = path, entry


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Entry]:
        from pyarrow import fs

        files, root = open_files(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
        if not found and info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for name in sorted(f.path for f in found if f.type == fs.FileType.File):
            if name.lower().endswith(".zip"):
                out += [Entry(name, e) for e in self._entries(files, name)]
            elif name.lower().endswith((".xml", ".gz")):
                out.append(Entry(name, None))
        return out

    @staticmethod
    def _entries(files, name: str) -> list[str | None]:
        try:
            with files.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                return [i.filename for i in z.infolist() if i.filename.lower().endswith(".xml")]
        except (zipfile.BadZipFile, OSError, ValueError):
            return [None]  # read() will say so

    def read(self, partition: Entry) -> Iterator:
        """The rows in Arrow batches: a column at a time, not a value at a time."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), self._read(partition)
        nested = {k: [f.name for f in t.value_type] for k, t in enumerate(schema.types) if pa.types.is_list(t) and pa.types.is_struct(t.value_type)}
        while own := list(islice(rows, BATCH)):
            columns = list(zip(*own))
            for k, names in nested.items():
                columns[k] = [[dict(zip(names, x)) for x in v] if v else v for v in columns[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def _read(self, partition: Entry) -> Iterator[tuple]:
        head = (partition.path, partition.entry or "")
        none, n = (None,) * FIELDS, 0
        files, _ = open_files(self.path)
        try:
            with files.open_input_file(partition.path) as f:
                if partition.path.lower().endswith(".zip"):
                    with zipfile.ZipFile(f) as z, z.open(partition.entry or "") as stream:
                        for n, row in enumerate(self._rows(stream)):
                            yield (*head, n, *row)
                else:
                    with gzip.GzipFile(fileobj=f) if partition.path.lower().endswith(".gz") else f as stream:
                        for n, row in enumerate(self._rows(stream)):
                            yield (*head, n, *row)
        except (zipfile.BadZipFile, EOFError, OSError, KeyError, ValueError, zlib.error) as e:
            yield (*head, n + 1, f"archive: {type(e).__name__}", *none)

    @staticmethod
    def _rows(stream) -> Iterator[tuple]:
        for record, wrong in cut(stream):
            try:
                if wrong:
                    raise ValueError(wrong)
                yield (None, *case_file(record))
            except ValueError as e:
                yield (str(e), *(None,) * FIELDS)


class CaseFiles(DataSource):
    """spark.read.format("case_files").load(path): a row for each record, broken ones included."""

    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def read_case_archives(spark: SparkSession, path: str, live_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Case files of a file or folder, with live; and source, entry, parsed, emitted, dead, malformed: the counts of each entry."""
    ship(spark)
    spark.dataSource.register(CaseFiles)
    rows = stage(spark.read.format("case_files").load(path), "case_files").withColumn("live", F.coalesce(F.col("status").between(600, 899), F.lit(False)))
    good = F.col("malformed").isNull()
    emitted = good & F.col("live") if live_only else good
    counts = rows.groupBy("source", "entry").agg(F.count("*").alias("parsed"), F.count_if(emitted).alias("emitted"), F.count_if(good & ~emitted).alias("dead"), F.count_if(~good).alias("malformed"))
    return rows.where(emitted).drop("malformed"), counts
