"""Office documents as text: DOCX with headings, RTF, and PDF by pages where a PDF library is installed on the executors.

Files are read whole, one row a file, by the binaryFile source; a file that cannot be read becomes a row of skipped files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: RTF destinations that hold no text, and control words that stand for characters.
HIDDEN = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "listtable", "listoverridetable", "generator", "themedata", "datastore", "object")
SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)


def docx_text(data: bytes) -> str:
    """Paragraphs parted by blank lines; styles named "heading n" become Markdown headings (2 without a number, 6 at most)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = s.find(_W + "name")
                styles[s.get(_W + "styleId")] = (name.get(_W + "val") if name is not None else "").lower()
    out = []
    for p in body.iter(_W + "p"):
        text = "".join(n.text or "" if n.tag == _W + "t" else {"tab": "\t", "br": "\n"}.get(n.tag.removeprefix(_W), "") for n in p.iter()).strip()
        used = p.find(f"{_W}pPr/{_W}pStyle")
        style = styles.get(used.get(_W + "val"), used.get(_W + "val").lower()) if used is not None else ""
        if text and style.startswith("heading"):
            level = style.removeprefix("heading").strip()
            text = "#" * (max(1, min(int(level), 6)) if level.isdigit() else 2) + " " + text
        if text:
            out.append(text)
    return "\n\n".join(out)


def rtf_text(data: bytes) -> str:
    """Lines with text, parted by blank lines. Groups of HIDDEN destinations and starred ones are left out."""
    out, stack, hidden, skip, uc = [], [], False, 0, 1
    for word, number, hexed, sign, brace, char in _RTF.findall(data.decode("utf-8", "replace")):
        if brace == "{":
            stack.append((hidden, uc))
        elif brace == "}":
            hidden, uc = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in HIDDEN:
            hidden = True
        elif word == "uc":
            uc = int(number or 1)
        elif not hidden:
            if word == "u" and number:
                out.append(chr(int(number) % 65536))
                skip = uc
            elif word in SIGNS:
                out.append(SIGNS[word])
            elif hexed or char or sign:
                if skip:
                    skip -= 1
                else:
                    out.append(bytes.fromhex(hexed).decode("cp1252", "replace") if hexed else char or {"~": " ", "_": "-"}.get(sign, sign if sign in "\\{}" else ""))
    return "\n\n".join(line.strip() for line in "".join(out).splitlines() if line.strip())


def pdf_text(data: bytes) -> str:
    """Pages under "## Page n" headings."""
    from pypdf import PdfReader  # not part of this library

    pages = [(n, (p.extract_text() or "").strip()) for n, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    return "\n\n".join(f"## Page {n}\n\n{t}" for n, t in pages if t)


READERS = {"docx": docx_text, "rtf": rtf_text, "pdf": pdf_text}


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents (source, format, content), skipped (source, reason)) of a folder's DOCX, RTF and PDF files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, data in zip(b["path"], b["content"]):
                kind = source.rsplit(".", 1)[-1].lower()
                try:
                    text = READERS[kind](bytes(data)).strip()
                    reason = None if text else "empty"
                except ImportError:
                    text, reason = None, f"no reader for {kind} installed"
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    text, reason = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(source, kind, text or None, reason)], columns=["source", "format", "content", "reason"])

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,rtf,pdf,DOCX,RTF,PDF}").format("binaryFile").load(path)
    rows = files.select("path", "content").mapInPandas(run, "source string, format string, content string, reason string")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("source", "reason")
