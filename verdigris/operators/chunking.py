"""Chunkers with state, one document at a time: paragraphs packed to a size, Markdown sections with exact spans."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .markdown import windows

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def pack_paragraphs(text: str, size: int = 800, overlap: int = 100) -> list[str]:
    """Paragraphs, white space collapsed, packed while they fit; longer ones are cut into windows. A chunk begins with the tail of the one before
    if it stays within size and overlap."""
    out, current = [], ""
    for paragraph in (" ".join(p.split()) for p in re.split(r"\n\s*\n+", text)):
        if not paragraph:
            continue
        if len(paragraph) > size:
            out += [current] * bool(current) + windows(paragraph, size, overlap)
            current = ""
        elif current and len(current) + 2 + len(paragraph) > size:
            out.append(current)
            current = paragraph
        else:
            current = f"{current}\n\n{paragraph}" if current else paragraph
    out += [current] * bool(current)
    tails = ["", *(c[-overlap:].strip() if overlap else "" for c in out[:-1])]
    return [f"{tail}\n\n{c}" if tail and len(tail) + 2 + len(c) <= size + overlap else c for tail, c in zip(tails, out)]


def markdown_sections(text: str) -> list[dict]:
    """Heading sections that tile the text; headings within fences are text. Spans in characters and bytes."""
    cuts, stack, fence, at = [], [], None, 0
    for line in text.splitlines(keepends=True):
        mark = _FENCE.match(line)
        if fence:
            fence = None if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]) else fence
        elif mark:
            fence = mark[1]
        elif h := _HEADING.match(line.rstrip("\r\n")):
            level = len(h[1])
            stack = [s for s in stack if s[0] < level] + [(level, h[2])]
            cuts.append((at, list(stack)))
        at += len(line)
    if text and (not cuts or cuts[0][0] > 0):
        cuts.insert(0, (0, []))
    out, seen, byte = [], {}, 0
    for (start, path), end in zip(cuts, [c[0] for c in cuts[1:]] + [len(text)]):
        body = text[start:end]
        names = tuple(n for _, n in path)
        seen[names] = seen.get(names, 0) + 1
        size = len(body.encode())
        out.append({"heading_path": list(names), "level": path[-1][0] if path else 0, "occurrence": seen[names], "char_start": start, "char_end": end, "byte_start": byte, "byte_end": byte + size, "display_text": body})
        byte += size
    return out


def digest(*parts) -> str:
    """sha256 of the compact JSON list of the parts."""
    return hashlib.sha256(json.dumps(list(parts), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def paragraph_chunks(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 800, overlap: int = 100) -> DataFrame:
    """id, chunk_index, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b["id"], b["text"]) for k, c in enumerate(pack_paragraphs(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, chunk_index int, text string")


def section_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, parent_id, heading_path, level, occurrence, spans and text of every section."""
    names = ["heading_path", "level", "occurrence", "char_start", "char_end", "byte_start", "byte_end", "display_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, "parent-" + digest(str(i), s["heading_path"], s["occurrence"])[:32], *(s[n] for n in names)) for i, t in zip(b["id"], b["text"]) for s in markdown_sections(t or "")]
            yield pd.DataFrame(rows, columns=["id", "parent_id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, parent_id string, heading_path array<string>, level int, occurrence int, char_start long, char_end long, byte_start long, byte_end long, display_text string")


def sections_by_strategy(docs: DataFrame, id_col="doc_id", text_col="text", strategy_col="strategy") -> DataFrame:
    """id, section_index, title, text: a document's heading sections, packed paragraphs, or the whole of it where no strategy is named. Blank sections are none."""
    strategy = F.coalesce(F.col(strategy_col), F.lit("single"))
    heading, paragraph = docs.where(strategy == "heading"), docs.where(strategy == "paragraph")
    parts = section_rows(heading, id_col, text_col).where(F.trim("display_text") != "")
    order = Window.partitionBy("id").orderBy("char_start")
    parts = parts.select("id", (F.row_number().over(order) - 1).alias("section_index"), F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Document")).alias("title"), F.col("display_text").alias("text"))
    packed = paragraph_chunks(paragraph, id_col, text_col).select("id", F.col("chunk_index").alias("section_index"), F.concat(F.lit("Part "), (F.col("chunk_index") + 1).cast("string")).alias("title"), "text")
    whole = docs.where(~strategy.isin("heading", "paragraph") & (F.trim(F.coalesce(F.col(text_col), F.lit(""))) != ""))
    return parts.unionByName(packed).unionByName(whole.select(F.col(id_col).alias("id"), F.lit(0).alias("section_index"), F.lit("Document").alias("title"), F.col(text_col).alias("text")))
