"""Parent and child chunks: sections are cut into typed blocks, packed to a target size, and kept under a hard one.

One document at a time: where a child ends depends on what the one before took. A document is held as its lines' starts and
a running count of UTF-8 bytes, so every size is a subtraction. Spans are exact: the children of a section tile it, in
characters, bytes and lines. What a child's search text repeats (the open fence, a table's header) is in that text alone.

Defined cases: null and empty texts have no children; a span that its heading leaves no room for is kept, with fits false.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import digest

#: The patterns of Markdown lines, and the versions that are parts of identities.
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*\r?\n?$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
LIST = re.compile(r"^[ \t]*(?:[-+*]|\d+[.)])[ \t]+")
SCHEMA, ESTIMATOR = "parent-child-v1", "utf8-bytes-div4-v1"
#: Where an overlong line may be cut.
BREAKS = " \t.!?;,:\n"


@dataclass(frozen=True)
class Sizes:
    target: int = 160
    hard: int = 512

    def config_hash(self) -> str:
        return digest(SCHEMA, ESTIMATOR, str(self.target), str(self.hard), "0")


class Page:
    """A text with its lines, sizes and closed fences."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.splitlines(keepends=True)
        self.starts = [0, *np.cumsum([len(line) for line in self.lines]).tolist()]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.bytes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        self.fences: list[tuple[int, int, str, str]] = []  # start, end, opening line, marker
        self.headings: list[tuple[int, int, str]] = []  # line, level, title
        opened = None
        for k, line in enumerate(self.lines):
            mark = FENCE.match(line)
            if mark and opened is None:
                opened = (k, mark[1])
            elif mark and mark[1].startswith(opened[1]):
                self.fences.append((self.starts[opened[0]], self.starts[k + 1], self.lines[opened[0]], opened[1]))
                opened = None
            elif opened is None and (h := HEADING.match(line)):
                self.headings.append((k, len(h[1]), h[2].strip()))

    def size(self, start: int, end: int) -> int:
        return max(1, int(self.bytes[end] - self.bytes[start] + 3) // 4)

    def sections(self) -> Iterator[tuple[int, int, list[tuple[int, str]], int]]:
        """First line, last line (exclusive), path of (level, title) and its occurrence, of sections that tile the text."""
        ends = [h[0] for h in self.headings[1:]] + [len(self.lines)]
        if self.lines and (not self.headings or self.headings[0][0] > 0):
            yield 0, self.headings[0][0] if self.headings else len(self.lines), [], 1
        path: list[tuple[int, str]] = []
        seen: Counter = Counter()
        for (line, level, title), end in zip(self.headings, ends):
            path = [p for p in path if p[0] < level] + [(level, title)]
            seen[tuple(path)] += 1
            yield line, end, path, seen[tuple(path)]

    def blocks(self, first: int, last: int) -> Iterator[tuple[int, int, str]]:
        """Spans of typed blocks; blank lines belong to the block that they follow."""
        is_row = lambda k: self.lines[k].lstrip().startswith("|")
        blank = lambda k: not self.lines[k].strip()
        special = lambda k: is_row(k) or bool(FENCE.match(self.lines[k]) or LIST.match(self.lines[k]))
        goes_on = {
            "table": is_row,
            "list": lambda k: bool(LIST.match(self.lines[k])) or self.lines[k][0] in " \t",
            "whitespace": lambda k: False,
            "heading": lambda k: not blank(k) and not special(k),
            "prose": lambda k: not blank(k) and not special(k),
        }
        k = first
        while k < last:
            begin, line, mark = k, self.lines[k], FENCE.match(self.lines[k])
            k += 1
            if mark:
                kind = "code"
                while k < last:
                    k += 1
                    close = FENCE.match(self.lines[k - 1])
                    if close and close[1].startswith(mark[1]):
                        break
            else:
                kind = "table" if is_row(begin) else "list" if LIST.match(line) else "whitespace" if blank(begin) else "heading" if HEADING.match(line) else "prose"
                while k < last and goes_on[kind](k):
                    k += 1
            while k < last and blank(k):
                k += 1
            yield self.starts[begin], self.starts[k], kind

    def search_text(self, start: int, end: int) -> str:
        """The span's text, with the fence or the table header that it was cut from."""
        body = self.text[start:end]
        for begin, stop, opening, marker in self.fences:
            if begin < end and start < stop:
                return (opening if start > begin else "") + (body.rstrip("\r\n") + "\n" + marker + "\n" if end < stop else body)
        here = max(0, bisect.bisect_right(self.starts, start) - 1)
        top = here
        while 0 < top < len(self.lines) and self.lines[top].lstrip().startswith("|") and self.lines[top - 1].lstrip().startswith("|"):
            top -= 1
        header = "".join(self.lines[top : top + 2])
        return header + body if top < here and not body.startswith(header) else body

    def cut(self, start: int, end: int, limit: int) -> list[tuple[int, int]]:
        """Whole lines while they fit into the limit; a line that alone exceeds it is cut between characters, at a break if one is near."""
        if self.size(start, end) <= limit:
            return [(start, end)]
        inner = self.starts[bisect.bisect_right(self.starts, start) : bisect.bisect_left(self.starts, end)]
        stops, out, at, k = [*inner, end], [], start, 0
        reach = lambda a: int(np.searchsorted(self.bytes, self.bytes[a] + 4 * limit, side="right")) - 1
        while at < end:
            most = bisect.bisect_right(stops, reach(at), k) - 1
            if most >= k:
                out.append((at, stops[most]))
            else:
                most, a = k, at
                while a < stops[k]:
                    b = min(max(reach(a), a + 1), stops[k])
                    if b < stops[k]:
                        near = a + max(1, (b - a) // 2)
                        b = max([self.text.rfind(c, near, b) + 1 for c in BREAKS] + [0]) or b
                    out.append((a, b))
                    a = b
            at, k = stops[most], most + 1
        return out


def size_of(text: str) -> int:
    return max(1, (len(text.encode("utf-8", "surrogatepass")) + 3) // 4)


def children(text: str, identity: str, sizes: Sizes = Sizes()) -> Iterator[dict]:
    page, config = Page(text), sizes.config_hash()
    sha = lambda a, b: hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()
    for first, last, path, occurrence in page.sections():
        names, levels = [t for _, t in path], [n for n, _ in path]
        parent = "parent-" + digest(SCHEMA, identity, json.dumps(names, ensure_ascii=False), json.dumps(levels), str(occurrence))[:32]
        prefix = f"Document: {identity[-240:]}" + ("\nHeading: " + " > ".join(n[:160] for n in names)[-480:] if names else "") + "\n\n"
        taken = size_of(prefix)
        prefix_bytes = len(prefix.encode("utf-8", "surrogatepass"))
        packed: list[list] = []
        seen: Counter = Counter()
        for a, b, kind in page.blocks(first, last):
            h = sha(a, b)
            seen[kind, h] += 1
            atom = "atom-" + digest(parent, kind, h, str(seen[kind, h]))[:32]
            for s, e in page.cut(a, b, max(1, sizes.target - taken)) if page.size(a, b) > max(1, sizes.hard - taken) else [(a, b)]:
                before = packed[-1] if packed else None
                if before and (prefix_bytes + int(page.bytes[e] - page.bytes[before[0]]) + 3) // 4 <= sizes.target:
                    packed[-1] = [before[0], e, kind if before[2] == kind else "mixed", "atom-" + digest(before[3], atom)[:32]]
                else:
                    packed.append([s, e, kind, atom])
        ordinal, copies = 0, Counter()
        todo = packed[::-1]
        while todo:
            a, b, kind, atom = todo.pop()
            search = prefix + page.search_text(a, b)
            need = size_of(search)
            if need > sizes.hard:
                parts = page.cut(a, b, max(1, sizes.hard - max(0, need - page.size(a, b)) - 1))
                if len(parts) > 1:
                    todo += [[s, e, kind, atom] for s, e in parts[::-1]]
                    continue
            h = sha(a, b)
            copies[h] += 1
            line = bisect.bisect_right(page.starts, a)
            yield {
                "child_id": "child-" + digest(parent, config, h, str(copies[h]))[:40], "parent_id": parent, "ordinal": ordinal, "heading_path": names, "kind": kind, "atom_id": atom,
                "char_start": a, "char_end": b, "byte_start": int(page.bytes[a]), "byte_end": int(page.bytes[b]), "line_start": line, "line_end": max(line, bisect.bisect_left(page.starts, b)),
                "tokens": page.size(a, b), "search_tokens": need, "fits": need <= sizes.hard, "display_text": text[a:b], "search_text": search,
            }
            ordinal += 1


CHILD = "child_id string, parent_id string, ordinal int, heading_path array<string>, kind string, atom_id string, char_start long, char_end long, byte_start long, byte_end long, line_start int, line_end int, tokens int, search_tokens int, fits boolean, display_text string, search_text string"


def child_rows(docs: DataFrame, id_col="doc_id", text_col="text", sizes: Sizes = Sizes(), rows_a_frame: int = 512) -> DataFrame:
    """id and the columns of CHILD, one row per child. Results leave the worker in frames of at most rows_a_frame rows."""
    names = [c.split()[0] for c in CHILD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                for c in children(t or "", str(i), sizes):
                    out.append((i, *(c[n] for n in names)))
                    if len(out) >= rows_a_frame:
                        yield pd.DataFrame(out, columns=["id", *names])
                        out = []
        yield pd.DataFrame(out, columns=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, {CHILD}")
