"""HTML extraction by layout-aware rendering.

A tokenizer that reads each character once, as a browser's does, feeds a tree builder with implied end tags; what is not displayed
(scripts, styles, templates, hidden elements, closed details) makes no text. The renderer emits all that is visible:
blocks apart from each other, paragraphs by an empty line, lists with markers and indents, tables with their
cells aligned in columns (a cell of several rows stands in its first), preformatted text as it stands. Text and elements that stand in a table but in no cell or caption come before
the table. Of a drop-down the chosen option is text, of a list box every option; of svg its text elements; a text area's
lines stand as they are; an object gives its fallback. What is text by its element (text area, title, xmp, plaintext, scripts, styles) holds no tags.

Hidden visibility is inherited and may be undone within. Not displayed by a browser that runs scripts and plays media, so without text: head, script, style, template, noscript, title;
the fallback of iframe, audio, video, canvas and ruby; noframes and noembed; datalist; annotations of math; definitions and descriptions in svg.

Defined cases: null and empty pages give empty text; broken markup never fails and takes time in proportion to it; unclosed elements end with the page, an unclosed comment
or tag hides what follows, as in a browser; a table whose spans cover more than `COVERED` times its cells is laid out without row spans, and no cell makes its column
wider than `WIDEST`; elements nested deeper than `DEEPEST` are laid out as if they stood at that depth; repeated rows render alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: HTML's void elements, elements that are not displayed, blocks, and blocks with a margin.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noframes noembed title meta link base iframe audio video canvas datalist rp annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 listing ol p plaintext pre table ul xmp menu fieldset".split())
#: Start tags that end an open p, and for each start tag the open elements that it ends, up to a boundary.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})} | {
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
#: Elements that leave an open head open; any other start tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements that an end tag of an element around them may not be matched across.
WALLS = frozenset("table td th caption body html".split())
#: What a table, its sections and rows hold; where else in it text and elements are put before the table. Where table tags go back to.
TABLE = frozenset("table tbody thead tfoot tr colgroup".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th style script template".split())
BACK_TO = {"td": TABLE, "th": TABLE, "tr": TABLE - {"tr", "colgroup"}} | {t: frozenset({"table"}) for t in ("tbody", "thead", "tfoot", "caption", "colgroup")}
#: Elements in svg and math that hold HTML, parts of svg that are not drawn, and start tags that end svg and math.
HTML_IN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
UNDRAWN = frozenset("defs symbol title desc metadata clippath mask pattern marker style script".split())
ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements that show something of their own, besides text.
GHOSTLESS = frozenset("img input hr select textarea svg".split())
DEEPEST = 200
#: Elements whose content is text up to their end tag, without tags; in the second kind character references count.
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes noscript plaintext".split()), frozenset("textarea title".split())
_BLANK = r"[ \t\n\f\r]"
_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_ATTRIBUTE = re.compile(rf"(?:{_BLANK}|/)*+(?:(=?[^ \t\n\f\r/>=]*+)(?:{_BLANK}*+=(?!>){_BLANK}*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?))?+)?+")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: Greatest spans of cells that count.
COLUMNS, ROWS = 100, 1000
#: Covered columns for each cell of a table up to which row spans count; width up to which a cell counts for its column.
COVERED, WIDEST = 16, 160


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """A tag's attributes from behind its name, whether it ends itself, and where the page goes on: beyond its end if the tag has none."""
    found, n = [], len(html)
    while at < n and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m[1]:
            value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6] or ""
            found.append((m[1].lower(), unescape(value) if "&" in value else value))
        at = max(m.end(), at + 1) if m.end() == at else m.end()
    return found, at < n and html[at - 1] == "/", at + 1


def _after_comment(html: str, at: int) -> int:
    """Behind a comment, a declaration or whatever else begins with <!, <? or </ and is no tag."""
    if html.startswith("<!--", at):
        if html.startswith(("<!-->", "<!--->"), at):
            return html.index(">", at) + 1
        ends = [(k, len(mark)) for mark in ("-->", "--!>") if (k := html.find(mark, at + 4)) >= 0]
        return sum(min(ends)) if ends else len(html)
    end = html.find(">", at)
    return end + 1 if end >= 0 else len(html)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.past_head = self.drawn = False

    def feed(self, html: str) -> None:
        """Reads a page from its beginning to its end, each character once."""
        at, n, text = 0, len(html), []

        def told() -> None:
            if text:
                data = "".join(text)
                text.clear()
                self.handle_data(unescape(data) if "&" in data else data)

        while at < n:
            open_ = html.find("<", at)
            if open_ < 0:
                text.append(html[at:])
                break
            text.append(html[at:open_])
            sign = html[open_ + 1 : open_ + 2]
            name = _NAME.match(html, open_ + 1 + (sign == "/"))
            if name:
                told()
                attrs, closed, at = _attributes(html, name.end())
                if at > n:  # the page ends within the tag
                    return
                tag = name[0].lower()
                if sign == "/":
                    self.handle_endtag(tag)
                    continue
                foreign = self._foreign()
                (self.handle_startendtag if closed else self.handle_starttag)(tag, attrs)
                if tag in RAW | ESCAPABLE and not foreign and self.open[-1].tag == tag:
                    at = self._raw(tag, html, at)
            elif sign == "!" or sign == "?" or (sign == "/" and open_ + 2 < n):
                if html.startswith("<![CDATA[", open_) and self._foreign():
                    end = html.find("]]>", open_)
                    text.append(html[open_ + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                    at = end + 3 if end >= 0 else n
                    continue
                at = _after_comment(html, open_)
            else:
                text.append("<")
                at = open_ + 1
        told()

    def _raw(self, tag: str, html: str, at: int) -> int:
        """Takes the text of an element that holds no tags, and ends it; where the page goes on."""
        end = re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I).search(html, at) if tag != "plaintext" else None
        data = html[at : end.start() if end else len(html)]
        if data:
            self.open[-1].children.append(unescape(data) if tag in ESCAPABLE else data)
        self.open.pop()
        return _attributes(html, end.end())[2] if end else len(html)

    def _close(self, tags, walls) -> None:
        """Ends the innermost open element of the tags, if it is not beyond a wall."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in walls:
                return

    def _end_head(self) -> None:
        """Ends a head that is the current element; after that, or after other content, a head start tag means nothing."""
        if self.open[-1].tag == "head":
            self.open.pop()
        self.past_head |= all(n.tag == "html" for n in self.open)

    def _foreign(self) -> int:
        """Where the svg or math is in whose own content the parser stands, else 0."""
        for k in range(len(self.open) - 1, 0, -1) if self.drawn else ():
            if self.open[k].tag in ("svg", "math"):
                return k
            if self.open[k].tag in HTML_IN:
                return 0
        return 0

    def _place(self, child, foster: bool) -> None:
        """Adds a child to the current element, or before the table that is open."""
        if foster and self.open[-1].tag == "colgroup":
            self.open.pop()
        at = max((k for k, n in enumerate(self.open) if n.tag == "table"), default=0) if foster and self.open[-1].tag in TABLE else 0
        if at:
            around = self.open[at - 1].children  # the open table is the last in it
            around.insert(len(around) - 1, child)
        else:
            self.open[-1].children.append(child)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_SVG and (k := self._foreign()):
            del self.open[k:]
        if tag in ("html", "body") and len(self.open) > 1 and tag != "body":
            return
        if tag == "head" and (self.past_head or any(n.tag != "html" for n in self.open)):
            return
        if tag not in IN_HEAD and tag not in ("html", "head"):
            self._end_head()
        if tag in ENDS_P:
            self._close({"p"}, WALLS)
        if tag in ENDS:
            tags, walls = ENDS[tag]
            while True:
                before = len(self.open)
                self._close(tags, walls)
                if len(self.open) == before:
                    break
        if tag in BACK_TO:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in BACK_TO[tag]:
                    del self.open[k + 1 :]
                    break
                if self.open[k].tag in ("td", "th", "caption"):
                    break
        elif tag == "table" and self.open[-1].tag in TABLE:
            self._close({"table"}, ())
        node = Node(tag, dict(reversed(attrs)))  # of equal names the first counts
        self.drawn |= tag in ("svg", "math")
        form = tag == "form" and self.open[-1].tag in TABLE  # is empty there
        self._place(node, tag not in IN_TABLE and not form)
        if tag not in VOID and not form and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self._foreign() and self.open[-1].tag == tag:  # in HTML the slash means nothing
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self._place(Node("br", {}), True)
        elif tag in VOID:
            pass
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self._place(Node("p", {}), True)
        else:
            self._close({tag}, WALLS - {tag} if tag not in ("table", "body", "html") else ())

    def handle_data(self, data):
        if data.strip(" \t\n\f\r"):
            self._end_head()
            self._place(data, True)
        else:
            self.open[-1].children.append(data)


def build(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    return b.root


def _visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _HIDDEN.search(a["style"]))


def without_ghosts(node: Node, ghost: bool = False) -> Node:
    """The tree without what visibility hides: it is inherited, and an element within may be visible again."""
    kept = []
    for child in node.children:
        if isinstance(child, str):
            kept += [] if ghost else [child]
            continue
        said = _VISIBILITY.findall(child.attrs.get("style", ""))
        unseen = said[-1].lower() in ("hidden", "collapse") if said and said[-1].lower() != "inherit" else ghost
        if unseen and child.tag in GHOSTLESS:
            continue
        if unseen and child.tag == "li":
            child.tag = "div"  # no marker
        kept.append(without_ghosts(child, unseen))
    node.children = kept
    return node


class _Lines:
    """Lines under construction: runs of white space collapse, blocks start lines, margins do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap = False, False

    def text(self, s: str) -> None:
        parts = _SPACE.split(s)
        for k, part in enumerate(parts):
            self.space |= k > 0
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                if not self.line and self.gap and self.lines:
                    self.lines.append("")
                self.gap = self.space = False
                self.line.append(part)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap |= spaced

    def take(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines


def _indented(lines: list[str], first: str) -> list[str]:
    rest = " " * len(first)
    return [(first if k == 0 else rest) + x if x or k == 0 else "" for k, x in enumerate(lines)]


def _render(node: Node) -> list[str]:
    out = _Lines()
    _flow(node, out)
    out.newline()
    return out.lines


def _list(node: Node, out: _Lines) -> None:
    step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
    first = 1 if step > 0 else sum(not isinstance(c, str) and c.tag == "li" and _visible(c) for c in node.children)
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else first
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif child.tag == "li" and _visible(child):
            out.newline()
            if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                number = int(child.attrs["value"])
            marker = f"{number}. " if node.tag == "ol" else "- "
            out.take(_indented(_render(child) or [""], marker))
            number += step
        else:
            _element(child, out)


def _span(cell: Node, name: str, most: int) -> int:
    said = cell.attrs.get(name, "")
    return min(int(said), most) if re.fullmatch(r"[1-9]\d{0,5}", said) else 1


def _rows(node: Node, rows: list[list[tuple[int, int, list[str]]]], captions: list[str]) -> None:
    """rows: column span, row span and lines of each row's cells. A row span ends with its section."""
    first = len(rows)
    for child in node.children:
        if isinstance(child, str) or not _visible(child):
            continue
        if child.tag == "tr":
            cells = [c for c in child.children if not isinstance(c, str) and c.tag in ("td", "th") and _visible(c)]
            rows.append([(_span(c, "colspan", COLUMNS), _span(c, "rowspan", ROWS) if c.attrs.get("rowspan") != "0" else ROWS, _render(c)) for c in cells])
        elif child.tag in ("tbody", "thead", "tfoot"):
            _rows(child, rows, captions)
        elif child.tag not in ("colgroup", "col"):
            captions += _render(child)
    if node.tag != "table":
        for k in range(first, len(rows)):
            rows[k] = [(c, min(r, len(rows) - k), lines) for c, r, lines in rows[k]]


def _placed(rows: list[list[tuple[int, int, list[str]]]], most: int) -> list[list[tuple[int, int, list[str]]]] | None:
    """Column, column span and lines of each row's cells; columns that a cell of a row above still covers are passed by, as empty cells. None if those are more than most."""
    out, covered = [], {}
    for row in rows:
        placed, at, left = [], 0, dict(covered)
        most -= len(left)
        if most < 0:
            return None
        for span, down, lines in row:
            while left.get(at):
                placed.append((at, 1, []))
                at += 1
            placed.append((at, span, lines))
            if down > 1:
                for c in range(at, at + span):
                    covered[c] = max(covered.get(c, 0), down)
            at += span
        covered = {c: n - 1 for c, n in covered.items() if n > 1}
        out.append(placed)
    return out


def _table(node: Node, out: _Lines) -> None:
    found: list[list[tuple[int, int, list[str]]]] = []
    captions: list[str] = []
    _rows(node, found, captions)
    rows = _placed(found, 1000 + COVERED * sum(map(len, found)))
    if rows is None:
        rows = _placed([[(span, 1, lines) for span, _, lines in row] for row in found], 1)
    width: dict[int, int] = {}
    for row in rows:
        for at, span, lines in row:
            if span == 1:
                width[at] = max(width.get(at, 0), max((n for n in map(len, lines) if n <= WIDEST), default=0))
    out.take(captions)
    for row in rows:
        height = max((len(lines) for _, _, lines in row), default=0)
        done: list[list[str]] = [[] for _ in range(height)]
        for at, span, lines in row:
            room = width.get(at, 0) if span == 1 else sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
            for y in range(height):
                done[y].append((lines[y] if y < len(lines) else "").ljust(room))
        out.take([" | ".join(x).rstrip() for x in done])


def _options(node: Node, off: bool = False) -> Iterator[tuple[bool, bool, str, dict]]:
    """off, is an option, text, attributes of a select's options and groups."""
    for child in node.children:
        if isinstance(child, str) or not _visible(child):
            continue
        if child.tag == "option":
            yield off or "disabled" in child.attrs, True, child.attrs.get("label") or " ".join(_SPACE.split("".join(_plain(child)))).strip(), child.attrs
        else:
            if child.tag == "optgroup" and child.attrs.get("label"):
                yield True, False, child.attrs["label"], child.attrs
            yield from _options(child, off or (child.tag == "optgroup" and "disabled" in child.attrs))


def _select(node: Node, out: _Lines) -> None:
    found = list(_options(node))
    if "multiple" in node.attrs or re.fullmatch(r"0*([2-9]|[1-9]\d+)", node.attrs.get("size", "")):
        out.newline()
        out.take([text for _, _, text, _ in found if text])
        return
    options = [x for x in found if x[1]]
    chosen = [x for x in options if "selected" in x[3]][-1:] or [x for x in options if not x[0]][:1]
    for _, _, text, _ in chosen:
        out.text(text)


def _svg(node: Node, out: _Lines) -> None:
    """Text elements, apart from each other, and embedded HTML."""
    for child in node.children:
        if isinstance(child, str) or child.tag in UNDRAWN or not _visible(child):
            continue
        if child.tag == "text":
            out.space = True
            _flow(child, out)
            out.space = True
        elif child.tag == "foreignobject":
            out.newline()
            _flow(child, out)
            out.newline()
        else:
            _svg(child, out)


def _element(node: Node, out: _Lines) -> None:
    tag = node.tag
    if not _visible(node):
        return
    if tag == "br":
        if not out.line and out.lines:
            out.gap = True
        out.newline()
    elif tag == "img":
        out.text(node.attrs.get("alt", ""))
    elif tag == "input":
        if node.attrs.get("type", "").lower() in ("button", "submit", "reset"):
            out.text(node.attrs.get("value", ""))
    elif tag == "hr":
        out.newline()
        out.take(["----"])
    elif tag in ("pre", "listing", "xmp", "plaintext"):
        out.block(True)
        lines = "".join(_plain(node)).replace("\r\n", "\n").removeprefix("\n").rstrip("\n").split("\n")
        out.take(lines if any(x.strip() for x in lines) else [])
        out.block(True)
    elif tag == "select":
        _select(node, out)
    elif tag == "svg":
        _svg(node, out)
    elif tag == "textarea":
        lines = "".join(_plain(node)).replace("\r\n", "\n").removeprefix("\n").rstrip("\n").split("\n")
        if len(lines) == 1:
            out.text(lines[0])
        else:
            out.newline()
            out.take(lines)
    elif tag == "table":
        out.block(True)
        _table(node, out)
        out.block(True)
    elif tag in ("ul", "ol", "menu"):
        out.block(True)
        _list(node, out)
        out.block(True)
    elif tag in ("blockquote", "dd"):
        out.block(tag == "blockquote")
        out.take(_indented(_render(node), "> " if tag == "blockquote" else "  "))
        out.block(tag == "blockquote")
    elif tag == "details" and "open" not in node.attrs:
        for child in node.children:
            if not isinstance(child, str) and child.tag == "summary":
                _element(child, out)
    elif tag in BLOCKS:
        out.block(tag in SPACED)
        _flow(node, out)
        out.block(tag in SPACED)
    else:
        _flow(node, out)


def _plain(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag == "br":
            yield "\n"
        elif child.tag in ("select", "svg", "table"):
            inner = _Lines()
            _element(child, inner)
            inner.newline()
            yield "\n".join(inner.lines)
        elif _visible(child):
            yield from _plain(child)


def _flow(node: Node, out: _Lines) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        else:
            _element(child, out)


def render(html: str) -> str:
    """The visible text of a page."""
    root = build(html)
    return "\n".join(_render(without_ghosts(root) if "visibility" in html.lower() else root))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(t.as_py() or "") for t in batch.column(1)], pa.string())], ["id", "text"])


def extract(pages: DataFrame, *, id_col="page_id", html_col="html") -> DataFrame:
    """id, text of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lean(_rendered), f"id {dict(rows.dtypes)['id']}, text string")


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "text", F.length("text").cast("long").alias("n_chars"))
