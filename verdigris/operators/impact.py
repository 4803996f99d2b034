"""From a diff to the documentation that it touches: sections and what they mention, changed paths, lines and symbols, ranked findings.

A document's sections carry the paths and symbols that they name. A diff gives changed paths, line ranges and the symbols that its lines declare; ranges meet the
spans of known symbols by file and block of lines. Findings are joins of what changed with what is mentioned, by value, and of code with the documents of its
module or project; the first rule that holds gives the finding its action and score.

Null texts are empty; an unreadable diff has no changes; lines end at line feeds, returns and Unicode's line marks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, stage
from .codegraph import DEFINES

#: Patterns of headings, fences, paths and symbols in a document, and the bounds of what a section lists.
HEADING, FENCE = r"^(#{1,6})\s+(.+?)\s*#*\s*$", r"^[ \t]{0,3}(`{3,}|~{3,})"
PATHS = r"(?U)(?<![\w.-])(?:(?<=//)(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]*[A-Za-z0-9_]|((?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]*[A-Za-z0-9_]))"
CODE, SYMBOL = r"`([^`\n]+)`", r"^[A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z_][A-Za-z0-9_-]*)*$"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MOST_MENTIONS, HEADING_CHARS, PATH_CHARS, SYMBOL_CHARS = 64, 512, 4096, 512
#: Files of dependencies, what a test's path looks like, folders of modules, and declarations in changed lines by suffix.
DEPENDENCY_FILES = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pubspec.yaml", "pubspec.lock", "Cargo.toml", "Cargo.lock", "pyproject.toml", "poetry.lock", "uv.lock", "requirements.txt")
TEST_FOLDERS = ("tests", "test", "__tests__")
TEST_ENDINGS = ("_test.py", "_test.go", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")
MODULE_ROOTS, LIB_ROOTS = ("packages", "apps", "services", "modules", "libs", "crates", "plugins", "components"), ("modules", "features")
SCRIPT = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)|^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
TYPED = r"^\s*(?:export\s+)?(?:declare\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)|^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
DECLARES = {
    ".py": r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", ".js": SCRIPT, ".jsx": SCRIPT, ".ts": TYPED, ".tsx": TYPED,
    ".dart": r"^\s*(?:abstract\s+)?(?:class|enum|mixin|extension|typedef)\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*(?!(?:return|await|throw|yield|if|for|while|switch|new)\b)(?:[A-Za-z_][A-Za-z0-9_<>,?\[\] ]+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
}
#: Scores of findings; what names an authority document adds.
SCORES = {"section_reference_changed_symbol": 100, "section_reference_changed_path": 95, "module": 65, "project": 45, "fallback": 35, "unlikely": 10}
AUTHORITY = 5
#: Lines of a block in which ranges and spans meet; documents that an unread file falls back on.
LINE_BLOCK, FALLBACK_DOCS = 64, 5
#: Rows of an authority's documents or sections up to which they are broadcast.
BROADCAST_ROWS = 100_000
CHANGES = "change_id {id}, kind string, old_path string, new_path string"
EVIDENCE = "change_id {id}, path string, what string, symbol string, line_start int, line_end int"


def section_metadata(docs: DataFrame, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, section, heading_path, paths, symbols, truncated, content_hash: what each section of each Markdown text names, in order. Lines in fences open no section."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), rf"(?:{LINE_ENDS})\z", "")
    rows = docs.where(F.col(text_col).rlike(r"(?U)\S")).select(F.col(path_col).alias("path"), F.split(text, LINE_ENDS, -1).alias("lines"))
    # A text's fences and headings alone are folded, in its row: a fence ends at one of its own sign, as long or longer; a heading outside of them opens a section under those of lower levels.
    numbered = F.filter(F.transform("lines", lambda line, n: F.struct(n.alias("n"), line.alias("line"))), lambda x: x["line"].rlike(FENCE) | x["line"].rlike(HEADING))
    mark, level = (lambda x: F.regexp_extract(x["line"], FENCE, 1)), (lambda x: F.length(F.regexp_extract(x["line"], HEADING, 1)))
    events = F.transform(numbered, lambda x: F.struct(x["n"].alias("n"), F.left(mark(x), F.lit(1)).alias("sign"), F.length(mark(x)).alias("size"), level(x).alias("level"), F.trim(F.regexp_extract(x["line"], HEADING, 2)).alias("title")))
    names = F.array().cast("array<string>")
    first = F.struct(F.lit("").alias("sign"), F.lit(0).alias("size"), names.alias("stack"), F.array().cast("array<struct<n:int,heading_path:array<string>>>").alias("out"))
    state = lambda s, sign, size: F.struct(sign.alias("sign"), size.alias("size"), s["stack"].alias("stack"), s["out"].alias("out"))
    under = lambda s, x: F.concat(F.slice(s["stack"], F.lit(1), x["level"] - 1), F.array(x["title"]))
    opened = lambda s, x: F.struct(s["sign"].alias("sign"), s["size"].alias("size"), under(s, x).alias("stack"), F.concat(s["out"], F.array(F.struct(x["n"].alias("n"), under(s, x).alias("heading_path")))).alias("out"))
    step = lambda s, x: F.when((s["sign"] == "") & (x["size"] > 0), state(s, x["sign"], x["size"])).when(s["sign"] == "", opened(s, x)).when((s["sign"] == x["sign"]) & (x["size"] >= s["size"]), state(s, F.lit(""), F.lit(0))).otherwise(s)
    rows = rows.select("path", "lines", events.alias("events")).select("path", "lines", F.aggregate("events", first, step, lambda s: s["out"]).alias("heads"))
    # Section k reaches from its heading to the next; 0 is what stands before the first, if anything does.
    opens = F.concat(F.array(F.struct(F.lit(0).alias("n"), names.alias("heading_path"))), F.col("heads"))
    ends = F.concat(F.transform("heads", lambda h: h["n"]), F.array(F.size("lines")))
    rows = rows.select("path", "lines", opens.alias("opens"), ends.alias("ends"))
    content = lambda x, k: F.array_join(F.slice("lines", x["n"] + 1, F.get("ends", k) - x["n"]), "\n")
    own = F.transform("opens", lambda x, k: F.struct(k.alias("section"), x["heading_path"].alias("heading_path"), F.when((k > 0) | (F.get("ends", k) > 0), content(x, k)).alias("content")))
    rows = rows.select("path", F.explode(own).alias("x")).select("path", "x.section", "x.heading_path", "x.content").where("content is not null")
    found = F.transform(F.filter(F.regexp_extract_all("content", F.lit(PATHS), F.lit(1)), lambda p: p != ""), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    paths = F.array_distinct(F.filter(F.transform(found, lambda p: F.ltrim(F.regexp_replace(p, r"^\./", ""), F.lit("/"))), lambda p: p != ""))
    tokens = F.transform(F.filter(F.regexp_extract_all("content", F.lit(CODE), F.lit(1)), lambda t: ~t.contains("/")), lambda t: F.trim(t))
    symbols = F.array_distinct(F.filter(tokens, lambda t: t.rlike(SYMBOL)))
    rows = rows.select("path", "section", F.col("heading_path").alias("own"), paths.alias("p"), symbols.alias("s"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"))
    short = lambda c, most: F.filter(c, lambda v: F.length(v) <= most)
    cut = (F.size(short("p", PATH_CHARS)) > MOST_MENTIONS) | (F.size(short("s", SYMBOL_CHARS)) > MOST_MENTIONS) | (F.size(short("p", PATH_CHARS)) < F.size("p")) | (F.size(short("s", SYMBOL_CHARS)) < F.size("s")) | F.exists("own", lambda h: F.length(h) > HEADING_CHARS)
    return rows.select(
        "path", F.col("section").cast("int").alias("section"), F.transform("own", lambda h: F.left(h, F.lit(HEADING_CHARS))).alias("heading_path"), F.slice(short("p", PATH_CHARS), 1, MOST_MENTIONS).alias("paths"),
        F.slice(short("s", SYMBOL_CHARS), 1, MOST_MENTIONS).alias("symbols"), cut.alias("truncated"), "content_hash",
    )


def name_status(raw: bytes) -> list[tuple[str, str | None, str | None]]:
    """(kind, old path, new path) of the fields of a NUL-separated name-status list; what is cut off at its end is left out."""
    fields = [f.decode("utf-8", "backslashreplace") for f in raw.split(b"\0")]
    kinds, out, at = {"A": "added", "D": "deleted", "T": "type_changed", "R": "renamed", "C": "copied"}, [], 0
    while at < len(fields) and fields[at]:
        kind, two = kinds.get(fields[at][0], "modified"), fields[at][0] in "RC"
        paths = fields[at + 1 : at + 2 + two]
        if len(paths) < 1 + two or not all(paths):
            break
        out.append((kind, None if kind == "added" else paths[0], None if kind == "deleted" else paths[-1]))
        at += 2 + two
    return out


def changes(diffs: DataFrame, *, id_col: str = "change_id", status_col: str = "status") -> DataFrame:
    """change_id, kind, old_path, new_path of each diff's name-status list (bytes or text, fields ended by NUL)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *c) for i, raw in zip(frame["change_id"], frame["status"]) for c in name_status(bytes(raw or b""))]
            yield pd.DataFrame(rows, columns=["change_id", "kind", "old_path", "new_path"])

    ship(diffs.sparkSession)
    rows = diffs.select(F.col(id_col).alias("change_id"), F.col(status_col).cast("binary").alias("status"))
    return rows.mapInPandas(run, CHANGES.format(id=dict(rows.dtypes)["change_id"]))


def _unquoted(name: str) -> str:
    if name.startswith('"') and name.endswith('"'):
        try:
            return ast.literal_eval("b" + name).decode("utf-8", "backslashreplace")
        except (SyntaxError, ValueError):
            return name
    return name


def patch_evidence(patch: str) -> list[tuple[str, str, str | None, int | None, int | None]]:
    """(path, what, symbol, first, last line): 'range' for each run of changed lines (of the new file; a removal stands where it was), 'symbol' for each declared name, and
    'read' or 'unread' for each file, read being one whose every changed line declares a symbol."""
    out: list[tuple] = []
    path, at, left, state, old = None, 0, (0, 0), {}, None
    for line in patch.split("\n"):
        if left[0] <= 0 and left[1] <= 0:
            if line.startswith("diff --git "):
                path = old = None
            elif line.startswith("--- "):
                old = _unquoted(line[4:].split("\t")[0].strip())
                path = old[2:] if old.startswith("a/") else None
            elif line.startswith("+++ "):
                new = _unquoted(line[4:].split("\t")[0].strip())
                path = new[2:] if new.startswith("b/") else path if new == "/dev/null" else None
        hunk = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)", line) if path else None
        pattern = DECLARES.get("." + path.rpartition(".")[2].lower()) if path else None
        sign = line[:1]
        if hunk and left[0] <= 0 and left[1] <= 0:
            left, at = (int(hunk[2] or 1), int(hunk[4] or 1)), int(hunk[3])
            state.setdefault(path, [pattern is not None, False])
            text = hunk[5]
        elif path and (left[0] > 0 or left[1] > 0) and sign in ("+", "-", " ", ""):
            text = line[1:] if sign in ("+", "-") and sign else ""
            if sign in ("+", "-"):
                last = out[-1] if out else None
                if last and last[:2] == (path, "range") and last[4] >= at - 1 and last[4] <= at:
                    out[-1] = (*last[:4], max(last[4], at))
                else:
                    out.append((path, "range", None, at, at))
            left = (left[0] - (sign != "+"), left[1] - (sign != "-"))
            at += sign != "-"
            if sign not in ("+", "-"):
                continue
        else:
            continue
        found = re.match(pattern, text) if pattern and text else None
        name = next(filter(None, found.groups()), None) if found else None
        if name:
            state[path][1] = True
            k = len(out) - 1 if out and out[-1][1] == "range" else len(out)
            out.insert(k, (path, "symbol", name, None, None))
        elif sign in ("+", "-") and not hunk:
            state[path][0] = False
    rows = [*dict.fromkeys(r for r in out if r[1] == "symbol"), *(r for r in out if r[1] == "range")]
    return rows + [(p, "read" if whole and named else "unread", None, None, None) for p, (whole, named) in state.items()]


def evidence(diffs: DataFrame, *, id_col: str = "change_id", patch_col: str = "patch") -> DataFrame:
    """change_id, path, what, symbol, line_start, line_end of each diff's patch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["change_id", "path", "what", "symbol", "line_start", "line_end"]
        for frame in frames:
            rows = [(i, *r) for i, patch in zip(frame["change_id"], frame["patch"]) for r in patch_evidence(patch or "")]
            yield pd.DataFrame(rows, columns=columns).astype({"line_start": "Int32", "line_end": "Int32"})

    ship(diffs.sparkSession)
    rows = diffs.select(F.col(id_col).alias("change_id"), F.col(patch_col).alias("patch"))
    return rows.mapInPandas(run, EVIDENCE.format(id=dict(rows.dtypes)["change_id"]))


def symbols_in_ranges(found: DataFrame, facts: DataFrame) -> DataFrame:
    """change_id, path, symbol: the known symbols (facts of the new files) whose lines a changed range touches. They meet by file and block of lines."""
    blocks = lambda a, b: F.sequence(F.floor(F.col(a) / LINE_BLOCK), F.floor(F.col(b) / LINE_BLOCK))
    ranges = found.where("what = 'range'").select("change_id", "path", F.col("line_start").alias("a"), F.col("line_end").alias("b"), F.explode(blocks("line_start", "line_end")).alias("block"))
    spans = facts.where(F.col("kind").isin(*DEFINES) & F.col("line_start").isNotNull()).select(F.col("path").alias("p"), F.col("name").alias("symbol"), F.col("line_start").alias("c"), F.col("line_end").alias("d"))
    spans = spans.select("*", F.explode(blocks("c", "d")).alias("k"))
    met = ranges.join(spans, (F.col("path") == F.col("p")) & (F.col("block") == F.col("k")) & (F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b")))
    return met.select("change_id", "path", "symbol").distinct()


def module_of(path: Column) -> Column:
    """The module that a path belongs to: the folder below a folder of modules, or null."""
    parts = F.split(path, "/")
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    return F.when((F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(*MODULE_ROOTS), head(2)).when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "lib") & F.get(parts, F.lit(1)).isin(*LIB_ROOTS), head(3))


def is_test(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    ending = F.lit(False)
    for e in TEST_ENDINGS:
        ending = ending | name.endswith(e)
    return F.exists(F.split(F.lower(path), "/"), lambda p: p.isin(*TEST_FOLDERS)) | name.startswith("test_") | ending


def docs_impact(changed: DataFrame, found: DataFrame, docs: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changed (of `changes`), found (of `evidence`, and further rows of what = 'symbol'), docs (path, module, authority), sections (of `section_metadata`; a document without
    any counts as unread) -> findings (change_id, doc_path, heading_path, action, reason, score, evidence) and what is missing (change_id, module, reason).

    must_update: a section names a changed path or symbol. updated, deleted, renamed: the document changed itself, and needs no other finding. review: code of its module or
    project changed, or a file or section could not be read whole. unlikely: code of the project changed and its symbols are known, but no section names one.
    """
    own = docs.select(F.col("path").alias("doc_path"), F.col("module"), F.coalesce("authority", F.lit(False)).alias("authority"))
    paths = changed.select("change_id", "kind", F.col("old_path").alias("o"), F.col("new_path").alias("n"), F.explode(F.array_distinct(F.array_compact(F.array("old_path", "new_path")))).alias("path"))
    paths = paths.where("not (kind = 'copied' and path = o and o <> n)").select("change_id", "kind", "path", "o", "n").distinct()
    paths = stage(paths.join(own.select(F.col("doc_path").alias("is_doc")), F.col("path") == F.col("is_doc"), "left"), "impact_paths")
    both = F.count("is_doc").over(Window.partitionBy("change_id", "kind", "o", "n")) == 2
    renamed = F.col("kind") == "renamed"
    kind = F.when(F.col("kind") == "deleted", "deleted").when(renamed & F.col("both") & (F.col("path") == F.col("n")), "renamed").when(renamed & F.col("both"), None).when(renamed & (F.col("path") == F.col("o")), "deleted").otherwise("updated")
    itself = paths.withColumn("both", both).where("is_doc is not null").where(kind.isNotNull()).groupBy("change_id", F.col("path").alias("doc_path")).agg(F.min(kind).alias("action"))
    itself = stage(itself, "impact_itself")
    unread = found.where("what = 'unread'").select(F.col("change_id").alias("u_id"), F.col("path").alias("u_path")).distinct()
    code = paths.where(F.col("is_doc").isNull() & ~is_test(F.col("path"))).select("change_id", "path", module_of(F.col("path")).alias("of"), F.substring_index("path", "/", -1).isin(*DEPENDENCY_FILES).alias("dependency")).distinct()
    code = stage(code.join(unread, (F.col("change_id") == F.col("u_id")) & (F.col("path") == F.col("u_path")), "left").select("change_id", "path", "of", "dependency", F.col("u_path").isNotNull().alias("unread")), "impact_code")
    in_module = code.where("of is not null").join(own.where("module is not null"), F.col("of") == F.col("module"), "left")
    in_module = in_module.select("change_id", "path", "of", "doc_path", F.when(F.col("unread"), "diff_symbol_parser_fallback").when(F.col("dependency"), "module_dependency_metadata_changed").otherwise("module_code_changed").alias("reason"))
    rest = code.where("of is null")
    whole = own.where("authority").select("doc_path")
    named = F.when(F.col("dependency"), "dependency_metadata_changed").when(F.col("unread"), "diff_symbol_parser_fallback").otherwise("project_code_changed")
    rest = rest.select("change_id", "path", named.alias("reason"))
    any_authority = not whole.isEmpty()
    if not any_authority:
        whole = own.orderBy("doc_path").limit(FALLBACK_DOCS).select("doc_path")
    rest_of = rest.where(F.lit(any_authority) | (F.col("reason") == "diff_symbol_parser_fallback"))
    missing = in_module.where("doc_path is null").select("change_id", F.col("of").alias("module"), F.lit("module_code_changed_without_module_docs").alias("reason")).distinct()
    if not any_authority:
        none = F.when(F.col("reason") == "dependency_metadata_changed", "dependency_metadata_changed_without_root_readme").when((F.col("reason") == "diff_symbol_parser_fallback") & F.lit(own.isEmpty()), "unmapped_parser_fallback_without_project_docs")
        missing = missing.union(rest.select("change_id", F.lit("."), none.alias("reason")).where("reason is not null").distinct())

    mentions = sections.join(own, F.col("path") == F.col("doc_path")).select("doc_path", "authority", "heading_path", "paths", "symbols")
    by_path = paths.select("change_id", F.col("path").alias("value")).distinct()
    names = found.where("what = 'symbol'").where(~is_test(F.col("path"))).select("change_id", F.col("symbol").alias("value")).distinct()
    hints = None
    for column, values, reason in (("paths", by_path, "section_reference_changed_path"), ("symbols", names, "section_reference_changed_symbol")):
        met = mentions.select("doc_path", "authority", "heading_path", F.explode(column).alias("m")).join(values, F.col("m") == F.col("value"))
        met = met.groupBy("change_id", "doc_path", "authority", "heading_path").agg(F.array_sort(F.collect_set("value")).alias("evidence")).withColumn("reason", F.lit(reason))
        hints = met if hints is None else hints.union(met)
    hints = stage(hints.select("change_id", "doc_path", "heading_path", F.lit("must_update").alias("action"), "reason", (F.when(F.col("reason") == "section_reference_changed_symbol", SCORES["section_reference_changed_symbol"]).otherwise(SCORES["section_reference_changed_path"]) + F.when(F.col("authority"), AUTHORITY).otherwise(0)).alias("score"), "evidence"), "impact_hints")

    order = {"diff_symbol_parser_fallback": 0, "section_metadata_truncated": 1, "module_dependency_metadata_changed": 2, "module_code_changed": 3, "dependency_metadata_changed": 4, "project_code_changed": 5}
    ranked = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    best = [F.min(F.struct(F.element_at(ranked, F.col("reason")), "reason")).alias("r"), F.array_sort(F.collect_set("path")).alias("evidence")]
    pair, few = ["change_id", "doc_path"], lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    touched = paths.select("change_id").distinct()
    by_cut = own.join(sections.where("truncated").select(F.col("path").alias("doc_path")).distinct(), "doc_path").select("doc_path")
    truncated = touched.crossJoin(by_cut).select("change_id", F.lit(None).cast("string").alias("path"), "doc_path", F.lit("section_metadata_truncated").alias("reason"))
    by_code = in_module.where("doc_path is not null").select("change_id", "path", "doc_path", "reason").union(truncated)
    # By rule each change of a project, here one, meets all of its authority documents. What a change says of them it says of all alike, so it is made once a change; only
    # pairs of which something else is known too (they changed, are named, or are met by another rule) are made and merged one by one.
    whole = stage(whole.distinct(), "impact_whole")
    apart = itself.select(*pair).union(hints.select(*pair)).union(by_code.select(*pair)).join(few(whole), "doc_path", "left_semi").select(*pair).distinct()
    apart = stage(apart, "impact_apart")
    by_code = by_code.union(apart.join(rest_of, "change_id").select("change_id", "path", "doc_path", "reason"))
    by_code = by_code.groupBy(*pair).agg(*best).select(*pair, "r.reason", "evidence")
    by_code = by_code.join(itself.select(*pair), pair, "left_anti").join(hints.select(*pair, F.lit(True).alias("hinted")).distinct(), pair, "left")
    low = F.col("reason").isin("diff_symbol_parser_fallback", "section_metadata_truncated")
    none = F.array().cast("array<string>")
    score = F.when(F.col("reason").contains("module"), SCORES["module"]).when(low, SCORES["fallback"]).otherwise(SCORES["project"]).alias("score")
    review = by_code.where(F.col("hinted").isNull() | low).select(*pair, none.alias("heading_path"), F.lit("review").alias("action"), "reason", score, "evidence")
    known = names.groupBy("change_id").agg(F.array_sort(F.collect_set("value")).alias("known"))
    by_change = rest_of.groupBy("change_id").agg(*best).select("change_id", "r.reason", "evidence").join(apart.groupBy("change_id").agg(F.collect_set("doc_path").alias("apart")), "change_id", "left")
    by_change = stage(by_change.join(known, "change_id", "left"), "impact_by_change")
    silent = (F.col("reason") == "project_code_changed") & F.col("known").isNotNull()
    alike = F.col("apart").isNull() | ~F.array_contains("apart", F.col("doc_path"))
    review = review.union(by_change.where(~silent).crossJoin(few(whole)).where(alike).select(*pair, none, F.lit("review"), "reason", score, "evidence"))
    every = sections.select(F.col("path").alias("doc_path"), "heading_path").join(few(whole), "doc_path", "left_semi")
    every = stage(whole.join(every, "doc_path", "left").select("doc_path", F.coalesce("heading_path", none).alias("heading_path")), "impact_whole_sections")
    unlikely = by_change.where(silent).crossJoin(few(every)).where(alike)
    unlikely = unlikely.select(*pair, "heading_path", F.lit("unlikely"), F.lit("no_explicit_reference_match"), F.lit(SCORES["unlikely"]), "known")
    changed_docs = itself.select("change_id", "doc_path", none.alias("heading_path"), "action", F.concat(F.lit("documentation_"), F.when(F.col("action") == "updated", "changed").otherwise(F.col("action"))).alias("reason"), F.lit(0).alias("score"), F.array("doc_path"))
    return hints.union(review).union(unlikely).union(changed_docs), missing
