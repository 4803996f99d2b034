"""Section metadata, diffs, and the impact rules on small cases written out."""

import hashlib
import random
import re

import pytest

from verdigris.operators import impact as I


def sections(spark, **texts):
    rows = I.section_metadata(spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")).orderBy("path", "section").collect()
    return {k: [(r.heading_path, r.paths, r.symbols) for r in rows if r.path == k] for k in texts}


def test_sections_and_their_mentions(spark):
    text = "before `x.y`\n# One ##\nsee src/a.py, ./b/c and \\d\\e.txt\n````py\n# not a heading\n```\n````\n### Deep\n`run` `a/b` ` key ` `two words`\n## Two\nhttps://host.example/p/q.html x//h/i and docs/a.\n~~~\n# no\n"
    got = sections(spark, a=text, b="no heading: lib/x/y", c="", d=" \n", e="# Only", f="## Low\n# High")
    assert got["a"] == [([], [], ["x.y"]), (["One"], ["src/a.py", "b/c", "d/e.txt"], []), (["One", "Deep"], ["a/b"], ["run", "key"]), (["One", "Two"], ["docs/a"], [])]
    assert got["b"] == [([], ["lib/x/y"], [])]
    assert got["c"] == got["d"] == []
    assert got["e"] == [(["Only"], [], [])]
    assert got["f"] == [(["Low"], [], []), (["High"], [], [])]
    row = I.section_metadata(spark.createDataFrame([("a", "# T\r\nline\r\n")], "path string, text string")).first()
    assert row.content_hash == "sha256:" + hashlib.sha256(b"# T\nline").hexdigest()


def test_what_is_too_much_is_marked(spark):
    many = "# T\n" + " ".join(f"`s{k}`" for k in range(70))
    rows = {r.path: r for r in I.section_metadata(spark.createDataFrame([("a", many), ("b", "# T\n`s`"), ("c", "# " + "h" * 600), ("d", "`" + "s" * 600 + "`")], "path string, text string")).collect()}
    assert len(rows["a"].symbols) == 64
    assert [rows[k].truncated for k in "abcd"] == [True, False, True, True]
    assert rows["d"].symbols == [] and len(rows["c"].heading_path[0]) == 512


@pytest.mark.parametrize(("raw", "want"), [
    (b"M\0a b.py\0A\0new\0D\0gone\0R090\0x\0y\0C100\0x\0z\0T\0t\0", [("modified", "a b.py", "a b.py"), ("added", None, "new"), ("deleted", "gone", None), ("renamed", "x", "y"), ("copied", "x", "z"), ("type_changed", "t", "t")]),
    (b"M\0a\0R100\0only", [("modified", "a", "a")]), (b"", []), (b"M\0\xff\0", [("modified", "\\xff", "\\xff")]), (b"M\0line\nbreak\0", [("modified", "line\nbreak", "line\nbreak")]),
])
def test_name_status(raw, want):
    assert I.name_status(raw) == want


PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -3,3 +3,4 @@ class Outer:
 keep
-def old():
+def new():
+async def other(): ...
 keep
@@ -20 +21,0 @@
--- a comment of SQL
diff --git a/gone.ts b/gone.ts
--- a/gone.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-export const x = 1;
-interface Y {}
diff --git "a/sp\\303\\251 c.js" "b/sp\\303\\251 c.js"
--- "a/sp\\303\\251 c.js"
+++ "b/sp\\303\\251 c.js"
@@ -0,0 +1 @@
+function f() {}
diff --git a/notes.txt b/notes.txt
--- a/notes.txt
+++ b/notes.txt
@@ -1 +1 @@
-def a
+def b
"""


def test_patches():
    rows = I.patch_evidence(PATCH)
    assert sorted((r[0], r[2]) for r in rows if r[1] == "symbol") == [("gone.ts", "Y"), ("gone.ts", "x"), ("spé c.js", "f"), ("src/a.py", "Outer"), ("src/a.py", "new"), ("src/a.py", "old"), ("src/a.py", "other")]
    assert [(r[0], r[3], r[4]) for r in rows if r[1] == "range"] == [("src/a.py", 4, 5), ("src/a.py", 21, 21), ("gone.ts", 0, 0), ("spé c.js", 1, 1), ("notes.txt", 1, 1)]
    assert {r[0]: r[1] for r in rows if r[1] in ("read", "unread")} == {"src/a.py": "unread", "gone.ts": "read", "spé c.js": "read", "notes.txt": "unread"}
    assert I.patch_evidence("") == [] and I.patch_evidence("no diff at all\n@@ -1 +1 @@\n+x") == []


def test_symbols_meet_ranges(spark):
    found = spark.createDataFrame([(1, "a.py", "range", None, 5, 5), (1, "a.py", "range", None, 60, 300), (2, "b.py", "range", None, 10, 10)], "change_id long, path string, what string, symbol string, line_start int, line_end int")
    facts = spark.createDataFrame([("a.py", "function", "one", 1, 4), ("a.py", "class", "two", 5, 59), ("a.py", "method", "wide", 1, 1000), ("a.py", "function", "end", 300, 301), ("a.py", "reference", "no", 5, 5), ("b.py", "function", "b", 11, 12), ("b.py", "function", "odd", None, None)], "path string, kind string, name string, line_start int, line_end int")
    assert {tuple(r) for r in I.symbols_in_ranges(found, facts).collect()} == {(1, "a.py", "two"), (1, "a.py", "wide"), (1, "a.py", "end")}


def impact(spark, changed, found, docs, mentions):
    id_ = "change_id long, "
    rows, missing = I.docs_impact(
        spark.createDataFrame([(1, *c) for c in changed], id_ + "kind string, old_path string, new_path string"), spark.createDataFrame([(1, *f, None, None) for f in found], id_ + "path string, what string, symbol string, line_start int, line_end int"),
        spark.createDataFrame(docs, "path string, module string, authority boolean"), spark.createDataFrame(mentions, "path string, section int, heading_path array<string>, paths array<string>, symbols array<string>, truncated boolean"),
    )
    return sorted((r.doc_path, r.action, r.reason, r.score, "/".join(r.heading_path)) for r in rows.collect()), sorted((r.module, r.reason) for r in missing.collect())


DOCS = [("README.md", None, True), ("packages/a/README.md", "packages/a", False), ("docs/x.md", None, False)]
MENTIONS = [("README.md", 1, ["T"], [], ["other"], False), ("docs/x.md", 1, ["X"], ["src/m.py"], ["Run"], False), ("docs/x.md", 2, ["X", "Y"], [], [], False)]


def modified(*paths):
    return [("modified", p, p) for p in paths]


CASES = [
    (modified("packages/a/s.py"), [("packages/a/s.py", "read", None)], [("packages/a/README.md", "review", "module_code_changed", 65, "")], []),
    (modified("packages/a/package.json"), [], [("packages/a/README.md", "review", "module_dependency_metadata_changed", 65, "")], []),
    (modified("packages/a/s.py", "packages/a/package.json"), [("packages/a/s.py", "unread", None)], [("packages/a/README.md", "review", "diff_symbol_parser_fallback", 35, "")], []),
    (modified("packages/b/s.py"), [], [], [("packages/b", "module_code_changed_without_module_docs")]),
    (modified("packages/b/tests/s.py", "x/test_y.py", "x/y.spec.ts"), [], [], []),
    (modified("uv.lock"), [], [("README.md", "review", "dependency_metadata_changed", 45, "")], []),
    (modified("src/m.py"), [("src/m.py", "unread", None)], [("README.md", "review", "diff_symbol_parser_fallback", 35, ""), ("docs/x.md", "must_update", "section_reference_changed_path", 95, "X")], []),
    (modified("src/n.py"), [("src/n.py", "symbol", "Run"), ("src/n.py", "read", None)], [("README.md", "unlikely", "no_explicit_reference_match", 10, "T"), ("docs/x.md", "must_update", "section_reference_changed_symbol", 100, "X")], []),
    (modified("src/n.py"), [("src/n.py", "symbol", "other"), ("src/n.py", "read", None)], [("README.md", "must_update", "section_reference_changed_symbol", 105, "T")], []),
    (modified("src/n.py"), [("src/n.py", "read", None)], [("README.md", "review", "project_code_changed", 45, "")], []),
    (modified("src/n.py", "README.md"), [], [("README.md", "updated", "documentation_changed", 0, "")], []),
    ([("deleted", "docs/x.md", None)], [], [("docs/x.md", "deleted", "documentation_deleted", 0, "")], []),
    ([("renamed", "docs/x.md", "README.md")], [], [("README.md", "renamed", "documentation_renamed", 0, "")], []),
    ([("copied", "src/m.py", "docs/x.md")], [], [("docs/x.md", "updated", "documentation_changed", 0, "")], []),
]


def test_each_rule(spark):
    """All cases as changes of one run, told apart by their ids."""
    id_ = "change_id long, "
    changed = [(n, *c) for n, case in enumerate(CASES) for c in case[0]]
    found = [(n, *f, None, None) for n, case in enumerate(CASES) for f in case[1]]
    rows, missing = I.docs_impact(
        spark.createDataFrame(changed, id_ + "kind string, old_path string, new_path string"), spark.createDataFrame(found, id_ + "path string, what string, symbol string, line_start int, line_end int"),
        spark.createDataFrame(DOCS, "path string, module string, authority boolean"), spark.createDataFrame(MENTIONS, "path string, section int, heading_path array<string>, paths array<string>, symbols array<string>, truncated boolean"),
    )
    got = [(r.change_id, (r.doc_path, r.action, r.reason, r.score, "/".join(r.heading_path))) for r in rows.collect()]
    lost = [(r.change_id, (r.module, r.reason)) for r in missing.collect()]
    for n, (_, _, want, gone) in enumerate(CASES):
        assert sorted(v for k, v in got if k == n) == want, CASES[n]
        assert sorted(v for k, v in lost if k == n) == gone, CASES[n]


def test_projects_without_authority_or_documents(spark):
    docs = [(f"docs/{k}.md", None, False) for k in range(7)]
    rows, missing = impact(spark, modified("src/a.zig", "uv.lock", "src/b.py"), [("src/a.zig", "unread", None), ("src/b.py", "read", None)], docs, [])
    assert rows == [(f"docs/{k}.md", "review", "diff_symbol_parser_fallback", 35, "") for k in range(5)]
    assert missing == [(".", "dependency_metadata_changed_without_root_readme")]
    rows, missing = impact(spark, modified("src/a.zig"), [("src/a.zig", "unread", None)], [], [])
    assert (rows, missing) == ([], [(".", "unmapped_parser_fallback_without_project_docs")])
    cut = [("README.md", 1, ["T"], ["src/m.py"], [], True)]
    rows, _ = impact(spark, modified("src/m.py"), [("src/m.py", "read", None)], DOCS, cut)
    assert rows == [("README.md", "must_update", "section_reference_changed_path", 100, "T"), ("README.md", "review", "section_metadata_truncated", 35, "")]


def test_sections_stay_in_their_rows(spark):
    """A text's sections equal a loop over its lines, and no line is shuffled."""
    rng, pieces = random.Random(5), ["# A", "## B ", "### C ##", "## D", "```", "````", "~~~", "x", "", "   ```py", "#no", "####### seven", "  # in", "`s`"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    rows = I.section_metadata(spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "path string, text string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = []
    for n, text in enumerate(texts):
        lines, fence, stack, own = text.removesuffix("\n").split("\n"), "", [], [([], [])]
        for line in lines if text.strip() else []:
            mark = (re.match("[ \\t]{0,3}(`{3,}|~{3,})", line) or ["", ""])[1]
            head = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
            if mark and (not fence or fence[0] == mark[0] and len(mark) >= len(fence)):
                fence = "" if fence else mark
            elif head and not fence:
                stack = [*stack[: len(head[1]) - 1], head[2].strip()]
                own.append((stack, []))
            own[-1][1].append(line)
        want += [(str(n), k, path, "sha256:" + hashlib.sha256("\n".join(held).encode()).hexdigest()) for k, (path, held) in enumerate(own) if held]
    assert sorted((r.path, r.section, r.heading_path, r.content_hash) for r in rows.collect()) == sorted(want)


def test_no_table_of_changes_times_authorities(spark, monkeypatch):
    """What all authority documents have alike is made once a change; pairs of which more is known are as by the rules."""
    staged, stage = {}, I.stage

    def counted(df, name):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(I, "stage", counted)
    ids, docs = range(60), [(f"a{k}.md", "packages/a" if k == 5 else None, True) for k in range(30)]
    changed = [(n, "modified", p, p) for n in ids for p in [f"src/f{n}.py", *([f"a{n % 30}.md"] if n % 7 == 0 else []), *(["packages/a/x.py"] if n == 8 else [])]]
    found = [(n, f"src/f{n}.py", w, s, None, None) for n in ids for w, s in [("unread", None) if n % 3 == 0 else ("read", None), *([("symbol", f"s{n}")] if n % 3 == 1 else [])]]
    mentions = [(f"a{k}.md", j, [f"H{k}.{j}"], [], [f"s{k}"] if j == 1 else [], k % 10 == 0) for k in range(30) for j in (1, 2) if k != 29]
    rows, missing = I.docs_impact(
        spark.createDataFrame(changed, "change_id long, kind string, old_path string, new_path string"), spark.createDataFrame(found, "change_id long, path string, what string, symbol string, line_start int, line_end int"),
        spark.createDataFrame(docs, "path string, module string, authority boolean"), spark.createDataFrame(mentions, "path string, section int, heading_path array<string>, paths array<string>, symbols array<string>, truncated boolean"),
    )
    want = []
    for n in ids:
        for k in range(30):
            doc, code, hinted, module = f"a{k}.md", [f"src/f{n}.py"], n % 3 == 1 and n == k and k != 29, n == 8 and k == 5
            if hinted:
                want.append((n, doc, [f"H{k}.1"], "must_update", "section_reference_changed_symbol", 105, [f"s{n}"]))
            if n % 7 == 0 and k == n % 30:
                want.append((n, doc, [], "updated", "documentation_changed", 0, [doc]))
            elif n % 3 == 0:
                want.append((n, doc, [], "review", "diff_symbol_parser_fallback", 35, code))
            elif k % 10 == 0:
                want.append((n, doc, [], "review", "section_metadata_truncated", 35, code))
            elif module:
                want.append((n, doc, [], "review", "module_code_changed", 65, ["packages/a/x.py", *code]))
            elif n % 3 == 2:
                want.append((n, doc, [], "review", "project_code_changed", 45, code))
            elif not hinted:
                want += [(n, doc, h, "unlikely", "no_explicit_reference_match", 10, [f"s{n}"]) for h in ([[f"H{k}.1"], [f"H{k}.2"]] if k != 29 else [[]])]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want) and missing.isEmpty()
    assert max(staged.values()) < 60 * 30 / 4, staged  # pairs apart: 60 changes with 3 truncated documents, and a few
