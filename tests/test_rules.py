"""Rules on examples and against plain loops: questions, quality, context, filters, registry, redirects, candidates, snippets."""

import posixpath
import random
import re
from itertools import combinations
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from verdigris.functions import context as C
from verdigris.functions import quality as Q
from verdigris.functions import questions as A
from verdigris.operators import index as X
from verdigris.operators import registry as G
from verdigris.operators import rules as R
from verdigris.plans import rule_queries

SF = "/root/testdata/sf0.001"


def each(spark, values, expression, kind="string"):
    """The expression's value for each input, in order."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", expression(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def test_exact_terms(spark):
    got = each(spark, ["Use `foo bar` with --dry-run and ERR_42, MAX_SIZE, THE; a.b::c in src/x/y.py", "", "and/or is not a path, docs/guide is", "`a`", "FOO_BAR foo_bar Foo.Bar foo.bar " + " ".join(f"`t{k}`" for k in range(20))], A.exact_terms)
    pairs = [[(t.kind, t.value) for t in x] for x in got]
    assert pairs[0] == [("quoted", "foo bar"), ("flag", "--dry-run"), ("config_key", "ERR_42"), ("config_key", "MAX_SIZE"), ("symbol", "a.b::c"), ("path", "src/x/y.py")] or pairs[0] == [("quoted", "foo bar"), ("flag", "--dry-run"), ("error_code", "ERR_42"), ("config_key", "MAX_SIZE"), ("symbol", "a.b::c"), ("path", "src/x/y.py")]
    assert pairs[1] == [] and pairs[2] == [("path", "docs/guide")] and pairs[3] == [] and len(pairs[4]) == 12 and pairs[4][0] == ("quoted", "t0")


def test_locators_and_concepts(spark):
    got = each(spark, ["what is said in docs/a.md.", "compare a.md and b.md", "from ./x/readme.rst and in docs/a.md", "in main.py", "according to `guide.MD`, how"], A.document_locator)
    assert got == ["docs/a.md", None, None, None, "guide.MD"]
    rows = spark.createDataFrame([("How do I set `max retries` for the client?",), ("is it the",)], "v string").select(A.query_plan(F.col("v")).alias("p")).collect()
    assert {r.p.concept for r in rows} == {"set client", None}


def test_stopwords(spark):
    assert each(spark, ["How do I configure the client", "how do I", "Укажи id и evidence токена", "show id"], A.without_stopwords) == ["configure client", "how do I", "токена", "show id"]


INTENTS = {
    "What changed in the last release?": "release_history", "Which file was added": "release_history", "how to use what was added": "how_to", "How do I call get_project_docs": "docs_mcp", "install an action-pack": "packs_mcp", "is the mcp server up": "mcp_disambiguation",
    "how does indexing work": "ingestion_how_to", "the embedding table": "ingestion_internals", "project layout": "architecture", "why does not it start": "troubleshooting", "quickstart please": "how_to", "hello": "general", "": "general",
}


def test_intents(spark):
    assert [x.name for x in each(spark, list(INTENTS), A.intent)] == list(INTENTS.values())
    assert [x.code_symbols for x in each(spark, ["where is it defined in", "docs files"], A.intent)] == [True, False]
    assert each(spark, ["createIssue in user_list", ""], A.with_synonyms) == ["create issue in user list open add new ticket bug search find", ""]
    pairs = [("set up token", "how to set up it"), ("set up token", "a setuptoken b"), ("token", "tokens"), ("token", "other"), ("set token", "set the token")]
    got = spark.createDataFrame(pairs, "a string, b string").select(A.fuzzy_match(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, False, False]
    got = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>").select(A.overlap_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [0.5, 0.0]


CODE = "```py\nprint(1)\n```\n"


def test_quality(spark):
    texts = ["", None, "just words", CODE, "pip install x", "a = b", "plain text that goes on " * 5, "TODO: x\nfine", "| a | b |", "    indented code"]
    assert each(spark, texts, Q.looks_like_code) == [False, False, False, True, True, True, False, False, False, False]  # the indent of a single line is stripped
    assert each(spark, texts, lambda v: Q.is_trivial(v, F.lit(""), F.lit(""))) == [True, True, True, False, False, False, False, True, False, True]
    assert each(spark, texts, Q.noise_score) == pytest.approx([0, 0, 0, 0, 0, 0, 0, 0.85, 0, 0])
    assert each(spark, ["see app/main.py", "class Foo", "nothing here", "`Client`"], Q.has_code_symbol) == [True, True, False, True]
    got = each(spark, ["x\n```js\nlet a = 1\n```\ny\n~~~\nb\n~~~", "const alpha = 1;\n- no\ncall(alpha);\n\n\nreturn alpha;\nand more prose", "two = 1\nlines = 2", "prose"], Q.code_snippets)
    assert [[(s.language, s.code) for s in x] for x in got] == [[("js", "let a = 1"), ("", "b")], [("", "const alpha = 1;\n\ncall(alpha);\n\nreturn alpha;")], [], []]
    assert each(spark, ["Title [¶]\nCopy code\nText 🚀 \nTranslated by me\nEnd"], Q.clean_section) == ["Title\nText\nEnd"]
    got = spark.createDataFrame([("snake_case", "uses snake_case()"), ("SnakeCase", "a snake_case b"), ("Snake", "snakes"), ("a.b", "axb"), ("", "x")], "v string, t string").select(Q.value_visible(F.col("v"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]
    assert each(spark, ["You must not do it if deprecated", "It shall be", "plain"], Q.polarity) == ["forbidden", "required", "neutral"]
    assert each(spark, ["You must not do it if deprecated", "proposal"], Q.qualifiers) == [["conditional", "deprecated", "negated"], ["proposed"]]


def test_paths(spark):
    urls = ["HTTP://Ex.com:80/a/../b//c/./d?x#y", "https://ex.com:8080", "https://u@h.org/..", "ftp://a/b", "x", "https://h.org/a/"]

    def plain(u):
        p = urlsplit(u)
        if p.scheme not in ("http", "https") or not p.hostname:
            return ""
        host = p.hostname + (f":{p.port}" if p.port and (p.scheme, p.port) not in (("http", 80), ("https", 443)) else "")
        return f"{p.scheme}://{host}/" + posixpath.normpath(p.path or "/").lstrip("/")

    assert each(spark, urls, C.canonical_url) == [plain(u) for u in urls]
    assert each(spark, ["docs\\a\\..\\b.md", "/home/x/readme.md", "C:/t/z.md", "../up.md", "", "./a"], C.canonical_relative_path) == ["docs/b.md", "readme.md", "z.md", "up.md", "", "a"]
    globs = ["README.md", "docs/**/*.md", "**/*.rst", "a?c.[tm]xt"]
    assert each(spark, ["README.md", "x/README.md", "docs/a/b.md", "docs/a.md", "other/a.md", "q/z.rst", "abc.txt", "abc.pxt"], lambda v: C.glob_matches(v, globs)) == [True, False, True, True, False, True, True, False]
    assert each(spark, ["node_modules/x.md", "a/tests/b.md", "dist/x", "lib/dist/x", "vendor/q/x.md", "ok.md"], lambda v: C.excluded(v, ["node_modules", "test*", "./dist", "vendor/*"])) == [True, False, True, False, True, False]


TAXONOMY = {
    "docs/research/x.md": ("research", "research"), "a/dogfood/b.md": ("dogfood_artifact", "artifact"), "x/patch-review/y.md": ("patch_review_artifact", "artifact"), "CHANGELOG.md": ("changelog", "historical"),
    "packages/a/ARCHITECTURE.md": ("package_architecture", "secondary"), "docs/architecture/x.md": ("architecture", "primary"), "docs/index.md": ("index", "primary"), "adr/0001.md": ("adr", "primary"), "ops/runbooks/x.md": ("runbook", "primary"),
    "README.md": ("readme", "primary"), "apps/web/README.md": ("package_readme", "secondary"), "docs/guide.md": ("docs", "supporting"), "wiki/x.md": ("wiki", "supporting"), "notes.md": ("project_doc", "supporting"), "": ("project_doc", "supporting"),
}


def test_taxonomy(spark):
    assert [(x.source_type, x.authority) for x in each(spark, list(TAXONOMY), C.path_taxonomy)] == list(TAXONOMY.values())
    assert each(spark, ["docs/research/constraints.md"], C.path_taxonomy)[0].risk_flags == ["research_artifact", "generated_review_output"]


def test_prefix_leaves_out_what_does_not_fit(spark):
    fields = {"document_title": F.lit("T"), "canonical_location": F.lit("x" * 300), "library": F.col("v"), "authority": F.lit("")}
    got = each(spark, ["lib", None], lambda v: C.context_prefix(fields, most_bytes=60))
    assert [(x.text, list(x.fields), x.truncated) for x in got] == [("Document Title: T\nLibrary: lib", ["document_title", "library"], True), ("Document Title: T", ["document_title"], True)]
    assert each(spark, ["use Foo.bar and foo.BAR, MAX_X, call( Word"], C.symbol_aliases) == [["BAR", "MAX_X", "Foo.bar"]]  # call is a plain word, foo.BAR the same alias as Foo.bar


def test_filters(spark):
    rows = [{"library_id": "a", "authority": "official", "lifecycle_status": "active"}, {"library_id": "b", "project_doc_authority": "verified", "docs_snapshot_exact": "true"}, {"library_id": "c", "authority": "community", "lifecycle_status": "superseded"}, {}]
    kept = lambda f: [i for i, x in enumerate(each(spark, rows, lambda v: C.passes(v, f), "map<string,string>")) if x]
    assert kept({}) == [0, 1, 2, 3] and kept({"minimum_authority": "verified"}) == [0, 1] and kept({"library_id": "c"}) == [2]
    assert kept({"lifecycle_statuses": ["active"]}) == [0, 1, 3] and kept({"temporal_relevance": "historical"}) == [2] and kept({"exact_snapshot_required": True}) == [1]
    assert kept({"forbidden_sources": [" A "]}) == [1, 2, 3] and kept({"minimum_authority": "no such"}) == []
    assert C.compile_filters({"source_classes": ["b", "a"], "x": 1, "forbidden_sources": ["q"]}) == {"source_class": {"in": ["a", "b"]}, "x": 1}


def test_registry(spark):
    rows = [("p:a@1:api", "a", "p", "1", None, ["al"], []), ("a", "a", None, None, None, [], ["old-a"]), ("b@latest", "b", None, "latest", None, [], []), ("q:b@latest:api", "b", "q", "latest", None, [], []), ("x-y", "x-y", None, None, None, ["ex"], [])]
    records = spark.createDataFrame(rows, "library_id string, normalized_name string, ecosystem string, version string, source_type string, aliases array<string>, legacy_ids array<string>")
    asked = [(1, "b@latest", None, None, None), (2, "A", None, None, None), (3, "a", "p", "1", None), (4, "a", None, "2", None), (5, "b", None, None, None), (6, "XY", None, None, None), (7, "AL", None, None, None), (8, "old-a", None, None, None), (9, "zzz", None, None, None), (10, "ex", None, "9", None), (11, "A", "p", "1", None), (12, "X.Y", None, None, None)]
    asked = spark.createDataFrame(asked, "ask int, library string, ecosystem string, version string, source_type string")
    got = {r.ask: r.library_id for r in G.resolve(records, asked).collect()}
    assert got == {1: "b@latest", 2: "a", 3: "a", 4: "a", 5: "q:b@latest:api", 6: "x-y", 7: "p:a@1:api", 8: "a", 11: "p:a@1:api", 12: "x-y"}
    found = sorted((r.ask, r.library_id) for r in G.candidates(records, asked).collect())
    assert found == [(1, "b@latest"), (2, "a"), (2, "p:a@1:api"), (3, "p:a@1:api"), (5, "b@latest"), (5, "q:b@latest:api"), (6, "x-y"), (7, "p:a@1:api"), (8, "a"), (11, "p:a@1:api"), (12, "x-y")]


def test_redirects(spark):
    seen = [("http://h/v1/a/x", "http://h/v2/a/x", 1), ("http://h/v1/b", "http://h/v2/b", 2), ("http://h/v1/c/d", "http://h/v2/c/d", 3), ("http://h/v1/e", "http://h/v2/e", 4), ("http://h/p", "http://k/p", 5), ("http://h/q", "http://h/q", 6)]
    seen += [("http://h/old/z%d" % k, "http://h/new/deep/z%d" % k, 10 + k) for k in range(3)] + [("http://h/a/b", "http://h/a", 20)]
    learnt = G.learn_redirects(spark.createDataFrame(seen, "original string, final string, at int"))
    assert sorted((r.old, r.new, r.learnt_at) for r in learnt.collect()) == [("http://h/old", "http://h/new/deep", 12), ("http://h/v1", "http://h/v2", 3)]
    urls = spark.createDataFrame([("http://h/v1/q",), ("http://h/older/x",), ("http://g/v1",)], "url string")
    assert {r.url: r.predicted for r in G.predict_redirects(urls, learnt).collect()} == {"http://h/v1/q": "http://h/v2/q", "http://h/older/x": "http://h/new/deeper/x", "http://g/v1": None}


def test_candidates(spark):
    good = "f" * 64
    import hashlib

    h = hashlib.sha256(b"t").hexdigest()
    rows = [("p", "t", "s", "par", h, 0, 5, "official"), ("p", "t", "s", None, h, None, None, None), ("p", "t", "s", "par", good, None, None, None), ("p", "t", None, None, None, None, None, None), ("p", "t", None, None, None, 5, 5, None), ("p", "t", None, None, None, 5, None, None), ("", "t", None, None, None, None, None, None), ("p", None, None, None, None, None, None, None)]
    got = R.normalized_candidates(spark.createDataFrame(rows, "path string, text string, stable_id string, parent_id string, content_hash string, char_start long, char_end long, authority string")).collect()
    assert [r.invalid for r in got] == [None, "invalid_identity", "invalid_identity", None] + ["invalid_identity"] * 4
    assert got[0].authority == "canonical" and got[3].authority == "supporting" and got[3].stable_id.startswith("legacy:") and got[3].rank == 10_000
    assert each(spark, ["exact-version", "latest", "1.2", "source fallback", ""], R.version_rank) == [0, 2, 1, 2, 2]
    assert each(spark, ["use foo_bar_baz", "use foo_bar", "foo_bar_x and foo_bar", "other"], lambda v: R.identifier_conflict(v, F.array(F.lit("foo_bar")))) == [True, False, False, False]


def test_policy_conflicts(spark):
    rows = spark.createDataFrame([("The cache must be flushed.\nNever flushed",), ("The cache must not be flushed",), ("Logs are required",)], "text string")
    assert [(r.statement, r.required, r.forbidden) for r in R.conflicts(R.policy_lines(rows, "text")).collect()] == [("the cache flushed", 1, 1)]


def test_cheaper_cover(spark):
    rng = random.Random(3)
    rows = [(g, f"i{k}", k < 3, rng.sample("abcd", rng.randint(1, 3)), rng.choice(["canonical", "supporting"]), rng.randint(0, 2), rng.randint(1, 50)) for g in range(6) for k in range(7)]
    full = [(*r, sorted({x for q in rows if q[0] == r[0] and q[2] for x in q[3]})) for r in rows]
    schema = "group_id int, id string, selected boolean, covers array<string>, authority string, version_rank int, cost int, mandatory array<string>"
    got = {}
    for r in R.cheaper_cover(spark.createDataFrame(full, schema)).collect():
        got.setdefault(r.group_id, []).append(r.id)
    for g in range(6):
        own = {r[1]: r for r in full if r[0] == g}
        start, needed = [i for i in own if own[i][2]], set(next(iter(own.values()))[7])
        value = lambda ids: (sum(own[i][4] != "canonical" for i in ids), sum(own[i][5] for i in ids), sum(own[i][6] for i in ids), len(ids), sorted(ids))
        best = start
        for gone in [c for n in (1, 2) for c in combinations(start, n)]:
            for new in [c for n in (1, 2) for c in combinations([i for i in own if i not in start], n)]:
                tried = [i for i in start if i not in gone] + list(new)
                if needed <= {x for i in tried for x in own[i][3]} and value(tried) < value(best):
                    best = tried
        assert sorted(got[g]) == sorted(best)


def test_snippets(spark):
    rows = [(1, "a", 0, "code one()", "", 0.7), (1, "a", 1, "code two()", "", 0.69), (1, "b", 0, "code  one()", "", 0.6), (1, "c", 0, "copy", "", 0.9), (1, "d", 0, "code three()", "", 0.5), (1, "e", 0, "x](y)", "", 0.8), (2, "a", 0, "only()", "", 0.56)]
    got = R.present_snippets(spark.createDataFrame(rows, "query_id int, source string, block int, code string, language string, score double")).collect()
    assert sorted((r.query_id, r.position, r.source, r.confidence) for r in got) == [(1, 0, "a", "high"), (1, 1, "d", None), (2, 0, "a", "high")]


def test_queries_against_loops(spark):
    fits = {r.query_id: r.kept for r in rule_queries.stage_fit(spark, SF).collect()}
    import hashlib

    rows = rule_queries._with_source(rule_queries._ranked(spark, SF, 20), spark, SF).select("query_id", "rank", "text").collect()
    for q in fits:
        kept, used = [], 0
        for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"]):
            size = len(r.text.encode())
            if len(kept) < 8 and used + size <= 12_000:
                kept.append(hashlib.sha256(r.text.encode()).hexdigest())
                used += size
        assert fits[q] == kept
    ids = {(r.query_id, r.pos): r.section_id for r in rule_queries.hydrated_ranking(spark, SF).collect()}
    length = {r.doc_id: max(1, -(-len(r.text or "") // 4)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = set()
    for q in {k[0] for k in ids}:
        used = 0
        for pos in range(1, 25):
            if (q, pos) not in ids or (used and used + length[ids[q, pos]] > 2400):
                break
            used += length[ids[q, pos]]
            want.add((q, pos, ids[q, pos]))
    assert {(r.query_id, r.pos, r.doc_id) for r in rule_queries.fetched_prefix(spark, SF).collect()} == want
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rule_queries.section_quality(spark, SF).collect():
        t = texts[r.doc_id].strip()
        code = any(re.search(p.replace("(?md)", "(?m)"), t) for p in (Q.FENCED, Q.INDENTED, Q.COMMAND, Q.SIGNATURE, Q.CODE_LINE))
        assert (r.code, r.trivial, r.symbol) == (code, not t or not code and not re.search(Q.TABLE_ROW.replace("(?md)", "(?m)"), t) and len(t.split()) < 20, bool(re.search(Q.CODE_SYMBOL, texts[r.doc_id])))


def test_index(spark, tmp_path):
    """Postings, fall-back, weights and fetching against a loop over the documents."""
    import math

    docs = [(k, f"title {w}", f"{w} body {w} x{k}", "src") for k, w in enumerate(["alpha", "beta", "alpha beta", "gamma", "delta alpha"])] + [(9, None, None, "src")]
    frame = spark.createDataFrame(docs, "id int, title string, text string, source string")
    index = X.build(frame, str(tmp_path / "ix"), id_col="id", title=F.col("title"), source=F.col("source"), buckets=4)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha nowhere"), (3, "title")], "query_id int, text string")
    got = {(r.query_id, r.id): (round(r.cost, 9), r.full) for r in X.weighted_bm25(index, asked).collect()}
    weighted = {d[0]: {} for d in docs}
    for i, title, text, source in docs:
        for w, value in ((title, 6.0), (text, 2.0), (source, 0.5)):
            for t in re.findall(r"\w+", (w or "").lower()):
                weighted[i][t] = weighted[i].get(t, 0) + value
    sizes = {d[0]: sum(len(re.findall(r"\w+", x or "")) for x in d[1:]) for d in docs}
    mean = sum(sizes.values()) / len(sizes)
    for q, words in ((1, ["alpha", "beta"]), (2, ["alpha", "nowhere"]), (3, ["title"])):
        df = {t: sum(t in w for w in weighted.values()) for t in words}
        idf = {t: max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) for t in words}
        cost = {i: -sum(idf[t] * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for t in words if t in w) for i, w in weighted.items() if any(t in w for t in words)}
        whole = {i for i in cost if all(t in weighted[i] for t in words)}
        assert {i for k, i in got if k == q} == (whole or set(cost))
        for i in whole or cost:
            assert got[q, i] == (pytest.approx(cost[i], abs=1e-9), i in whole)
    assert {r.id for r in X.fetch(index, spark.createDataFrame([(3,), (9,), (77,)], "id int"), "id").collect()} == {3, 9}


def test_markdown_chunks():
    from verdigris.operators import markdown as M

    text = "intro words\n# A\n\nprose of a " + "word " * 60 + "\n## B\n- one\n- two\n  more\n- three\n\n# C\n| h | k |\n|---|---|\n" + "".join(f"| r{k} | {'x' * 20} |\n" for k in range(12)) + "\n```py\n# no heading\n" + "".join(f"line_{k} = {k}\n" for k in range(30)) + "```\nend\n"
    assert [(names, body.strip()[:5]) for names, body in M.sections(text)] == [([], "intro"), (["A"], "prose"), (["A", "B"], "- one"), (["C"], "| h |")]
    got = M.chunk_markdown(text, 200, 40)
    assert all(len(c) <= 200 for c in got)
    assert got[0].startswith("intro words") and any(c.startswith("[# A > ## B]\n- one\n- two\n  more") for c in got)
    tables = [c for c in got if "| h | k |\n|---|---|\n" in c]
    assert len(tables) > 1 and sum(c.count("| r") for c in tables) == 12
    code = [c for c in got if "```py" in c]
    assert len(code) > 1 and all(c.count("```") == 2 for c in code) and sum(c.count("line_") for c in code) == 30
    assert M.merged(["a" * 30, "b" * 30, "c" * 60], 100) == ["a" * 30 + "\n" + "b" * 30, "c" * 60]
    assert M.windows("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and M.windows("abc", 4, 1) == ["abc"] and M.chunk_markdown(" ") == []
    assert M.is_list("- a\ntext\n1. b\n") and not M.is_list("- a\ntext\nmore\n") and M.list_items("intro\n- a\n  - sub\n- b") == ["intro", "- a\n  - sub", "- b"]


def test_paragraphs_are_packed():
    from verdigris.operators.chunking import pack_paragraphs

    got = pack_paragraphs("aaaa bbbb\n\ncccc\n\ndddd eeee ffff", 16, 4)
    assert got == ["aaaa bbbb\n\ncccc", "cccc\n\ndddd eeee ffff"]
    assert pack_paragraphs("", 16, 4) == [] and pack_paragraphs("  \n\n ", 16, 4) == []


def test_sections_by_strategy(spark):
    from verdigris.operators.chunking import sections_by_strategy

    docs = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny", "heading"), (2, "p\n\nq", "paragraph"), (3, "# whole", None), (4, " ", None), (5, None, "heading")], "doc_id int, text string, strategy string")
    got = sorted((r.id, r.section_index, r.title, r.text.strip()) for r in sections_by_strategy(docs).collect())
    assert got == [(1, 0, "Document", "intro"), (1, 1, "A", "# A\nx"), (1, 2, "B", "## B\ny"), (2, 0, "Part 1", "p\n\nq"), (3, 0, "Document", "# whole")]


def test_registry_queries_against_loops(spark):
    """Every record is looked at for every question, step by step."""
    name = lambda x: re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9_]+", "-", (x or "").lower().strip()))
    key = lambda x: re.sub("[-_]+", "", name(x))
    records = rule_queries._registry(spark, SF).collect()
    asked = records
    want = {}
    for q in asked:
        lib = q.aliases[0] if q.k % 5 == 0 else q.legacy_ids[0] if q.k % 5 == 1 else q.name.replace(" ", "") if q.k % 5 == 2 else q.name
        system, version = q.ecosystem if q.k % 3 == 0 else None, q.version if q.k % 4 == 0 else None
        tail = f"@{version}" if version else ""
        canonical = f"{name(system)}:{name(lib)}{tail}:api" if name(system) else name(lib) + tail
        steps = [lambda r: r.library_id == lib, lambda r: r.library_id == canonical, lambda r: r.library_id == name(lib) + tail]
        if version:
            steps += [lambda r: r.normalized_name == name(lib) and r.version == version and (not system or r.ecosystem == system), lambda r: key(r.normalized_name) == key(lib) and r.version == version]
        else:
            steps += [lambda r: r.normalized_name == name(lib) and r.version is None and (not system or r.ecosystem == system), lambda r: r.normalized_name == name(lib) and r.version == "latest" and r.ecosystem, lambda r: r.normalized_name == name(lib) and r.version == "latest"]
            steps += [lambda r: r.version is None and key(r.normalized_name) == key(lib) or key(lib) in map(key, r.aliases) or lib in r.legacy_ids]
        for step in steps:
            met = [r.library_id for r in records if step(r)]
            if met:
                want[q.k] = min(met)
                break
    assert {r.ask: r.library_id for r in rule_queries.registry_resolution(spark, SF).collect()} == want
    got = {r.ask: (r.records, r.first) for r in rule_queries.registry_candidates(spark, SF).collect()}
    for n in {r.normalized_name for r in records}:
        met = [r.library_id for r in records if r.version == "latest" and (key(r.normalized_name) == key(n) or key(n) in map(key, r.aliases) or n in r.legacy_ids or r.library_id == n)]
        assert got.get(n) == ((len(met), min(met)) if met else None)


def test_page_queries_against_loops(spark):
    pages = sorted(spark.read.parquet(f"{SF}/pages.parquet").collect(), key=lambda r: r.page_id)
    seen, learnt = {}, {}
    for r in pages:
        u = urlsplit(r.url)
        base = f"{u.scheme}://{'.'.join(u.netloc.lower().split('.')[-2:])}"
        found = re.match(r"/(fr|de|es)/", u.path)
        if found:
            pattern = (f"{base}/{found[1]}", f"{base}/en")
            seen[pattern] = seen.get(pattern, 0) + 1
            if seen[pattern] == 3:
                learnt[pattern] = r.page_id
    assert {(r.old, r.new): r.learnt_at for r in rule_queries.redirect_patterns(spark, SF).collect()} == learnt
    order = sorted(learnt, key=learnt.get)
    for r in rule_queries.redirect_predictions(spark, SF).collect():
        assert r.predicted == next((new + r.url[len(old) :] for old, new in order if r.url.startswith(old)), None)
    labels = {"document_title": "Document Title", "canonical_location": "Location", "library": "Library", "source_class": "Source Class", "symbol_aliases": "Symbol Aliases"}
    text = {r.page_id: r.x for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", rule_queries.T.main_content(F.coalesce("html", F.lit(""))).alias("x")).collect()}
    got = {r.page_id: r for r in rule_queries.context_prefixes(spark, SF).collect()}
    for r in pages:
        aliases, keys, used = [], set(), 0
        for p in C.SYMBOLS:
            for m in re.finditer(p.replace("(?U)", ""), text[r.page_id]):
                a = m[0][:120]
                if len(aliases) < 16 and not re.fullmatch("[A-Za-z][a-z]{2,}", a) and a.lower() not in keys and used + len(a.encode()) <= 512:
                    aliases.append(a)
                    keys.add(a.lower())
                    used += len(a.encode())
        u = urlsplit(r.url)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html or "")
        fields = {"document_title": title[1] if title else "", "canonical_location": f"{u.scheme}://{u.hostname}/" + posixpath.normpath(u.path or "/").lstrip("/"), "library": u.netloc.lower(), "source_class": "page", "symbol_aliases": ", ".join(aliases)}
        lines = []
        for n, v in fields.items():
            line = f"{labels[n]}: {' '.join(v.split())[:480]}"
            joined = "\n".join([*lines, line])
            if v.split() and len(joined.encode()) <= 1024 and max(1, -(-len(joined.encode()) // 4)) <= 192:
                lines.append(line)
        assert got[r.page_id].prefix == "\n".join(lines)


def test_clean_sections_against_a_loop(spark):
    import hashlib

    got = {r.doc_id: r.clean_hash for r in rule_queries.clean_sections(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = re.sub("[\U0001f300-\U0001faff\U00002700-\U000027bf]", "", re.sub(r"\s*\[¶\]", "", r.text or ""))
        kept = [x.rstrip() for x in t.splitlines() if x.strip().lower().strip(":") not in Q.UI_LINES and not x.strip().lower().startswith(("translated by ", "translation missing"))]
        assert got[r.doc_id] == hashlib.sha256("\n".join(kept).strip().encode()).hexdigest()


def test_prefixes_make_a_page_s_text_once(spark):
    plan = rule_queries.context_prefixes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("script|style|head") == 2  # in one pattern
