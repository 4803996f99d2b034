"""Technical terms: what questions name, and spans of many terms against a loop of one pattern a term."""

import random
import re
import time

import pytest

from verdigris.operators import technical as T


@pytest.mark.parametrize(("question", "want"), [
    ("Use --dry-run or `retry count` and MAX_SIZE of app.core.run in clear-index, get_value; a same-day end-to-end one", [("cli_flag", "dry-run"), ("plain_term", "retry-count"), ("env_var", "MAX_SIZE"), ("config_key", "app.core.run"), ("cli_command", "clear-index"), ("cli_flag", "get-value")]),
    ("the function get_value and Get_Value", [("code_symbol", "get-value")]), ("A::b and A.B", [("code_symbol", "a::b"), ("code_symbol", "a.b")]), ("", []), (None, []), ("plain prose only", []), ("`--flag` --flag", [("cli_flag", "flag")]), ("'get_x' option", [("cli_flag", "get-x")]),
])
def test_what_a_question_names(question, want):
    got = T.named(question)
    assert [g[:2] for g in got] == want
    assert all(question[a:b].strip("`'\"") == raw or raw in question[a:b] for _, _, raw, a, b in got)


def plain(terms, text):
    out = set()
    for kind, name, raw in terms:
        parts = [w for w in re.split(r"[\s_-]+", T.clean(raw).removeprefix("--")) if w]
        if not parts:
            continue
        body = r"[\s_-]+".join(re.escape(p.lower()) for p in parts)
        dashes = "(?:--)?" if kind == "cli_flag" or raw.startswith("--") else ""
        for a in range(len(text or "")):
            for prefix in ([dashes, ""] if dashes else [""]):
                m = re.compile(rf"(?<![A-Za-z0-9_-]){prefix.rstrip('?')}{body}(?![A-Za-z0-9_-])", re.I).match(text, a)
                if m and T.has_shape(kind, raw, m[0]):
                    out.add((a, m.end(), kind, name))
                    break
    return sorted(out)


TERMS = [
    ("cli_flag", "dry-run", "--dry-run"), ("code_symbol", "get-value", "get_value"), ("code_symbol", "get", "get"), ("env_var", "MAX_SIZE", "MAX_SIZE"), ("config_key", "app.core", "app.core"), ("cli_command", "clear-index", "clear-index"),
    ("plain_term", "get-value-now", "get value now"), ("plain_term", "é", "É"), ("code_symbol", "a::b", "A::b"), ("plain_term", "run", "run"), ("plain_term", "", " - "), ("code_symbol", "max-size", "max_size"),
]
PIECES = ["get", "value", "now", "_", "-", "--", " ", "\n", "dry", "run", "MAX", "max", "SIZE", "size", "app.core", ".", "clear", "index", "É", "é", "a::b", "A::B", "x", "(", ",", "İ"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_spans_equal_a_loop():
    automaton = T.Terms(TERMS)
    for text in texts(4000, 1):
        assert automaton.spans(text) == plain(TERMS, text), text
    assert T.Terms([]).spans("get") == [] and automaton.spans(None) == []


@pytest.mark.parametrize("part", [3, 1000])
def test_leftmost_longest_spans(spark, monkeypatch, part):
    monkeypatch.setattr(T, "PART_TERMS", part)
    rows = list(enumerate([*texts(200, 2), None, ""]))
    got = {}
    for r in T.term_spans(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([*TERMS, TERMS[0], ("plain_term", "none", None)], "kind string, canonical string, raw string")).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.kind, r.canonical))
    for n, text in rows:
        want, until, at = [], 0, None
        for s in sorted(plain(TERMS, text), key=lambda s: (s[0], -s[1], s[2], s[3])):
            if s[0] >= until or (s[0], s[1]) == at:
                want.append(s)
                until, at = s[1], (s[0], s[1])
        assert sorted(got.get(n, [])) == sorted(want), text


def test_many_terms_read_each_text_once(spark, monkeypatch):
    """As many parts of terms once read every text as often, and gave a span twice whose raws were of two parts."""
    monkeypatch.setattr(T, "PART_TERMS", 10)
    monkeypatch.setattr(T, "CHARS", 100, raising=False)
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    listed = [*TERMS, *(("code_symbol", f"make-{k}", raw) for k in range(40) for raw in (f"make_{k}", f"MAKE_{k}", f"Make_{k}", f"mAKE_{k}"))]
    rows = [(n, f"{text} make_{n % 50} xmake_{n} --dry-run") for n, text in enumerate(texts(300, 3))]
    docs = spark.createDataFrame(rows, "id long, text string").mapInPandas(counted, "id long, text string")
    terms = spark.createDataFrame(listed, "kind string, canonical string, raw string")
    for shaped in (True, False):
        read.value, want = 0, T.Terms(listed)
        got = sorted(tuple(r) for r in T.term_spans(docs, terms, longest=False, shaped=shaped).collect())
        assert got == sorted((n, *s) for n, text in rows for s in want.spans(text, shaped))
        assert read.value == len(rows)


def test_runs_are_the_surfaces_that_nothing_touches():
    rows = ["make_1", "", "xmake_1", "--make_1", "make_1", "---make_1", "a--make_1", "\u00e9 --make_1", "\u00e9make_1\u00e9", "make_1_", "make__ 1.", "--", "make_1", "\u212amake_1 \u0130 make-1\u017f", "\u03a3make_1\u03c2", "make 1 make\x1f1", " --make-1", "\u0130", "make"]
    found = [(n, a - 2 * dashed, b) for n, a, b, dashed, key in T.runs(rows, [1, 3], lambda h: h == h) if key == "make\x1f1"]
    known = T.Terms([("cli_flag", "make-1", "--make-1")])
    assert sorted(found) == [(n, *s[:2]) for n, text in enumerate(rows) for s in known.spans(text, False)]
    hashed = T.keys_of(["make\x1f1", "", "a"])
    assert list(hashed[1]) == [3, 0, 1] and [r[0] for r in T.runs(rows, [1, 3], lambda h: h == hashed[0][0])] == [f[0] for f in found]
    assert list(T.runs([], [1], lambda h: h == h)) == list(T.runs(["a"], [], lambda h: h == h)) == list(T.runs(["a"], [5], lambda h: h == h)) == []


def test_time_follows_text_and_not_terms():
    text = " ".join(f"word{k % 977} make_{k}" for k in range(30_000))
    few, many = T.Terms([("code_symbol", "make-1", "make_1")]), T.Terms([("code_symbol", f"make-{k}", f"make_{k}") for k in range(100_000)])
    took = []
    for terms in (few, many):
        began = time.perf_counter()
        n = len(terms.spans(text))
        took.append(time.perf_counter() - began)
    assert n == 30_000
    assert took[1] < 20 * took[0] + 2
