"""Technical terms: what a text names as flags, variables, keys, symbols and commands, and where a list of terms stands in texts.

A term is known by its words, whatever separates them: `retry_count`, `retry-count` and `retry count` are one identity of a kind. All terms' words are
one automaton (Aho-Corasick) that reads each text once, with runs of separators as one sign; so time grows with the text and not with the number of terms. A surface
counts if nothing of a word touches it and it has the shape of its kind, so that prose does not stand for a symbol. The automaton goes to the tasks if there are
at most `PART_TERMS` terms. More of them stay where they are: since nothing may touch a surface, it is a run of whole atoms (words, separators, other signs), so each
text is read once for its runs as long as some term, and runs meet terms by equality; before that a bitmap of the terms' hashes, of bounded size, drops nearly all
runs that are no term. Of spans that overlap the leftmost, longest stay.

Null texts have no terms; terms without words are left out; equal terms are one; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, stage

#: Patterns of terms in a question by kind, in order; hyphened prose; bounds of a term, and of a question's terms.
QUOTED = re.compile(r"[`\"']([^`\"'\n]{2,160})[`\"']")
KINDS = (
    ("cli_flag", re.compile(r"(?<![\w-])--[A-Za-z][A-Za-z0-9-]{1,118}(?![\w-])")), ("env_var", re.compile(r"(?<!\w)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?!\w)")),
    ("dotted", re.compile(r"(?<!\w)[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)+(?!\w)")), ("snake", re.compile(r"(?<!\w)[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+(?!\w)")),
    ("cli_command", re.compile(r"(?<![\w-])[a-z][a-z0-9]*(?:-[a-z0-9]+)+(?![\w-])")),
)
PROSE = ("same-", "three-", "two-", "one-", "project-local", "production-", "source-backed", "provider-free", "model-visible", "end-to-end")
FLAG_WORDS, SYMBOL_WORDS = re.compile(r"\b(?:flag|option|switch|clear-index|command)\b", re.I), re.compile(r"\b(?:function|method|symbol|api|class|module)\b", re.I)
MOST_CHARS, MOST_TERMS = 160, 12
#: Most terms of an automaton; what stands for a run of separators in it.
PART_TERMS, GAP = 200_000, "\x1f"
SEPARATORS = re.compile(r"[\s_-]+")
#: Atoms of a text in lower case: a run of letters and digits that touch, of separators, or one other sign.
ATOMS = re.compile("[a-z0-9\u0130\u0131\u017f]+|[\\s_-]+|.", re.S)
#: Bits of the bitmap for each term, and at most as a power of two (32 MB); characters that a task reads at once; what joins the hashes of atoms.
KEY_BITS, MOST_BITS, CHARS, TIMES = 16, 28, 1_000_000, np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits of a word, with the four letters beyond ASCII that fold to ASCII ones.
TOUCHES = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-\u0130\u0131\u017f\u212a")


def clean(value: str | None) -> str:
    return " ".join((value or "").strip().strip("`\"'").split())[:MOST_CHARS]


def words(value: str) -> list[str]:
    return [w.casefold() for w in SEPARATORS.split(clean(value).removeprefix("--")) if w]


def kind_of(value: str, context: str = "") -> str:
    """What a term is by its spelling; a snake-case word is a flag where the text around speaks of flags and not of code."""
    v = clean(value)
    shape = "cli_flag" if v.startswith("--") else next((k for k, p in KINDS[1:] if p.fullmatch(v)), "plain_term")
    if shape == "dotted":
        return "config_key" if v.casefold() == v and "." in v else "code_symbol"
    if shape == "snake":
        return "cli_flag" if v.casefold() == v and FLAG_WORDS.search(context) and not SYMBOL_WORDS.search(context) else "code_symbol"
    return shape


def canonical(value: str, kind: str) -> str:
    parts = words(value)
    if not parts:
        return clean(value).casefold()
    return ("_".join(parts).upper() if kind == "env_var" else "-".join(parts))[:MOST_CHARS]


def named(question: str | None) -> list[tuple[str, str, str, int, int]]:
    """(kind, canonical, raw, start, end) of the terms that a question names, each once, in order; of terms within another the other."""
    source, held = question or "", []
    found = [(*m.span(1), m[1], None) for m in QUOTED.finditer(source)]
    for kind, pattern in KINDS:
        found += [(*m.span(), m[0], None if kind in ("dotted", "snake") else kind) for m in pattern.finditer(source) if kind != "cli_command" or not m[0].startswith(PROSE)]
    for a, b, raw, kind in found:
        if not any(x <= a and b <= y for x, y, _, _ in held):
            held.append((a, b, raw, kind))
    out = {}
    for a, b, raw, kind in sorted(held, key=lambda x: x[:3]):
        kind = kind or kind_of(raw, source)
        out.setdefault((kind, canonical(raw, kind).casefold()), (kind, canonical(raw, kind), clean(raw), a, b))
    return list(out.values())[:MOST_TERMS]


def technical_terms(questions: DataFrame, *, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """question_id, kind, canonical, raw, start, end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *t) for i, q in zip(frame["question_id"], frame["question"]) for t in named(q)]
            yield pd.DataFrame(rows, columns=["question_id", "kind", "canonical", "raw", "start", "end"])

    ship(questions.sparkSession)
    rows = questions.select(F.col(id_col).alias("question_id"), F.col(text_col).alias("question"))
    return rows.mapInPandas(run, f"question_id {dict(rows.dtypes)['question_id']}, kind string, canonical string, raw string, start int, end int")


def folded(text: str) -> tuple[str, list[int]]:
    """A text in lower case with a sign for each run of separators, and where each of its characters stands in the text."""
    out, at, end = [], [], 0
    for m in SEPARATORS.finditer(text):
        out += text[end : m.start()]
        at += range(end, m.start())
        out.append(GAP)
        at.append(m.start())
        end = m.end()
    out += text[end:]
    at += [*range(end, len(text)), len(text)]
    return lowered("".join(out)), at


def lowered(text: str) -> str:
    """A text in lower case, sign by sign, so that places stay."""
    return text.lower() if text.isascii() else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def key_of(raw: str) -> str:
    return GAP.join(words(raw)).lower()


def atoms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of atoms of each text, codes of all atoms in order, and the different atoms."""
    found = [ATOMS.findall(lowered(t)) for t in texts]
    flat = np.empty(sum(map(len, found)), object)
    flat[:] = [a for f in found for a in f]
    return np.array([len(f) for f in found], np.int64), *pd.factorize(flat)


def signs(kinds: np.ndarray) -> np.ndarray:
    return np.array([GAP if SEPARATORS.match(a) else a for a in kinds], object)


def joined(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n atoms from the atoms' own."""
    most = max(0, len(hashed) - n + 1)
    out = hashed[:most].copy()
    for k in range(1, n):
        out = out * TIMES + hashed[k : k + most]
    return out


def keys_of(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of atoms of each key."""
    sizes, codes, kinds = atoms(keys)
    hashed, first, out = pd.util.hash_array(signs(kinds))[codes], np.cumsum(sizes) - sizes, np.zeros(len(keys), np.uint64)
    for n in set(sizes.tolist()) - {0}:
        out[sizes == n] = joined(hashed, n)[first[sizes == n]]
    return out, sizes


def runs(texts: list[str], sizes: list[int], maybe: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, bool, str]]:
    """(text, start, end, after two dashes, key) of each run of as many atoms as one of the sizes that nothing touches, but for two dashes before it, and whose hash may be a term's."""
    counts, codes, kinds = atoms(texts)
    names, of = signs(kinds), lambda test: np.array([test(a) for a in kinds], bool)[codes]
    hashed, gap, touching = pd.util.hash_array(names)[codes], (names == GAP)[codes], of(lambda a: a[-1] in TOUCHES)
    text = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(np.array([len(a) for a in kinds], np.int64)[codes])
    starts = np.concatenate([[0], ends[:-1]])
    base = np.cumsum([0, *map(len, texts)])[text]
    # What stands before an atom, and before that, in its text; what stands behind it.
    before = lambda x, n: np.concatenate([np.zeros(min(n, len(x)), bool), x[:-n] & (text[n:] == text[:-n])])
    behind = of(lambda a: a[0] in TOUCHES)
    behind = np.concatenate([behind[1:] & (text[1:] == text[:-1]), np.zeros(min(1, len(text)), bool)])
    two, more = before(of(lambda a: a == "--"), 1), before(of(lambda a: len(a) > 2 and a[-2:] == "--" and a[-3] not in TOUCHES), 1)
    dashed = more | two & ~before(touching, 2)
    opens, closes = ~gap & (dashed | ~before(touching, 1)), ~gap & ~behind
    for n in sizes:
        most = max(0, len(codes) - n + 1)
        at = np.flatnonzero(opens[:most] & closes[n - 1 :] & (text[:most] == text[n - 1 :]))
        at = at[maybe(joined(hashed, n)[at])]
        for i, t, start, end, dash in zip(at.tolist(), text[at].tolist(), (starts - base)[at].tolist(), (ends[at + n - 1] - base[at]).tolist(), dashed[at].tolist()):
            yield t, start, end, dash, "".join(names[codes[i : i + n]])


def has_shape(kind: str, raw: str, surface: str) -> bool:
    if kind == "cli_flag":
        return surface.startswith("--") or "_" in surface or "-" in surface
    if kind == "cli_command":
        return "-" in surface or "_" in surface
    if kind == "env_var":
        return "_" in surface and surface.upper() == surface
    return kind == "plain_term" or all(mark in surface for mark in ("_", ".", "::") if mark in raw)


class Terms:
    """An automaton over terms (kind, canonical, raw)."""

    def __init__(self, terms: list[tuple[str, str, str]]):
        import ahocorasick

        self.automaton, by_words = ahocorasick.Automaton(), {}
        for kind, name, raw in sorted(set(terms)):
            if key := key_of(raw):
                by_words.setdefault(key, []).append((kind, name, raw))
        for key, own in by_words.items():
            self.automaton.add_word(key, (len(key), own))
        self.empty = not by_words
        self.automaton.make_automaton()

    def spans(self, text: str | None, shaped: bool = True) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, canonical) of every surface of every term."""
        if not text or self.empty:
            return []
        low, at = folded(text)
        out = set()
        for last, (size, own) in self.automaton.iter(low):
            start, end = at[last - size + 1], at[last] + 1
            if end < len(text) and text[end] in TOUCHES:
                continue
            for kind, name, raw in own:
                first = start - 2 if (kind == "cli_flag" or raw.startswith("--")) and text[max(0, start - 2) : start] == "--" else start
                if (first == 0 or text[first - 1] not in TOUCHES) and (not shaped or has_shape(kind, raw, text[first:end])):
                    out.add((first, end, kind, name))
        return sorted(out)


def _shaped(x: Column) -> Column:
    """`has_shape` of a term x for a run's surface."""
    has = lambda mark: F.col("surface").contains(mark)
    marks = x["kind"].eqNullSafe("plain_term") | (has("_") | ~x["raw"].contains("_")) & (has(".") | ~x["raw"].contains(".")) & (has("::") | ~x["raw"].contains("::"))
    cut = F.col("surface").startswith("--") | has("_") | has("-")
    return F.when(x["kind"] == "cli_flag", cut).when(x["kind"] == "cli_command", has("-") | has("_")).when(x["kind"] == "env_var", has("_") & F.col("upper")).otherwise(marks)


def _spans_by_key(texts: DataFrame, known: DataFrame, shaped: bool) -> DataFrame:
    """Spans of `Terms` of staged terms of any number in texts (id, text): runs of atoms joined with the terms' keys."""
    spark = texts.sparkSession

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["key"] = [key_of(raw) for raw in frame["raw"]]
            hashed, frame["size"] = keys_of(list(frame["key"]))
            frame["hash"] = hashed.view(np.int64)
            yield frame

    terms = stage(known.select("kind", "canonical", "raw").mapInPandas(keyed, "kind string, canonical string, raw string, key string, size long, hash long").where("key <> ''"), "term_keys")
    count, sizes = terms.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    bits = 1 << min(MOST_BITS, max(15, (KEY_BITS * count).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned("hash", n).bitwiseAND(F.lit(bits - 1)) for n in (0, 32)]))
    maps = terms.select(places.alias("at")).groupBy(F.shiftright("at", 15).alias("n")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    bitmap = np.zeros(bits >> 3, np.uint8)
    for n, part in maps.toLocalIterator():
        bitmap[n << 12 : n + 1 << 12] = np.frombuffer(part, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def maybe(h: np.ndarray) -> np.ndarray:
        at = [(h >> np.uint64(n)) & np.uint64(bits - 1) for n in (0, 32)]
        return np.logical_and(*[(shared.value[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 for x in at])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, all_texts = list(frame["id"]), [t or "" for t in frame["text"]]
            block = np.cumsum([len(t) for t in all_texts]) // CHARS
            for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(block)) + 1):
                part = [all_texts[k] for k in own]
                got = [(ids[own[k]], a - 2 * dash, b, dash, part[k][a:b].upper() == part[k][a:b], part[k][a - 2 * dash : b], key) for k, a, b, dash, key in runs(part, sizes, maybe)]
                yield pd.DataFrame(got, columns=["id", "start", "end", "dashed", "upper", "surface", "key"])

    met = texts.mapInPandas(run, f"id {dict(texts.dtypes)['id']}, start int, end int, dashed boolean, upper boolean, surface string, key string")
    own = terms.groupBy("key").agg(F.collect_list(F.struct("kind", "canonical", "raw")).alias("own"))
    met = met.join(own.hint("merge"), "key")  # both sides grow; their sizes as Spark guesses them would have one broadcast
    flag = lambda x: (x["kind"] == "cli_flag") | x["raw"].startswith("--")
    own = F.filter("own", lambda x: (~F.col("dashed") | flag(x)) & (_shaped(x) if shaped else F.lit(True)))
    own = F.array_distinct(F.transform(own, lambda x: F.struct(x["kind"].alias("kind"), x["canonical"].alias("canonical"))))
    return met.select("id", "start", "end", F.explode(own).alias("x")).select("id", "start", "end", "x.kind", "x.canonical")


def term_spans(texts: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", shaped: bool = True, longest: bool = True) -> DataFrame:
    """texts (id, text), terms (kind, canonical, raw) -> id, start, end, kind, canonical: each term's surfaces; if longest, of those that overlap the leftmost, longest, all identities of it."""
    spark = ship(texts.sparkSession)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {dict(rows.dtypes)['id']}, start int, end int, kind string, canonical string"
    known = stage(terms.select("kind", "canonical", "raw").where("raw is not null").distinct(), "terms")
    if known.count() <= PART_TERMS:
        automaton = spark.sparkContext.broadcast(Terms([tuple(r) for r in known.collect()]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                got = [(i, *s) for i, t in zip(frame["id"], frame["text"]) for s in automaton.value.spans(t, shaped)]
                yield pd.DataFrame(got, columns=["id", "start", "end", "kind", "canonical"])

        found = rows.mapInPandas(run, kind)
    else:
        found = _spans_by_key(rows, known, shaped)
    if not longest:
        return found
    spans = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("before"), "kind", "canonical"))).alias("spans"))
    first = F.struct(F.lit(0).alias("until"), F.lit(-1).alias("start"), F.filter("spans", lambda x: F.lit(False)).alias("out"))
    again = lambda s, x: (x["start"] == s["start"]) & (-x["before"] == s["until"])
    step = lambda s, x: F.when((x["start"] >= s["until"]) | again(s, x), F.struct((-x["before"]).alias("until"), x["start"].alias("start"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    kept = spans.select("id", F.explode(F.aggregate("spans", first, step, lambda s: s["out"])).alias("x"))
    return kept.select("id", "x.start", (-F.col("x.before")).alias("end"), "x.kind", "x.canonical")
