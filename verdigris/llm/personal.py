"""Personal data: regex, gazetteer and context labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Candidates are the spans of the base patterns, spans of looser shapes (numbers in groups, addresses written apart, card numbers with
another checksum, dotted and colon addresses) and runs of capitalised words. Each labeler votes for a candidate, against it, or not at all:

- regex: the base pattern holds / the shape is one of something else (dates, versions, prices, plain numbers);
- checksum: Luhn, octets, and lengths that are assigned / fail;
- gazetteer: the words beside the span name the kind, or the span holds a listed first name or mail host / a word of something else;
- context: an introducing mark or word just before the span / units, currencies and page words around it;

Votes are counted over all documents by pattern (kind and votes: `PATTERNS` rows at most). Expectation-maximisation estimates from these counts, for each kind,
how often each labeler votes for and against true and false candidates; priors keep its labels from changing places. The posteriors are the soft labels of the
final classifier: a logistic regression on the votes and on the span's shape, trained on counts of (features, posterior) over all documents,
a table of as many rows as there are feature combinations. A span is added if the classifier gives it `ADDED` or more and it overlaps no base span and no
added span before it.

Base spans stay, whatever the models say; they carry a probability too. Offsets are code points, ends exclusive. Every pattern takes time in proportion
to the text.

Defined cases: null and empty texts have no spans; without candidates both models keep their priors; repeated rows are scanned alike; texts are scanned
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table, unused

#: The base patterns' kinds in order, and their patterns (email's is applied from each @ by `emails`).
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the method adds to: the base kinds, and names.
EVERY = (*KINDS, "person")
#: Spans from this probability on are added.
ADDED = 0.9
#: Characters beside a span that context labelers read.
BESIDE = 48
LABELERS = ("regex", "checksum", "gazetteer", "context")
#: Distinct (kind, votes) at most.
PATTERNS = len(EVERY) * 3 ** len(LABELERS)

#: Looser shapes. An address written apart, a colon address, grouped numbers (split into cards and phones by their digits), names.
APART = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+)+", re.I)
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
GROUPED = re.compile(r"(?<![0-9A-Za-z+.,/_-])(?<![0-9] )(?:\([0-9]{2,4}\)[ -]?)?[0-9]++(?:[ ./-][0-9]++){0,7}+(?![0-9A-Za-z_]|[ ./-][0-9])")
NAME = re.compile(r"(?<![\w'-])[A-Z][a-z]{1,20}+(?: [A-Z]\.)?(?: [A-Z][a-z]{1,20}+){1,2}(?![\w'-])")

#: Gazetteers, as plain lists.
NAMED = {
    "email": ["email", "e-mail", "mail", "mailto", "correo", "courriel", "contact"],
    "ip": ["ip", "ipv4", "ipv6", "host", "server", "address", "adresse"],
    "card": ["card", "credit", "debit", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "iban", "account", "konto"],
    "phone": ["phone", "tel", "telephone", "mobile", "cell", "call", "fax", "whatsapp", "telefon", "handy", "portable", "telefono"],
    "person": ["name", "mr", "mrs", "ms", "dr", "herr", "frau", "monsieur", "madame", "senor", "senora", "signed", "author", "patient", "dear"],
}
OTHER = ["version", "page", "pages", "isbn", "figure", "fig", "table", "section", "chapter", "year", "years", "total", "price", "usd", "eur", "percent", "order", "invoice", "number", "no", "id", "license", "public", "foundation", "copyright", "university", "street", "avenue"]
FIRST_NAMES = ["james", "john", "robert", "michael", "william", "david", "mary", "patricia", "jennifer", "linda", "elizabeth", "susan", "sarah", "karen", "thomas", "charles", "daniel", "matthew", "anna", "peter", "hans", "klaus", "heike", "ursula", "pierre", "jean", "marie", "claire", "luc", "jose", "juan", "carlos", "maria", "carmen", "lucia", "ana", "paul", "laura", "emma", "sofia"]
MAIL_HOSTS = ["gmail", "hotmail", "outlook", "yahoo", "proton", "icloud", "gmx", "web", "orange"]
#: Introducing and disproving marks beside a span.
BEFORE_FOR, BEFORE_AGAINST, AFTER_AGAINST = re.compile(r"(?:[:#=]|\b(?:at|is|to|from|by|with)) ?$", re.I), re.compile(r"[$€£%] ?$"), re.compile(r"^ ?(?:[%$€£]|(?:kg|km|cm|mm|mb|gb|ms|px|pages|years|times|copies)\b)", re.I)
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2})")
_NAMED, _OTHER, _FIRST, _HOSTS = {k: frozenset(v) for k, v in NAMED.items()}, frozenset(OTHER), frozenset(FIRST_NAMES), frozenset(MAIL_HOSTS)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: the whole run of local characters before an @ that a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def octets(value: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in value.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order. A match that fails is dropped, nothing within it is tried again."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the looser shapes, whether they are base spans or not."""
    low = text.lower() if "at" in text or "AT" in text else ""
    out = [(m.start(), 0, m.end()) for m in APART.finditer(text)] if any(x in low for x in ("(at)", "[at]", "{at}")) else []
    out += [(m.start(), 1, m.end()) for m in COLONS.finditer(text)] if ":" in text else []
    for m in GROUPED.finditer(text):
        if m.end() - m.start() >= 7 and 7 <= (n := len(digits_of(m[0]))) <= 19:
            out.append((m.start(), 2 if n > 12 else 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in NAME.finditer(text)]
    return out


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and the looser ones that overlap none of them and none before: of several the earliest, longest."""
    base, more, last, k = base_spans(text), [], 0, 0
    reach, ends = 0, []
    for _, _, end in base:
        reach = max(reach, end)
        ends.append(reach)
    for start, kind, end in sorted(loose_spans(text), key=lambda s: (s[0], -s[2], s[1])):
        while k < len(base) and base[k][0] < end:
            k += 1
        # Base spans that begin before this one's end: does any reach into it? Later loose spans may end earlier, so step back.
        while k and base[k - 1][0] >= end:
            k -= 1
        if start >= last and not (k and ends[k - 1] > start):
            more.append((start, kind, end))
            last = end
    return base, more


def votes(text: str, span: tuple[int, int, int], base: bool) -> tuple[int, ...]:
    """For (1), against (-1) or not at all (0): of each labeler."""
    start, kind, end = span
    value, before, after = text[start:end], text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    digits, name = digits_of(value), EVERY[kind]
    number = name in ("card", "phone")
    left = [w.lower() for w in WORD.findall(before)][-4:]
    right = [w.lower() for w in WORD.findall(after)][:1]
    own = [w.lower() for w in WORD.findall(value)]
    regex = 1 if base else -1 if number and (DATE.fullmatch(value) or value == digits and len(digits) < 10) else 0
    checksum = 0
    if name == "card":
        checksum = 1 if len(digits) in (14, 15, 16) and luhn(digits) else -1 if not luhn(digits) else 0
    elif name == "phone":
        checksum = 1 if 10 <= len(digits) <= 13 and value != digits else -1 if value.count(".") > 1 or len(set(digits)) < 3 else 0
    elif name == "ip":
        checksum = -1 if value.startswith(("0.", "127.")) else 1
    elif name == "email":
        checksum = 1 if re.search(r"[A-Za-z]{2,}$", value) else -1
    elif name == "person":
        checksum = -1 if len(set(own)) < len(own) else 0
    gazetteer = 1 if _NAMED[name].intersection(left) or name == "person" and own and own[0] in _FIRST or name == "email" and _HOSTS.intersection(own) else -1 if _OTHER.intersection(left[-2:] + right + own) else 0
    context = -1 if BEFORE_AGAINST.search(before) or AFTER_AGAINST.search(after) else 1 if BEFORE_FOR.search(before) and (name != "person" or before.rstrip().endswith((":", "="))) else 0
    return regex, checksum, gazetteer, context


def shape(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """Bins of a span: digits, separators, length, whether a letter or digit touches it."""
    start, _, end = span
    value = text[start:end]
    digits = len(digits_of(value))
    marks = sum(not c.isalnum() for c in value)
    touched = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end : end + 1].isalnum())
    return min(digits // 4, 4), min(marks, 4), min((end - start) // 8, 4), int(touched)


SPAN = "struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,shape:array<int>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", ints), ("shape", ints)]))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, rows = batch.slice(at, 512), []
            for text in part.column(1).to_pylist():
                base, more = candidates(text)
                rows.append([{"start": s[0], "kind": s[1], "end": s[2], "base": b, "votes": votes(text, s, b), "shape": shape(text, s)} for b, spans in ((True, base), (False, more)) for s in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["id", "spans"])


def candidate_spans(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, spans: of every row its candidates with their votes and shapes, base ones first."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_spans), f"id {docs.schema[id_col].dataType.simpleString()}, spans array<{SPAN}>")


class Reliabilities:
    """For each kind the share of true candidates, and each labeler's shares of votes (against, none, for) on false and on true ones."""

    def __init__(self):
        self.prior = np.full(len(EVERY), 0.5)
        #: Before anything is counted a labeler is somewhat right; these pseudo-counts also keep true and false from changing places.
        self.belief = np.array([[3.0, 4.0, 1.0], [1.0, 4.0, 3.0]]) * 5
        self.share = np.broadcast_to((self.belief / self.belief.sum(axis=1, keepdims=True))[None, None], (len(EVERY), len(LABELERS), 2, 3)).copy()

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.column_stack([1 - self.prior[kind], self.prior[kind]]))
        for k in range(len(LABELERS)):
            log = log + np.log(self.share[kind, k, :, votes[:, k] + 1])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def fit(self, kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> Reliabilities:
        """Expectation-maximisation over counted vote patterns."""
        for _ in range(rounds if len(n) else 0):
            p = self.posterior(kind, votes)
            for e in range(len(EVERY)):
                own = kind == e
                mass = np.array([((1 - p[own]) * n[own]).sum(), (p[own] * n[own]).sum()])
                self.prior[e] = (mass[1] + 5) / (mass.sum() + 10)
                for k in range(len(LABELERS)):
                    counts = np.array([[(w[own] * n[own])[votes[own, k] == v].sum() for v in (-1, 0, 1)] for w in (1 - p, p)])
                    # Beliefs grow with the counts, slower: on any input they are a tenth of what is seen.
                    belief = self.belief * max(1.0, mass.sum() / 10 / self.belief.sum())
                    self.share[e, k] = (counts + belief) / (counts + belief).sum(axis=1, keepdims=True)
        return self


def columns(kind: np.ndarray, base: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The classifier's inputs: indicators of kinds, of votes by kind, and of shape bins by kind."""
    parts = [np.ones((len(kind), 1)), np.eye(len(EVERY))[kind]]
    for k in range(len(LABELERS)):
        parts.append(np.eye(len(EVERY) * 3)[kind * 3 + votes[:, k] + 1])
    for k, bins in enumerate((5, 5, 5, 2)):
        parts.append(np.eye(len(EVERY) * bins)[kind * bins + shape[:, k]])
    return np.concatenate(parts, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels with counts: Newton steps."""
    w = np.zeros(x.shape[1])
    n = n / max(n.sum() / 10_000, 1.0)  # the ridge weighs alike at every size
    for _ in range(rounds if len(n) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(spans: DataFrame) -> dict[tuple, float]:
    """Both models, fitted on counts over all candidates (id, spans: staged) -> the probability of each combination of features that occurs."""
    flat = spans.where(F.size("spans") > 0).select(F.explode("spans").alias("s"))
    counted = flat.groupBy("s.kind", "s.base", "s.votes", "s.shape").agg(F.count("*").alias("n")).collect()  # bounded by the numbers of votes and bins
    if not counted:
        return {}
    counted.sort(key=lambda r: (r.kind, r.base, r.votes, r.shape))
    kind, base, n = np.array([r.kind for r in counted]), np.array([r.base for r in counted]), np.array([float(r.n) for r in counted])
    cast, bins = np.array([r.votes for r in counted]), np.array([r.shape for r in counted])
    model = Reliabilities().fit(kind, cast, n)
    x = columns(kind, base, cast, bins)
    w = logistic(x, model.posterior(kind, cast), n)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(r.kind, r.base, tuple(r.votes), tuple(r.shape)): float(v) for r, v in zip(counted, p)}


def _decided(known: dict[tuple, float], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())]))
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                own = [s | {"p": known[s["kind"], s["base"], tuple(s["votes"]), tuple(s["shape"])]} for s in spans]
                rows.append(sorted(({k: s[k] for k in ("start", "kind", "end", "base", "p")} for s in own if s["base"] or s["p"] >= least), key=lambda s: (s["start"], s["kind"], s["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    return run


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", added: float = ADDED) -> DataFrame:
    """id, spans: array<struct<start, kind, end, base, p>> of every row, the base spans and those that the method adds, in order; p is the classifier's probability."""
    found = stage(candidate_spans(docs, id_col=id_col, text_col=text_col), "personal_candidates")
    known = train(found)
    return found.mapInArrow(lean(_decided(known, added)), f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<start:int,kind:int,end:int,base:boolean,p:double>>")


def masked(docs: DataFrame, spans: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """docs' rows with the spans' text replaced by <KIND>; spans (id, spans), ids unique in both."""
    key, own = unused(docs, "key", "own")
    names, text = F.array(*[F.lit(f"<{k.upper()}>") for k in EVERY]), F.col(text_col)
    cut = lambda a, n: F.substring(text, a + 1, n)
    step = lambda s, x: F.when(x.start < s["at"], s).otherwise(F.struct(x.end.alias("at"), F.concat(s["out"], cut(s["at"], x.start - s["at"]), F.get(names, x.kind)).alias("out")))
    merged = F.aggregate(F.col(own), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], cut(s["at"], F.length(text))))
    rows = docs.join(spans.select(F.col("id").alias(key), F.col("spans").alias(own)), F.col(id_col).eqNullSafe(F.col(key)))
    return rows.withColumn(text_col, F.when(text.isNotNull(), merged)).select(*docs.columns)


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op13_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    n = [F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return rows.select(F.col("id").alias("doc_id"), *n, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
