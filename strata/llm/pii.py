r"""Personal data by candidate gradient boosting.

Base rules find addresses, numbers and their checks exactly as stated; these spans always stay. Beside them, generous generators
propose overlapping candidate spans (anything around an @ or a spelled-out one, any run of digits with separators). A candidate has
features of its format (lengths, digit groups, separators) and of its context (neighbouring characters, cue words before it),
none of which repeats a base rule's check. Boosted regression trees are fitted on candidates outside the base spans, in at most `sample`
documents. Positives are base spans rewritten, within their contexts, into forms that no base rule finds (spelled-out or dotless
addresses, numbers without a plus sign or with other separators); negatives are wrong extents of these, planted order numbers, versions, dates, hashes and
prose, and what the text itself shows to be something else: candidates inside a base span of another kind, inside a longer word, after
a word like "version" or "token", or of a card's length with a wrong check digit. Other candidates of the text have no label and are not learned
from. On held-out documents each kind gets the lowest threshold whose precision on such candidates is at least `precision` (none: no
candidate of that kind is taken). Candidates above it that overlap no span of their kind are added under `<kind>_like`, best first, and `redact` blanks all spans.

Defined cases: a null or empty text has no spans; repeated rows and null ids are searched like any row (a null id is never in the
sample); without labelled candidates of both kinds nothing is added; an empty table gives an empty result; other columns are not
read. All searches are linear in the text, also for very long runs of one character class.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import SPANS_TYPE, query, schema_text, span_digest, table, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates the trees are fitted on at most; precision asked of each kind on the held-out third.
SAMPLE = 20_000
PRECISION = 0.95
LEAST_HELD_OUT = 20
TREES = 40
DEPTH = 3
RATE = 0.3
BINS = 32

# The patterns of the contract. Possessive runs and the look-behind keep them linear and change no match: a run
# of digits that fails from its start also fails from within.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators of candidates, and words that speak for or against them.
_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++")
_AT, _DOT = (r"\x20?[\[({<]?\x20?(?:%s|%s)\x20?[\])}>]?\x20?" % (w, w.upper()) for w in ("at", "dot"))
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*{_DOT}[A-Za-z]{{2,}}+(?![A-Za-z0-9])")
_AROUND_AT = re.compile(r"[A-Za-z0-9.-]++")
_GROUP = re.compile(r"[0-9]+")
#: Digits of the longest number that any kind may have.
MOST_DIGITS = 19
_CUES = (
    ("mail", "contact", "write"), ("phone", "tel", "call", "mobile", "fax", "whatsapp"), ("card", "visa", "credit", "iban", "account", "payment"),
    ("ip", "host", "server", "address", "login"), ("version", "license", "licence", "token", "key", "secret", "hash", "id", "no", "isbn", "order", "invoice"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, kind by kind; offsets are code points."""
    found: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:  # each match holds one @: what may stand before it, cut at the last match, and a domain after it
        m = _DOMAIN.match(text, at + 1) if at > end and text[at - 1] in _LOCAL else None
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def number_windows(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every stretch of neighbouring digit groups with at most MOST_DIGITS digits.

    A group begins at most that many windows, as each further group adds a digit; so numbers joined by single separators are all found.
    """
    for m in _NUMBERS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            n = 0
            begin = start - (start > 0 and text[start - 1] in "+(")
            for s, e in groups[i:i + MOST_DIGITS]:
                n += e - s
                if n > MOST_DIGITS:
                    break
                yield begin, e, n


class Taken:
    """Spans of one text by kind, none of a kind overlapping another of it; asking and adding take logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]] = ()):
        self.spans: dict[str, list[tuple[int, int]]] = {}
        for kind, start, end in spans:
            self.add(kind, start, end)

    def add(self, kind: str, start: int, end: int) -> None:
        insort(self.spans.setdefault(kind, []), (start, end))

    def meets(self, kind: str, start: int, end: int) -> bool:
        held = self.spans.get(kind, ())
        i = bisect_left(held, (end,))  # the last one that starts before `end` ends last
        return i > 0 and held[i - 1][1] > start


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans of high recall, each under every kind it may be."""
    found: set[tuple[str, int, int]] = set()
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _AROUND_AT.match(text, at + 1)
        if m and start < at:
            found.add(("email", start, m.end()))
            if (d := _DOMAIN.match(text, at + 1)):
                found.add(("email", start, d.end()))
        free = at + 1
        at = text.find("@", free)
    if "dot" in text or "DOT" in text:
        found.update(("email", m.start(), m.end()) for m in _SPELLED.finditer(text))
    for start, end, n in number_windows(text):
        if n <= 12 and text.count(".", start, end) >= 3:
            found.add(("ip", start, end))
        if 7 <= n <= 15:
            found.add(("phone", start, end))
        if 12 <= n <= MOST_DIGITS:
            found.add(("card", start + (text[start] in "+("), end))
    return sorted(found, key=lambda c: (c[1], BASE_KINDS.index(c[0]), c[2]))


FEATURES = 25


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    before, after = text[start - 1:start], text[end:end + 1]
    cue = text[max(0, start - 40):start].lower()
    words = re.findall(r"[^\W\d_]+", cue)[-4:]
    return [
        float(BASE_KINDS.index(kind)), float(len(span)), float(sum(groups)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("(") + span.count(")")), float(span[:1] == "+"),
        float(sum(c.isalpha() for c in span)), float("@" in span), float(len(span.rpartition(".")[2]) if "." in span else 0),
        float(span.count("[") + span.count("{") + span.count("<")), float(any("0" <= c <= "9" for c in text[max(0, start - 2):start])),
        float(any("0" <= c <= "9" for c in text[end:end + 2])), float(before.isalnum()), float(after.isalnum()), float(before in ('"', "'", "=", ":", "/", "#")),
        *(float(any(w.startswith(c) for w in words for c in cues)) for cues in _CUES)]


# -- boosted trees ---------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete regression trees of one depth: per inner node a feature and a cut, per leaf a value."""

    start: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=int)
            while True:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
                if len(node) == 0 or node[0] >= len(f):
                    break
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, penalty: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    score, inner = np.full(len(y), start), 2 ** depth - 1
    all_f, all_c, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, c, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for n in range(inner):
            mine = np.flatnonzero(node == n)
            if len(mine):
                gs, hs, best = g[mine].sum(), h[mine].sum(), 1e-6
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[mine, j], weights=g[mine], minlength=len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, j], weights=h[mine], minlength=len(e) + 1))[:-1]
                    gain = gl ** 2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs ** 2 / (hs + penalty)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, f[n], c[n] = gain[k], j, e[k]
            node[mine] = 2 * n + 1 + (x[mine, f[n]] > c[n])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            mine = node == inner + k
            leaf[k] = -rate * g[mine].sum() / (h[mine].sum() + penalty)
        score += leaf[node - inner]
        all_f.append(f), all_c.append(c), all_leaf.append(leaf)
    return Trees(start, np.array(all_f), np.array(all_c), np.array(all_leaf))


@dataclass
class PiiModel:
    trees: Trees = field(default_factory=Trees)
    thresholds: dict[str, float] = field(default_factory=dict)


def calibrate(kinds: np.ndarray, scores: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the lowest score at and above which at least `precision` of the held-out candidates are right."""
    out = {}
    for i, kind in enumerate(BASE_KINDS):
        mine = kinds == i
        s, t = scores[mine], y[mine]
        levels = np.unique(s)[::-1]
        for level in levels:
            taken = s >= level
            if taken.sum() >= LEAST_HELD_OUT and t[taken].mean() >= precision:
                out[kind] = float(level)
    return out


# -- labels that no base rule gives ----------------------------------------------------------------------------------


def _rewritten(kind: str, span: str, rng: random.Random) -> str:
    """The same datum in a form outside its base rule."""
    if kind == "email":
        local, _, domain = span.rpartition("@")
        a, b = rng.choice([(" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("@", "")])
        return local + a + b.join(domain.split(".")) if b else local + a + domain.partition(".")[0]
    if kind == "ip":
        return rng.choice([". ", " ."]).join(span.split("."))
    d = _digits(span)
    if kind == "card":
        return rng.choice([".", "/", "  ", "--"]).join(d[i:i + 4] for i in range(0, len(d), 4))
    local = [d[-10:-7], d[-7:-4], d[-4:]] if len(d) >= 10 else [d[:-4], d[-4:]]
    code = d[:-10] if len(d) > 10 else ""
    bare = rng.choice([" ", "-", ".", "/"]).join(local)
    return rng.choice([bare, bare, f"({local[0]}) {'-'.join(local[1:])}", f"{code} ({local[0]}) {'-'.join(local[1:])}".strip(), f"00{code} {bare}", f"{code} {bare}".strip()])


def _stranger(kind: str, near: str, rng: random.Random) -> str:
    """Something else that looks alike: prose, order numbers, versions, dates, hashes."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == "email":
        words = re.findall(r"[A-Za-z]{2,12}", near) or ["there"]
        return f"{rng.choice(words)} at {rng.choice(words)} dot {rng.choice(words)}"
    if kind == "ip":
        return f"version {rng.randrange(30)}. {rng.randrange(30)}. {rng.randrange(300, 2000)}. {rng.randrange(30)}"
    if kind == "card":
        return f"{rng.choice(['order no', 'order', 'invoice id', 'isbn'])} {digits(rng.randrange(12, 20))}"
    return rng.choice([
        f"order {digits(rng.randrange(7, 13))}", f"invoice no {digits(4)}-{digits(6)}", f"version {rng.randrange(20)}.{digits(3)}.{digits(4)}",
        f"token {digits(2)}a{digits(9)}fb{digits(3)}", f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        f"{rng.randrange(1900, 2100)}-{rng.randrange(1900, 2100)}", f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2100)}", f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"])


def planted(text: str, rng: random.Random) -> tuple[str, set[tuple[str, int, int]], list[tuple[int, int]]]:
    """The text with its base spans rewritten or replaced by strangers; the rewritten spans, and all places that were touched."""
    out, length, at, true, touched = [], 0, 0, set(), []
    for kind, start, end in sorted(base_spans(text), key=lambda b: b[1]):
        if start < at:
            continue
        good = rng.random() < 0.6
        new = _rewritten(kind, text[start:end], rng) if good else _stranger(kind, text[max(0, start - 100):start], rng)
        out += [text[at:start], new]
        place = length + start - at
        if good:
            true.add((kind, place, place + len(new)))
        touched.append((place, place + len(new)))
        length, at = place + len(new), end
    return "".join([*out, text[at:]]), true, touched


def labelled(text: str, rng: random.Random) -> Iterator[tuple[float, list[float]]]:
    """(label, features) of candidates outside the base spans of their kind whose label is known."""
    new, true, touched = planted(text, rng)
    for source, spans in ((text, None), (new, touched)):
        base = Taken(base_spans(source))
        places = Taken([("", *s) for s in spans or ()])
        for c in candidates(source):
            kind, start, end = c
            if base.meets(kind, start, end):
                continue
            if spans is not None and places.meets("", start, end):
                yield float(c in true), features(source, *c)
            elif spans is None:
                x = features(source, *c)
                inside = any(base.meets(k, start, end) for k in BASE_KINDS)
                wrong = kind == "card" and not luhn(_digits(source[start:end]))
                joined = kind != "email" and (source[start - 1:start].isalnum() or source[end:end + 1].isalnum())
                if inside or wrong or joined or kind != "email" and x[-1]:
                    yield 0.0, x


_SAMPLED = "doc_id long, place long, label double, x array<double>"


def train(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> PiiModel:
    """Fit and calibrate on the labelled candidates of at most `sample` documents, chosen by a hash of their ids."""
    chosen = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (label, x) in enumerate(labelled(text, random.Random(doc))):
                    for column, value in zip(out, (doc, i, label, x)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.float64()))],
                ["doc_id", "place", "label", "x"])

    # `chosen` has at most `sample` ids; of their candidates as many rows again reach the driver
    rows = (docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").mapInArrow(run, _SAMPLED)
            .orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "label", "x").limit(sample).toArrow())
    y = np.asarray(rows["label"])
    if not len(y) or y.min() == y.max():
        return PiiModel()
    x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(len(y), FEATURES)
    held = np.asarray(rows["doc_id"]) % 3 == 0  # whole documents, so that no context is on both sides
    if held.all() or not held.any():
        return PiiModel()
    trees = fit_trees(x[~held], y[~held])
    return PiiModel(trees, calibrate(x[held, 0].astype(int), trees.score(x[held]), y[held], precision))


def find_pii(texts_: list[str], model: PiiModel) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: base spans, and accepted candidates that overlap none of their kind; by start, then kind."""
    found, taken, rows, owners = [], [], [], []
    for i, text in enumerate(texts_):
        base = base_spans(text)
        found.append(base)
        taken.append(Taken(base))
        if model.thresholds:
            for c in candidates(text):
                if c[0] in model.thresholds and not taken[i].meets(*c):
                    rows.append(features(text, *c))
                    owners.append((i, c))
    if rows:
        scores = model.trees.score(np.array(rows))
        for k in np.argsort(-scores, kind="stable").tolist():
            i, (kind, start, end) = owners[k]
            like = f"{kind}_like"
            if scores[k] >= model.thresholds[kind] and not taken[i].meets(like, start, end):
                found[i].append((like, start, end))
                taken[i].add(like, start, end)
    order = {k: r for r, k in enumerate((*BASE_KINDS, *(f"{k}_like" for k in BASE_KINDS)))}
    return [sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])) for spans in found]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by the kind of its first span, in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.removesuffix('_like').upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Rows of `docs` with their spans and the redacted text beside what they hold; a column named text is searched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = [t or "" for t in batch.column(at).to_pylist()]
            found = find_pii(texts_, shared.value)
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
            redacted = [redact(t, f) if f else t for t, f in zip(texts_, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind), pa.array(redacted, pa.string())], [*batch.schema.names, "spans", "redacted"])

    return docs.mapInArrow(run, f"{schema_text(docs)}, spans {SPANS_TYPE}, redacted string")


@query("op6_pii")
def pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(table(spark, sf, "documents"))
    return with_spans(docs, train(docs)).select("doc_id", *span_digest(F.col("spans"), BASE_KINDS))
