"""Personal data: generated candidate spans, boosted trees, calibrated thresholds.

Four formats (email, ip, card, phone) are matched exactly and always reported.
Beside them, generators propose overlapping candidates with high recall: any
number-like run, any long token that mixes letters and digits, any value after
a credential word, any token with digits after a word for a document or
account, colon-separated addresses, spelled-out ones. Boosted regression trees
score each candidate from its format and its context; a threshold per kind, set
on held-out candidates for a wanted precision, selects what is added. Of
selected spans that overlap, those that cover most at the highest chances stay
(weighted interval scheduling). An added card must pass its check digit.

The trees learn from candidates of a bounded sample of texts (``max_docs``
smallest hashes of doc_id, ``max_candidates`` smallest hashes of what is
distinct in them) whose format tells the answer by itself (an exact match with
its check digits or ranges, or the same shape failing them), and from examples
that a small grammar writes, a fifth of both held out for the thresholds. They
see neither the check digits nor the exact patterns. One task fits them; the
driver gets the model alone, a few thousand numbers.

The scoring pass reads every whole text once in Arrow batches and shuffles
nothing. All patterns run in time linear in the text: an ``@`` is extended to
both sides instead of trying every start, and digit runs are matched once from
their beginning.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret")
MAX_DOCS, MAX_CANDIDATES = 40_000, 20_000
ROUNDS, DEPTH, RATE, CUTS = 40, 3, 0.25, 16
#: Precision the thresholds aim at on held-out candidates, held-out candidates a kind needs for a threshold of its own.
PRECISION, LEAST_HELD = 0.95, 10

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_])[+(]{0,2}[0-9](?:[ ().,/:-]{0,2}[0-9])++")
_GROUP = re.compile(r"[^ ]+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}")
_VALUE = re.compile(r"[=:][ ]?[\"']?([^\s\"',;=:]++[^\s\"',;]*+)")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])")
_NAMED = re.compile(r"\b(?:passport|ssn|iban|account|acct|licen[cs]e|social security)(?: (?:no|number|nr|id))?[ .:#=]{1,3}+([A-Z0-9][A-Z0-9-]{4,40}+)\b", re.I)
_SPELLED = re.compile(r"(?<![\w.])[\w.+-]{1,64}+ ?[\[(]at[\])] ?[\w-]{1,64}+(?: ?[\[(]dot[\])] ?[\w-]{1,64}+)+", re.I)
#: Words that speak for personal data or credentials, and for harmless numbers.
_FOR = re.compile(r"(?:phone|tel|call|fax|mobile|card|visa|iban|account|acct|ssn|passport|mail|contact|ip|host)\W*\Z", re.I)
_KEYWORD = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|apikey|access[_-]?key|auth|credential)s?\W*\Z", re.I)
_AGAINST = re.compile(r"(?:version|page|pages|isbn|order|chapter|section|figure|table|year|item|part|no|number|doi|sha|commit|hash)\W*\Z", re.I)

Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def exact_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(the base spans by kind and start, matches whose ranges or check digits fail)."""
    good, bad = list(emails(text)), []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
            (good if fits else bad).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19:
                (good if luhn(d) else bad).append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            fits = 9 <= len(_digits(m[0])) <= 15
            (good if fits else bad).append(("phone", *m.span()))
    return good, bad


#: Fewest digits of a number, and its most when it has several groups between blanks.
LEAST_DIGITS, MOST_DIGITS = 7, 19
#: Candidates scored at a time.
SCORED = 4096


def _numbers(text: str, run: re.Match) -> Iterator[Span]:
    """The numbers that a run of digit groups may hold: all neighbouring groups of a fitting length.

    A last group that goes on with a letter is part of a word and of no number.
    """
    groups = [(g.start(), g.end(), len(_digits(g[0]))) for g in _GROUP.finditer(text, run.start(), run.end())]
    if text[run.end():run.end() + 1].isalpha():
        groups.pop()
    for i, (a, _, _) in enumerate(groups):
        n = 0
        for k, (_, b, more) in enumerate(groups[i:i + MOST_DIGITS]):    # every group has a digit
            n += more
            if n > MOST_DIGITS and k:
                break
            if n >= LEAST_DIGITS:
                s = text[a:b]
                parts = s.split(".")
                yield ("ip" if len(parts) == 4 and all(map(str.isdigit, parts))
                       else "card" if 13 <= n <= 19 else "phone" if n <= 15 and not s.isdigit() else "account", a, b)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals; the kind is what the span would be reported as."""
    found: set[Span] = set()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            found.update(_numbers(text, m))
        for m in _TOKEN.finditer(text):
            if _DIGIT.search(m[0]) and not m[0].isdigit() and any(map(str.isalpha, m[0])):
                found.add(("secret", *m.span()))
        for m in _NAMED.finditer(text):
            if _DIGIT.search(m[1]):
                found.add(("account", *m.span(1)))
        for m in _COLONS.finditer(text):
            if len(re.findall("[0-9A-Fa-f]+", m[0])) >= 3:
                found.add(("ip", *m.span()))
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            if _KEYWORD.search(text[max(0, m.start() - 24):m.start()]):
                found.add(("secret", *m.span(1)))
    if "(at)" in text.lower() or "[at]" in text.lower():
        found |= {("email", *m.span()) for m in _SPELLED.finditer(text)}
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate; no check digits, no exact pattern."""
    kind, a, b = span
    s = text[a:b]
    n = len(s)
    digits = len(_digits(s))
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    share = np.unique(list(s), return_counts=True)[1] / n
    before, after = text[max(0, a - 40):a], text[b:b + 8]
    near = before.rstrip(" \"'=:([")
    return [
        float(KINDS.index(kind)), n, digits / n, digits, len(groups), max(groups, default=0), min(groups, default=0),
        s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count(")"), float(s[0] == "+"), upper / n, lower / n,
        float(-(share * np.log2(share)).sum()), float(bool(_FOR.search(before))), float(bool(_KEYWORD.search(before))),
        float(bool(_AGAINST.search(near))), float(before[-1:] in ("=", ":", '"', "'")),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "-_/.")),
        float(bool(after) and (after[0].isalnum() or after[0] in "-_/")), s.count("/") + s.count(",") + s.count(":")]


#: The grammar of written examples: {field} draws from FIELDS; what stands between < and > is personal or a credential
#: (1) or not (0). Each template is written EACH times with other values.
TEMPLATES = (
    ("{cred}{is}<{mixed}>", 1), ("the {cred}{is}<{phrase}>", 1), ('{cred}{is}"<{hex}>"', 1), ("{cred}{is}'<{odd}>'", 1), ("my {cred}{is}<{mixed}> {word}", 1),
    ("key <AKIA{upper}> {word}", 1), ("uses <AKIA{upper}> here", 1), ("found <ghp_{long}> in", 1), ("{word} <eyJ{long}> sent", 1), ("{word} <{long}> {word}", 1),
    ("account <{iban}> please", 1), ("iban{is}<{iban}>", 1), ("account <{d11}>", 1), ("account number <{d10}> {word}", 1), ("passport {no}<{pass}>", 1),
    ("passport<{sp}{pass}>", 1), ("acct{is}<{d9}>", 1),
    ("call <({d3}) {d3}-{d4}> now", 1), ("tel <0049 {d2} {d7}>", 1), ("phone: <{d3}-{d3}-{d4}>", 1), ("{for} <{d3}-{d2}-{d4}> on file", 1), ("ssn <{d3}-{d2}-{d4}>", 1),
    ("mobile <0{d4} {d3} {d3}>", 1), ("{for} <0{d2} {d4} {d4}> {word}", 1), ("call <{d3}.{d3}.{d4}>", 1), ("fax: <0{d3}/{d7}>", 1),
    ("write to <{name} (at) {name} (dot) {tld}>", 1), ("mail <{name} [at] {name} [dot] {tld}>", 1), ("{word} <{name}.{name} (at) {name} (dot) {tld}>", 1),
    ("host <{h}:{h}:{h}:{h}:{h}:{h}:{h}:{h}>", 1), ("ip <{h}:{h}::{h}:{h}> {word}", 1), ("{word} <fe80::{h}:{h}:{h}:{h}> up", 1),
    ("{cred}{is}<{word}>", 0), ("{cred}s: <{word}> {word}", 0), ("{cred}: <{d3}>", 0), ("the {cred} = <{flag}>", 0), ("{cred}{is}<{word},>", 0),
    ("version <{d1}.{d1}.{d2}.{d4}>", 0), ("{not} <{d8}>", 0), ("{not} id <{d10}>", 0), ("{not} id <{d11}>", 0), ("{not} <{d10}> {word}", 0), ("ISBN <978-{d1}-{d2}-{d6}-{d1}>", 0),
    ("on <20{d2}-0{d1}-1{d1} 12:3{d1}> we", 0), ("from <19{d2}-20{d2}> and", 0), ("pages <{d4}-{d4}>", 0), ("cost <{d1},{d3},{d3}.{d2}> in", 0),
    ("in <{d2},{d3},{d3}> cases", 0), ("table <{d1}.{d8}>", 0), ("the <covid-{d2}-{word}> plan", 0), ("see <section-{d2}-paragraph-{d1}> of", 0),
    ("commit <{hex}> fixed", 0), ("sha <{hex}>", 0), ("a <{word}-{d2}-{word}-{word}> file", 0), ("at <20{d2}/1{d1}/{word}-{word}-{d2}> there", 0),
    ("doi <10.1000/{d9}>", 0), ("time <12:3{d1}:4{d1}.{d3}> spent", 0), ("figure <{d2}.{d2} {d2}.{d2} {d2}.{d2}>", 0), ("year <20{d2}, 20{d2}, 20{d2}>", 0),
    ("number <{d9}> of", 0), ("item <000{d8}>", 0), ("{word} <12:3{d1}:4{d1}> {word}", 0), ("ratio <{d1}:{d1}:{d1}> {word}", 0), ("order <{d3}-{d7}-{d7}>", 0),
    ("invoice <20{d2}{d6}>", 0),
)
FIELDS = {
    "cred": "password passwd pwd token secret api_key apikey access-key auth credential".split(), "is": ["=", ": ", " = ", ":"],
    "word": "the required none empty please invalid expired bearer default hidden change ring access here there value must was only".split(),
    "flag": "true false null yes no on off".split(), "for": "phone call tel mobile contact fax".split(), "no": ["", "no ", "number ", "no. "], "sp": [""],
    "not": "order page item section chapter part figure invoice version".split(), "name": "joe jane bob mail home site office anna mike".split(),
    "tld": "org com net de info".split(),
}
EACH, EXAMPLE_WEIGHT = 10, 1.0
_LETTERS, _CAPITALS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _drawn(field: str, rng: np.random.Generator) -> str:
    """One value of a field of the grammar."""
    some = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    if field in FIELDS:
        return FIELDS[field][rng.integers(len(FIELDS[field]))]
    if field[0] == "d":
        return some("123456789", 1) + some(_DIGITS, int(field[1:]) - 1)
    if field == "phrase":
        return "".join(some(_LETTERS, rng.integers(4, 8)).capitalize() if rng.random() < 0.3 else some(_LETTERS, rng.integers(4, 8))
                       for _ in range(rng.integers(2, 5)))
    if field == "odd":
        return some(_LETTERS + _CAPITALS + _DIGITS + "!$%&*#@^", rng.integers(8, 21))
    return {"mixed": some(_LETTERS + _CAPITALS + _DIGITS, rng.integers(6, 25)), "hex": some("0123456789abcdef", (32, 40, 64)[rng.integers(3)]),
            "upper": some(_CAPITALS + _DIGITS, 16), "long": some(_LETTERS + _CAPITALS + _DIGITS, rng.integers(30, 44)),
            "iban": some(_CAPITALS, 2) + some(_DIGITS, rng.integers(18, 23)), "pass": some(_CAPITALS, rng.integers(1, 3)) + some(_DIGITS, rng.integers(6, 9)),
            "h": some("0123456789abcdef", rng.integers(2, 5))}[field]


def examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, answers, whether held out) of the candidates in the written examples; the same at every call."""
    rng = np.random.default_rng(10)
    xs, ys, held = [], [], []
    for template, y in TEMPLATES:
        for turn in range(EACH):
            shown = re.sub(r"\{(\w+)\}", lambda m: _drawn(m[1], rng), template)
            a, b = shown.index("<"), shown.index(">")
            text = shown[:a] + shown[a + 1:b] + shown[b + 1:]
            # of what is personal the whole span counts, of what is not every candidate in it
            spans = [s for s in candidates(text) if ((s[1], s[2]) == (a, b - 1) if y else s[1] < b - 1 and s[2] > a)]
            for s in spans:
                xs.append(features(text, s))
                ys.append(y)
                held.append(turn % 5 == 4)
    return np.array(xs), np.array(ys), np.array(held)


@dataclass
class Trees:
    """Boosted trees of one shape: nodes in heap order, leaves at depth DEPTH."""
    prior: float
    feature: np.ndarray      # (rounds, 2**DEPTH - 1)
    cut: np.ndarray          # (rounds, 2**DEPTH - 1)
    leaf: np.ndarray         # (rounds, 2**DEPTH)
    slope: float = 1.0       # of the calibrated chance
    shift: float = 0.0
    threshold: tuple[float, ...] = (0.5,) * len(KINDS)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2 ** DEPTH - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Gradient boosting on log loss; splits maximise the second-order gain."""
    share = np.clip((w * y).sum() / max(w.sum(), 1e-9), 0.02, 0.98)
    inner = 2 ** DEPTH - 1
    t = Trees(float(np.log(share / (1 - share))), np.zeros((ROUNDS, inner), int), np.full((ROUNDS, inner), np.inf),
              np.zeros((ROUNDS, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    above = [x[:, f, None] > c[None] for f, c in enumerate(cuts)]
    margin = np.full(len(y), t.prior)
    for r in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), int)
        for node in range(inner):
            mine = at == node
            gs, hs = g[mine].sum(), h[mine].sum()
            best = (1e-6, 0, np.inf)
            if mine.sum() > 1:
                for f, a in enumerate(above):
                    ga, ha = g[mine] @ a[mine], h[mine] @ a[mine]
                    gain = ga ** 2 / (ha + 1) + (gs - ga) ** 2 / (hs - ha + 1) - gs ** 2 / (hs + 1)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best[0]:
                        best = (float(gain[k]), f, float(cuts[f][k]))
            t.feature[r, node], t.cut[r, node] = best[1], best[2]
            at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
        for k in range(inner + 1):
            mine = at == inner + k
            t.leaf[r, k] = -RATE * g[mine].sum() / (h[mine].sum() + 1)
        margin += t.leaf[r][at - inner]
    return t


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees on four fifths of the labelled candidates and the examples, calibrated on the rest.

    A kind's threshold lies just below the lowest chance of a right held-out
    candidate from which on they reach PRECISION; a kind with fewer than LEAST_HELD of them takes
    the threshold of all kinds together.
    """
    ex, ey, held = examples()
    last = np.arange(len(y)) % 5 == 4
    bx, by = np.concatenate((x[~last], ex[~held])), np.concatenate((y[~last], ey[~held])).astype(float)
    # the candidates together weigh at most as much as a thousand examples, so that common shapes do not drown rare ones
    w = np.concatenate((np.full(int((~last).sum()), min(1.0, 1000 / max(1, (~last).sum()))), np.full(int((~held).sum()), EXAMPLE_WEIGHT)))
    t = boost(bx, by, w)
    hx, hy = np.concatenate((x[last], ex[held])), np.concatenate((y[last], ey[held])).astype(float)
    m = t.margin(hx)
    for _ in range(50):                                    # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-np.clip(t.slope * m + t.shift, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - hy) * m).sum() + 0.1 * (t.slope - 1), (p - hy).sum() + 0.1 * t.shift])
        hess = np.array([[(v * m * m).sum() + 0.1, (v * m).sum()], [(v * m).sum(), v.sum() + 0.1]])
        ds, db = np.linalg.solve(hess, g)
        t.slope, t.shift = float(t.slope - np.clip(ds, -0.5, 0.5)), float(t.shift - np.clip(db, -0.5, 0.5))
    chance = t.chance(hx)

    def cut(mine: np.ndarray) -> float:
        levels, at = np.unique(-chance[mine], return_inverse=True)           # equal chances stand or fall together
        right, n = np.bincount(at, hy[mine], len(levels)), np.bincount(at, minlength=len(levels))
        # a level without a right candidate sets no cut
        good = np.flatnonzero((right > 0) & (np.cumsum(right) / np.cumsum(n) >= PRECISION))
        if not len(good):
            return 1.1
        k = good[-1]                                        # half way to the next level below
        return float(-(levels[k] + (levels[k + 1] if k + 1 < len(levels) else 0.0)) / 2)

    every = cut(np.ones(len(hy), bool))
    t.threshold = tuple(cut(hx[:, 0] == k) if (hx[:, 0] == k).sum() >= LEAST_HELD else every for k in range(len(KINDS)))
    return t


def labelled(text: str) -> tuple[list[list[float]], list[int]]:
    """Candidates of a text whose format decides: exact matches, and the same shapes failing their checks."""
    good, bad = exact_spans(text)
    if not good and not bad:
        return [], []
    yes, no = set(good), set(bad)
    rows = [(features(text, s), int(s in yes)) for s in candidates(text) if s in yes or s in no]
    rows += [(features(text, s), 1) for s in good if s[0] == "phone"]
    return [x for x, _ in rows], [y for _, y in rows]


def train(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text",
          max_candidates: int = MAX_CANDIDATES) -> Trees:
    """Fit on the distinct labelled candidates of at most ``max_docs`` ids (the smallest hashes), of which the
    ``max_candidates`` with the smallest hashes reach the one task that fits. Only the model comes to the driver."""
    key = F.col(f"`{id_col}`").cast("long")
    ids = docs.select(key.alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    texts = (docs.select(key.alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
             .join(F.broadcast(ids), "_id").filter(F.col("text").rlike("[0-9]")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(np.array(x, np.float64).tobytes(), y) for t in b.column(1) for x, y in zip(*labelled(t.as_py() or ""), strict=True)]
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32())], ["x", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for b in batches:
            xs += [np.frombuffer(x.as_buffer()) for x in b.column(0)]
            ys += b.column(1).to_pylist()
        t = fit(np.array(xs).reshape(-1, FEATURES), np.array(ys, int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(t)], pa.binary())], ["model"])

    # the same text gives the same candidates: copies must not sit on both sides of the calibration
    rows = map_arrow(texts, cut, "x binary, y int").distinct().orderBy(F.xxhash64("x"), "x", "y").limit(max_candidates)
    model = map_arrow(rows.repartition(1).sortWithinPartitions(F.xxhash64("x"), "x", "y"), fitted, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit(np.zeros((0, FEATURES)), np.zeros(0, int))


def find(text: str | None, trees: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text, by kind as listed and start."""
    text = text or ""
    if "@" not in text and "=" not in text and ":" not in text and not _DIGIT.search(text) and "at" not in text.lower():
        return [], []
    base, _ = exact_spans(text)
    more = [s for s in candidates(text) if not any(s[1] < b and a < s[2] for _, a, b in base)] if len(base) < 64 \
        else _apart(candidates(text), base)
    chosen = []
    for k in range(0, len(more), SCORED):
        some = more[k:k + SCORED]
        x = np.array([features(text, s) for s in some])
        chance = trees.chance(x)
        cut = np.array(trees.threshold)[x[:, 0].astype(int)]
        chosen += [(s, c) for s, c, ok in zip(some, chance.tolist(), (chance >= cut).tolist(), strict=True)
                   if ok and (s[0] != "card" or luhn(_digits(text[s[1]:s[2]])))]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *without_overlaps(chosen)}, key=lambda s: (order[s[0]], s[1], s[2]))


def without_overlaps(chosen: list[tuple[Span, float]]) -> list[Span]:
    """The spans without overlaps that cover the most characters, each weighed by its chance
    (of equal covers the one found first by end, start and kind)."""
    chosen = sorted(chosen, key=lambda c: (c[0][2], c[0][1], c[0][0]))
    ends = [s[2] for s, _ in chosen]
    best, before = [0.0], []                                 # best weight of the first k spans; where the k-th would go on from
    for s, chance in chosen:
        before.append(bisect_right(ends, s[1], 0, len(before)))
        best.append(max(best[-1], best[before[-1]] + chance * (s[2] - s[1])))
    kept, k = [], len(chosen)
    while k:
        if best[k] == best[k - 1]:
            k -= 1
        else:
            kept.append(chosen[k - 1][0])
            k = before[k - 1]
    return kept[::-1]


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """Spans that touch no base span, by sorted bounds."""
    base = sorted(base, key=lambda s: s[1])
    starts = np.array([s[1] for s in base])
    ends = np.maximum.accumulate(np.array([s[2] for s in base]))
    keep = []
    for s in spans:
        k = int(np.searchsorted(starts, s[2])) - 1          # the last base span that starts before this one ends
        if k < 0 or ends[k] <= s[1]:
            keep.append(s)
    return keep


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind."""
    out, end, run = [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= run:
            out += [text[end:a], f"[{k.upper()}]"]
            end = run = b
        else:
            end = run = max(run, b)
    return "".join(out) + text[end:]


def scan(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans; offsets are code points; repeated rows
    and null ids are scanned like any other; other columns are not read; an
    empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                base, spans = find(t.as_py(), trees)
                kinds = [k for k, _, _ in base]
                out.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all spans replaced by ``[KIND]``; a column n_chars follows the text.

    Null texts stay null; texts without spans and all other columns stay as they are.
    No base span is left: what shows up once its neighbours are gone is replaced too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0):
                text = t.as_py()
                spans = find(text, trees)[1]
                while spans:                        # what is left may hold a format that its neighbours hid
                    text = redacted(text, spans)
                    spans = exact_spans(text)[0]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], ["text", "row"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    src = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*rest, F.lit(0).alias("_")).alias("row"))
    done = map_arrow(src, run, T.StructType([T.StructField("text", T.StringType()), src.schema["row"]]))
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            cols.append(F.col("text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(kind).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return done.select(*cols)


def op10_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


QUERIES = {"op10_pii_boost": op10_pii_boost}
ORACLES: dict[str, str] = {}
