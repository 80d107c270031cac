"""Secret scans: fixed base rules, and formats learned by grammar inference.

Labelled credentials are what the base rules find in at most ``MAX_DOCS`` documents (chosen by the hash of their id), at
most ``MAX_PER_KIND`` of each kind, taken in turn from its shapes (which kinds of characters occur), so that rare ones are
there; the same documents give ordinary strings.  For each kind and shape a prefix tree over character classes is built and its states are merged in breadth-first order when their outgoing and final frequencies agree
within Hoeffding's bound; the result is a deterministic probabilistic automaton.  Every candidate string of every text
is scored, whatever its length: log-likelihood of its classes under the automaton plus that of its length (smoothed, so that
new lengths cost something and exclude nothing), against the automaton of ordinary strings; and its classes must be typical
of the automaton, neither too unlikely nor too likely for that many characters.  Candidates that look like a labelled format
become spans of their own; those that overlap a base span do not.

Null texts count as empty.  Without labelled credentials of a kind, that kind adds nothing.  Repeated rows get equal
results.  Spans that begin at one place are listed by kind.  An empty table gives no row; extra columns are ignored.  Only the bounded sample reaches the driver; texts are scanned whole and in place.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import id_and_text, long_id, stored

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# the alphabet and least length of assigned secrets; a last dot ends a sentence
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{5,}[A-Za-z0-9+/_=-]")

MAX_DOCS = 20_000
MAX_PER_KIND = 400
ALPHA = 0.05
# log-likelihood ratio against ordinary strings that a candidate must exceed
MARGIN = 8.0
# deviations from the expected likelihood that are typical at least (99 %); labelled strings beyond them widen the range, but for this share
TYPICAL = 2.576
LOWEST = 0.01
# automata of a kind; the rarest shapes share the last one
SHAPES = 16
# weight of lengths that no labelled string has
NEW_LENGTHS = 0.1
CACHED = 100_000

_CLASS = {c: c for c in "+/_.=-"}
_CLASS |= {c: k for chars, k in (("0123456789", "0"), ("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "g"), ("ABCDEF", "A"), ("GHIJKLMNOPQRSTUVWXYZ", "G")) for c in chars}
_TABLE = str.maketrans(_CLASS)
_CLASSES = sorted(set(_CLASS.values()))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Automaton:
    """States with symbol counts; ``moves[state][symbol] = (next state, count)``."""

    moves: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    visits: list[int] = field(default_factory=list)
    lengths: dict[int, float] = field(default_factory=dict)
    lowest: float = -TYPICAL
    highest: float = TYPICAL

    def length_likelihood(self, n: int) -> float:
        """The learned lengths, mixed with a law over all lengths."""
        known = math.exp(self.lengths[n]) if n in self.lengths else 0.0
        return math.log((1 - NEW_LENGTHS) * known + NEW_LENGTHS / (n * (n + 1)))

    @cached_property
    def expected(self) -> tuple[float, float]:
        """Mean and deviation of the log-likelihood of one character."""
        terms = [(k, math.log((k + 0.5) / (n + 0.5 * len(_CLASSES)))) for moves, n in zip(self.moves, self.visits) for _, k in moves.values()]
        total = sum(k for k, _ in terms) or 1
        mean = sum(k * x for k, x in terms) / total
        return mean, math.sqrt(max(sum(k * (x - mean) ** 2 for k, x in terms) / total, 1e-4))

    def deviation(self, classes: str) -> float:
        """Of the classes' log-likelihood from what is expected of that many characters, in standard deviations."""
        mean, sd = self.expected
        return (self.class_likelihood(classes) - mean * len(classes)) / (sd * math.sqrt(len(classes)))

    def log_likelihood(self, classes: str) -> float:
        return self.class_likelihood(classes) + self.length_likelihood(len(classes))

    def class_likelihood(self, classes: str) -> float:
        """Of the classes of a string; an unseen move costs a small share and restarts."""
        state, total = 0, 0.0
        for c in classes:
            move = self.moves[state].get(c)
            n = self.visits[state] + 0.5 * len(_CLASSES)
            total += math.log(((move[1] if move else 0) + 0.5) / n)
            state = move[0] if move else 0
        return total


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings`` (over character classes)."""
    visits, ends, next_of, counts = [0], [0], [{}], [Counter()]
    for s in strings:
        at = 0
        visits[0] += 1
        for c in s:
            if c not in next_of[at]:
                next_of[at][c] = len(visits)
                visits.append(0), ends.append(0), next_of.append({}), counts.append(Counter())
            counts[at][c] += 1
            at = next_of[at][c]
            visits[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(a: int, n: int, b: int, m: int) -> bool:
        return n == 0 or m == 0 or abs(a / n - b / m) < bound * (n**-0.5 + m**-0.5)

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            x, y = todo.pop()
            if not agree(ends[x], visits[x], ends[y], visits[y]):
                return False
            for c in counts[x].keys() | counts[y].keys():
                if not agree(counts[x][c], visits[x], counts[y][c], visits[y]):
                    return False
            todo += [(next_of[x][c], next_of[y][c]) for c in next_of[x].keys() & next_of[y].keys()]
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            x, y = todo.pop()
            visits[x] += visits[y]
            ends[x] += ends[y]
            for c, n in counts[y].items():
                counts[x][c] += n
                if c in next_of[x]:
                    todo.append((next_of[x][c], next_of[y][c]))
                else:
                    next_of[x][c] = next_of[y][c]

    kept = [0]
    fringe = sorted(next_of[0].values())
    while fringe:
        q = fringe.pop(0)
        parent, symbol = next((r, c) for r in kept for c, n in next_of[r].items() if n == q)
        for r in kept:
            if compatible(r, q):
                next_of[parent][symbol] = r
                fold(r, q)
                break
        else:
            kept.append(q)
        inside = set(kept)
        fringe = sorted({n for r in kept for n in next_of[r].values()} - inside)
    number = {s: i for i, s in enumerate(kept)}
    return Automaton([{c: (number[n], counts[s][c]) for c, n in next_of[s].items()} for s in kept], [visits[s] for s in kept])


def _lengths(strings: list[str]) -> dict[int, float]:
    """Log share of each length, with a little weight for the lengths next to it."""
    weight: Counter = Counter()
    for s in strings:
        for d, w in ((-1, 0.05), (0, 0.9), (1, 0.05)):
            weight[len(s) + d] += w
    total = sum(weight.values())
    return {n: math.log(w / total) for n, w in weight.items()}


@dataclass
class Formats:
    """Automata of the labelled kinds and of ordinary strings."""

    kinds: list[Automaton] = field(default_factory=list)
    ordinary: Automaton | None = None

    verdicts: dict[str, bool] = field(default_factory=dict, repr=False)

    def looks_secret(self, s: str) -> bool:
        if not self.kinds:
            return False
        classes = s.translate(_TABLE)
        if (known := self.verdicts.get(classes)) is None:
            if len(self.verdicts) >= CACHED:
                self.verdicts.clear()
            known = self.verdicts[classes] = self._judge(classes)
        return known

    def _judge(self, classes: str) -> bool:
        usual = self.ordinary.log_likelihood(classes) if self.ordinary else len(classes) * math.log(1 / len(_CLASSES))
        return any(a.log_likelihood(classes) - usual > MARGIN and a.lowest <= a.deviation(classes) <= a.highest for a in self.kinds)


def shape(secret: str) -> str:
    """Which of digits, small and capital letters (hexadecimal or any) and marks occur."""
    seen = set(secret.translate(_TABLE))
    return "".join(sorted(seen - ({"a"} if "g" in seen else set()) - ({"A"} if "G" in seen else set())))


def automata(strings: list[str]) -> list[Automaton]:
    """One for each shape."""
    by_shape: dict[str, list[str]] = {}
    for s in strings:
        by_shape.setdefault(shape(s), []).append(s.translate(_TABLE))
    groups = sorted(by_shape.values(), key=len, reverse=True)
    made = []
    for classes in groups[: SHAPES - 1] + ([sum(groups[SHAPES - 1 :], [])] if len(groups) >= SHAPES else []):
        a = infer(classes)
        a.lengths = _lengths(classes)
        own = sorted(a.deviation(c) for c in classes)
        cut = int(LOWEST * (len(own) - 1))
        a.lowest, a.highest = min(-TYPICAL, own[cut]), max(TYPICAL, own[len(own) - 1 - cut])
        made.append(a)
    return made


def learn_formats(docs: DataFrame, max_docs: int = MAX_DOCS, per_kind: int = MAX_PER_KIND) -> Formats:
    """Automata from the base matches of a bounded sample of documents."""
    n = docs.count()
    place = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs if n <= max_docs else docs.filter(place < F.lit(max_docs / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for text in b["text"]:
                if isinstance(text, str):
                    spans = base_spans(text)
                    rows |= {(kind, secret) for _, kind, _, secret in spans}
                    covered = _Covered(spans)
                    rows |= {(3, m[0]) for m in CANDIDATE.finditer(text) if not covered.meets(m.start(), m.end())}
            yield pd.DataFrame(sorted(rows), columns=["kind", "secret"])

    found = stored(some.select("text").mapInPandas(run, "kind int, secret string").distinct().withColumn("_h", F.xxhash64("secret")), "secrets")
    shape_of = F.pandas_udf(lambda s: s.map(shape), "string")
    place_of = Window.partitionBy("kind", "_shape").orderBy("_h", "secret")  # distinct strings of the bounded sample
    ranked = found.withColumn("_shape", shape_of("secret")).withColumn("_rank", F.row_number().over(place_of)).filter(F.col("_rank") <= per_kind)
    strings: dict[int, list[str]] = {}
    for kind in range(4):  # at most ``per_kind`` strings each; ordinary ones as often as they come
        order = ["_rank", "_h", "secret"] if kind < 3 else ["_h", "secret"]
        rows = (ranked if kind < 3 else found).filter(F.col("kind") == kind).orderBy(*order).limit(per_kind).collect()
        strings[kind] = [r["secret"] for r in rows]
    return formats_of(strings)


def formats_of(strings: dict[int, list[str]]) -> Formats:
    """Automata of the labelled strings by kind; 3 are ordinary ones."""
    formats = Formats()
    if ordinary := strings.pop(3):
        formats.ordinary = infer([s.translate(_TABLE) for s in ordinary])
        formats.ordinary.lengths = _lengths(ordinary)
    for some_strings in strings.values():
        formats.kinds += automata(some_strings)
    return formats


class _Covered:
    """Whether a stretch meets one of the spans: of those that begin before its end, the furthest end decides."""

    def __init__(self, spans: list[tuple[int, int, int, str]]):
        ordered = sorted((s, e) for s, _, e, _ in spans)
        self.starts, self.furthest = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start


def all_spans(text: str, formats: Formats) -> list[tuple[int, int, int]]:
    """(start, kind number, end): base spans and learned ones, by start, then kind."""
    base = base_spans(text)
    covered = _Covered(base)
    more = [
        (m.start(), 3, m.end()) for m in CANDIDATE.finditer(text)
        if formats.looks_secret(m[0]) and not covered.meets(m.start(), m.end())]
    return sorted([s[:3] for s in base] + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # automata of a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                spans = all_spans(text, shared.value) if isinstance(text, str) else []
                kinds = [k for _, k, _ in spans]
                base = joined([s for s in spans if s[1] < 3])
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out

    return long_id(id_and_text(docs).mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each covered stretch replaced by the name of its first span."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(text: Column, formats: Formats, spark) -> Column:
    """The text column without its secrets; null stays null."""
    shared = spark.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, all_spans(t, shared.value)) if isinstance(t, str) else None)

    return run(text)
