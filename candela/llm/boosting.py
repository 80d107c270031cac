"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, one pass.  The trees are fitted on the statistics (never the texts) of at most
``MAX_ROWS`` labelled documents per label: numbers of a stated size, gathered on the driver, where numpy builds histograms of
at most ``BINS`` quantile bins per statistic.  Trees are complete to ``DEPTH`` levels and stored as flat arrays; scoring
walks all documents of a batch down one level at a time.

Documents without a label take no part in the fit.  Null and empty texts have statistics of zero and get a score like
any other.  Repeated rows count as often as they come in the fit and get equal scores; an empty table gives no row; extra columns
are ignored.  With no labelled rows, or one label only, the score is that label's share (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.llm.common import id_and_text, long_id, sampled_by

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "punctuation", "symbol", "high_bytes", "line_words",
    "distinct_words", "top_word", "runs", "repeated_lines", "stop_marks", "exclamations", "bars", "short_words", "long_words",
    "repeated_triples", "marked_words",
)
MAX_ROWS = 10_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAST = 10
PENALTY = 1.0

_KIND = np.zeros(256, np.int64)
for _chars, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#*$%&<>", 5), (range(128, 256), 6), (b" \t\n\r\x0b\x0c", 7)):
    for _c in _chars:
        _KIND[_c] = _k
for _c in b".,;:!?'\"()-|":
    _KIND[_c] = 4


def statistics(data: bytes) -> list[float]:
    """Numbers that describe one text, in the order of ``STATISTICS``."""
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=counts, minlength=8) / n
    words = data.split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    triples = len(words) - 2
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0, *map(float, kind[1:7]), len(words) / max(1, len(lines)),
        len(seen) / m, max(seen.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)), counts[46] / m, counts[33] / m, counts[124] / m,
        float((lengths <= 2).sum()) / m, float((lengths >= 12).sum()) / m,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        sum(w[-1] in b"#*$%&!" for w in words) / m,
    ]


@dataclass
class Forest:
    """Complete trees: ``feature`` and ``cut`` per inner node, ``value`` per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Newton boosting of the logistic loss on binned statistics."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if not len(y) or share in (0.0, 1.0):
        return none
    p = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(p)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b holds x <= edges[b]
    out = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-out))
        grad, hess = y - prob, prob * (1 - prob)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            pick = np.full((width, 2), -1)
            for j in range(p):
                if not len(edges[j]):
                    continue
                cell = at * BINS + bins[:, j]
                sums = [np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess, None)]
                (g, h, c), (gt, ht, ct) = sums, (s[:, -1:] for s in sums)
                gain = g**2 / (h + PENALTY) + (gt - g) ** 2 / (ht - h + PENALTY) - gt**2 / (ht + PENALTY)
                gain = np.where((c >= LEAST) & (ct - c >= LEAST), gain, 0.0)[:, : len(edges[j])]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                pick[better] = np.stack([np.full(width, j), top], 1)[better]
            for k, (j, b) in enumerate(pick):
                if j >= 0:
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + PENALTY)
        out += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Forest(np.array(features), np.array(cuts), np.array(values), start)


def document_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and one column per statistic."""
    kept = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t.encode() if isinstance(t, str) else b"") for t in b["_text"]]
            yield pd.concat([b.drop(columns="_text"), pd.DataFrame(rows, columns=list(STATISTICS), dtype="float64", index=b.index)], axis=1)

    types = ", ".join([f"{n} {t}" for n, t in kept.drop("_text").dtypes] + [f"{s} double" for s in STATISTICS])
    return kept.mapInPandas(run, types)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Fit on documents that ``labels`` (doc_id, label) marks, at most about ``max_rows`` per label value."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = sampled_by(marked, "_y", "doc_id", max_rows)
    rows = docs.select("doc_id", "text").join(chosen.hint("broadcast"), "doc_id")  # at most 2 * max_rows ids
    # numpy sums depend on the order of rows
    table = document_statistics(rows, "doc_id", "_y").toPandas().sort_values(["doc_id", *STATISTICS])
    return fit(table[list(STATISTICS)].to_numpy(float), table["_y"].to_numpy(float))


def _scores(texts, forest: Forest) -> np.ndarray:
    rows = [statistics(t.encode() if isinstance(t, str) else b"") for t in texts]
    return forest.scores(np.array(rows).reshape(-1, len(STATISTICS)))


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = _scores(b["text"], shared.value)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return long_id(id_and_text(docs).mapInPandas(run, "doc_id string, score double, predicted int"))


def score_column(text: Column, forest: Forest, spark: SparkSession) -> Column:
    """The score as a column, for filters that keep the table as it is."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(texts, shared.value), index=texts.index)

    return run(text)
