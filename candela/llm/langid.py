"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts hashed n-grams of at most ``MAX_DOCS`` labelled documents per language (chosen by the hash of their id),
keeps for each language the ``MAX_GRAMS`` most frequent ones that are not much more frequent elsewhere (n-grams of one
document alone count only for languages with no more than that many), and writes them
into Bloom filters of one size for all languages.  The filters are stored bit-sliced: cell ``i`` holds one bit per
language, so the cells of an n-gram combined with ``and`` give the mask of all languages that contain it.

A text is scored by how many of its n-grams each language contains (population counts per language bit), less the false positives that the
filter's fill predicts, divided by the share of the language's n-grams that its filter holds.  Texts are whole; long ones are cut into overlapping pieces whose counts add up.

Null texts and texts without a letter are ``und`` with score 0.  Without training rows everything is ``und``.  Equal
counts are decided by the order of the language names.  Rows that repeat an id are predicted each.  An empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from candela.llm.common import id_and_text, long_id, sampled_by, stored

WIDTH = 4
MAX_DOCS = 5_000
MAX_GRAMS = 30_000
HASHES = 3
BITS = 20  # cells: 2**BITS
ELSEWHERE = 4.0
CHUNK = 400_000
UNKNOWN = "und"


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all n-grams of the lower-cased text, with a space at either end."""
    codes = _code_points(f" {text.lower()} ")
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = h * np.uint64(0x100000001B3) + codes[i : len(h) + i] + np.uint64(1)
    return _mix(h)


def _cells(h: np.ndarray) -> list[np.ndarray]:
    """The cells of each hash, one array per hash function."""
    cells = np.uint64((1 << BITS) - 1)
    return [((h >> np.uint64(21 * k)) & cells).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str] = field(default_factory=list)
    cells: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.uint64))
    coverage: list[float] = field(default_factory=list)  # share of a language's n-grams (as often as they come) that its filter holds

    def __post_init__(self) -> None:
        n = len(self.languages)
        bits = [(self.cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(n)]
        self.false_rate = np.array([b.mean() ** HASHES for b in bits])

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], coverage: dict[str, float] | None = None) -> LanguageFilters:
        languages = sorted(grams)
        cells = np.zeros((1 << BITS, -(-len(languages) // 64)), np.uint64)
        for i, name in enumerate(languages):
            for at in _cells(grams[name].astype(np.uint64)):
                cells[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return cls(languages, cells, [(coverage or {}).get(name) or 1.0 for name in languages])

    def counts(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Corrected numbers of n-grams per text and language; ``starts``: where the texts begin in ``h``."""
        n = np.diff(np.append(starts, len(h)))
        out = np.zeros((len(starts), len(self.languages)))
        at = _cells(h)
        for word in range(self.cells.shape[1]):
            column = self.cells[:, word]
            mask = column[at[0]]
            for more in at[1:]:
                mask &= column[more]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                total = np.append(0, bit.cumsum())
                out[:, i] = total[starts + n] - total[starts]
        held = np.maximum(0, (out - n[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        return held / np.array(self.coverage or [1.0] * len(self.languages))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        result: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return result
        sums = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            if waiting:
                starts = np.cumsum([0] + [len(h) for _, h in waiting[:-1]])
                np.add.at(sums, [i for i, _ in waiting], self.counts(np.concatenate([h for _, h in waiting]), starts))
            waiting, held = [], 0

        known = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
        for i in known:
            text = texts[i]
            for at in range(0, len(text), CHUNK):
                waiting.append((i, gram_hashes(text[at : at + CHUNK + WIDTH - 3])))
                held += len(waiting[-1][1])
                if held > CHUNK:
                    flush()
        flush()
        total = sums.sum(1)
        for i in known:
            top = int(sums[i].argmax())
            result[i] = (self.languages[top], float(sums[i, top] / total[i]) if total[i] else 0.0)
        return result


def learn_languages(docs: DataFrame, max_docs: int = MAX_DOCS, max_grams: int = MAX_GRAMS) -> LanguageFilters:
    """Filters from rows with text and lang; n-grams are counted on the executors."""
    marked = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    chosen = sampled_by(marked, "lang", "doc_id", max_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, some in b.groupby("lang"):
                parts = [np.unique(gram_hashes(t)) for t in some["text"]]
                h, n = np.unique(np.concatenate(parts), return_counts=True)  # documents that hold the n-gram
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "n": n})

    counts = stored(chosen.select("lang", "text").mapInPandas(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "grams")
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return LanguageFilters()
    size = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))])
    totals = {r["lang"]: (r["grams"], r["n"]) for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n")).collect()}
    large = [name for name, (n, _) in totals.items() if n > max_grams]  # only these can do without what one document holds
    share = counts.filter((F.col("n") > 1) | ~F.col("lang").isin(*large)).withColumn("share", F.col("n") / F.element_at(size, F.col("lang")))
    top = share.groupBy("h").agg(F.max("share").alias("top"))
    typical = stored(share.join(top, "h").filter(F.col("share") * F.lit(ELSEWHERE) >= F.col("top")), "typical")
    grams, coverage = {}, {}
    for name in sizes:  # at most ``max_grams`` numbers each
        rows = typical.filter(F.col("lang") == name).orderBy(F.desc("share"), "h").limit(max_grams).select("h", "n").toPandas()
        grams[name] = rows["h"].to_numpy(np.int64).view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
        coverage[name] = float(rows["n"].sum()) / totals[name][1] if name in totals and len(rows) else 1.0
    return LanguageFilters.build(grams, coverage)


def identify_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**BITS cells: a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = shared.value.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return long_id(id_and_text(docs).mapInPandas(run, "doc_id string, lang_pred string, score double"))
