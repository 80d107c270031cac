"""User models as columns: text scores and embeddings in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _chunks(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i:i + size]


def score_column(load: Callable[[], Callable[[Sequence[str]], Sequence[float]]], batch: int = 32):
    """Pandas UDF from ``load()`` (called once per task) returning a batch scorer.

    Blank texts score 0.0; a failing batch scores 0.0 too.
    """
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list[float] = []
            for chunk in _chunks(texts, batch):
                try:
                    values = [float(v) for v in model(chunk)]
                except Exception:
                    values = [0.0] * len(chunk)
                out += [v if t.strip() else 0.0 for v, t in zip(values, chunk)]
            yield pd.Series(out, index=part.index, dtype="float64")
    return scored


def score_text(df: DataFrame, load, column: str, out: str = "score", batch: int = 32) -> DataFrame:
    return df.withColumn(out, score_column(load, batch)(F.col(column)))


def embed_text(df: DataFrame, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], column: str | Column,
               out: str = "embedding", batch: int = 32) -> DataFrame:
    """Embedding column from a batch encoder."""
    @F.pandas_udf("array<float>")
    def embedded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            rows: list = []
            for chunk in _chunks(part.fillna("").tolist(), batch):
                rows += [list(map(float, v)) for v in model(chunk)]
            yield pd.Series(rows, index=part.index)
    return df.withColumn(out, embedded(F.col(column) if isinstance(column, str) else column))
