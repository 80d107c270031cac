"""Keyed state of the streams: newest candles and sequence numbers seen.

State lives in the state store, bounded per key, and a batch touches only the keys of its rows.  Keys are parts of a
symbol, so a hot symbol is the work of several tasks.  What changed goes to a batch log with a version that rises with
every change; a read takes the last version of each entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candela.operators.candles import OHLCV, dedupe_latest, detect_gaps, last_n_per_key

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_NUMBER = -(1 << 63)
SLOTS = 8
BLOCK = 1 << 16

CANDLE = ", ".join(["at long", *[f"{c} double" for c in OHLCV], "number long", "version long"])
RUNS = "starts array<long>, ends array<long>"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started inside; other queries keep their own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class NewestCandles(StatefulProcessor):
    """The ``n`` newest candles of a key; among updates of one the highest number wins, the later of equal ones.

    An update without a number loses to any with one.  Candles older than all ``n`` are passed over.
    """

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candles = handle.getListState("candles", CANDLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r) for r in self.candles.get()}
        changed: set[int] = set()
        for some in rows:
            # within a batch the last of the highest numbers is enough
            some = some.sort_values("number", kind="stable").drop_duplicates("at", keep="last")
            for at, *values, number in some[["at", *OHLCV, "number"]].itertuples(index=False, name=None):
                old = held.get(at)
                if old is None or number >= old[-2]:
                    held[at] = (at, *map(float, values), int(number), old[-1] + 1 if old else 0)
                    changed.add(at)
            for at in sorted(held)[: max(len(held) - self.n, 0)]:
                del held[at]
                changed.discard(at)
        if changed:
            self.candles.put(list(held.values()))
            out = pd.DataFrame([held[at] for at in sorted(changed)], columns=["at", *OHLCV, "number", "version"])
            yield out.assign(symbol=key[0], interval=key[1])[["symbol", "interval", *out.columns]]

    def close(self) -> None:
        pass


def newest_candles(rows: DataFrame, n: int, slots: int = SLOTS) -> DataFrame:
    """Changed candles of a stream of (symbol, interval, ts, OHLCV, sequence), with their version."""
    parts = rows.select(
        "symbol", "interval", F.pmod(F.xxhash64("ts"), F.lit(slots)).alias("slot"), F.unix_micros("ts").alias("at"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV], F.coalesce("sequence", F.lit(NO_NUMBER)).alias("number"))
    changed = parts.groupBy("symbol", "interval", "slot").transformWithStateInPandas(
        NewestCandles(n), f"symbol string, interval string, {CANDLE}", "Update", "None")
    return changed.select("symbol", "interval", F.timestamp_micros("at").alias("ts"), *[F.nanvl(c, F.lit(None)).alias(c) for c in OHLCV],
                          F.nullif("number", F.lit(NO_NUMBER)).alias("sequence"), "version")


def merge_newest(log: DataFrame, n: int) -> DataFrame:
    """Last versions of the newest ``n`` candles per symbol and interval."""
    return last_n_per_key(dedupe_latest(log, ["symbol", "interval", "ts"], "version"), ["symbol", "interval"], n)


class SeenNumbers(StatefulProcessor):
    """Runs of consecutive numbers seen in a block of numbers; a late number closes or splits its gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", RUNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.runs.get() if self.runs.exists() else ([], [])
        starts, ends = (np.array(side, np.int64) for side in known)
        before = int((ends - starts + 1).sum())
        for some in rows:
            new = np.unique(some["sequence"].to_numpy(np.int64))
            starts, ends = joined_runs(np.concatenate([starts, new]), np.concatenate([ends, new]))
        seen = int((ends - starts + 1).sum())
        if seen > before:
            self.runs.update((starts.tolist(), ends.tolist()))
            yield pd.DataFrame({"symbol": [key[0]], "block": [key[1]], "starts": [starts], "ends": [ends], "seen": [seen]})

    def close(self) -> None:
        pass


def joined_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of closed runs of whole numbers; runs that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1] + 1])
    return starts[first], reach[np.concatenate([first[1:], [True]])]


def seen_numbers(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Changed blocks of a stream of (symbol, sequence): runs seen and how many numbers they hold."""
    parts = rows.filter("sequence is not null").select("symbol", F.floor(F.col("sequence") / F.lit(block)).alias("block"), "sequence")
    return parts.groupBy("symbol", "block").transformWithStateInPandas(
        SeenNumbers(), f"symbol string, block long, {RUNS}, seen long", "Update", "None")


def merge_seen(log: DataFrame) -> DataFrame:
    """Last state of each block: it holds the most numbers."""
    return dedupe_latest(log, ["symbol", "block"], "seen")


def gaps_of_runs(blocks: DataFrame) -> DataFrame:
    """(symbol, from_seq, to_seq, gap_size) between runs, inside blocks and across their borders.

    ``from_seq`` is the number before the gap.
    """
    inside = blocks.select("symbol", F.inline(F.arrays_zip(
        F.slice("ends", F.lit(1), F.size("ends") - 1).alias("from_seq"), F.slice("starts", F.lit(2), F.size("starts") - 1).alias("next"))))
    inside = inside.select("symbol", "from_seq", (F.col("next") - 1).alias("to_seq"), (F.col("next") - F.col("from_seq") - 1).alias("gap_size"))
    edges = blocks.select("symbol", "block", F.element_at("starts", 1).alias("low"), F.element_at("ends", -1).alias("high"))
    ends = edges.select("symbol", F.explode(F.array("low", "high")).alias("sequence"))
    # low and high of one block are neighbours here too, and no gap
    own = edges.select("symbol", F.col("low").alias("from_seq"), (F.col("high") - 1).alias("to_seq"))
    return inside.unionByName(detect_gaps(ends).join(own, ["symbol", "from_seq", "to_seq"], "left_anti"))
