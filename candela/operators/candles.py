"""OHLCV bars: resampling, merging, bar features, sequence gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.operators.ordering import blocked, exact_quantiles, ordered_index, seconds

OHLCV = ("open", "high", "low", "close", "volume")
RESAMPLE_INTERVALS = ("1m", "5m", "15m", "1h", "4h", "1d")
FLOOR_INTERVALS = ("15m", "30m", "1h", "4h", "12h", "1d", "1w")


def bucket_start(ts: Column | str, interval: str) -> Column:
    """Start of the epoch-aligned interval that holds ``ts``."""
    width = seconds(interval)
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / F.lit(width)) * F.lit(width))


def _merge(df: DataFrame, interval: str, order: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys, bucket_start(ts, interval).alias("ts")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
    )


def ticks_as_bars(ticks: DataFrame) -> DataFrame:
    """One-price bars, so that ticks and candles resample alike."""
    return ticks.withColumns({c: F.col("price") for c in OHLCV[:4]})


def resample(df: DataFrame, interval: str, order: Sequence[str] = ("ts",), keys: Sequence[str] = ("symbol",),
             ts: str = "ts") -> DataFrame:
    """First/max/min/last/sum per interval; empty intervals do not appear.

    An interval outside ``RESAMPLE_INTERVALS`` returns the input unchanged.
    """
    if interval not in RESAMPLE_INTERVALS:
        return df
    bars = _merge(df, interval, order, keys, ts)
    return bars.dropna(subset=list(OHLCV))


def resample_floor(df: DataFrame, interval: str | None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarsen stored hourly bars: 1h passes, finer targets give no rows, unknown ones pass."""
    if not interval or interval == "1h" or interval not in FLOOR_INTERVALS:
        return df
    if seconds(interval) < 3600:
        return df.limit(0)
    return _merge(df, interval, ("ts",), keys, "ts")


def multi_timeframe(df: DataFrame, intervals: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """Bars of several intervals in one table with a ``timeframe`` column.

    The rows are merged to bars of the smallest interval first; only those are copied per interval, where all
    intervals are multiples of it.
    """
    least = min(intervals, key=seconds)
    if all(seconds(i) % seconds(least) == 0 for i in intervals):
        df, order = _merge(df, least, order, ("symbol",), "ts"), ("ts",)
    spread = df.withColumn("timeframe", F.explode(F.array(*[F.lit(i) for i in intervals])))
    width = F.create_map(*[F.lit(x) for i in intervals for x in (i, seconds(i))])[F.col("timeframe")]
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width)
    at = F.struct(*[F.col(c) for c in order])
    return spread.groupBy("symbol", "timeframe", start.alias("bar")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def merge_updates(target: DataFrame | None, batch: DataFrame, order: str = "offset") -> DataFrame:
    """Upsert rule of the candle store, as one aggregation over old and new rows.

    Open keeps the first value, close and volume take the latest, high and low
    widen, a known sequence number is not lost.  Within a batch only the latest
    update of a candle counts.
    """
    latest = dedupe_latest(batch, ["symbol", "ts"], order)
    rows = latest.select("symbol", "ts", *OHLCV, "sequence", F.lit(1).alias("_age"))
    if target is not None:
        rows = target.select("symbol", "ts", *OHLCV, "sequence", F.lit(0).alias("_age")).unionByName(rows)
    return rows.groupBy("symbol", "ts").agg(*merge_aggregates("_age"))


def merge_aggregates(order: str) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.max_by("volume", order).alias("volume"),
        F.max_by("sequence", F.when(F.col("sequence").isNotNull(), F.col(order))).alias("sequence"),
    ]


def replay_updates(updates: DataFrame, order: str = "offset") -> DataFrame:
    """The state after every update was merged one by one."""
    return updates.groupBy("symbol", "ts").agg(*merge_aggregates(order))


def dedupe_latest(df: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    """Latest row per key; a map-side aggregation, so copies never travel."""
    at = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*")


def dedupe_earliest(df: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    at = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*")


def infer_interval(df: DataFrame, keys: Sequence[str] = ("symbol",), rn: str = "rn") -> DataFrame:
    """Median gap between neighbouring bars and whether it looks like 1-minute data."""
    gaps = blocked(
        df, 1, lambda d, w: d.withColumn("gap", F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(w)), keys, rn
    ).filter("gap is not null").withColumn("gap", F.col("gap").cast("double"))
    median = exact_quantiles(gaps, "gap", {"median_gap": 0.5}, keys)
    return median.withColumn("is_1m", (F.col("median_gap") / 60.0).between(0.5, 2.0))


def bar_features(df: DataFrame) -> DataFrame:
    """Ten features of one bar; prices are floored at 1e-8, the ratios are clipped to ±1."""
    o, h, l, c, v = (F.col(x) for x in OHLCV)
    floor = lambda x: F.greatest(x, F.lit(1e-8))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))
    return df.withColumns({
        "log_open": F.log(floor(o)), "log_high": F.log(floor(h)), "log_low": F.log(floor(l)),
        "log_close": F.log(floor(c)), "log_volume": F.log1p(F.greatest(v, F.lit(0.0))),
        "log_body": clip(F.log(floor(c) / floor(o))), "body": clip((c - o) / floor(o)),
        "upper_wick": clip((h - F.greatest(o, c)) / floor(o)),
        "lower_wick": clip((F.least(o, c) - l) / floor(o)), "range": clip((h - l) / floor(o)),
    })


BAR_FEATURES = ("log_open", "log_high", "log_low", "log_close", "log_volume", "log_body", "body",
                "upper_wick", "lower_wick", "range")


def detect_gaps(df: DataFrame, keys: Sequence[str] = ("symbol",), seq: str = "sequence") -> DataFrame:
    """Missing sequence ranges: one row per jump of more than one."""
    key = list(keys)
    rows = ordered_index(df.select(*key, seq).filter(F.col(seq).isNotNull()).distinct(), [seq], key)
    seen = blocked(rows, 1, lambda d, w: d.withColumn("last_seq", F.lag(seq).over(w)), key)
    return seen.filter(F.col(seq) > F.col("last_seq") + 1).select(
        *key, F.col("last_seq").alias("from_seq"), (F.col(seq) - 1).alias("to_seq"),
        (F.col(seq) - F.col("last_seq") - 1).alias("gap_size"),
    )


def gap_stats(gaps: DataFrame, recovered: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Totals per key; ``recovered`` holds the sequence numbers that came back."""
    key = list(keys)
    width = 1024
    cells = gaps.withColumn("_c", F.explode(F.sequence(
        F.floor((F.col("from_seq") + 1) / width), F.floor(F.col("to_seq") / width))))
    hit = recovered.select(*key, "sequence", F.floor(F.col("sequence") / width).alias("_c")).distinct()
    back = (
        cells.join(hit, [*key, "_c"])
        .filter(F.col("sequence").between(F.col("from_seq") + 1, F.col("to_seq")))
        .groupBy(*key).agg(F.count(F.lit(1)).alias("total_recovered"))
    )
    totals = gaps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_gaps"), F.sum("gap_size").alias("total_missed"),
        F.max_by("from_seq", "to_seq").alias("last_from"), F.max("to_seq").alias("last_to"),
    )
    return totals.join(back, key, "left").fillna(0, ["total_recovered"])


def missed_klines(df: DataFrame, symbol: str, from_seq: int, to_seq: int, limit: int = 100) -> DataFrame:
    """Recovery scan: rows with ``from_seq < sequence <= to_seq`` in order."""
    if not symbol:
        raise ValueError("symbol is required")
    if from_seq >= to_seq:
        raise ValueError("from_seq must be less than to_seq")
    if to_seq - from_seq > 1000:
        raise ValueError("at most 1000 sequence numbers per request")
    return (
        df.filter((F.col("symbol") == symbol.upper()) & (F.col("sequence") > from_seq) & (F.col("sequence") <= to_seq))
        .orderBy("sequence").limit(limit)
    )


def history_page(df: DataFrame, symbol: str, before: str | Column, n: int) -> DataFrame:
    """The newest ``n`` candles before a time, oldest first."""
    at = F.lit(before).cast("timestamp") if isinstance(before, str) else before
    page = df.filter((F.col("symbol") == symbol) & (F.col("ts") < at))
    return page.orderBy(F.col("ts").desc()).limit(n).orderBy("ts")


def candles_between(df: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    return df.filter(
        (F.col("symbol") == symbol) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )


def last_n_per_key(df: DataFrame, key: Sequence[str], n: int, order: str = "ts") -> DataFrame:
    """Newest ``n`` rows per key; the rank limit is applied before the shuffle too."""
    window = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def latest_per_key(df: DataFrame, key: Sequence[str], order: str = "ts") -> DataFrame:
    return dedupe_latest(df, key, order)


def number_events(batch: DataFrame, order: Sequence[str], last_seq: DataFrame | None = None,
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per-symbol sequence numbers that continue after the stored maximum."""
    key = list(keys)
    numbered = ordered_index(batch, order, key, "_pos")
    if last_seq is None:
        return numbered.withColumnRenamed("_pos", "sequence")
    return (
        numbered.join(last_seq.select(*key, "last_seq"), key, "left")
        .withColumn("sequence", F.coalesce("last_seq", F.lit(0)) + F.col("_pos")).drop("_pos", "last_seq")
    )
