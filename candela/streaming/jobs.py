"""Structured Streaming jobs for candles, news, insights, alerts and settings.

All sinks are batch logs (``candela.streaming.logs``), folded into snapshots as
they grow.  Late updates of a closed candle still merge, however late they come:
no sink has a watermark on event time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.operators.candles import OHLCV, dedupe_earliest, dedupe_latest
from candela.operators.tables import addressed, notifiable, payload_predictions, recipient_members
from candela.sources.imports import insert_new
from candela.sources.messages import normalize_insights, normalize_klines, normalize_news, normalize_settings
from candela.streaming import logs
from candela.streaming.state import gaps_of_runs, keyed_state, merge_newest, merge_seen, newest_candles, seen_numbers

# Topics of the message flow.
TOPICS = ("market.prices", "news_raw", "news_analyzed", "ai_insights", "investment_results", "user_settings_updated")

URL_BUCKETS = 64


def read_stream(spark: SparkSession, fmt: str, options: Mapping[str, str], schema: str | None = None) -> DataFrame:
    """Stream of messages with a text column ``value`` (Kafka keys and values become text)."""
    reader = spark.readStream.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load()
    if fmt == "kafka":
        df = df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")
    return df


def to_kafka(stream: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Publish rows as JSON messages."""
    out = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


# ------------------------------------------------------------------ candles

def partial_candles(rows: DataFrame, order: str) -> DataFrame:
    """Mergeable state of each candle in one batch: first open, last close, extremes."""
    known = F.when(F.col("sequence").isNotNull(), F.col(order))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("open", order).alias("open"), F.min(order).alias("first_at"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.max_by("volume", order).alias("volume"), F.max(order).alias("last_at"),
        F.max_by("sequence", known).alias("sequence"), F.max(known).alias("sequence_at"))


def merge_partials(log: DataFrame) -> DataFrame:
    return log.groupBy("symbol", "ts").agg(
        F.min_by("open", "first_at").alias("open"), F.min("first_at").alias("first_at"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_at").alias("close"), F.max_by("volume", "last_at").alias("volume"), F.max("last_at").alias("last_at"),
        F.max_by("sequence", "sequence_at").alias("sequence"), F.max("sequence_at").alias("sequence_at"))


def read_klines(spark: SparkSession, sink: str) -> DataFrame:
    """The merged candle table behind a kline sink."""
    return merge_partials(logs.read_log(spark, sink)).select("symbol", "ts", *OHLCV, "sequence")


def stream_klines(messages: DataFrame, sink: str, checkpoint: str, order: str | None = None, trigger: dict | None = None):
    """Messages to merged candles.

    ``order`` names the column that orders updates (``offset`` of Kafka, or a
    sequence); without it later batches win.
    """
    rows = normalize_klines(messages)

    def handle(batch: DataFrame, batch_id: int) -> None:
        at = order or "_batch"
        batch = batch if order else batch.withColumn("_batch", F.lit(batch_id))
        logs.write_batch(partial_candles(batch, at), sink, batch_id, merge_partials)
    return logs.start(rows, handle, checkpoint, trigger)


def stream_candles(ticks: DataFrame, sink: str, checkpoint: str, interval: str = "1 hour", trigger: dict | None = None):
    """Tumbling OHLCV over ticks: partial bars per batch, merged when read, so late ticks count too."""
    at = F.struct("ts", "event_id")
    bars = ticks.withColumn("ts_bar", F.window("ts", interval)["start"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy("symbol", F.col("ts_bar").alias("bar")).agg(
            F.min_by("price", at).alias("open"), F.min(at).alias("first_at"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.max(at).alias("last_at"), F.sum("volume").alias("volume"))
        logs.write_batch(partial, sink, batch_id, merge_bars)
    return logs.start(bars, handle, checkpoint, trigger)


def merge_bars(log: DataFrame) -> DataFrame:
    return log.groupBy("symbol", "bar").agg(
        F.min_by("open", "first_at").alias("open"), F.min("first_at").alias("first_at"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_at").alias("close"), F.max("last_at").alias("last_at"), F.sum("volume").alias("volume"))


def read_candles(spark: SparkSession, sink: str) -> DataFrame:
    """The merged bars behind a tick sink."""
    return merge_bars(logs.read_log(spark, sink)).select("symbol", F.col("bar").alias("ts"), *OHLCV)


def stream_last_n(messages: DataFrame, sink: str, checkpoint: str, n: int = 2000, trigger: dict | None = None):
    """Newest ``n`` candles per symbol and interval, kept as keyed state; a batch writes only what it changed.

    Updates of a candle are ordered by sequence number; those without one come before, in order of their batches.
    """
    changed = newest_candles(normalize_klines(messages).select("symbol", "interval", "ts", *OHLCV, "sequence"), n)
    with keyed_state(messages.sparkSession):
        return logs.start(changed, lambda b, i: logs.write_batch(b, sink, i, lambda log: merge_newest(log, n)), checkpoint, trigger, "update")


def read_state(spark: SparkSession, sink: str, n: int = 2000) -> DataFrame:
    """The newest ``n`` candles behind a price cache."""
    return merge_newest(logs.read_log(spark, sink).drop("batch_id"), n).drop("version")


def stream_gaps(messages: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Sequence numbers seen per symbol, in any order and over all batches; ``read_gaps`` gives the gaps left."""
    seen = seen_numbers(normalize_klines(messages).select("symbol", "sequence"))
    with keyed_state(messages.sparkSession):
        return logs.start(seen, lambda b, i: logs.write_batch(b, sink, i, merge_seen), checkpoint, trigger, "update")


def read_gaps(spark: SparkSession, sink: str) -> DataFrame:
    """Gaps that are open after the batches so far."""
    return gaps_of_runs(merge_seen(logs.read_log(spark, sink).drop("batch_id")))


# ------------------------------------------------------------------ news, insights, settings, alerts

def seen_urls(stream: DataFrame, ttl: str = "7 days", key: str = "url") -> DataFrame:
    """First row per url; a url is forgotten ``ttl`` after it arrived.  The age of an article plays no part."""
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", ttl)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def stream_news(messages: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Analysed news without urls that are stored already; of a url's rows in one batch the earliest stays.

    The urls stored so far lie in an index by hash bucket beside the news; a batch opens only the buckets of its own urls.
    """
    rows = normalize_news(messages)
    spark = messages.sparkSession
    index = f"{sink.rstrip('/')}-urls"
    bucket = F.pmod(F.xxhash64("url"), F.lit(URL_BUCKETS)).cast("int")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = dedupe_earliest(batch, ["url"], F.struct("time"))
        known = logs.read_log(spark, index, batch_id)
        if known is not None:
            mine = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most URL_BUCKETS numbers
            batch = insert_new(batch, known.filter(F.col("bucket").isin(mine)))
        logs.write_batch(batch, sink, batch_id)
        # the index comes last: a batch that is repeated reads what was there before it
        new = spark.read.parquet(logs.batch_path(spark, sink, batch_id)).select("url", bucket.alias("bucket"))
        logs.write_batch(new, index, batch_id, lambda log: log, by=["bucket"])
    return logs.start(rows, handle, checkpoint, trigger)


def stream_insights(messages: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Insight messages appended with their arrival time."""
    rows = normalize_insights(messages, now=F.current_timestamp())
    return logs.start(rows, lambda b, i: logs.write_batch(b, sink, i), checkpoint, trigger)


def stream_settings(messages: DataFrame, sink: str, checkpoint: str, order: str = "offset", trigger: dict | None = None):
    """User settings, last write per user."""
    rows = normalize_settings(messages)

    def latest(log: DataFrame) -> DataFrame:
        return dedupe_latest(log, ["user_id"], order)
    return logs.start(rows, lambda b, i: logs.write_batch(latest(b), sink, i, latest), checkpoint, trigger)


def read_settings(spark: SparkSession, sink: str, order: str = "offset") -> DataFrame:
    return dedupe_latest(logs.read_log(spark, sink).drop("batch_id"), ["user_id"], order).drop(order)


def stream_alerts(messages: DataFrame, users: DataFrame, sink: str, checkpoint: str, min_conf: float = 50, trigger: dict | None = None):
    """Alerts of the insight stream, sent to the class of verified active users as it is when their batch arrives."""
    rows = notifiable(payload_predictions(normalize_insights(messages)), min_conf)
    alerts = rows.select(F.col("prediction.symbol").alias("symbol"), F.col("forecast.direction").alias("direction"),
                         F.col("forecast.confidence").alias("confidence"))
    return logs.start(alerts, lambda b, i: logs.write_batch(addressed(b, recipient_members(users)), sink, i), checkpoint, trigger)


# ------------------------------------------------------------------ scheduled decisions

def decision_batch(candles: DataFrame, news: DataFrame, model_output: DataFrame, horizon: str = "1h") -> DataFrame:
    """Per symbol and hour: features, selected-news figures, news window and the alert decision.

    ``model_output`` brings signal, confidence, max_prob, tau and gamma of both
    horizons per (symbol, ts); ``candles`` has positions.
    """
    from candela.functions.decisions import alert_decision
    from candela.operators.indicators import fill_warmup, technical_indicators
    from candela.operators.news import news_window_stats, selected_news_stats, top_k_news

    wanted = model_output.select("symbol", "ts")
    features = fill_warmup(technical_indicators(candles), ("rsi_14", "macd_hist", "bb_pos", "stoch_rsi"), "carry").select(
        "symbol", "ts", "close", "rsi_14", "macd_hist", "bb_pos", "stoch_rsi")
    rows = features.join(wanted, ["symbol", "ts"])
    rows = news_window_stats(rows, news, 1.0).select(*rows.columns, "news_count", "vader_mean", "bullish_ratio")
    rows = selected_news_stats(rows, top_k_news(wanted, news, horizon), news).select(
        *rows.columns, "selected_news_count", "weighted_sentiment")
    return alert_decision(rows.join(model_output, ["symbol", "ts"]))
