"""Small business tables: insights, positions, users, settings, crawl sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions.decisions import forecast_accuracy, position_pnl
from candela.operators.candles import dedupe_latest
from candela.operators.joins import asof_join
from candela.operators.ordering import ordered_index, rows_at


def _ts(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


# ------------------------------------------------------------------ insights

def query_insights(df: DataFrame, start=None, end=None, type: str | None = None, symbol: str | None = None, limit: int = 100) -> DataFrame:
    """Optional predicates, newest first; a page has at most 2000 rows."""
    if limit > 2000:
        raise ValueError("a page has at most 2000 rows")
    if start is not None:
        df = df.filter(F.col("time") >= _ts(start))
    if end is not None:
        df = df.filter(F.col("time") <= _ts(end))
    if type:
        df = df.filter(F.col("type") == type)
    if symbol:
        df = df.filter(F.col("symbol") == symbol.upper())
    return df.orderBy(F.col("time").desc(), *[F.col(c).desc() for c in ("offset",) if c in df.columns]).limit(limit)


PREDICTIONS_SCHEMA = ("array<struct<symbol:string,should_alert:boolean,current_price:double,forecast:struct<"
                      "next_1h:struct<direction:string,confidence:double>,next_4h:struct<direction:string,confidence:double>,"
                      "next_24h:struct<direction:string,confidence:double>>>>")


def payload_predictions(insights: DataFrame) -> DataFrame:
    """One row per prediction inside the payload."""
    return insights.select(*[c for c in insights.columns if c != "payload"], F.posexplode(
        F.from_json(F.get_json_object("payload", "$.predictions"), PREDICTIONS_SCHEMA)).alias("_i", "prediction"))


def latest_prediction_in_payload(insights: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Newest prediction of each symbol over all insight rows."""
    rows = payload_predictions(insights.filter("type = 'aggregated_prediction'").drop("symbol"))
    rows = rows.select(F.col("prediction.symbol").alias("symbol"), "time", "_i", "prediction")
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(*symbols))
    return dedupe_latest(rows, ["symbol"], F.struct("time", -F.col("_i"))).select("symbol", "time", "prediction")


def notifiable(predictions: DataFrame, min_conf: float = 50) -> DataFrame:
    """Open alerts with enough confidence; the forecast is next_24h, else next_1h."""
    forecast = F.coalesce(F.col("prediction.forecast.next_24h"), F.col("prediction.forecast.next_1h"))
    rows = predictions.withColumn("forecast", forecast).filter(F.coalesce(F.col("prediction.should_alert"), F.lit(False)))
    return rows.filter(F.coalesce(F.col("forecast.confidence"), F.lit(0.0)) >= min_conf)


def active_users(users: DataFrame) -> DataFrame:
    return users.filter(F.coalesce("email_verified", F.lit(True)) & (F.lower(F.coalesce("status", F.lit("active"))) == "active") & F.col("email").isNotNull())


EVERYONE = "active"  # the class of all verified active users


def recipient_members(users: DataFrame) -> DataFrame:
    """(recipients, user_id, email): who belongs to which class of recipients."""
    return active_users(users).select(F.lit(EVERYONE).alias("recipients"), "user_id", "email")


def addressed(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """Alerts with their class of recipients and the number of its members.

    Every user of a class gets every alert sent to it, so a row per alert and a row per member say all that the pairs
    would; the pairs are never written.
    """
    sizes = members.groupBy("recipients").agg(F.count(F.lit(1)).alias("n_recipients"))
    sent = alerts.withColumn("recipients", F.lit(EVERYONE)).join(F.broadcast(sizes), ["recipients"], "left")  # a row per class
    return sent.withColumn("n_recipients", F.coalesce("n_recipients", F.lit(0).cast("bigint")))


def per_recipient(sent: DataFrame, members: DataFrame, by: Sequence[str] = (), **figures: Column) -> DataFrame:
    """``figures`` (aggregates over addressed alerts) for every member, per ``by``: aggregated per class, then joined to it."""
    per_class = sent.groupBy("recipients", *by).agg(*[c.alias(n) for n, c in figures.items()])
    return members.join(per_class, ["recipients"]).select("user_id", *by, *figures)


def result_recipients(results: DataFrame, users: DataFrame) -> DataFrame:
    return results.join(active_users(users).select("user_id", "email"), ["user_id"])


# ------------------------------------------------------------------ positions

def due_positions(df: DataFrame, now: str | Column) -> DataFrame:
    return df.filter((F.col("status") == "active") & (F.col("target_sell_time") <= _ts(now)))


def close_positions(positions: DataFrame, candles: DataFrame, now: str | None = None) -> DataFrame:
    """Sell price (latest close at ``now`` or at each target time), profit and forecast accuracy."""
    at = F.col("target_sell_time") if now is None else _ts(now)
    prices = candles.select("symbol", F.col("ts").alias("price_ts"), F.col("close").alias("sell_price"))
    rows = position_pnl(asof_join(positions.withColumn("_at", at), prices, "_at", "price_ts").drop("_at"))
    word = F.when(F.col("change_percent") > 0, "UP").when(F.col("change_percent") < 0, "DOWN").otherwise("NEUTRAL")
    return rows.filter("sell_price is not null").withColumn("accuracy", forecast_accuracy(
        F.col("actual_profit_percent"), F.col("change_percent"), word, F.lit(1)))


def price_change(candles: DataFrame, now: str, lookbacks: Mapping[str, int]) -> DataFrame:
    """Percent change per symbol and look-back against the last close at or before the earlier time."""
    until = candles.filter(F.col("ts") <= _ts(now))
    before = lambda s: F.col("ts") <= F.timestamp_seconds(F.unix_seconds(_ts(now)) - s)
    aggs = [F.max_by("close", "ts").alias("price")] + [F.max_by("close", F.when(before(s), F.col("ts"))).alias(f"_{k}") for k, s in lookbacks.items()]
    wide = until.groupBy("symbol").agg(*aggs)
    rows = wide.select("symbol", "price", F.explode(F.array(*[F.struct(F.lit(k).alias("lookback"), F.col(f"_{k}").alias("old_price")) for k in lookbacks])).alias("x"))
    return rows.select("symbol", "price", "x.*").filter("old_price is not null").withColumn(
        "change_percent", (F.col("price") - F.col("old_price")) / F.col("old_price") * 100)


# ------------------------------------------------------------------ users, settings, pages

def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """One page of rows with the total and the number of pages; a far page reads only the rows around it."""
    rows, total = rows_at(df, order, (number - 1) * size, size)
    return rows.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))  # one row


def consolidate_settings(prefs: DataFrame) -> DataFrame:
    """One row per user from one row per (user, type, symbol)."""
    on = F.col("enabled")
    return prefs.groupBy("user_id").agg(
        F.max("email").alias("email"),
        F.array_sort(F.collect_set(F.when((F.col("type") == "PREDICTION") & on, F.col("symbol")))).alias("prediction_symbols"),  # symbols of one user
        F.bool_or((F.col("type") == "INVESTMENT") & on).alias("investment_enabled"), F.max("updated_at").alias("updated_at"))


def flatten_settings(settings: DataFrame) -> DataFrame:
    """(type, symbol, enabled) rows of consolidated settings."""
    row = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("symbol"), F.lit(True).alias("enabled"))
    symbols = F.transform(F.coalesce("prediction_symbols", F.array().cast("array<string>")), lambda s: row("PREDICTION", s))
    invest = F.when(F.col("investment_enabled"), F.array(row("INVESTMENT", F.lit("ALL")))).otherwise(F.slice(F.array(row("INVESTMENT", F.lit("ALL"))), 1, 0))
    return settings.select("user_id", F.explode(F.concat(symbols, invest)).alias("_s")).select("user_id", "_s.*")


def duplicate_keys(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def retain_valid(tokens: DataFrame, now: str | Column) -> DataFrame:
    """Tokens that neither expired nor were revoked (the rest is dropped on rewrite)."""
    return tokens.filter(~((F.col("expires_at") < _ts(now)) | F.col("is_revoked")))


def valid_tokens(tokens: DataFrame, now: str | Column) -> DataFrame:
    return tokens.filter((F.col("expires_at") > _ts(now)) & ~F.col("is_revoked"))


def source_health(crawls: DataFrame, key: str = "url", order: Sequence[str] = ("crawled_at", "crawl_id")) -> DataFrame:
    """Crawls, errors since the last success and last time per source.

    The error streak is the number of crawls minus the position of the last
    success; both are plain aggregates over row positions.
    """
    rows = ordered_index(crawls.select(key, *order, "error"), list(order), [key])
    ok = F.max(F.when(~F.col("error"), F.col("rn")))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("crawl_count"), (F.max("rn") - F.coalesce(ok, F.lit(0))).alias("error_count"),
        F.max(order[0]).alias("last_crawled_at"))
