"""Message normalisation: JSON text of several shapes to one row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions.arrays import let
from candela.functions.text import to_ts


def _object(json: Column) -> Column:
    """Top-level fields of a JSON object as text (nested objects stay JSON); one parse for all fields."""
    return F.from_json(json, "map<string,string>")


def _get(obj: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(obj, F.lit(n)) for n in names])


def _first(obj: Column, *names: str) -> Column:
    """First value that is present and neither empty nor 0."""
    return F.coalesce(*[F.nullif(F.nullif(F.try_element_at(obj, F.lit(n)), F.lit("")), F.lit("0")) for n in names])


def _is_object(col: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(col), F.lit("{")), F.lit(False))


def _exploded(raw: DataFrame, value_col: str, row: Column, known) -> DataFrame:
    """Fields of ``row`` where ``known(row)`` holds.

    The struct is built once per message and exploded; a filter on its fields
    would be pushed below the parsing and repeat it.
    """
    keep = [c for c in raw.columns if c != value_col]
    return raw.select(*keep, F.explode(F.filter(F.array(row), known)).alias("_r")).select(*keep, "_r.*")


def _unpack(raw: DataFrame, value_col: str, row: Column) -> DataFrame:
    """Fields of ``row`` where it names a symbol and a time."""
    return _exploded(raw, value_col, row, lambda r: r["symbol"].isNotNull() & r["ts"].isNotNull())


def normalize_klines(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """``{symbol, kline}``, ``data.k`` / ``k`` or flat messages; everything else is dropped.

    A message is parsed level by level: its own fields, ``data``, the candle.
    """
    num, whole = (lambda c: c.try_cast("double")), (lambda c: c.try_cast("bigint"))

    def candle(m: Column, d: Column) -> Column:
        nested = _is_object(_get(m, "kline"))
        packed = F.coalesce(_get(d, "k"), _get(m, "k", "K"))
        stream = ~nested & _is_object(packed)
        flat = _first(m, "s").isNotNull() & _first(m, "o", "c").isNotNull()
        inner = F.when(nested, _object(_get(m, "kline"))).when(stream, _object(packed)).when(flat, m)
        pick = lambda a, b, c: F.when(nested, a).when(stream, b).otherwise(c)

        def fields(k: Column) -> Column:
            opened = pick(_first(k, "openTime", "t", "T"), _first(k, "t"), _first(k, "t", "openTime"))
            closed = pick(_first(k, "closeTime", "T"), _first(k, "T"), _first(k, "T", "closeTime"))
            value = lambda long, short: num(pick(_first(k, long, short), _first(k, short), _first(k, short, long)))
            final = pick(_get(k, "isFinal", "x"), _get(k, "x"), _get(k, "x", "isFinal"))
            symbol = pick(F.coalesce(_first(m, "symbol"), _first(k, "s")), _first(k, "s"), _first(k, "s"))
            return F.struct(
                F.upper(symbol).alias("symbol"), F.coalesce(_first(m, "interval", "i"), _first(k, "i", "interval"), F.lit("1m")).alias("interval"),
                F.timestamp_millis(F.coalesce(whole(opened), whole(closed))).alias("ts"),
                F.timestamp_millis(whole(closed)).alias("close_time"), value("open", "o").alias("open"),
                value("high", "h").alias("high"), value("low", "l").alias("low"), value("close", "c").alias("close"),
                num(pick(_get(k, "volume", "v"), _get(k, "v"), _get(k, "v", "volume"))).alias("volume"),
                whole(F.coalesce(_first(m, "seq"), _first(k, "seq"))).alias("sequence"),
                (F.coalesce(final, F.lit("false")) == "true").alias("is_final"))
        return let(inner, fields)

    return _unpack(raw, value_col, let(_object(F.col(value_col)), lambda m: let(_object(_get(m, "data")), lambda d: candle(m, d))))


def normalize_cached_klines(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Tolerant variant of the price cache: missing prices take the close, the interval defaults to 1m."""
    def candle(m: Column) -> Column:
        packed = _get(m, "kline", "k")
        nested = _is_object(packed)

        def fields(k: Column) -> Column:
            t = F.when(nested, _first(k, "closeTime", "close_time", "openTime", "open_time", "t", "T")).otherwise(
                _first(k, "time", "ts", "open_time", "t")).try_cast("bigint")
            close = F.when(nested, _first(k, "close", "c")).otherwise(_first(k, "close", "c", "price")).try_cast("double")
            price = lambda a, b: F.coalesce(_first(k, a, b).try_cast("double"), close, F.lit(0.0))
            return F.struct(
                F.upper(F.coalesce(_first(m, "symbol", "s"), F.when(nested, _first(k, "s")))).alias("symbol"),
                F.coalesce(_first(m, "interval", "i"), F.lit("1m")).alias("interval"),
                F.timestamp_seconds(F.when(t > 1_000_000_000_000, F.floor(t / 1000)).otherwise(t)).alias("ts"),
                price("open", "o").alias("open"), price("high", "h").alias("high"), price("low", "l").alias("low"),
                F.coalesce(close, F.lit(0.0)).alias("close"),
                F.coalesce(_first(k, "volume", "v").try_cast("double"), F.lit(0.0)).alias("volume"))
        return let(F.when(nested, _object(packed)).otherwise(m), fields)

    body = lambda o: F.when(_is_object(_get(o, "data")), _object(_get(o, "data"))).otherwise(o)
    return _unpack(raw, value_col, let(_object(F.col(value_col)), lambda o: let(body(o), candle)))


def final_only(df: DataFrame) -> DataFrame:
    return df.filter("is_final")


# ------------------------------------------------------------------ news

def unwrap_raw(json: Column) -> Column:
    """Follow nested ``raw`` objects to the innermost one.

    The text itself tells how many levels there can be: one for each ``"raw"`` in it.  Each level is parsed once.
    """
    def level(json: Column, _: Column) -> Column:
        return let(F.get_json_object(json, "$.raw"), lambda inner: F.when(
            inner.isNull() | inner.isin("", "0", "false", "null"), json).otherwise(inner))
    return F.aggregate(F.array_repeat(F.lit(0), F.regexp_count(json, F.lit('"raw"'))), json, level)


def _probabilities(json: Column) -> Column:
    """``pos`` and ``neg`` of a probability map, parsed once; what is missing counts as 0."""
    def part(m: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)).try_cast("double"), F.lit(0.0)) for n in names], F.lit(0.0))
    return let(_object(json), lambda m: F.struct(part(m, "pos", "positive").alias("pos"), part(m, "neg", "negative").alias("neg")))


def _pos_neg(json: Column) -> Column:
    return let(_probabilities(json), lambda p: p["pos"] - p["neg"])


def signed_sentiment(label: Column, score: Column, raw: Column) -> Column:
    """Signed score from a probability map, a raw value, or a score and its label."""
    is_map = F.coalesce(F.ltrim(score).startswith("{"), F.lit(False))
    raw_map = F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False))
    number = score.try_cast("double")
    no_score = score.isNull() | (number == 0)
    by_label = (F.when(F.lower(label).isin("negative", "neg"), -F.abs(number))
                .when(F.lower(label) == "neutral", F.lit(0.0)).otherwise(number))
    return (F.when(is_map, _pos_neg(score))
            .when(no_score & raw_map & let(_probabilities(raw), lambda p: (p["pos"] != 0) | (p["neg"] != 0)), _pos_neg(raw))
            .when(score.isNull() & ~raw_map & raw.try_cast("double").isNotNull(), raw.try_cast("double"))
            .when(number.isNotNull(), by_label).otherwise(F.lit(0.0)))


def document_sentiment(score: Column, sentiment: Column) -> Column:
    """Stored documents: a number, a map with ``score``, or a map of probabilities."""
    value = F.coalesce(score, sentiment)
    number = value.try_cast("double")
    mapped = F.get_json_object(value, "$.score").try_cast("double")
    return F.coalesce(number, mapped, F.when(F.ltrim(value).startswith("{"), _pos_neg(value)), F.lit(0.0))


def normalize_news(raw: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """Analysed-news messages; without a url they are dropped, an unreadable time becomes ``now``."""
    v = F.col(value_col)

    def row(m: Column) -> Column:
        body = F.coalesce(_get(m, "raw", "raw_score", "sentiment"), v)
        return F.struct(
            F.coalesce(to_ts(_get(m, "published_at")), now if now is not None else F.current_timestamp()).alias("time"),
            _first(m, "url", "link").alias("url"), _get(m, "source").alias("source"), _get(m, "title").alias("title"),
            signed_sentiment(_get(m, "sentiment_label", "label"), _get(m, "sentiment_score", "score"), body).alias("sentiment_score"),
            unwrap_raw(body).alias("raw_score"))
    return _exploded(raw, value_col, let(_object(v), row), lambda r: r["url"].isNotNull())


# ------------------------------------------------------------------ insights and settings

def normalize_insights(raw: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """Insight messages: type, symbol and payload."""
    v = F.col(value_col)

    def row(m: Column) -> Column:
        meta, first = _get(m, "meta"), _get(m, "predictions")
        kind = F.when(meta.isNotNull() & first.isNotNull(), "aggregated_prediction").otherwise(F.coalesce(_first(m, "type"), F.lit("unknown")))
        symbols = [F.nullif(F.nullif(F.get_json_object(x, path), F.lit("")), F.lit("0")) for x, path in ((meta, "$.symbol"), (first, "$[0].symbol"))]
        stamp = [] if now is None else [now.alias("time")]
        return F.struct(*stamp, kind.alias("type"), F.coalesce(*symbols).alias("symbol"), F.coalesce(_get(m, "insight"), v).alias("payload"))
    return _exploded(raw.filter(F.try_parse_json(v).isNotNull()), value_col, let(_object(v), row), lambda r: F.lit(True))


def normalize_settings(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """User settings; incomplete messages are dropped."""
    def row(m: Column) -> Column:
        names = lambda n: F.coalesce(F.from_json(_get(n, "prediction_symbols"), "array<string>"), F.array().cast("array<string>"))
        return F.struct(_get(m, "user_id").alias("user_id"), _get(m, "email").alias("email"), let(_get(m, "notification_settings"), lambda n: F.when(
            n.isNotNull(), let(_object(n), lambda o: F.struct(
                names(o).alias("prediction_symbols"), F.coalesce(_get(o, "investment_enabled") == "true", F.lit(False)).alias("investment_enabled"))))).alias("_n"))
    known = lambda r: r["user_id"].isNotNull() & r["email"].isNotNull() & r["_n"].isNotNull()
    rows = _exploded(raw, value_col, let(_object(F.col(value_col)), row), known)
    return rows.select(*[c for c in rows.columns if c != "_n"], "_n.*")


def payload_field(json: Column, path: str) -> Column:
    return F.get_json_object(json, "$." + path)
