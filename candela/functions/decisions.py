"""Decision expressions: alerts, consensus, accuracy, prices, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions import lexicons as lx
from candela.functions.arrays import clip


def position_confidence(conf: Column, p_neutral: Column) -> Column:
    return conf * (1 - p_neutral)


def alert_decision(df: DataFrame) -> DataFrame:
    """Alert over two horizons from signal, confidence, max_prob, tau and gamma with suffix 1h / 4h."""
    c = F.col
    active = {h: (c(f"signal_{h}") != "HOLD") & (c(f"confidence_{h}") >= c(f"tau_{h}")) & (c(f"max_prob_{h}") >= c(f"gamma_{h}")) for h in ("1h", "4h")}
    a, b = active["1h"], active["4h"]
    conflict = a & b & (c("signal_1h") != c("signal_4h"))
    alert = (a | b) & ~conflict
    word = lambda x: F.when(x, "True").otherwise("False")
    detail = F.format_string("Eq.26 active horizons: 1h=%s (conf=%.3f, p=%.3f), 4h=%s (conf=%.3f, p=%.3f)", word(a), "confidence_1h", "max_prob_1h",
                             word(b), "confidence_4h", "max_prob_4h")
    reason = (F.when(~a & ~b, "No horizon passes Eq.26 thresholds")
              .when(conflict, F.format_string("Conflicting active horizons: 1h=%s, 4h=%s", "signal_1h", "signal_4h")).otherwise(detail))
    return df.withColumns({
        "alert": alert, "level": F.when(~alert, "abstain").when(a & b, "high").otherwise("medium"), "reason": reason,
        "signal": F.when(alert, F.when(a, c("signal_1h")).otherwise(c("signal_4h")))})


def signal_direction(signal: Column) -> Column:
    return F.when(signal == "BUY", "UP").when(signal == "SELL", "DOWN").otherwise("SIDEWAYS")


def signal_sentiment(signal: Column) -> Column:
    return F.when(signal == "BUY", "BULLISH").when(signal == "SELL", "BEARISH").otherwise("NEUTRAL")


def expected_price(price: Column, prob: Column, signal: Column) -> Column:
    move = F.abs(prob - 0.5) * 0.04
    value = F.when(signal == "BUY", price * (1 + move)).when(signal == "SELL", price * (1 - move)).otherwise(price)
    return F.when(price <= 0, price).otherwise(F.round(value, 2))


def insight_fields(df: DataFrame) -> DataFrame:
    """Directions, expected prices, range and volatility word of an insight."""
    c = F.col
    df = df.withColumns({f"expected_{h}": expected_price(c("current_price"), c(f"prob_{h}"), c(f"signal_{h}")) for h in ("1h", "4h")})
    low, high = F.least("current_price", "expected_4h"), F.greatest("current_price", "expected_4h")
    change = F.when(c("current_price") > 0, (c("expected_4h") - c("current_price")) / F.nullif(c("current_price"), F.lit(0.0)) * 100).otherwise(0.0)
    return df.withColumns({
        "direction_1h": signal_direction(c("signal_1h")), "direction_4h": signal_direction(c("signal_4h")),
        "sentiment": signal_sentiment(c("signal_1h")), "range_low": F.round(low * 0.98, 2), "range_high": F.round(high * 1.02, 2),
        "change_4h": F.round(change, 2),
        "volatility": F.when(c("confidence_1h") < 0.25, "low").when(c("confidence_1h") > 0.55, "high").otherwise("medium")})


def horizon_consensus(df: DataFrame) -> DataFrame:
    """Direction, confidence and change from both horizons, weighted by the time to the target (``hours``)."""
    c = F.col
    value = lambda s: F.when(s == "BUY", 1).when(s == "SELL", -1).otherwise(0)
    edge = {h: F.coalesce(c(f"p_up_{h}") - c(f"p_down_{h}"), value(c(f"signal_{h}")) * c(f"confidence_{h}")) for h in ("1h", "4h")}
    w1 = F.when(c("hours") <= 2, 0.7).when(c("hours") <= 6, 0.4).otherwise(0.25)
    w4 = 1 - w1
    agree = value(c("signal_1h")) == value(c("signal_4h"))
    score = edge["1h"] * w1 + edge["4h"] * w4
    change = clip(edge["1h"], -1, 1) * 2 * w1 + clip(edge["4h"], -1, 1) * 4 * w4
    conf = (c("confidence_1h") * w1 + c("confidence_4h") * w4) * F.when(agree, 1.0).otherwise(0.78)
    return df.withColumns({
        "consensus": score, "agrees": agree, "consensus_confidence": clip(conf, 0, 1), "change_percent": F.round(change, 2),
        "direction": F.when(score > 0.08, "UP").when(score < -0.08, "DOWN").otherwise("SIDEWAYS")})


def forecast_accuracy(actual: Column, predicted: Column, direction: Column, hours: Column, digits: int | None = 1) -> Column:
    """Same direction 50 + 50 similarity, opposite 0, otherwise 50 similarity."""
    eps = F.when(hours <= 2, 0.15).otherwise(0.30)
    word = F.upper(F.coalesce(direction, F.lit("")))
    want = F.when(word.isin("UP", "BUY"), "UP").when(word.isin("DOWN", "SELL"), "DOWN").otherwise("NEUTRAL")
    got = F.when(actual > 0, "UP").when(actual < 0, "DOWN").otherwise("NEUTRAL")
    sim = F.exp(-F.abs(actual - predicted) / F.greatest(2 * eps, F.abs(actual), F.abs(predicted)))
    opposite = ((want == "UP") & (got == "DOWN")) | ((want == "DOWN") & (got == "UP"))
    score = F.when(want == got, 50 + 50 * sim).when(opposite, 0.0).otherwise(50 * sim)
    return F.coalesce(F.round(score, digits) if digits is not None else score, F.lit(0.0))


def position_pnl(df: DataFrame) -> DataFrame:
    """Predicted price and profit, actual profit of a position."""
    coins = F.col("usdt_amount") / F.col("buy_price")
    price = F.col("buy_price") * (1 + F.col("change_percent") / 100)
    df = df.withColumns({"coin_amount": coins, "predicted_price": price, "predicted_profit_usdt": (price - F.col("buy_price")) * coins})
    if "sell_price" not in df.columns:
        return df
    profit = F.col("sell_price") * F.col("coin_amount") - F.col("usdt_amount")
    return df.withColumns({"actual_profit_usdt": profit, "actual_profit_percent": profit / F.col("usdt_amount") * 100})


def advice_class(df: DataFrame) -> DataFrame:
    """Advice UP / DOWN / UNCLEAR and its first text line."""
    c = F.col
    firm = (c("confidence") >= 0.55) & F.coalesce(c("agrees"), F.lit(True))
    kind = F.when((c("direction") == "UP") & firm, "UP").when((c("direction") == "DOWN") & firm, "DOWN").otherwise("UNCLEAR")
    up = F.format_string("Dự đoán giá sẽ TĂNG %.2f%% (độ tin cậy %.1f%%)", c("change_percent"), c("confidence") * 100)
    down = F.format_string("Dự đoán giá sẽ GIẢM %.2f%% (độ tin cậy %.1f%%)", F.abs("change_percent"), c("confidence") * 100)
    weak = F.format_string("Kết quả tổng hợp có độ tin cậy %.1f%%", c("confidence") * 100)
    return df.withColumn("advice", kind).withColumn("advice_text", F.when(kind == "UP", up).when(kind == "DOWN", down).otherwise(weak))


def _lookup(col: Column, table: dict, default: Column) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default)


def explanation_text(df: DataFrame, asset: str = "BTC", max_titles: int = 3, max_factors: int = 2, title_chars: int = 120) -> DataFrame:
    """Template text from direction, confidence, horizon, top titles, top factors and the alert flag.

    Columns: direction, confidence, horizon, titles (array), factors (array of
    names), alert, return_pred (may be null).  A title longer than ``title_chars``
    is cut and ends in three dots within that length.
    """
    c = F.col
    way = _lookup(c("direction"), lx.DIRECTION_TEXT, F.lit("không xác định"))
    named = F.transform(F.slice("factors", 1, max_factors), lambda f: _lookup(f, lx.FACTOR_TEXT, F.replace(f, F.lit("_"), F.lit(" "))))
    factors = F.when(F.size("factors") == 0, "không có yếu tố nổi bật").otherwise(F.array_join(named, " và "))

    def cut(title, i):
        t = F.rtrim(F.trim(title), F.lit("."))
        t = F.when(F.length(t) > title_chars, F.concat(F.substring(t, 1, title_chars - 3), F.lit("..."))).otherwise(t)
        return F.concat(F.lit("("), F.char(i + 97), F.lit(") "), t)
    proof = F.array_join(F.transform(F.slice("titles", 1, max_titles), cut), "; ")
    moved = F.format_string("Mức thay đổi kỳ vọng: %s%.2f%%.", F.when(c("return_pred") >= 0, "+").otherwise(""), c("return_pred") * 100)
    fired = F.format_string("Quyết định: PHÁT CẢNH BÁO (ĉ=%.2f đạt ngưỡng tin cậy và phân phối dự báo đủ sắc nét).", c("confidence"))
    quiet = F.format_string("Quyết định: GIỮ IM LẶNG (ĉ=%.2f chưa đạt ngưỡng — tránh phát tín hiệu khi bất định cao).", c("confidence"))
    lines = F.array_compact(F.array(
        F.concat(F.lit(f"Tín hiệu: {asset} có khả năng "), way, F.lit(" trong "), c("horizon"), F.lit(" tới.")),
        F.when(c("return_pred").isNotNull(), moved), F.format_string("Độ tin cậy: %.2f.", c("confidence")),
        F.when(F.size("titles") > 0, F.concat(F.lit("Bằng chứng chính: "), proof, F.lit("."))),
        F.when(F.size("factors") > 0, F.concat(F.lit("Yếu tố chi phối: "), factors, F.lit("."))),
        F.concat(F.lit("Giải thích: Mô hình nhận thấy tín hiệu "), way, F.lit(" hiện tại được hỗ trợ bởi "), factors,
                 F.lit(" kết hợp với bối cảnh thị trường đa khung thời gian; các tin còn lại được xem là ít quan trọng hơn hoặc trùng lặp ngữ nghĩa.")),
        F.when(c("alert"), fired).otherwise(quiet)))
    return df.withColumn("explanation", F.array_join(lines, "\n"))
