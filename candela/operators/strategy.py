"""User strategies: JSON conditions compiled to Column expressions.

A strategy row context has the back-test indicators (``*_bt``), ``close``, the
prediction columns and ``news_count`` / ``news_sentiment``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Indicator names a condition may use, and the columns behind them.
INDICATORS = {
    "rsi": "rsi_bt", "macd": "macd_bt", "macd_signal": "macd_signal_bt", "macd_histogram": "macd_histogram_bt",
    "ema20": "ema20_bt", "ema50": "ema50_bt", "sma20": "sma20_bt", "sma50": "sma50_bt", "bb_upper": "bb_upper_bt",
    "bb_middle": "bb_middle_bt", "bb_lower": "bb_lower_bt", "atr": "atr_bt", "current_price": "close",
    "price_above_ema20": "price_above_ema20", "price_above_sma50": "price_above_sma50", "rsi_overbought": "rsi_overbought",
    "rsi_oversold": "rsi_oversold", "macd_bullish": "macd_bullish", "bb_squeeze": "bb_squeeze",
}
# Prediction fields with fallbacks, in order.
AI_ALIASES = {
    "direction_1h": ("direction_1h", "forecast.next_1h.direction", "direction"),
    "confidence_1h": ("confidence_1h", "forecast.next_1h.confidence", "confidence"),
    "direction_4h": ("direction_4h", "forecast.next_4h.direction"),
    "confidence_4h": ("confidence_4h", "forecast.next_4h.confidence"),
}
TOLERANCE = 1e-4


def ai_field(name: str, columns: Sequence[str] | None = None, payload: str = "prediction") -> Column:
    """First present value among the aliases of a prediction field.

    ``columns`` lists flat prediction columns; with ``None`` the fields are read
    from the JSON column ``payload``.
    """
    paths = AI_ALIASES.get(name, (name,))
    if columns is None:
        return F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in paths])
    there = [F.col(p).cast("string") for p in paths if p in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _compare(actual: Column, operator: str, expected) -> Column:
    """Numbers first (equality within 1e-4), else text without case; unknown operators are false."""
    text = actual.cast("string")
    number = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))
    try:
        target = float(expected)
    except (TypeError, ValueError):
        target = None
    out = F.lit(False)
    if target is not None:
        e = F.lit(target)
        tests = {">": number > e, "<": number < e, ">=": number >= e, "<=": number <= e,
                 "==": F.abs(number - e) < TOLERANCE, "=": F.abs(number - e) < TOLERANCE, "!=": F.abs(number - e) >= TOLERANCE,
                 "crosses_above": number > e, "crosses_below": number < e}
        out = tests.get(operator, F.lit(False))
    up, want = F.upper(text), F.lit(str(expected).upper())
    words = {"==": up == want, "=": up == want, "!=": up != want}.get(operator, F.lit(False))
    chosen = words if target is None else F.when(number.isNotNull(), out).otherwise(words)
    return F.coalesce(chosen, F.lit(False))


def compile_condition(cond: Mapping, columns: Sequence[str], payload: str | None = None) -> Column:
    """Boolean expression of one condition; a missing value is false."""
    kind = cond.get("type")
    if kind == "indicator":
        name = INDICATORS.get(str(cond.get("name", "")).lower())
        if name is None or name not in columns:
            return F.lit(False)
        actual = F.col(name)
    elif kind == "ai":
        actual = ai_field(cond.get("field"), None if payload else columns, payload or "prediction")
    elif kind == "price":
        actual = F.col("close")
    elif kind == "news":
        actual = F.when(F.col("news_count") > 0, F.col("news_sentiment"))
    else:
        return F.lit(False)
    return _compare(actual, cond.get("operator"), cond.get("value"))


def compile_strategy(strategy: Mapping | str, columns: Sequence[str], payload: str | None = None) -> Column:
    """``action`` where the conditions hold (AND unless OR is asked for), else HOLD."""
    s = json.loads(strategy) if isinstance(strategy, str) else strategy
    conditions = [compile_condition(c, columns, payload) for c in s.get("conditions") or []]
    if not conditions:
        return F.lit("HOLD")
    met = conditions[0]
    for c in conditions[1:]:
        met = (met | c) if s.get("logic") == "OR" else (met & c)
    return F.when(met, F.lit(s.get("action"))).otherwise("HOLD")


def uses(strategy: Mapping, kind: str) -> bool:
    return any(c.get("type") == kind for c in strategy.get("conditions") or [])


CONDITION_SCHEMA = "array<struct<type:string,name:string,field:string,operator:string,value:string>>"


def validate_strategies(df: DataFrame) -> DataFrame:
    """Error list per row of a strategy table (name, conditions as JSON, logic, action)."""
    conds = F.from_json("conditions", CONDITION_SCHEMA)

    def problems(c, i):
        at = F.concat(F.lit("Condition "), (i + 1).cast("string"))
        missing = lambda f: c[f].isNull() | (c[f] == "")
        return F.array_compact(F.array(
            F.when(missing("type"), F.concat(at, F.lit(": type is required"))),
            F.when(missing("operator"), F.concat(at, F.lit(": operator is required"))),
            F.when(c["value"].isNull(), F.concat(at, F.lit(": value is required")))))

    is_array = F.coalesce(F.startswith(F.ltrim("conditions"), F.lit("[")), F.lit(False))
    head = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("Strategy name is required")),
        F.when(~is_array, F.lit("Conditions must be an array")).when(F.size(conds) == 0, F.lit("At least one condition is required"))))
    tail = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("logic").isin("AND", "OR"), F.lit(False)), F.lit("Logic must be AND or OR")),
        F.when(~F.coalesce(F.col("action").isin("BUY", "SELL"), F.lit(False)), F.lit("Action must be BUY or SELL"))))
    body = F.when(is_array, F.flatten(F.transform(conds, problems))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("errors", F.concat(head, body, tail)).withColumn("valid", F.size("errors") == 0)
