"""Queries over signals, strategies, trades and positions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candela.functions import decisions as dc
from candela.operators import backtest as bt, candles as cd, joins, metrics as mt, strategy as st
from candela.operators.ordering import ordered_index
from candela.plans.evaluation import ORDER, SPLIT
from candela.plans.market import BACKTEST
from candela.plans.news import stats_sql
from candela.plans.registry import R, Rs, query, rd, rounded
from candela.plans.tables import sql_with
from candela.session import durable



def _direction():
    return F.element_at(F.array(*[F.lit(x) for x in ("DOWN", "NEUTRAL", "UP")]), F.col("pred") + 1)


DIR_SQL = "CASE pred WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEUTRAL' ELSE 'UP' END"


def _directed(t):
    return t.predictions.select("symbol", "ts", "horizon", "pred_id", "confidence", _direction().alias("direction"))


# ------------------------------------------------------------------ as-of joins


@query("j01_latest_prediction", sql_with("c1h predictions", f"""SELECT c.symbol, c.ts, p.pred_id, {R('p.confidence')} AS confidence, {DIR_SQL.replace('pred ', 'p.pred ')} AS d
    FROM c1h c ASOF LEFT JOIN predictions p ON c.symbol = p.symbol AND c.ts >= p.ts""").replace("ELSE 'UP' END AS d", "WHEN 2 THEN 'UP' END AS direction"))
def _(t):
    p = _directed(t).withColumnRenamed("ts", "pred_ts").drop("horizon")
    out = joins.asof_join(t.candles().select("symbol", "ts"), p, "ts", "pred_ts")
    return rounded(out.select("symbol", "ts", "pred_id", "confidence", "direction"))


CARRY = {
    "cf": f"""SELECT symbol, ts, horizon, pred_id, last_value(CASE WHEN horizon = '1h' THEN {DIR_SQL} END IGNORE NULLS) OVER w AS direction_1h,
        last_value(CASE WHEN horizon = '1h' THEN confidence END IGNORE NULLS) OVER w AS confidence_1h,
        last_value(CASE WHEN horizon = '4h' THEN {DIR_SQL} END IGNORE NULLS) OVER w AS direction_4h,
        last_value(CASE WHEN horizon = '4h' THEN confidence END IGNORE NULLS) OVER w AS confidence_4h
        FROM predictions WINDOW w AS (PARTITION BY symbol ORDER BY ts, horizon, pred_id ROWS UNBOUNDED PRECEDING)"""}


@query("j08_carry_forward", sql_with("predictions", f"""SELECT symbol, ts, horizon, direction_1h, direction_4h, {Rs('confidence_1h confidence_4h')} FROM cf
    WHERE ts >= TIMESTAMP '2024-01-03'""", CARRY))
def _(t):
    return rounded(bt.carry_forward(_directed(t), "2024-01-03"))


LOOKBACKS = {"1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}


@query("j12_price_change", sql_with("c1h", " UNION ALL ".join(f"""SELECT '{k}' AS lookback, n.symbol, {R('n.close')} AS price, {R('o.close')} AS old_price, {R('(n.close - o.close) / o.close * 100')} AS change_percent
    FROM now n JOIN (SELECT symbol, arg_max(close, ts) AS close FROM c1h WHERE ts <= TIMESTAMP '2024-01-20' - INTERVAL {s} SECOND GROUP BY symbol) o USING (symbol)""" for k, s in LOOKBACKS.items()),
    {"now": "SELECT symbol, arg_max(close, ts) AS close FROM c1h WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY symbol"}))
def _(t):
    from candela.operators.tables import price_change
    return rounded(price_change(t.candles(), "2024-01-20 00:00:00", LOOKBACKS))


@query("j19_nearest_join", sql_with("c4h articles", f"""SELECT article_id, arg_min(c.ts, (abs(epoch_us(c.ts) - epoch_us(a.published_at)), epoch_us(c.ts))) AS ts FROM articles a JOIN c4h c ON c.symbol = 'click' GROUP BY article_id"""))
def _(t):
    curve = t.candles("4h").filter("symbol = 'click'").select("ts", "close")
    news = t.articles.select("article_id", "published_at")
    return joins.nearest_join(news, curve, "published_at", "ts", by=()).select("article_id", "ts")


# ------------------------------------------------------------------ signal series


def signal_series(df):
    return df.withColumn("signal", F.col("pred") - 1)


PNL = lambda short: {
    **SPLIT,
    "hd": f"""SELECT *, {'' if short else 'greatest(0, '}coalesce(last_value(nullif(pred - 1, 0) IGNORE NULLS) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING), 0){'' if short else ')'} AS position FROM sp""",
    "pn": "SELECT *, coalesce(lag(position) OVER (ORDER BY rn), 0) * ret - 0.0015 * abs(position - coalesce(lag(position) OVER (ORDER BY rn), 0)) AS pnl FROM hd"}

for _n, _s in (("m25_signal_pnl", True), ("m25_signal_pnl_long_only", False)):
    query(_n, sql_with("predictions", f"SELECT pred_id, CAST(position AS INTEGER) AS position, {R('pnl')} AS pnl FROM pn", PNL(_s)))(
        lambda t, s=_s: rounded(bt.signal_pnl(ordered_index(signal_series(t.predictions), ORDER), allow_short=s).select("pred_id", "position", "pnl")))

_A = math.sqrt(8760)


def perf_sql(src: str, col: str, part: str = "", order: str = "rn") -> dict[str, str]:
    p, k = (f"PARTITION BY {part} ", f"{part}, ") if part else ("", "")
    return {"lg": f"SELECT *, {col} AS r, sum(ln(1 + {col})) OVER ({p}ORDER BY {order}) AS lg FROM {src}",
            "lp": f"SELECT *, max(lg) OVER ({p}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS top FROM lg",
            "pf": f"""SELECT {k}exp(sum(ln(1 + r))) - 1 AS total_return, exp(sum(ln(1 + r)) * 8760 / count(*)) - 1 AS annual_return, coalesce(stddev_samp(r), 0) * {_A!r} AS annual_vol,
            sqrt(avg(least(r, 0) ** 2)) * {_A!r} AS dv, min(exp(lg - top) - 1) AS max_dd, coalesce(count(*) FILTER (r > 0) / nullif(count(*) FILTER (r <> 0), 0), 0) AS win_rate FROM lp {('GROUP BY ' + part) if part else ''}""",
            "perf": f"""SELECT {k}total_return, annual_return, annual_vol, CASE WHEN annual_vol > 0 THEN (annual_return - 0.02) / (annual_vol + 1e-6) ELSE 0 END AS sharpe,
            CASE WHEN dv > 0 THEN (annual_return - 0.02) / (dv + 1e-6) ELSE 0 END AS sortino, max_dd, annual_return / (abs(max_dd) + 1e-6) AS calmar, win_rate FROM pf"""}


PERF_DIGITS = {"annual_return": 4, "sharpe": 4, "sortino": 4, "calmar": 4}
_perf_cols = lambda: ", ".join(f"{R(c, PERF_DIGITS.get(c, 6))} AS {c}" for c in bt.PERFORMANCE)


def _pnl(t):
    # returns scaled down so that annualised figures stay in range
    p = t.predictions.withColumn("ret", F.col("ret") / 50)
    return bt.signal_pnl(ordered_index(signal_series(p), ORDER))


_SMALL = {k: v.replace("* ret", "* ret / 50") for k, v in PNL(True).items()}


@query("m26_performance", sql_with("predictions", f"SELECT {_perf_cols()} FROM perf", {**_SMALL, **perf_sql("pn", "pnl")}))
def _(t):
    return rounded(bt.performance(_pnl(t)), PERF_DIGITS)


_WIN = {**_SMALL, "wn": "SELECT *, CAST(least((rn - 1) // (n // least(5, greatest(1, n // 20))), least(5, greatest(1, n // 20)) - 1) AS INTEGER) AS window_idx FROM pn"}


@query("m27_window_performance", sql_with("predictions", f"SELECT window_idx, {_perf_cols()} FROM perf", {**_WIN, **perf_sql("wn", "pnl", "window_idx")}))
def _(t):
    return rounded(bt.window_performance(_pnl(t)), PERF_DIGITS)


@query("m27_window_summary", sql_with("predictions", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {R(f'avg({c})', 3)} AS mean, {R(f'stddev_pop({c})', 3)} AS std FROM perf" for c in bt.PERFORMANCE), {**_WIN, **perf_sql("wn", "pnl", "window_idx")}))
def _(t):
    return rounded(bt.window_summary(bt.window_performance(_pnl(t))), 3)


def _two() -> dict[str, str]:
    a = perf_sql("pn", "pnl")
    b = {k.replace("lg", "blg").replace("lp", "blp").replace("pf", "bpf").replace("perf", "bperf"): v.replace("FROM lg", "FROM blg").replace("FROM lp", "FROM blp").replace("FROM pf", "FROM bpf") for k, v in perf_sql("pn", "ret / 50").items()}
    return {**_SMALL, **a, **b}


@query("m27_strategy_vs_hold", sql_with("predictions", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {R(f'perf.{c}', 3)} AS strategy, {R(f'bperf.{c}', 3)} AS buy_hold FROM perf, bperf" for c in bt.PERFORMANCE), _two()))
def _(t):
    return rounded(bt.strategy_vs_hold(_pnl(t)), 3)


# ------------------------------------------------------------------ strategies

STRATEGIES = {
    "dip": {"name": "dip", "conditions": [{"type": "indicator", "name": "RSI", "operator": "<", "value": 48}, {"type": "news", "operator": ">", "value": -0.2}],
            "logic": "AND", "action": "BUY", "stop_loss": 30, "take_profit": 40},
    "fade": {"name": "fade", "conditions": [{"type": "indicator", "name": "macd_bullish", "operator": "=", "value": 0}, {"type": "price", "operator": ">=", "value": 150}],
             "logic": "OR", "action": "SELL", "stop_loss": 60, "take_profit": 25},
    "model": {"name": "model", "conditions": [{"type": "ai", "field": "direction_1h", "operator": "==", "value": "up"}, {"type": "ai", "field": "confidence_1h", "operator": ">", "value": 0.45}],
              "logic": "AND", "action": "BUY", "take_profit": 90},
    "never": {"name": "never", "conditions": [{"type": "indicator", "name": "rsi", "operator": ">", "value": 1000}], "logic": "AND", "action": "BUY"},
    "empty": {"name": "empty", "conditions": [], "logic": "AND", "action": "BUY"},
}

SIGNALS = {
    **BACKTEST, **CARRY, "n24": stats_sql(24, "both"),
    "ctx": """SELECT b.*, n24.news_count, n24.vader_mean AS news_sentiment, p.direction_1h, p.confidence_1h, p.direction_4h FROM b
        ASOF LEFT JOIN cf p ON b.symbol = p.symbol AND b.ts >= p.ts JOIN n24 ON n24.symbol = b.symbol AND n24.ts = b.ts""",
    "sg": """SELECT 'dip' AS strategy, symbol, ts, rn, close, CASE WHEN rsi_bt < 48 AND news_count > 0 AND news_sentiment > -0.2 THEN 'BUY' ELSE 'HOLD' END AS signal FROM ctx
        UNION ALL SELECT 'fade', symbol, ts, rn, close, CASE WHEN NOT macd_bt > macd_signal_bt OR close >= 150 THEN 'SELL' ELSE 'HOLD' END FROM ctx
        UNION ALL SELECT 'model', symbol, ts, rn, close, CASE WHEN upper(direction_1h) = 'UP' AND confidence_1h > 0.45 THEN 'BUY' ELSE 'HOLD' END FROM ctx
        UNION ALL SELECT 'never', symbol, ts, rn, close, 'HOLD' FROM ctx UNION ALL SELECT 'empty', symbol, ts, rn, close, 'HOLD' FROM ctx""",
}


def _signals(t):
    context = bt.strategy_context(durable(t.indexed()), _directed(t), t.articles)
    return bt.strategy_signals(context, STRATEGIES)


@query("p12_p13_strategy_signals", sql_with("i1h c1h predictions articles", "SELECT strategy, symbol, ts, signal FROM sg", SIGNALS))
def _(t):
    return _signals(t).select("strategy", "symbol", "ts", "signal")


@query("m33_mean_news_sentiment", sql_with("c1h articles", f"SELECT symbol, ts, {R('vader_mean', 9)} AS news_sentiment FROM n24", {"n24": SIGNALS["n24"]}))
def _(t):
    from candela.operators.news import recent_news
    return rounded(recent_news(t.candles().select("symbol", "ts"), t.articles), 9).select("symbol", "ts", "news_sentiment")


OPS = (">", "<", ">=", "<=", "==", "=", "!=", "crosses_above", "crosses_below", "~")


@query("p12_operators", sql_with("c1h", "SELECT symbol, ts, " + ", ".join(
    f"{e} AS o{i}" for i, e in enumerate(("close > 50", "close < 50", "close >= 50", "close <= 50", "abs(close - 50) < 0.0001", "abs(close - 50) < 0.0001",
                                          "abs(close - 50) >= 0.0001", "close > 50", "close < 50", "false"))) + ", symbol = 'click' AS text_equal FROM c1h"))
def _(t):
    c = t.candles().withColumn("direction", F.col("symbol"))
    cols = c.columns
    numeric = [st.compile_condition({"type": "price", "operator": op, "value": "50"}, cols).alias(f"o{i}") for i, op in enumerate(OPS)]
    words = st.compile_condition({"type": "ai", "field": "direction", "operator": "=", "value": "CLICK"}, cols)
    return c.select("symbol", "ts", *numeric, words.alias("text_equal"))


# strategy table derived from the parts table: some rows break a rule
STRATEGY_TABLE = """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name,
    CASE WHEN p_partkey % 5 = 0 THEN '[]' WHEN p_partkey % 5 = 1 THEN '[{"type":"price","operator":">","value":' || p_size || '},{"type":"","operator":"<"}]'
    WHEN p_partkey % 5 = 2 THEN '{"type":"price"}' ELSE '[{"type":"indicator","name":"rsi","operator":"<","value":30}]' END AS conditions,
    CASE WHEN p_partkey % 3 = 0 THEN 'XOR' ELSE 'AND' END AS logic, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'BUY' END AS action FROM part"""


@query("p14_validate_strategies", sql_with("", f"""SELECT id, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'Strategy name is required' END,
    CASE id % 5 WHEN 0 THEN 'At least one condition is required' WHEN 2 THEN 'Conditions must be an array' WHEN 1 THEN 'Condition 2: type is required' END,
    CASE WHEN id % 5 = 1 THEN 'Condition 2: value is required' END, CASE WHEN logic = 'XOR' THEN 'Logic must be AND or OR' END,
    CASE WHEN action IS NULL THEN 'Action must be BUY or SELL' END], lambda x: x IS NOT NULL), '; ') AS errors FROM ({STRATEGY_TABLE})"""))
def _(t):
    t.raw("part").createOrReplaceTempView("candela_part")
    rows = t.spark.sql(STRATEGY_TABLE.replace("FROM part", "FROM candela_part"))
    return st.validate_strategies(rows).select("id", F.array_join("errors", "; ").alias("errors"))


PAYLOAD = """'{"forecast":{"next_1h":{"direction":"' || """ + DIR_SQL + """ || '","confidence":' || (pred_id % 100) || '}},"direction_4h":"' || horizon || '"}'"""


@query("p15_ai_field", sql_with("predictions", f"SELECT pred_id, {DIR_SQL} AS d1, CAST(pred_id % 100 AS VARCHAR) AS c1, horizon AS d4, CAST(NULL AS VARCHAR) AS c4 FROM predictions"))
def _(t):
    p = t.predictions.withColumn("prediction", F.expr(PAYLOAD))
    return p.select("pred_id", st.ai_field("direction_1h").alias("d1"), st.ai_field("confidence_1h").alias("c1"), st.ai_field("direction_4h").alias("d4"), st.ai_field("confidence_4h").alias("c4"))


@query("p16_validate_policies", sql_with("predictions", f"SELECT pred_id FROM predictions WHERE confidence * 2 - 0.4 BETWEEN 0 AND 1 AND max_prob + 0.55 BETWEEN 0 AND 1 AND 20 * confidence * 2 BETWEEN 0.05 AND 20"))
def _(t):
    p = t.predictions.select("pred_id", (F.col("confidence") * 2 - 0.4).alias("tau"), (F.col("max_prob") + 0.55).alias("gamma"), (20 * F.col("confidence") * 2).alias("temperature"))
    return bt.validate_policies(p).select("pred_id")


# ------------------------------------------------------------------ barriers and ledgers


def _limit_sql(field: str) -> str:
    return "CASE strategy " + " ".join(f"WHEN '{n}' THEN {float(s[field])!r}" for n, s in STRATEGIES.items() if s.get(field)) + " END"


ENTRIES = {"en": f"""SELECT *, CASE WHEN signal = 'BUY' THEN 'long' ELSE 'short' END AS side, close * (1 - (CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END) * ({_limit_sql('stop_loss')}) / 100) AS stop,
    close * (1 + (CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END) * ({_limit_sql('take_profit')}) / 100) AS take FROM sg WHERE signal IN ('BUY', 'SELL')"""}
STOP_HIT = "(CASE WHEN {e}.side = 'long' THEN c.low <= {e}.stop ELSE c.high >= {e}.stop END)"
TAKE_HIT = "(CASE WHEN {e}.side = 'long' THEN c.high >= {e}.take ELSE c.low <= {e}.take END)"


@query("m28_barrier_touch", sql_with("i1h c1h predictions articles", f"""SELECT strategy, symbol, entry_rn, exit_rn, {R('CASE WHEN s THEN stop ELSE take END')} AS exit_price, CASE WHEN s THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS reason
    FROM (SELECT en.strategy, en.symbol, en.rn AS entry_rn, c.rn AS exit_rn, en.stop, en.take, coalesce({STOP_HIT.format(e='en')}, false) AS s,
    row_number() OVER (PARTITION BY en.strategy, en.symbol, en.rn ORDER BY c.rn) AS k FROM en JOIN i1h c ON c.symbol = en.symbol AND c.rn > en.rn
    WHERE coalesce({STOP_HIT.format(e='en')}, false) OR coalesce({TAKE_HIT.format(e='en')}, false)) WHERE k = 1""", {**SIGNALS, **ENTRIES}))
def _(t):
    c = t.indexed()
    return rounded(bt.barrier_touch(bt.entries_of(_signals(t), STRATEGIES), c, block=64).select("strategy", "symbol", "entry_rn", "exit_rn", "exit_price", "reason"))


_OPEN = "(s.signal IN ('BUY', 'SELL') AND r.side IS NULL)"
_SL = "coalesce(CASE WHEN r.side = 'long' THEN s.low <= r.stop ELSE s.high >= r.stop END, false)"
_TP = "coalesce(CASE WHEN r.side = 'long' THEN s.high >= r.take ELSE s.low <= r.take END, false)"
_SIG = "(s.signal = 'SELL' AND r.side = 'long')"
_LAST = "s.rn = s.last_rn"
_EX = f"(r.side IS NOT NULL AND ({_SL} OR {_TP} OR {_SIG} OR {_LAST}))"
_XP = f"CASE WHEN {_SL} THEN r.stop WHEN {_TP} THEN r.take ELSE s.close END"
_GROSS = f"(({_XP}) - r.ep) * r.qty * (CASE WHEN r.side = 'long' THEN 1 ELSE -1 END)"
_SG = "CASE WHEN s.signal = 'BUY' THEN 1 ELSE -1 END"
# an entry on the last candle is closed at once
_NOW = f"({_OPEN} AND {_LAST})"
_Q = "(r.cash * 0.99 / s.close)"
RUN = {
    **SIGNALS, "src": f"""SELECT sg.*, i.high, i.low, max(sg.rn) OVER (PARTITION BY strategy, sg.symbol) AS last_rn, {_limit_sql('stop_loss')} AS sl, {_limit_sql('take_profit')} AS tp
        FROM sg JOIN i1h i ON i.symbol = sg.symbol AND i.rn = sg.rn""",
    "recursive r": f"""SELECT DISTINCT strategy, symbol, CAST(50 AS BIGINT) AS rn, CAST(10000 AS DOUBLE) AS cash, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS BIGINT) AS ern,
        CAST(NULL AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS take, false AS closed, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS xp, CAST(NULL AS DOUBLE) AS profit,
        CAST(NULL AS VARCHAR) AS cside, CAST(NULL AS BIGINT) AS cern, CAST(10000 AS DOUBLE) AS equity FROM src
        UNION ALL SELECT s.strategy, s.symbol, s.rn,
        CASE WHEN {_EX} THEN r.cash + {_GROSS} - r.qty * ({_XP}) * 0.001 WHEN {_NOW} THEN r.cash - 2 * {_Q} * s.close * 0.001 WHEN {_OPEN} THEN r.cash - {_Q} * s.close * 0.001 ELSE r.cash END,
        CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN CASE WHEN s.signal = 'BUY' THEN 'long' ELSE 'short' END ELSE r.side END,
        CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN s.close ELSE r.ep END, CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN s.rn ELSE r.ern END,
        CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN {_Q} ELSE r.qty END,
        CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN s.close * (1 - {_SG} * s.sl / 100) ELSE r.stop END,
        CASE WHEN {_EX} OR {_NOW} THEN NULL WHEN {_OPEN} THEN s.close * (1 + {_SG} * s.tp / 100) ELSE r.take END,
        {_EX} OR {_NOW}, CASE WHEN {_NOW} THEN 'END_OF_DATA' WHEN NOT {_EX} THEN NULL WHEN {_SL} THEN 'STOP_LOSS' WHEN {_TP} THEN 'TAKE_PROFIT' WHEN {_SIG} THEN 'SIGNAL_SELL' ELSE 'END_OF_DATA' END,
        CASE WHEN {_NOW} THEN s.close WHEN {_EX} THEN {_XP} END,
        CASE WHEN {_NOW} THEN -2 * {_Q} * s.close * 0.001 WHEN {_EX} THEN {_GROSS} - r.qty * r.ep * 0.001 - r.qty * ({_XP}) * 0.001 END,
        CASE WHEN {_NOW} THEN CASE WHEN s.signal = 'BUY' THEN 'long' ELSE 'short' END WHEN {_EX} THEN r.side END, CASE WHEN {_NOW} THEN s.rn WHEN {_EX} THEN r.ern END,
        CASE WHEN {_EX} THEN r.cash + {_GROSS} - r.qty * ({_XP}) * 0.001 WHEN {_NOW} THEN r.cash - 2 * {_Q} * s.close * 0.001 WHEN {_OPEN} THEN r.cash - 2 * {_Q} * s.close * 0.001
        WHEN r.side IS NOT NULL THEN r.cash + (s.close - r.ep) * r.qty * (CASE WHEN r.side = 'long' THEN 1 ELSE -1 END) - r.qty * s.close * 0.001 ELSE r.cash END
        FROM r JOIN src s ON s.strategy = r.strategy AND s.symbol = r.symbol AND s.rn = r.rn + 1""",
    "tr2": "SELECT strategy, symbol, cside AS side, cern AS entry_rn, rn AS exit_rn, xp AS exit_price, reason, profit, cash AS cumulative_capital FROM r WHERE closed",
}


def _ledger(t):
    signals, candles = durable(_signals(t)), durable(t.indexed())
    return signals, candles, durable(bt.trade_ledger(signals, STRATEGIES, candles))


@query("m29_trade_ledger", sql_with("i1h c1h predictions articles", f"SELECT strategy, symbol, side, entry_rn, exit_rn, reason, {R('exit_price')} AS exit_price, {R('profit', 4)} AS profit, {R('cumulative_capital', 4)} AS cumulative_capital FROM tr2", RUN))
def _(t):
    _, _, ledger = _ledger(t)
    return rounded(ledger.select("strategy", "symbol", "side", "entry_rn", "exit_rn", "reason", "exit_price", "profit", "cumulative_capital"), {"profit": 4, "cumulative_capital": 4})


@query("m30_equity_curve", sql_with("i1h c1h predictions articles", f"SELECT r.strategy, r.symbol, i.ts, {R('equity', 4)} AS equity FROM r JOIN i1h i ON i.symbol = r.symbol AND i.rn = r.rn", RUN))
def _(t):
    signals, candles, ledger = _ledger(t)
    return rounded(bt.equity_curve(signals, candles, ledger).select("strategy", "symbol", "ts", "equity"), 4)


LEDGER_SQL = {**RUN, "lt": """SELECT strategy, symbol, count(*) AS total_trades, count(*) FILTER (profit > 0) AS winning_trades, count(*) FILTER (profit <= 0) AS losing_trades,
    coalesce(sum(profit) FILTER (profit > 0), 0) AS total_profit, abs(coalesce(sum(profit) FILTER (profit <= 0), 0)) AS total_loss, sum(profit) AS net_profit,
    avg(rp) AS m, stddev_pop(rp) AS s FROM (SELECT tr2.*, profit / (i.close * ((cumulative_capital - profit) * 0.99 / i.close)) * 100 AS rp FROM tr2 JOIN i1h i ON i.symbol = tr2.symbol AND i.rn = tr2.entry_rn) GROUP BY strategy, symbol""",
    "fl": "SELECT strategy, symbol, max((pk - equity) / pk * 100) AS mdd FROM (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY strategy, symbol ORDER BY rn)) AS pk FROM r) GROUP BY strategy, symbol"}
_ZERO = lambda c: f"coalesce({c}, 0)"


@query("m31_ledger_metrics", sql_with("i1h c1h predictions articles", f"""SELECT strategy, symbol, coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades,
    {R(_ZERO('winning_trades * 100 / total_trades'))} AS win_rate, {R(_ZERO('total_profit'), 3)} AS total_profit, {R(_ZERO('total_loss'), 3)} AS total_loss, {R(_ZERO('net_profit'), 3)} AS net_profit,
    {R(_ZERO('net_profit / 100'), 4)} AS net_profit_percent, {R('10000 + ' + _ZERO('net_profit'), 3)} AS final_equity, {R('CASE WHEN total_trades IS NULL THEN 0 ELSE greatest(mdd, 0) END', 4)} AS max_drawdown,
    {R('CASE WHEN s > 1e-9 THEN m / s ELSE 0 END', 4)} AS sharpe_ratio FROM fl LEFT JOIN lt USING (strategy, symbol)""", LEDGER_SQL))
def _(t):
    signals, candles, ledger = _ledger(t)
    m = bt.ledger_metrics(ledger, bt.equity_curve(signals, candles, ledger))
    names = ["total_trades", "winning_trades", "losing_trades", "win_rate", "total_profit", "total_loss", "net_profit", "net_profit_percent", "final_equity", "max_drawdown", "sharpe_ratio"]
    return rounded(m.select("strategy", "symbol", *names), {"total_profit": 3, "total_loss": 3, "net_profit": 3, "net_profit_percent": 4, "final_equity": 3, "max_drawdown": 4, "sharpe_ratio": 4})


@query("m32_no_trade_reason", sql_with("i1h c1h predictions articles", f"""SELECT strategy, symbol, count(*) FILTER (signal IN ('BUY', 'SELL')) AS actionable_signals,
    CASE WHEN count(*) FILTER (signal IN ('BUY', 'SELL')) = 0 THEN '{bt.NO_TRADE["signal"]}' END AS no_trade_reason FROM sg GROUP BY strategy, symbol""", SIGNALS))
def _(t):
    signals, _, ledger = _ledger(t)
    trades = ledger.groupBy("strategy", "symbol").agg(F.count(F.lit(1)).alias("total_trades"))
    counts = bt.signal_counts(signals).join(trades, ["strategy", "symbol"], "left").fillna(0, ["total_trades"])
    names = lambda kind: F.col("strategy").isin(*[n for n, s in STRATEGIES.items() if st.uses(s, kind)] or ["-"])
    n_p = t.predictions.agg(F.count(F.lit(1)).alias("predictions"))
    n_n = t.articles.agg(F.count(F.lit(1)).alias("news"))
    counts = counts.join(F.broadcast(n_p)).join(F.broadcast(n_n)).withColumns({"uses_ai": names("ai"), "uses_news": names("news")})  # one row each
    return bt.no_trade_reason(counts).select("strategy", "symbol", "actionable_signals", "no_trade_reason")


@query("m34_backtest_history", sql_with("", """SELECT o_custkey AS user_id, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 20"""))
def _(t):
    results = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return bt.backtest_history_all(results).select("user_id", "id")


@query("m34_backtest_by_id", sql_with("", "SELECT o_custkey AS user_id, o_orderkey AS id FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) AND o_custkey = (SELECT arg_min(o_custkey, o_orderkey) FROM orders)"))
def _(t):
    results = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"))
    first = results.agg(F.min(F.struct("id", "user_id")).alias("r")).first().r
    return bt.backtest_by_id(results, first.id, first.user_id)


# ------------------------------------------------------------------ decisions on two horizons

PAIR = {"pr": f"""SELECT a.pred_id, CASE a.pred WHEN 0 THEN 'SELL' WHEN 1 THEN 'HOLD' ELSE 'BUY' END AS signal_1h, CASE b.pred WHEN 0 THEN 'SELL' WHEN 1 THEN 'HOLD' ELSE 'BUY' END AS signal_4h,
    a.confidence AS confidence_1h, b.confidence AS confidence_4h, a.max_prob AS max_prob_1h, b.max_prob AS max_prob_4h, a.probs[3] AS p_up_1h, a.probs[1] AS p_down_1h, b.probs[3] AS p_up_4h, b.probs[1] AS p_down_4h,
    a.pred_id % 9 AS hours, 100 + a.ret * 1000 AS current_price, a.ret * 100 AS actual FROM predictions a JOIN predictions b ON b.pred_id = a.pred_id + 1"""}


def _pair(t):
    word = F.element_at(F.array(*[F.lit(x) for x in ("SELL", "HOLD", "BUY")]), F.col("pred") + 1)
    one = lambda h: [word.alias(f"signal_{h}"), F.col("confidence").alias(f"confidence_{h}"), F.col("max_prob").alias(f"max_prob_{h}"),
                     F.col("probs")[2].alias(f"p_up_{h}"), F.col("probs")[0].alias(f"p_down_{h}")]
    p = t.predictions
    a = p.select("pred_id", "ret", *one("1h"))
    b = p.select((F.col("pred_id") - 1).alias("pred_id"), *one("4h"))
    return a.join(b, ["pred_id"]).withColumns({"hours": F.pmod("pred_id", F.lit(9)), "current_price": 100 + F.col("ret") * 1000, "actual": F.col("ret") * 100})


_ACT = lambda h: f"(signal_{h} <> 'HOLD' AND confidence_{h} >= 0.5 AND max_prob_{h} >= 0.36)"
_BOOL = lambda h: f"CASE WHEN {_ACT(h)} THEN 'True' ELSE 'False' END"


@query("f30_alert_decision", sql_with("predictions", f"""SELECT pred_id, ({_ACT('1h')} OR {_ACT('4h')}) AND NOT ({_ACT('1h')} AND {_ACT('4h')} AND signal_1h <> signal_4h) AS alert,
    CASE WHEN NOT ({_ACT('1h')} OR {_ACT('4h')}) OR ({_ACT('1h')} AND {_ACT('4h')} AND signal_1h <> signal_4h) THEN 'abstain' WHEN {_ACT('1h')} AND {_ACT('4h')} THEN 'high' ELSE 'medium' END AS level,
    CASE WHEN NOT ({_ACT('1h')} OR {_ACT('4h')}) THEN 'No horizon passes Eq.26 thresholds' WHEN {_ACT('1h')} AND {_ACT('4h')} AND signal_1h <> signal_4h THEN 'Conflicting active horizons: 1h=' || signal_1h || ', 4h=' || signal_4h
    ELSE format('Eq.26 active horizons: 1h={{}} (conf={{:.3f}}, p={{:.3f}}), 4h={{}} (conf={{:.3f}}, p={{:.3f}})', {_BOOL('1h')}, confidence_1h, max_prob_1h, {_BOOL('4h')}, confidence_4h, max_prob_4h) END AS reason,
    CASE WHEN ({_ACT('1h')} OR {_ACT('4h')}) AND NOT ({_ACT('1h')} AND {_ACT('4h')} AND signal_1h <> signal_4h) THEN CASE WHEN {_ACT('1h')} THEN signal_1h ELSE signal_4h END END AS signal FROM pr""", PAIR))
def _(t):
    p = _pair(t).withColumns({f"{k}_{h}": F.lit(v) for h in ("1h", "4h") for k, v in (("tau", 0.5), ("gamma", 0.36))})
    return dc.alert_decision(p).select("pred_id", "alert", "level", "reason", "signal")


@query("f31_position_confidence", sql_with("predictions", f"SELECT pred_id, {R('confidence * (1 - probs[2])')} AS position_confidence FROM predictions"))
def _(t):
    return rounded(t.predictions.select("pred_id", dc.position_confidence(F.col("confidence"), F.col("probs")[1]).alias("position_confidence")))


_EXP = lambda h: f"round(CASE WHEN signal_{h} = 'BUY' THEN current_price * (1 + abs(p_up_{h} - 0.5) * 0.04) WHEN signal_{h} = 'SELL' THEN current_price * (1 - abs(p_up_{h} - 0.5) * 0.04) ELSE current_price END, 2)"
_DIR = lambda h: f"CASE signal_{h} WHEN 'BUY' THEN 'UP' WHEN 'SELL' THEN 'DOWN' ELSE 'SIDEWAYS' END"


@query("f33_insight_fields", sql_with("predictions", f"""SELECT pred_id, {R('e1', 2)} AS expected_1h, {R('e4', 2)} AS expected_4h, {R('least(current_price, e4) * 0.98', 2)} AS range_low, {R('greatest(current_price, e4) * 1.02', 2)} AS range_high,
    {R('(e4 - current_price) / current_price * 100', 2)} AS change_4h, {_DIR('1h')} AS direction_1h, {_DIR('4h')} AS direction_4h, CASE signal_1h WHEN 'BUY' THEN 'BULLISH' WHEN 'SELL' THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment,
    CASE WHEN confidence_1h < 0.25 THEN 'low' WHEN confidence_1h > 0.55 THEN 'high' ELSE 'medium' END AS volatility FROM (SELECT *, {_EXP('1h')} AS e1, {_EXP('4h')} AS e4 FROM pr)""", PAIR))
def _(t):
    out = dc.insight_fields(_pair(t).withColumns({"prob_1h": F.col("p_up_1h"), "prob_4h": F.col("p_up_4h")}))
    return rounded(out.select("pred_id", "expected_1h", "expected_4h", "range_low", "range_high", "change_4h", "direction_1h", "direction_4h", "sentiment", "volatility"), 2)


_V = lambda h: f"CASE signal_{h} WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END"
CONS = {**PAIR, "cw": "SELECT *, CASE WHEN hours <= 2 THEN 0.7 WHEN hours <= 6 THEN 0.4 ELSE 0.25 END::DOUBLE AS w, p_up_1h - p_down_1h AS e1, p_up_4h - p_down_4h AS e4 FROM pr",
        "cs": f"""SELECT *, e1 * w + e4 * (1 - w) AS score, {_V('1h')} = {_V('4h')} AS agrees, least(1, greatest(0, (confidence_1h * w + confidence_4h * (1 - w)) * CASE WHEN {_V('1h')} = {_V('4h')} THEN 1 ELSE 0.78 END)) AS conf,
        round(least(1, greatest(-1, e1)) * 2 * w + least(1, greatest(-1, e4)) * 4 * (1 - w), 2) AS change_percent FROM cw""",
        "cd": "SELECT *, CASE WHEN score > 0.08 THEN 'UP' WHEN score < -0.08 THEN 'DOWN' ELSE 'SIDEWAYS' END AS direction FROM cs"}


@query("f34_horizon_consensus", sql_with("predictions", f"SELECT pred_id, {R('score')} AS consensus, agrees, {R('conf')} AS consensus_confidence, {R('change_percent', 2)} AS change_percent, direction FROM cd", CONS))
def _(t):
    return rounded(dc.horizon_consensus(_pair(t)).select("pred_id", "consensus", "agrees", "consensus_confidence", "change_percent", "direction"))


ACC = {**CONS, "ac": """SELECT *, exp(-abs(actual - change_percent) / greatest(2 * CASE WHEN hours <= 2 THEN 0.15 ELSE 0.30 END, abs(actual), abs(change_percent))) AS sim,
    CASE WHEN actual > 0 THEN 'UP' WHEN actual < 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS got, CASE direction WHEN 'UP' THEN 'UP' WHEN 'DOWN' THEN 'DOWN' ELSE 'NEUTRAL' END AS want FROM cd"""}


@query("f35_forecast_accuracy", sql_with("predictions", f"SELECT pred_id, {R('CASE WHEN got = want THEN 50 + 50 * sim WHEN got <> want AND want <> ' + chr(39) + 'NEUTRAL' + chr(39) + ' AND got <> ' + chr(39) + 'NEUTRAL' + chr(39) + ' THEN 0 ELSE 50 * sim END', 1)} AS accuracy FROM ac", ACC))
def _(t):
    p = dc.horizon_consensus(_pair(t))
    acc = dc.forecast_accuracy(F.col("actual"), F.col("change_percent"), F.col("direction"), F.col("hours"))
    return p.select("pred_id", rd(acc, 1).alias("accuracy"))


@query("f37_advice_class", sql_with("predictions", """SELECT pred_id, CASE WHEN direction = 'UP' AND conf >= 0.45 AND agrees THEN 'UP' WHEN direction = 'DOWN' AND conf >= 0.45 AND agrees THEN 'DOWN' ELSE 'UNCLEAR' END AS advice, CASE WHEN direction = 'UP' AND conf >= 0.45 AND agrees THEN format('Dự đoán giá sẽ TĂNG {:.2f}% (độ tin cậy {:.1f}%)', change_percent, (conf + 0.10) * 100)
    WHEN direction = 'DOWN' AND conf >= 0.45 AND agrees THEN format('Dự đoán giá sẽ GIẢM {:.2f}% (độ tin cậy {:.1f}%)', abs(change_percent), (conf + 0.10) * 100)
    ELSE format('Kết quả tổng hợp có độ tin cậy {:.1f}%', (conf + 0.10) * 100) END AS advice_text FROM cd""", CONS))
def _(t):
    p = dc.horizon_consensus(_pair(t)).withColumn("confidence", F.col("consensus_confidence") + 0.10)
    return dc.advice_class(p).select("pred_id", "advice", "advice_text")


_CUT = "CASE WHEN length(rtrim(trim(x), '.')) > 120 THEN substr(rtrim(trim(x), '.'), 1, 117) || '...' ELSE rtrim(trim(x), '.') END"
_NAMED = "CASE x WHEN 'etf_flow' THEN 'dòng tiền ETF' WHEN 'exchange_risk' THEN 'rủi ro sàn giao dịch' ELSE replace(x, '_', ' ') END"
_FACTORS = (("etf_flow",), ("etf_flow", "exchange_risk"), ("exchange_risk", "made_up_name", "etf_flow"), ("made_up_name",))


@query("f38_explanation_text", sql_with("predictions articles", f"""SELECT pred_id, md5('Tín hiệu: BTC có khả năng ' || way || ' trong ' || horizon || ' tới.' || chr(10)
    || CASE WHEN pred_id % 7 = 0 THEN '' ELSE 'Mức thay đổi kỳ vọng: ' || CASE WHEN ret >= 0 THEN '+' ELSE '' END || format('{{:.2f}}', ret * 100) || '%.' || chr(10) END
    || 'Độ tin cậy: ' || format('{{:.2f}}', confidence) || '.' || chr(10)
    || CASE WHEN len(titles) = 0 THEN '' ELSE 'Bằng chứng chính: ' || array_to_string(list_transform(titles[1:3], lambda x, i: '(' || chr(96 + CAST(i AS INTEGER)) || ') ' || {_CUT}), '; ') || '.' || chr(10) END
    || CASE WHEN len(factors) = 0 THEN '' ELSE 'Yếu tố chi phối: ' || named || '.' || chr(10) END
    || 'Giải thích: Mô hình nhận thấy tín hiệu ' || way || ' hiện tại được hỗ trợ bởi ' || named || ' kết hợp với bối cảnh thị trường đa khung thời gian; các tin còn lại được xem là ít quan trọng hơn hoặc trùng lặp ngữ nghĩa.' || chr(10)
    || CASE WHEN confidence >= 0.5 THEN 'Quyết định: PHÁT CẢNH BÁO (ĉ=' || format('{{:.2f}}', confidence) || ' đạt ngưỡng tin cậy và phân phối dự báo đủ sắc nét).'
    ELSE 'Quyết định: GIỮ IM LẶNG (ĉ=' || format('{{:.2f}}', confidence) || ' chưa đạt ngưỡng — tránh phát tín hiệu khi bất định cao).' END) AS digest
    FROM (SELECT *, CASE WHEN len(factors) = 0 THEN 'không có yếu tố nổi bật' ELSE array_to_string(list_transform(factors[1:2], lambda x: {_NAMED}), ' và ') END AS named
    FROM (SELECT p.*, CASE pred WHEN 0 THEN 'giảm' WHEN 1 THEN 'đi ngang' ELSE 'tăng' END AS way, list_filter([a.title, b.title, c.title, d.title], lambda x: x IS NOT NULL)[1 : p.pred_id % 5] AS titles,
    CASE p.pred_id % 5 {' '.join(f"WHEN {i + 1} THEN {list(f)}" for i, f in enumerate(_FACTORS))} ELSE [] END AS factors
    FROM predictions p JOIN articles a ON a.article_id = p.pred_id LEFT JOIN articles b ON b.article_id = p.pred_id + 1 LEFT JOIN articles c ON c.article_id = p.pred_id + 2
    LEFT JOIN articles d ON d.article_id = p.pred_id + 3))"""))
def _(t):
    shifted = [t.articles.select((F.col("article_id") - i).alias("pred_id"), F.col("title").alias(f"title{i}")) for i in range(4)]
    rows = t.predictions.join(shifted[0], ["pred_id"])
    for more in shifted[1:]:
        rows = rows.join(more, ["pred_id"], "left")
    kind = F.col("pred_id") % 5
    factors = F.array().cast("array<string>")
    for i, names in enumerate(_FACTORS):
        factors = F.when(kind == i + 1, F.array(*map(F.lit, names))).otherwise(factors)
    titles = F.slice(F.array_compact(F.array(*[f"title{i}" for i in range(4)])), 1, kind.cast("int"))
    rows = rows.select("pred_id", F.col("pred").alias("direction"), "confidence", "horizon", titles.alias("titles"), factors.alias("factors"),
                       (F.col("confidence") >= 0.5).alias("alert"), F.when(F.col("pred_id") % 7 != 0, F.col("ret")).alias("return_pred"))
    return dc.explanation_text(rows).select("pred_id", F.md5("explanation").alias("digest"))
