"""Back-tests: signal PnL, barriers, trade ledgers, equity, performance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.operators.dataset import result_windows
from candela.operators.indicators import WARMUP, backtest_indicators
from candela.operators.joins import asof_join
from candela.operators.metrics import PERIODS_PER_YEAR, ratio
from candela.operators.news import recent_news
from candela.operators.ordering import blocked, fold_sorted, ordered_index, running
from candela.operators.strategy import compile_strategy
from candela.session import durable

RISK_FREE = 0.02
SIGNAL_COST = 0.0015      # commission and slippage per position change
CAPITAL_SHARE, FEE = 0.99, 0.001


# ------------------------------------------------------------------ signal series

def signal_pnl(df: DataFrame, keys: Sequence[str] = (), rn: str = "rn", cost: float = SIGNAL_COST, allow_short: bool = True,
               signal: str = "signal", ret: str = "ret") -> DataFrame:
    """PnL per step: the position of the step before earns the return, changes cost.

    The position is the last signal that was not HOLD (never below 0 without
    shorts).  Needs positions ``rn``; no key is ordered in one task.
    """
    s = F.col(signal) if allow_short else F.greatest(F.col(signal), F.lit(-1))
    rows = running(df, {"_held": ("last", F.nullif(s.cast("int"), F.lit(0)))}, keys, rn)
    held = F.coalesce("_held", F.lit(0))
    rows = rows.withColumn("position", held if allow_short else F.greatest(held, F.lit(0)))

    def compute(d, w):
        before = F.coalesce(F.lag("position").over(w), F.lit(0))
        return d.withColumn("pnl", before * F.col(ret) - cost * F.abs(F.col("position") - before))
    key = list(keys) or ["_one"]
    rows = rows if keys else rows.withColumn("_one", F.lit(0))
    return blocked(rows, 1, compute, key, rn).drop("_held", "_one")


def performance(df: DataFrame, rn: str = "rn", column: str = "pnl", keys: Sequence[str] = (), ppy: int = PERIODS_PER_YEAR,
                rf: float = RISK_FREE) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar and win rate (sample deviation)."""
    keys = list(keys)
    rows = running(df, {"_log": ("sum", F.log(1 + F.col(column)))}, keys, rn)
    rows = running(rows, {"_top": ("max", "_log")}, keys, rn)
    r = F.col(column)
    low = F.least(r, F.lit(0.0))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.log(1 + r)).alias("_g"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_sd"),
        F.sqrt(F.avg(low * low)).alias("_dd"), F.min(F.exp(F.col("_log") - F.col("_top")) - 1).alias("max_dd"),
        F.sum(F.when(r > 0, 1).otherwise(0)).alias("_w"), F.sum(F.when(r != 0, 1).otherwise(0)).alias("_nz"))
    annual = F.exp(F.col("_g") * ppy / F.col("_n")) - 1
    vol, down = F.col("_sd") * (ppy ** 0.5), F.col("_dd") * (ppy ** 0.5)
    return base.select(
        *keys, (F.exp("_g") - 1).alias("total_return"), annual.alias("annual_return"), vol.alias("annual_vol"),
        F.when(vol > 0, (annual - rf) / (vol + 1e-6)).otherwise(0.0).alias("sharpe"),
        F.when(down > 0, (annual - rf) / (down + 1e-6)).otherwise(0.0).alias("sortino"), "max_dd",
        (annual / (F.abs("max_dd") + 1e-6)).alias("calmar"), ratio(F.col("_w"), F.col("_nz")).alias("win_rate"))


PERFORMANCE = ("total_return", "annual_return", "annual_vol", "sharpe", "sortino", "max_dd", "calmar", "win_rate")


def window_performance(df: DataFrame, n: int = 5, rn: str = "rn", column: str = "pnl") -> DataFrame:
    """Performance in consecutive windows; each window starts at one again."""
    rows = result_windows(df, n, rn)
    first = rows.groupBy("window_idx").agg((F.min(rn) - 1).alias("_first"))
    rows = rows.join(F.broadcast(first), ["window_idx"]).withColumn("_wrn", F.col(rn) - F.col("_first"))  # n rows
    return performance(rows, "_wrn", column, ["window_idx"])


def window_summary(per_window: DataFrame) -> DataFrame:
    cells = per_window.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in PERFORMANCE])).alias("x")).select("x.*")
    return cells.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def strategy_vs_hold(df: DataFrame, rn: str = "rn", pnl: str = "pnl", ret: str = "ret") -> DataFrame:
    """Performance of a strategy next to holding, one row per metric."""
    def long(one: DataFrame, name: str) -> DataFrame:
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in PERFORMANCE])).alias("x")).select("x.*")
    return long(performance(df, rn, pnl), "strategy").join(long(performance(df, rn, ret), "buy_hold"), ["metric"])


def validate_policies(policies: DataFrame) -> DataFrame:
    """Policies whose thresholds and temperature are possible values."""
    tau, gamma = F.coalesce("tau", F.lit(0.5)), F.coalesce("gamma", F.lit(0.5))
    return policies.filter(tau.between(0, 1) & gamma.between(0, 1) & F.coalesce("temperature", F.lit(1.0)).between(0.05, 20))


# ------------------------------------------------------------------ strategy signals

def carry_forward(predictions: DataFrame, start: str | None = None, horizons: Sequence[str] = ("1h", "4h")) -> DataFrame:
    """One timeline with the latest output of every horizon at each event.

    Events before ``start`` only warm up the carried values.  Equal times are
    ordered by horizon.
    """
    rows = ordered_index(predictions.select("symbol", "ts", "horizon", "direction", "confidence", F.col("pred_id").alias("_id")),
                         ["ts", "horizon", "_id"], ["symbol"])
    values = {}
    for h in horizons:
        mine = F.when(F.col("horizon") == h, F.struct("direction", "confidence"))
        values[f"_{h}"] = ("last", mine)
    rows = running(rows, values, ["symbol"])
    out = rows.select("symbol", "ts", "horizon", *[
        F.col(f"_{h}.{f}").alias(f"{f}_{h}") for h in horizons for f in ("direction", "confidence")])
    return out if start is None else out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))


def strategy_context(candles: DataFrame, predictions: DataFrame, news: DataFrame, hours: float = 24.0) -> DataFrame:
    """Evaluated candles with indicators, the latest prediction and the news of the last day."""
    base = backtest_indicators(candles)
    timeline = carry_forward(predictions).withColumnsRenamed({"horizon": "_h", "ts": "pred_ts"})
    joined = asof_join(base, timeline, "ts", "pred_ts", tie=("_h",)).drop("_h", "pred_ts")
    return recent_news(joined, news, hours)


def strategy_signals(context: DataFrame, strategies: Mapping[str, Mapping]) -> DataFrame:
    """One signal row per strategy and candle."""
    made = F.array(*[F.struct(F.lit(name).alias("strategy"), compile_strategy(s, context.columns).alias("signal"))
                     for name, s in strategies.items()])
    return context.select("symbol", "ts", "rn", "open", "high", "low", "close", F.explode(made).alias("_s")).select(
        "symbol", "ts", "rn", "open", "high", "low", "close", "_s.*")


# ------------------------------------------------------------------ barriers

BLOCK = 512


def price_levels(candles: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """A hierarchy of lows and highs: symbol, parent, kids (at, lo, hi, ts) of ``block`` positions each.

    The lowest level holds candles, every other one the blocks of the level below; the last has one block per symbol.
    """
    cells = candles.select("symbol", (F.col("rn") - 1).alias("at"), F.col("low").alias("lo"), F.col("high").alias("hi"), "ts")
    most = cells.agg(F.max("at")).first()[0] or 0
    levels = []
    while True:
        rows = durable(cells.groupBy("symbol", F.floor(F.col("at") / F.lit(block)).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("at", "lo", "hi", "ts"))).alias("kids"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))  # ``block`` elements
        levels.append(rows.select("symbol", "parent", "kids"))
        most //= block
        if not most:
            return levels
        cells = rows.select("symbol", F.col("parent").alias("at"), "lo", "hi", F.lit(None).cast("timestamp").alias("ts"))


def barrier_touch(entries: DataFrame, candles: DataFrame, block: int = BLOCK) -> DataFrame:
    """First candle after the entry that reaches a barrier; the stop is checked first.

    ``entries``: strategy, symbol, rn, side (``long`` / ``short``), stop, take.
    ``candles``: symbol, rn, ts, high, low.  An entry looks at the rest of its own block of candles, then at the rest of
    the block of blocks around it, and so on up ``price_levels``; from where it finds a block with a hit it goes down
    again.  Each step is a join by block that adds one row of ``block`` elements to an entry; entries that end in the same block
    are the large side of such a join.
    """
    levels = price_levels(candles, block)
    long = F.col("side") == "long"
    stops = lambda x: F.coalesce(F.when(long, x["lo"] <= F.col("stop")).otherwise(x["hi"] >= F.col("stop")), F.lit(False))
    takes = lambda x: F.coalesce(F.when(long, x["hi"] >= F.col("take")).otherwise(x["lo"] <= F.col("take")), F.lit(False))
    names = ["strategy", "symbol", "entry_rn", "side", "stop", "take"]
    state = entries.select("strategy", "symbol", F.col("rn").alias("entry_rn"), "side", "stop", "take", (F.col("rn") - 1).alias("at"))

    def looked(rows: DataFrame, level: DataFrame, parent: Column, after: Column) -> DataFrame:
        hits = F.filter("kids", lambda x: (x["at"] > after) & (stops(x) | takes(x)))
        return rows.withColumn("parent", parent).join(level, ["symbol", "parent"], "left").select(*names, "at", F.get(hits, F.lit(0)).alias("hit"))

    found = []
    for level in levels:
        seen = durable(looked(state, level, F.floor(F.col("at") / F.lit(block)), F.col("at")))
        found.append(seen.filter("hit is not null").select(*names, "hit"))
        state = seen.filter("hit is null").select(*names, F.floor(F.col("at") / F.lit(block)).alias("at"))
    hits = found[-1]
    for level, own in zip(reversed(levels[:-1]), reversed(found[:-1])):
        down = looked(hits.withColumn("at", F.col("hit")["at"]), level, F.col("at"), F.lit(-1))
        hits = own.unionByName(down.select(*names, "hit"))
    stopped = stops(F.col("hit"))
    return hits.select("strategy", "symbol", "entry_rn", (F.col("hit")["at"] + 1).alias("exit_rn"), F.col("hit")["ts"].alias("exit_ts"),
                       F.when(stopped, F.col("stop")).otherwise(F.col("take")).alias("exit_price"), F.when(stopped, "STOP_LOSS").otherwise("TAKE_PROFIT").alias("reason"))


def entries_of(signals: DataFrame, limits: Mapping[str, Mapping]) -> DataFrame:
    """Possible entries: BUY opens long, SELL opens short; barriers in percent of the entry price."""
    def pct(field: str) -> Column:
        pairs = [(n, s.get(field)) for n, s in limits.items() if s.get(field)]
        if not pairs:
            return F.lit(None).cast("double")
        return F.create_map(*[F.lit(x) for n, v in pairs for x in (n, float(v))])[F.col("strategy")]
    long = F.col("signal") == "BUY"
    sign = F.when(long, 1.0).otherwise(-1.0)
    return signals.filter(F.col("signal").isin("BUY", "SELL")).withColumn("side", F.when(long, "long").otherwise("short")).withColumns({
        "stop": F.col("close") * (1 - sign * pct("stop_loss") / 100), "take": F.col("close") * (1 + sign * pct("take_profit") / 100)})


# ------------------------------------------------------------------ ledger

LEDGER = ("strategy string, symbol string, side string, entry_rn long, entry_ts timestamp, entry_price double, exit_rn long, "
          "exit_ts timestamp, exit_price double, reason string, qty double, gross_profit double, entry_fee double, exit_fee double, "
          "profit double, return_percent double, cumulative_capital double")


def trade_ledger(signals: DataFrame, limits: Mapping[str, Mapping], candles: DataFrame, capital: float = 10000.0) -> DataFrame:
    """Trades of each (strategy, symbol): one open position, next entry after the exit.

    Exits (barrier, opposite signal for longs, end of data) of every possible
    entry are found in parallel; the chain of trades and its capital is then one
    streaming pass over the few columns of the possible entries.
    """
    signals = durable(signals)  # read by the entries, the barrier search and the sell signals
    entries = entries_of(signals, limits)
    touches = barrier_touch(entries, candles)
    ends = candles.groupBy("symbol").agg(F.max_by(F.struct("rn", "ts", "close"), "rn").alias("_end"))
    rows = entries.withColumnRenamed("rn", "entry_rn").select("strategy", "symbol", "entry_rn", F.col("ts").alias("entry_ts"), "side", F.col("close").alias("entry_price"))
    rows = rows.join(touches, ["strategy", "symbol", "entry_rn"], "left").join(ends, ["symbol"])
    sells = signals.filter("signal = 'SELL'").select("strategy", "symbol", F.col("ts").alias("sell_ts"), F.col("rn").alias("sell_rn"), F.col("close").alias("sell_price"))
    later = rows.withColumn("_after", F.timestamp_micros(F.unix_micros("entry_ts") + 1))
    rows = asof_join(later, sells, "_after", "sell_ts", by=("strategy", "symbol"), forward=True).drop("_after")
    sold = (F.col("side") == "long") & F.col("sell_rn").isNotNull() & (F.col("exit_rn").isNull() | (F.col("sell_rn") < F.col("exit_rn")))
    pick = lambda barrier, sell, end: F.when(sold, F.col(sell)).when(F.col("exit_rn").isNotNull(), F.col(barrier)).otherwise(F.col(end))
    rows = rows.select(
        "strategy", "symbol", "side", "entry_rn", "entry_ts", "entry_price",
        F.when(sold, "SIGNAL_SELL").when(F.col("exit_rn").isNotNull(), F.col("reason")).otherwise("END_OF_DATA").alias("reason"),
        pick("exit_rn", "sell_rn", "_end.rn").alias("exit_rn"), pick("exit_ts", "sell_ts", "_end.ts").alias("exit_ts"),
        pick("exit_price", "sell_price", "_end.close").alias("exit_price"))
    names = [c.split(" ")[0] for c in LEDGER.split(", ")]

    def step(state, pdf):
        import pandas as pd
        out = []
        for r in pdf.itertuples(index=False):
            if r.entry_rn <= state["busy"]:
                continue
            qty = state["cash"] * CAPITAL_SHARE / r.entry_price
            entry_fee, exit_fee = qty * r.entry_price * FEE, qty * r.exit_price * FEE
            gross = (r.exit_price - r.entry_price) * qty * (1 if r.side == "long" else -1)
            profit = gross - entry_fee - exit_fee
            state["cash"] += profit
            state["busy"] = r.exit_rn
            out.append((r.strategy, r.symbol, r.side, r.entry_rn, r.entry_ts, r.entry_price, r.exit_rn, r.exit_ts, r.exit_price, r.reason, qty, gross,
                        entry_fee, exit_fee, profit, profit / (qty * r.entry_price) * 100, state["cash"]))
        return pd.DataFrame(out, columns=names)

    return fold_sorted(rows, ["strategy", "symbol"], ["entry_rn"], lambda: {"cash": capital, "busy": -1}, step, LEDGER)


def equity_curve(signals: DataFrame, candles: DataFrame, ledger: DataFrame, capital: float = 10000.0) -> DataFrame:
    """Account value at every evaluated candle: closed trades plus the open one at market less its exit fee."""
    keys = signals.select("strategy", "symbol").distinct()
    grid = candles.filter(F.col("rn") >= WARMUP).select("symbol", "ts", "rn", "close").join(keys, ["symbol"])
    # position as time, so that the as-of join works on candle positions
    at = F.timestamp_seconds(F.col("rn") * 3600)
    opened = ledger.select("strategy", "symbol", F.timestamp_seconds(F.col("entry_rn") * 3600).alias("_open"), "entry_rn", "exit_rn", "side",
                           "entry_price", "qty", "entry_fee", "profit", "cumulative_capital")
    rows = asof_join(grid.withColumn("_at", at), opened, "_at", "_open", by=("strategy", "symbol"))
    before = F.col("cumulative_capital") - F.col("profit")
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    open_value = before - F.col("entry_fee") + sign * (F.col("close") - F.col("entry_price")) * F.col("qty") - F.col("qty") * F.col("close") * FEE
    value = (F.when(F.col("entry_rn").isNull(), F.lit(float(capital))).when(F.col("rn") >= F.col("exit_rn"), F.col("cumulative_capital")).otherwise(open_value))
    return rows.select("strategy", "symbol", "ts", "rn", value.alias("equity"))


def ledger_metrics(ledger: DataFrame, equity: DataFrame, capital: float = 10000.0) -> DataFrame:
    """Counts, profits, fees, drawdown and trade Sharpe per (strategy, symbol); no trades give zeros.

    A deviation below 1e-9 percent is rounding noise of equal trades and gives a Sharpe of 0.
    """
    keys = ["strategy", "symbol"]
    p = F.col("profit")
    won = p > 0
    trades = ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum(F.when(won, 1).otherwise(0)).alias("winning_trades"),
        F.sum(F.when(won, 0).otherwise(1)).alias("losing_trades"), F.sum(F.when(won, p).otherwise(0.0)).alias("total_profit"),
        F.abs(F.sum(F.when(won, 0.0).otherwise(p))).alias("total_loss"), F.sum(p).alias("net_profit"),
        F.sum(F.col("entry_fee") + F.col("exit_fee")).alias("total_fees"), F.avg("return_percent").alias("_m"),
        F.stddev_pop("return_percent").alias("_s"), F.max(F.when(won, p)).alias("largest_win"), F.min(F.when(~won, p)).alias("largest_loss"),
        F.avg(F.when(won, p)).alias("avg_win"), F.avg(F.when(~won, p)).alias("avg_loss"),
        F.avg(F.unix_seconds("exit_ts") - F.unix_seconds("entry_ts")).alias("avg_trade_seconds"))
    curve = equity.withColumn("_rn", F.col("rn") - (WARMUP - 1))
    curve = running(curve, {"_peak": ("max", "equity")}, keys, "_rn")
    peak = F.greatest("_peak", F.lit(float(capital)))
    falls = curve.groupBy(*keys).agg(F.greatest(F.max((peak - F.col("equity")) / peak * 100), F.lit(0.0)).alias("max_drawdown"))
    names = ["total_trades", "winning_trades", "losing_trades", "total_profit", "total_loss", "net_profit", "total_fees"]
    rows = falls.join(trades, keys, "left").fillna(0, names).withColumns({
        "max_drawdown": F.when(F.col("total_trades") == 0, 0.0).otherwise(F.col("max_drawdown")),
        "win_rate": ratio(F.col("winning_trades") * 100, F.col("total_trades")),
        "net_profit_percent": F.col("net_profit") / capital * 100, "final_equity": capital + F.col("net_profit"),
        "sharpe_ratio": F.when(F.col("_s") > 1e-9, F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0))).otherwise(0.0),
        "profit_factor": ratio(F.col("total_profit"), F.col("total_loss"))})
    return rows.drop("_m", "_s")


# Why a back-test made no trade.
NO_TRADE = {
    "ai": "Không có dự báo AI lịch sử trong khoảng thời gian đã chọn.",
    "news": "Không có dữ liệu tin tức trong khoảng thời gian đã chọn.",
    "signal": "Không có thời điểm nào thỏa đồng thời toàn bộ điều kiện của chiến lược.",
    "trade": "Có tín hiệu nhưng không hình thành được giao dịch hoàn chỉnh.",
}


def no_trade_reason(counts: DataFrame) -> DataFrame:
    """Diagnosis from counts: uses_ai, uses_news, predictions, news, actionable_signals, total_trades."""
    c = F.col
    reason = (F.when(c("total_trades") > 0, F.lit(None)).when(c("uses_ai") & (c("predictions") == 0), NO_TRADE["ai"])
              .when(c("uses_news") & (c("news") == 0), NO_TRADE["news"]).when(c("actionable_signals") == 0, NO_TRADE["signal"]).otherwise(NO_TRADE["trade"]))
    return counts.withColumn("no_trade_reason", reason)


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("strategy", "symbol").agg(
        F.sum(F.col("signal").isin("BUY", "SELL").cast("bigint")).alias("actionable_signals"), F.count(F.lit(1)).alias("candles"))


def backtest_history(results: DataFrame, user_id, limit: int = 20) -> DataFrame:
    return results.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "id").limit(limit)


def backtest_history_all(results: DataFrame, limit: int = 20) -> DataFrame:
    """Newest results of every user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    return results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def backtest_by_id(results: DataFrame, result_id, user_id) -> DataFrame:
    return results.filter((F.col("id") == result_id) & (F.col("user_id") == user_id))
