"""Queries over candles: bars, indicators, labels along the time axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import candles as cd, indicators as ind
from candela.operators.ordering import blocked, candle_index
from candela.plans.registry import R, Rs, query, rd, rounded
from candela.plans.tables import sql_with

BARS = "open high low close volume"

# ------------------------------------------------------------------ bars


for _i in ("1m", "5m", "15m", "1h", "4h", "1d"):
    query(f"a01_resample_{_i}", sql_with(f"c{_i}", f"SELECT symbol, ts, {BARS.replace(' ', ', ')} FROM c{_i}"))(
        lambda t, i=_i: t.candles(i))


def _floor_sql(width: int) -> str:
    start = f"make_timestamp((epoch_us(ts) // {width * 1000000}) * {width * 1000000})"
    return sql_with("c1h", f"""SELECT symbol, {start} AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
        min(low) AS low, last(close ORDER BY ts) AS close, {R('sum(volume)')} AS volume FROM c1h GROUP BY symbol, {start}""")


for _i, _w in (("4h", 14400), ("12h", 43200), ("1d", 86400), ("1w", 604800)):
    query(f"a02_resample_floor_{_i}", _floor_sql(_w))(
        lambda t, i=_i: cd.resample_floor(t.candles("1h"), i).withColumn("volume", rd("volume")))


@query("a02_resample_floor_sides", sql_with("c1h", """SELECT 'pass' AS rule, count(*) AS n FROM c1h
    UNION ALL SELECT 'unknown', count(*) FROM c1h UNION ALL SELECT 'finer', 0"""))
def _(t):
    c = t.candles("1h")
    sides = {"pass": "1h", "unknown": "3d", "finer": "15m"}
    out = None
    for rule, interval in sides.items():
        part = cd.resample_floor(c, interval).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query("a03_multi_timeframe", sql_with("c1m c5m c15m c1h c4h", " UNION ALL ".join(
    f"SELECT '{i}' AS timeframe, symbol, ts, open, high, low, close, volume FROM c{i}"
    for i in ("1m", "5m", "15m", "1h", "4h"))))
def _(t):
    return cd.multi_timeframe(cd.ticks_as_bars(t.ticks), ("1m", "5m", "15m", "1h", "4h"), ("ts", "event_id"))


# ------------------------------------------------------------------ rolling indicators (pandas dialect)

W = "PARTITION BY symbol ORDER BY rn"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} = {n} THEN {agg}({col}) OVER {frame(n)} END"


DELTA = {
    "d": f"SELECT *, close - lag(close) OVER ({W}) AS delta FROM i1h",
    "g": """SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, CAST(0 AS DOUBLE)) END AS gain,
        CASE WHEN delta IS NOT NULL THEN greatest(-delta, CAST(0 AS DOUBLE)) END AS loss FROM d""",
}


def rsi_sql(n: int, src: str = "g") -> str:
    return f"100 - 100 / (1 + ({full('avg', 'gain', n)}) / nullif({full('avg', 'loss', n)}, 0))"


KEY = "symbol, ts, "


@query("w01_rsi_pd", sql_with("i1h", f"SELECT {KEY}{R('v')} AS rsi_pd FROM (SELECT *, {rsi_sql(14)} AS v FROM g)", DELTA))
def _(t):
    return rounded(ind.rsi_pd(t.indexed()).select("symbol", "ts", "rsi_pd"))


@query("w02_rsi_bt", sql_with("i1h", f"""SELECT {KEY}{R('v')} AS rsi_bt FROM (SELECT *, CASE WHEN rn < 15 THEN 50
    WHEN avg(loss) OVER {frame(14)} = 0 THEN 100
    ELSE 100 - 100 / (1 + avg(gain) OVER {frame(14)} / nullif(avg(loss) OVER {frame(14)}, 0)) END AS v FROM g)""", DELTA))
def _(t):
    return rounded(ind.rsi_bt(t.indexed()).select("symbol", "ts", "rsi_bt"))


@query("w10_sma", sql_with("i1h", f"""SELECT {KEY}{R(full('avg', 'close', 20))} AS sma_20_pd,
    {R(f'avg(close) OVER {frame(20)}')} AS sma20_bt, {R(full('avg', 'close', 50))} AS sma_50_pd FROM i1h"""))
def _(t):
    return rounded(ind.sma_bt(ind.sma_pd(ind.sma_pd(t.indexed(), 20), 50), 20).select(
        "symbol", "ts", "sma_20_pd", "sma_50_pd", "sma20_bt"))


@query("w11_bollinger_pd", sql_with("i1h", f"""SELECT {KEY}{R('m + 2 * s')} AS bb_upper_pd, {R('m')} AS bb_mid_pd,
    {R('m - 2 * s')} AS bb_lower_pd, {R('4 * s / nullif(m, 0)')} AS bb_width_pd,
    {R('(close - (m - 2 * s)) / nullif(4 * s, 0)')} AS bb_pos_pd
    FROM (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS s FROM i1h)"""))
def _(t):
    return rounded(ind.bollinger(t.indexed()).select(
        "symbol", "ts", "bb_upper_pd", "bb_mid_pd", "bb_lower_pd", "bb_width_pd", "bb_pos_pd"))


@query("w11_bollinger_bt_ch", sql_with("i1h", f"""SELECT {KEY}{R('coalesce(m + 2 * s, close)')} AS bb_upper_bt,
    {R('coalesce(m, close)')} AS bb_mid_bt, {R('coalesce(m - 2 * s, close)')} AS bb_lower_bt,
    {R('m + 2 * s')} AS bb_upper_ch, {R('m')} AS bb_mid_ch, {R('m - 2 * s')} AS bb_lower_ch
    FROM (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_pop', 'close', 20)} AS s FROM i1h)"""))
def _(t):
    df = ind.bollinger(ind.bollinger(t.indexed(), dialect="bt"), dialect="ch")
    return rounded(df.select("symbol", "ts", *[f"bb_{x}_{d}" for x in ("upper", "mid", "lower") for d in ("bt", "ch")]))


@query("w12_stoch_rsi", sql_with("i1h", f"""SELECT {KEY}{R(f"(v - ({full('min', 'v', 14)})) / nullif(({full('max', 'v', 14)}) - ({full('min', 'v', 14)}), 0)")}
    AS stoch_rsi FROM (SELECT *, {rsi_sql(14)} AS v FROM g)""", DELTA))
def _(t):
    return rounded(ind.stoch_rsi(t.indexed()).select("symbol", "ts", "stoch_rsi"))


@query("w13_stochastic", sql_with("i1h", f"""SELECT {KEY}{R('k')} AS stoch_k, {R(full('avg', 'k', 3))} AS stoch_d
    FROM (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN max(high) OVER {frame(14)} = min(low) OVER {frame(14)} THEN 50
    ELSE (close - min(low) OVER {frame(14)}) / (max(high) OVER {frame(14)} - min(low) OVER {frame(14)}) * 100 END END AS k FROM i1h)"""))
def _(t):
    return rounded(ind.stochastic(t.indexed()).select("symbol", "ts", "stoch_k", "stoch_d"))


@query("w14_vwap_rolling", sql_with("i1h", f"""SELECT {KEY}{R('v')} AS vwap_pd, {R('(close - v) / nullif(v, 0)')} AS vwap_dev_pd
    FROM (SELECT *, ({full('sum', 'money', 20)}) / nullif({full('sum', 'volume', 20)}, 0) AS v
    FROM (SELECT *, (high + low + close) / 3 * volume AS money FROM i1h))"""))
def _(t):
    return rounded(ind.vwap_rolling(t.indexed()).select("symbol", "ts", "vwap_pd", "vwap_dev_pd"))


@query("w15_vwap_cumulative", sql_with("i1h", f"""SELECT {KEY}{R(f'''coalesce(sum((high + low + close) / 3 * volume) OVER ({W})
    / nullif(sum(volume) OVER ({W}), 0), (high + low + close) / 3)''')} AS vwap_ch FROM i1h"""))
def _(t):
    return rounded(ind.vwap_cumulative(t.indexed()).select("symbol", "ts", "vwap_ch"))


TR = f"""greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"""


@query("w16_atr_bt", sql_with("i1h", f"""SELECT {KEY}{R(f'CASE WHEN rn < 15 THEN 0 ELSE avg(tr) OVER {frame(14)} END')} AS atr_bt
    FROM (SELECT *, {TR} AS tr FROM i1h)"""))
def _(t):
    return rounded(ind.atr_bt(t.indexed()).select("symbol", "ts", "atr_bt"))


MOVES = {
    "mv": f"""SELECT *, {TR} AS tr, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM i1h""",
    "dm": """SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
        CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM mv""",
}
ADX = {
    **MOVES,
    "di": f"""SELECT *, 100 * ({full('avg', 'pdm', 14)}) / nullif({full('avg', 'tr', 14)}, 0) AS pdi,
        100 * ({full('avg', 'mdm', 14)}) / nullif({full('avg', 'tr', 14)}, 0) AS mdi FROM dm""",
    "dx": "SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di",
    "adx": f"SELECT *, {full('avg', 'dx', 14)} AS adx FROM dx",
}


@query("w17_adx_pd", sql_with("i1h", f"SELECT {KEY}{R('adx')} AS adx_pd FROM adx", ADX))
def _(t):
    return rounded(ind.adx_pd(t.indexed()).select("symbol", "ts", "adx_pd"))


@query("w18_obv", sql_with("i1h", f"""SELECT {KEY}sum(coalesce(sign(delta) * volume, CAST(0 AS DOUBLE))) OVER ({W}) AS obv FROM d""",
                           {"d": DELTA["d"]}))
def _(t):
    return ind.obv(t.indexed()).select("symbol", "ts", "obv")


@query("w20_returns", sql_with("i1h", "SELECT symbol, ts, " + ", ".join(
    [f"{R(f'ln(close / lag(close, {k}) OVER ({W}))')} AS log_return_{k}" for k in (1, 3, 5)]
    + [f"{R(f'close / lag(close, {k}) OVER ({W}) - 1')} AS return_{k}" for k in (1, 5, 15)]) + " FROM i1h"))
def _(t):
    return rounded(ind.returns(t.indexed()).select(
        "symbol", "ts", *[f"log_return_{k}" for k in (1, 3, 5)], *[f"return_{k}" for k in (1, 5, 15)]))


@query("w21_rolling_stats", sql_with("i1h", "SELECT symbol, ts, " + ", ".join(
    [f"{R(full('avg', 'close', n))} AS ma_{n}" for n in (5, 10, 20)]
    + [f"{R(full('stddev_samp', 'close', n))} AS std_{n}" for n in (5, 15)]
    + [f"{R('(high - low) / nullif(close, 0)')} AS range", f"{R(full('avg', 'volume', 10))} AS volume_ma_10",
       f"{R('volume / nullif(' + full('avg', 'volume', 10) + ', 0)')} AS volume_spike", f"{R('ln(1 + volume)')} AS volume_log"])
    + " FROM i1h"))
def _(t):
    return rounded(ind.rolling_stats(t.indexed()).drop("open", "high", "low", "close", "volume", "rn"))


@query("w22_lags", sql_with("i1h", "SELECT symbol, ts, " + ", ".join(
    f"{R(f'lag({c}, {k}) OVER ({W})')} AS {c}_lag{k}" for c in ("log_return_1", "return_1") for k in (1, 2, 3, 5))
    + f""" FROM (SELECT *, ln(close / lag(close) OVER ({W})) AS log_return_1,
    close / lag(close) OVER ({W}) - 1 AS return_1 FROM i1h)"""))
def _(t):
    df = ind.lags(ind.returns(t.indexed()))
    return rounded(df.select("symbol", "ts", *[f"{c}_lag{k}" for c in ("log_return_1", "return_1") for k in (1, 2, 3, 5)]))


# ------------------------------------------------------------------ recursions


def ema_rec(exprs: dict[str, tuple[str, str]], source: str = "i1h", start: str = "i.rn = 1") -> str:
    """Recursive CTE with one column per entry: (seed expression, step expression)."""
    seeds = ", ".join(f"CAST({s} AS DOUBLE) AS {n}" for n, (s, _) in exprs.items())
    steps = ", ".join(f"CAST({s} AS DOUBLE)" for _, s in exprs.values())
    return (f"SELECT i.symbol, i.rn, i.ts, {seeds} FROM {source} i WHERE {start} UNION ALL "
            f"SELECT i.symbol, i.rn, i.ts, {steps} FROM r JOIN {source} i ON i.symbol = r.symbol AND i.rn = r.rn + 1")


def ema_step(name: str, value: str, span: float) -> str:
    return f"({value} * {2 / (span + 1)!r} + r.{name} * {1 - 2 / (span + 1)!r})"


def _ema_pair(span: int, name: str, value: str = "i.close") -> tuple[str, str]:
    return value, ema_step(name, value, span)


@query("w04_ema_pd", sql_with("i1h", f"SELECT symbol, ts, {Rs('ema_9 ema_21 ema_50 ema_200')} FROM r", {
    "recursive r": ema_rec({f"ema_{s}": _ema_pair(s, f"ema_{s}") for s in (9, 21, 50, 200)})}))
def _(t):
    df = ind.emas_pd(t.indexed(), {f"ema_{s}": s for s in (9, 21, 50, 200)})
    return rounded(df.select("symbol", "ts", "ema_9", "ema_21", "ema_50", "ema_200"))


_F, _S = ema_step("f", "i.close", 12), ema_step("s", "i.close", 26)
MACD_REC = ema_rec({"f": ("i.close", _F), "s": ("i.close", _S), "g": ("0", ema_step("g", f"({_F} - {_S})", 9))})


@query("w07_macd_pd", sql_with("i1h", f"""SELECT symbol, ts, {R('f - s')} AS macd_pd, {R('g')} AS macd_signal_pd,
    {R('f - s - g')} AS macd_hist_pd FROM r""", {"recursive r": MACD_REC}))
def _(t):
    return rounded(ind.macd_pd(t.indexed()).select("symbol", "ts", "macd_pd", "macd_signal_pd", "macd_hist_pd"))


def _sma_at(n: int, col: str = "close", src: str = "i1h") -> str:
    return f"(SELECT avg(q.{col}) FROM {src} q WHERE q.symbol = i.symbol AND q.rn <= {n})"


@query("w06_ema_ch", sql_with("i1h", f"""SELECT i.symbol, i.ts, {R('r.e')} AS ema_20_ch FROM i1h i
    LEFT JOIN r ON r.symbol = i.symbol AND r.rn = i.rn""", {
    "recursive r": ema_rec({"e": (_sma_at(20), ema_step("e", "i.close", 20))}, start="i.rn = 20")}))
def _(t):
    return rounded(ind.ema_ch(t.indexed(), 20).select("symbol", "ts", "ema_20_ch"))


@query("w09_macd_ch", sql_with("i1h", f"""SELECT i.symbol, i.ts, {R('m.m')} AS macd_ch, {R('x.g')} AS macd_signal_ch,
    {R('m.m - x.g')} AS macd_hist_ch FROM i1h i LEFT JOIN m ON m.symbol = i.symbol AND m.rn = i.rn
    LEFT JOIN x ON x.symbol = i.symbol AND x.rn = i.rn""", {
    "recursive rf": ema_rec({"e": (_sma_at(12), ema_step("e", "i.close", 12))}, start="i.rn = 12").replace("FROM r JOIN", "FROM rf r JOIN"),
    "recursive rs": ema_rec({"e": (_sma_at(26), ema_step("e", "i.close", 26))}, start="i.rn = 26").replace("FROM r JOIN", "FROM rs r JOIN"),
    "m": "SELECT rf.symbol, rf.rn, rf.ts, rf.e - rs.e AS m FROM rf JOIN rs ON rf.symbol = rs.symbol AND rf.rn = rs.rn",
    "recursive x": ema_rec({"g": ("(SELECT avg(q.m) FROM m q WHERE q.symbol = i.symbol AND q.rn <= 34)", ema_step("g", "i.m", 9))},
                           source="m", start="i.rn = 34").replace("FROM r JOIN", "FROM x r JOIN")}))
def _(t):
    return rounded(ind.macd_ch(t.indexed()).select("symbol", "ts", "macd_ch", "macd_signal_ch", "macd_hist_ch"))


@query("w03_rsi_ch", sql_with("i1h", f"""SELECT i.symbol, i.ts, {R("100 - 100 / (1 + CASE WHEN r.l = 0 THEN 100 ELSE r.g / r.l END)")} AS rsi_ch
    FROM i1h i LEFT JOIN r ON r.symbol = i.symbol AND r.rn = i.rn""", {
    **DELTA, "recursive r": ema_rec({
        "g": (f"({_sma_at(15, 'gain', 'g')} * 13 + i.gain) / 14", "(r.g * 13 + i.gain) / 14"),
        "l": (f"({_sma_at(15, 'loss', 'g')} * 13 + i.loss) / 14", "(r.l * 13 + i.loss) / 14")}, source="g", start="i.rn = 15")}))
def _(t):
    return rounded(ind.rsi_ch(t.indexed()).select("symbol", "ts", "rsi_ch"))


TRS = {"tr": f"SELECT *, {TR} AS tr FROM i1h"}


def _mean_between(col: str, src: str, a: int, b: int, agg: str = "avg") -> str:
    return f"(SELECT {agg}(q.{col}) FROM {src} q WHERE q.symbol = i.symbol AND q.rn BETWEEN {a} AND {b})"


@query("w16_atr_ch", sql_with("i1h", f"""SELECT i.symbol, i.ts, {R('r.a')} AS atr_ch FROM i1h i
    LEFT JOIN r ON r.symbol = i.symbol AND r.rn = i.rn""", {
    **TRS, "recursive r": ema_rec({"a": (_mean_between("tr", "tr", 2, 15), "(r.a * 13 + i.tr) / 14")}, source="tr", start="i.rn = 15")}))
def _(t):
    return rounded(ind.atr_ch(t.indexed()).select("symbol", "ts", "atr_ch"))


@query("w17_adx_ch", sql_with("i1h", f"""SELECT i.symbol, i.ts, {R('a.a')} AS adx_ch FROM i1h i
    LEFT JOIN a ON a.symbol = i.symbol AND a.rn = i.rn""", {
    **MOVES,
    "recursive w": ema_rec({n: (_mean_between(c, "dm", 2, 15, "sum"), f"r.{n} - r.{n} / 14 + i.{c}")
                            for n, c in (("t", "tr"), ("p", "pdm"), ("m", "mdm"))}, source="dm", start="i.rn = 15").replace("FROM r JOIN", "FROM w r JOIN"),
    "v": """SELECT symbol, rn, ts, CASE WHEN t = 0 THEN 0 ELSE 100 * p / t END AS pdi,
        CASE WHEN t = 0 THEN 0 ELSE 100 * m / t END AS mdi FROM w WHERE rn > 15""",
    "dxs": "SELECT *, CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM v",
    "recursive a": ema_rec({"a": (_mean_between("dx", "dxs", 16, 29), "(r.a * 13 + i.dx) / 14")}, source="dxs", start="i.rn = 29").replace("FROM r JOIN", "FROM a r JOIN")}))
def _(t):
    return rounded(ind.adx_ch(t.indexed()).select("symbol", "ts", "adx_ch"))


_UP = "((i.high + i.low) / 2 + 3 * i.a)"
_DN = "((i.high + i.low) / 2 - 3 * i.a)"
_NU = f"CASE WHEN {_UP} < r.u OR i.prev > r.u THEN {_UP} ELSE r.u END"
_NL = f"CASE WHEN {_DN} > r.l OR i.prev < r.l THEN {_DN} ELSE r.l END"


@query("w19_supertrend", sql_with("i1h", f"""SELECT symbol, ts, {R('CASE WHEN t = 1 THEN l ELSE u END')} AS supertrend,
    CAST(CASE WHEN t = 1 THEN 1 ELSE -1 END AS INTEGER) AS trend FROM r""", {
    **TRS, "recursive atr": ema_rec({"a": (_mean_between("tr", "tr", 2, 11), "(r.a * 9 + i.tr) / 10")}, source="tr", start="i.rn = 11").replace("FROM r JOIN", "FROM atr r JOIN"),
    "s": f"""SELECT i.symbol, i.rn, i.ts, i.high, i.low, i.close, i.prev, atr.a
        FROM (SELECT *, lag(close) OVER ({W}) AS prev FROM i1h) i JOIN atr ON atr.symbol = i.symbol AND atr.rn = i.rn""",
    "recursive r": ema_rec({
        "u": (_UP, _NU), "l": (_DN, _NL),
        "t": (f"CASE WHEN i.close > {_UP} THEN 1 WHEN i.close < {_DN} THEN 0 ELSE 1 END",
              f"CASE WHEN i.close > {_NU} THEN 1 WHEN i.close < {_NL} THEN 0 ELSE r.t END")}, source="s", start="i.rn = 11")}))
def _(t):
    return rounded(ind.supertrend(t.indexed()))


# ------------------------------------------------------------------ back-test dialect


@query("w05_ema_bt", sql_with("i1h", f"""SELECT symbol, ts, {R('CASE WHEN rn < 20 THEN close ELSE e END')} AS ema20_bt FROM (
    SELECT symbol, ts, rn, close, list_reduce(list(close) OVER {frame(51)},
    lambda acc, x: acc * {1 - 2 / 21!r} + x * {2 / 21!r}) AS e FROM i1h)"""))
def _(t):
    return rounded(ind.ema_bt(t.indexed(), 20).select("symbol", "ts", "ema20_bt"))


_E = lambda n: f"list_reduce(w, lambda acc, x: acc * {1 - 2 / (n + 1)!r} + x * {2 / (n + 1)!r})"
_P = lambda n: f"list_reduce(w[1:k], lambda acc, x: acc * {1 - 2 / (n + 1)!r} + x * {2 / (n + 1)!r})"
BACKTEST = {
    "mvs": f"SELECT *, {TR} AS tr, close - lag(close) OVER ({W}) AS delta FROM i1h",
    "bt": f"""SELECT *, list(close) OVER {frame(51)} AS w, avg(greatest(delta, CAST(0 AS DOUBLE))) OVER {frame(14)} AS ag,
        avg(greatest(-delta, CAST(0 AS DOUBLE))) OVER {frame(14)} AS al, avg(close) OVER {frame(20)} AS s20,
        avg(close) OVER {frame(50)} AS s50, stddev_pop(close) OVER {frame(20)} AS sd, avg(tr) OVER {frame(14)} AS atr FROM mvs""",
    "mm": f"""SELECT symbol, rn, list({_P(12)} - {_P(26)} ORDER BY k) AS ms FROM bt, range(26, 52) q(k) WHERE rn > 50 GROUP BY symbol, rn""",
    "b": f"""SELECT bt.symbol, bt.ts, bt.rn, bt.open, bt.high, bt.low, bt.close, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi_bt,
        {_E(12)} - {_E(26)} AS macd_bt, list_reduce(ms, lambda acc, x: acc * {1 - 2 / 10!r} + x * {2 / 10!r}) AS macd_signal_bt,
        {_E(20)} AS ema20_bt, {_E(50)} AS ema50_bt, s20 AS sma20_bt, s50 AS sma50_bt, s20 + 2 * sd AS bb_upper_bt,
        s20 AS bb_middle_bt, s20 - 2 * sd AS bb_lower_bt, atr AS atr_bt
        FROM bt JOIN mm ON mm.symbol = bt.symbol AND mm.rn = bt.rn WHERE bt.rn > 50""",
}
_BT_COLS = ("rsi_bt macd_bt macd_signal_bt ema20_bt ema50_bt sma20_bt sma50_bt bb_upper_bt bb_middle_bt bb_lower_bt atr_bt")


@query("w08_macd_bt", sql_with("i1h", f"SELECT symbol, ts, {Rs('macd_bt macd_signal_bt')} FROM b", BACKTEST))
def _(t):
    return rounded(ind.backtest_indicators(t.indexed()).select("symbol", "ts", "macd_bt", "macd_signal_bt"))


@query("w33_indicator_flags", sql_with("i1h", f"""SELECT symbol, ts, {Rs(_BT_COLS)}, close > ema20_bt AS price_above_ema20,
    close > sma50_bt AS price_above_sma50, rsi_bt > 70 AS rsi_overbought, rsi_bt < 30 AS rsi_oversold,
    macd_bt > macd_signal_bt AS macd_bullish, (bb_upper_bt - bb_lower_bt) / bb_middle_bt < 0.04 AS bb_squeeze FROM b""", BACKTEST))
def _(t):
    df = ind.backtest_indicators(t.indexed())
    return rounded(df.select("symbol", "ts", *_BT_COLS.split(), "price_above_ema20", "price_above_sma50", "rsi_overbought",
                             "rsi_oversold", "macd_bullish", "bb_squeeze"))


@query("w34_evaluable_rows", sql_with("i1h", "SELECT symbol, ts, rn FROM i1h WHERE rn > 50"))
def _(t):
    return ind.evaluable_rows(t.indexed()).select("symbol", "ts", "rn")


# ------------------------------------------------------------------ regimes, intervals, bar features

_D50, _D200 = ema_step("e50", "i.close", 50), ema_step("e200", "i.close", 200)


@query("w24_market_regime", sql_with("i1h", """SELECT adx.symbol, adx.ts,
    CAST(coalesce(adx > 25, false) AND e50 > e200 AS INTEGER) AS regime_trending_up,
    CAST(coalesce(adx > 25, false) AND e50 < e200 AS INTEGER) AS regime_trending_down,
    CAST(NOT coalesce(adx > 25, false) AS INTEGER) AS regime_sideways
    FROM adx JOIN r ON r.symbol = adx.symbol AND r.rn = adx.rn""", {
    **ADX, "recursive r": ema_rec({"e50": ("i.close", _D50), "e200": ("i.close", _D200)})}))
def _(t):
    return ind.market_regime(t.indexed()).select(
        "symbol", "ts", "regime_trending_up", "regime_trending_down", "regime_sideways")


REGIME = {
    "lr": f"SELECT *, ln(greatest(close, 1e-8)) AS lc, ln(greatest(close, 1e-8)) - lag(ln(greatest(close, 1e-8))) OVER ({W}) AS lr FROM id",
    "rv": f"""SELECT *, CASE WHEN rn >= 5 THEN lc - first_value(lc) OVER {frame(30)} ELSE 0 END AS roll_ret,
        CASE WHEN rn >= 5 THEN stddev_pop(lr) OVER {frame(29)} ELSE 0 END AS roll_vol FROM lr""",
    "vl": "SELECT symbol, quantile_cont(roll_vol, 0.66) AS lim FROM rv WHERE roll_vol > 0 GROUP BY symbol",
    "regimes": """SELECT rv.*, lim, CAST(CASE WHEN roll_vol > lim THEN 3 WHEN roll_ret > 0.03 THEN 1 WHEN roll_ret < -0.03 THEN 2
        ELSE 0 END AS INTEGER) AS regime FROM rv JOIN vl USING (symbol)""",
}


@query("w25_regime_label", sql_with("id", f"SELECT symbol, ts, {Rs('roll_ret roll_vol')}, regime FROM regimes", REGIME))
def _(t):
    return rounded(ind.regime_label(t.daily_indexed()).select("symbol", "ts", "roll_ret", "roll_vol", "regime"))


@query("w28_infer_interval", sql_with("i1h", f"""SELECT symbol, {R('median(g)')} AS median_gap, median(g) / 60 BETWEEN 0.5 AND 2 AS is_1m
    FROM (SELECT symbol, epoch(ts) - lag(epoch(ts)) OVER ({W}) AS g FROM i1h) WHERE g IS NOT NULL GROUP BY symbol"""))
def _(t):
    return rounded(cd.infer_interval(t.indexed()))


def bar_sql(src: str) -> str:
    c = lambda x: f"least(CAST(1 AS DOUBLE), greatest(CAST(-1 AS DOUBLE), {x}))"
    f = lambda x: f"greatest({x}, 1e-8)"
    return f"""SELECT *, ln({f('open')}) AS log_open, ln({f('high')}) AS log_high, ln({f('low')}) AS log_low,
        ln({f('close')}) AS log_close, ln(1 + greatest(volume, CAST(0 AS DOUBLE))) AS log_volume,
        {c(f"ln({f('close')} / {f('open')})")} AS log_body, {c(f"(close - open) / {f('open')}")} AS body,
        {c(f"(high - greatest(open, close)) / {f('open')}")} AS upper_wick,
        {c(f"(least(open, close) - low) / {f('open')}")} AS lower_wick, {c(f"(high - low) / {f('open')}")} AS range FROM {src}"""


@query("w29_bar_features", sql_with("c1h", f"SELECT symbol, ts, {Rs(' '.join(cd.BAR_FEATURES))} FROM bf", {"bf": bar_sql("c1h")}))
def _(t):
    return rounded(cd.bar_features(t.candles()).select("symbol", "ts", *cd.BAR_FEATURES))


@query("w30_affine_scan", sql_with("id", f"SELECT symbol, ts, {R('y', 2)} AS y FROM r", {
    "recursive r": ema_rec({"y": ("i.close", "0.9 * r.y + 0.25 * i.close - 0.5 * i.low")}, source="id")}))
def _(t):
    from candela.operators.scan import Scan, affine_scan
    b = F.when(F.col("rn") == 1, F.col("close")).otherwise(0.25 * F.col("close") - 0.5 * F.col("low"))
    return rounded(affine_scan(t.daily_indexed(), [Scan("y", 0.9, b)]).select("symbol", "ts", "y"), 2)


# ------------------------------------------------------------------ feature vectors


def tf_sql(params, tag: str, size: int = 251) -> str:
    """Features of one scale; ``w`` is the list of the last closes (oldest first)."""
    rsi_p, fast, slow, signal, bb, es, el, st, ret, ma, sd = params
    a = lambda n: 2 / (n + 1)
    red = lambda n: f"list_reduce(w, lambda acc, x: acc * {1 - a(n)!r} + x * {a(n)!r})"
    hist = (f"list_reduce(list_prepend({{'f': w[1], 's': w[1], 'g': CAST(0 AS DOUBLE)}}, list_transform(w[2:], lambda x: {{'f': x, 's': x, 'g': CAST(0 AS DOUBLE)}})), "
            f"lambda acc, x: {{'f': acc.f * {1 - a(fast)!r} + x.f * {a(fast)!r}, 's': acc.s * {1 - a(slow)!r} + x.s * {a(slow)!r}, "
            f"'g': acc.g * {1 - a(signal)!r} + {a(signal)!r} * ((acc.f * {1 - a(fast)!r} + x.f * {a(fast)!r}) - (acc.s * {1 - a(slow)!r} + x.s * {a(slow)!r}))}})")
    z = lambda e, n: f"coalesce({e}, CAST(0 AS DOUBLE)) AS {n}{tag}"
    return f"""SELECT *, {z('h.f - h.s - h.g', 'macd_hist')} FROM (SELECT *, {hist} AS h,
        {z('v', 'rsi')}, {z(f"(close - (({full('avg', 'close', bb)}) - 2 * ({full('stddev_samp', 'close', bb)}))) / nullif(4 * ({full('stddev_samp', 'close', bb)}), 0)", 'bb_pos')},
        {z(f"(v - ({full('min', 'v', st)})) / nullif(({full('max', 'v', st)}) - ({full('min', 'v', st)}), 0)", 'stoch_rsi')},
        {z(f"({red(es)} - {red(el)}) / nullif(close, 0)", 'ema_cross')},
        {z(f"(close - ({full('sum', 'money', ma)}) / nullif({full('sum', 'volume', ma)}, 0)) / nullif(({full('sum', 'money', ma)}) / nullif({full('sum', 'volume', ma)}, 0), 0)", 'vwap_dev')},
        {z(f"ln(close / lag(close) OVER ({W}))", 'log_ret')}, {z(f"close / lag(close, {ret}) OVER ({W}) - 1", 'ret_n')},
        {z(f"volume / nullif({full('avg', 'volume', ma)}, 0)", 'vol_spike')}, {z("(high - low) / nullif(close, 0)", 'range')},
        {z(f"({full('avg', 'close', ma)}) / nullif(close, 0) - 1", 'ma_rel')}, {z(f"({full('stddev_samp', 'close', sd)}) / nullif(close, 0)", 'std_rel')}
        FROM (SELECT *, list(close) OVER {frame(size)} AS w, {rsi_sql(rsi_p)} AS v, (high + low + close) / 3 * volume AS money FROM g))"""


@query("w26_timeframe_features", sql_with("i1h", f"SELECT symbol, ts, {Rs(' '.join(ind.FEATURE_NAMES))} FROM f", {
    **DELTA, "f": tf_sql(ind.BASE_SCALE, "")}))
def _(t):
    return rounded(ind.timeframe_features(t.indexed()).select("symbol", "ts", *ind.FEATURE_NAMES))


def _vector_sql() -> str:
    extra = dict(DELTA)
    for i, p in enumerate(ind.SCALES):
        names = ", ".join(f"{n}_{i}" for n in ind.FEATURE_NAMES)
        extra[f"f{i}"] = f"SELECT symbol, ts, rn, {names} FROM ({tf_sql(p, f'_{i}')})"
    value = lambda n, i: f"CASE WHEN f0.rn >= {max(50, ind.SCALE_ROWS[i])} THEN {n}_{i} ELSE 0 END"
    rsi = [f"CASE WHEN f0.rn >= {need} THEN rsi_{i} ELSE 50 END" for i, need in enumerate(ind.SCALE_ROWS)]
    parts = [value(n, i) for i in range(5) for n in ind.FEATURE_NAMES]
    late = lambda e: f"CASE WHEN f0.rn >= 50 THEN {e} ELSE 0 END"
    parts += [late("(" + " + ".join(rsi) + ") / 5"), late(f"{rsi[4]} - {rsi[0]}"),
              late(f"least(10, greatest(0, ({value('std_rel', 0)}) / (({value('std_rel', 4)}) + 1e-8)))")]
    cols = ", ".join(f"{R(p)} AS x{k:02d}" for k, p in enumerate(parts))
    joins = " ".join(f"JOIN f{i} ON f{i}.symbol = f0.symbol AND f{i}.rn = f0.rn" for i in range(1, 5))
    return sql_with("i1h", f"SELECT f0.symbol, f0.ts, {cols} FROM f0 {joins}", extra)


@query("w27_feature_vector", _vector_sql())
def _(t):
    v = ind.feature_vector(t.indexed())
    return v.select("symbol", "ts", *[rd(F.col("features")[k]).alias(f"x{k:02d}") for k in range(63)])


TECH_COLS = "rsi_14 macd macd_signal macd_hist bb_upper bb_lower bb_width bb_pos ema_9 ema_21 ema_cross sma_20 sma_50 stoch_rsi vwap_20 vwap_deviation"
_E9, _E21 = ema_step("e9", "i.close", 9), ema_step("e21", "i.close", 21)
TECH = {
    **DELTA,
    "recursive r": ema_rec({"f": ("i.close", _F), "s": ("i.close", _S), "g": ("0", ema_step("g", f"({_F} - {_S})", 9)),
                            "e9": ("i.close", _E9), "e21": ("i.close", _E21)}),
    "q": f"""SELECT *, {rsi_sql(14)} AS rsi_14, {full('avg', 'close', 20)} AS m20, {full('avg', 'close', 50)} AS m50,
        {full('stddev_samp', 'close', 20)} AS sd, ({full('sum', 'money', 20)}) / nullif({full('sum', 'volume', 20)}, 0) AS vw
        FROM (SELECT *, (high + low + close) / 3 * volume AS money FROM g)""",
    "tech": f"""SELECT q.symbol, q.ts, q.rn, q.rsi_14, f - s AS macd, r.g AS macd_signal, f - s - r.g AS macd_hist, m20 + 2 * sd AS bb_upper,
        m20 - 2 * sd AS bb_lower, 4 * sd / nullif(m20, 0) AS bb_width, (close - (m20 - 2 * sd)) / nullif(4 * sd, 0) AS bb_pos,
        e9 AS ema_9, e21 AS ema_21, e9 - e21 AS ema_cross, m20 AS sma_20, m50 AS sma_50, (q.rsi_14 - q.lo) / nullif(q.hi - q.lo, 0) AS stoch_rsi,
        vw AS vwap_20, (close - vw) / nullif(vw, 0) AS vwap_deviation
        FROM (SELECT *, {full('min', 'rsi_14', 14)} AS lo, {full('max', 'rsi_14', 14)} AS hi FROM q) q
        JOIN r ON r.symbol = q.symbol AND r.rn = q.rn""",
}


@query("w00_technical_indicators", sql_with("i1h", f"SELECT symbol, ts, {Rs(TECH_COLS)} FROM tech", TECH))
def _(t):
    return rounded(ind.technical_indicators(t.indexed()).select("symbol", "ts", *TECH_COLS.split()))


_FRAMES = ("15m", "1h", "4h")


@query("a03_indicator_rows", sql_with(" ".join(f"c{i}" for i in _FRAMES), f"SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS timeframe, ts, {Rs(TECH_COLS)} FROM tech", {
    "i1h": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (" + " UNION ALL ".join(
        f"SELECT symbol || '|{i}' AS symbol, ts, open, high, low, close, volume FROM c{i}" for i in _FRAMES) + ")", **TECH}))
def _(t):
    bars = cd.multi_timeframe(cd.ticks_as_bars(t.ticks), _FRAMES, ("ts", "event_id"))
    return rounded(ind.timeframe_indicators(bars, "15m").select("symbol", "timeframe", "ts", *TECH_COLS.split()))


_FILL = {"rsi_14": 50.0, "stoch_rsi": 0.5, "bb_pos": 0.5, "sma_50": 0.0}


@query("p20_fill_warmup_carry", sql_with("i1h", "SELECT symbol, ts, " + ", ".join(
    f"{R(f'coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), {v})')} AS {c}" for c, v in _FILL.items())
    + " FROM tech", TECH))
def _(t):
    df = ind.fill_warmup(ind.technical_indicators(t.indexed()), list(_FILL), "carry")
    return rounded(df.select("symbol", "ts", *_FILL))


@query("p20_fill_warmup_drop", sql_with("i1h", f"SELECT symbol, ts, {Rs(TECH_COLS)} FROM tech WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in TECH_COLS.split()), TECH))
def _(t):
    df = ind.technical_indicators(t.indexed())
    return rounded(ind.fill_warmup(df, TECH_COLS.split()).select("symbol", "ts", *TECH_COLS.split()))


LEAD = ("return_1", "log_return_1", "rsi_14", "macd_hist")


@query("j07_join_lead_asset", sql_with("i1h", "SELECT f.symbol, f.ts, " + ", ".join(f"{R(f'coalesce(b.{c}, 0)')} AS btc_{c}" for c in LEAD)
       + " FROM i1h f LEFT JOIN (SELECT * FROM lead WHERE symbol = 'click') b ON b.ts = f.ts WHERE f.symbol <> 'click'", {
    **TECH, "lead": f"""SELECT tech.*, close / lag(close) OVER (PARTITION BY tech.symbol ORDER BY tech.rn) - 1 AS return_1,
    ln(close / lag(close) OVER (PARTITION BY tech.symbol ORDER BY tech.rn)) AS log_return_1 FROM tech JOIN i1h ON i1h.symbol = tech.symbol AND i1h.rn = tech.rn"""}))
def _(t):
    c = t.indexed()
    lead = ind.technical_indicators(c.filter("symbol = 'click'"), (ind.returns_step(),))
    out = ind.join_lead_asset(c.filter("symbol <> 'click'"), lead)
    return rounded(out.select("symbol", "ts", *[f"btc_{x}" for x in LEAD]))
