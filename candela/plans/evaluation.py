"""Queries over predictions: metrics, alert policies, reports, dataset statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from candela.functions import arrays as ar
from candela.operators import candles as cd, dataset as ds, metrics as mt
from candela.operators.indicators import BASE_SCALE, FEATURE_NAMES
from candela.plans.market import REGIME, bar_sql, tf_sql, DELTA
from candela.plans.news import VISIBLE, _visible
from candela.plans.registry import R, Rs, query, rd, rounded
from candela.plans.tables import _softmax, sql_with
from candela.session import durable

ORDER = ["ts", "pred_id"]
CNT = "SELECT count(*) AS n, " + ", ".join(
    f"count(*) FILTER (label = {c} AND pred = {c}) AS tp{c}, count(*) FILTER (pred = {c}) AS p{c}, count(*) FILTER (label = {c}) AS l{c}" for c in range(3))
F1 = "(" + " + ".join(f"coalesce(2.0 * tp{c} / nullif(p{c} + l{c}, 0), 0)" for c in range(3)) + ") / (" + " + ".join(
    f"CASE WHEN p{c} + l{c} > 0 THEN 1 ELSE 0 END" for c in range(3)) + ")"
_P = lambda a, b: " + ".join(f"{a}{c}::DOUBLE * {b}{c}" for c in range(3))
MCC = f"coalesce(((tp0 + tp1 + tp2)::DOUBLE * n - ({_P('p', 'l')})) / nullif(sqrt((n::DOUBLE * n - ({_P('p', 'p')})) * (n::DOUBLE * n - ({_P('l', 'l')}))), 0), 0)"
BIN = "(" + " + ".join(f"CASE WHEN max_prob >= {i * 0.1!r} THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"
CAL = f"SELECT {BIN} AS bin, count(*) AS count, avg(max_prob) AS conf_mean, avg(CAST(pred = label AS INTEGER)) AS acc FROM predictions GROUP BY 1"
ECE = {"cal": CAL, "ece": "SELECT sum(abs(conf_mean - acc) * count) / sum(count) AS ece FROM cal"}


@query("m01_macro_f1", sql_with("predictions", f"SELECT {R(F1)} AS macro_f1 FROM c", {"c": CNT + " FROM predictions"}))
def _(t):
    return rounded(mt.macro_f1(t.predictions))


@query("m02_mcc", sql_with("predictions", f"SELECT {R(MCC)} AS mcc FROM c", {"c": CNT + " FROM predictions"}))
def _(t):
    return rounded(mt.mcc(t.predictions))


@query("m02_mcc_labels", sql_with("", f"SELECT {R(MCC)} AS mcc, {R(F1)} AS macro_f1 FROM c", {"c": CNT + " FROM (SELECT quality AS label, toxic AS pred FROM labels)"}))
def _(t):
    rows = t.raw("labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    return rounded(mt.class_counts(rows).select(mt.mcc_expr().alias("mcc"), mt.f1_expr().alias("macro_f1")))


@query("m03_mae_rmse", sql_with("predictions", f"SELECT {R('avg(abs(confidence - 0.5 - ret))')} AS mae, {R('sqrt(avg((confidence - 0.5 - ret) ** 2))')} AS rmse FROM predictions"))
def _(t):
    return rounded(mt.mae_rmse(t.predictions.withColumn("ret_pred", F.col("confidence") - 0.5)))


@query("m04_calibration_table", sql_with("predictions", f"SELECT CAST(bin AS INTEGER) AS bin, count, {R('conf_mean')} AS conf_mean, {R('acc')} AS acc, {R('abs(conf_mean - acc)')} AS gap FROM cal", ECE))
def _(t):
    return rounded(mt.calibration_table(t.predictions))


@query("m04_ece", sql_with("predictions", f"SELECT {R('sum(abs(conf_mean - acc) * count) / sum(count)')} AS ece, {R('max(abs(conf_mean - acc))')} AS worst_gap, CAST(arg_max(bin, abs(conf_mean - acc)) AS INTEGER) AS worst_bin FROM cal", ECE))
def _(t):
    return rounded(mt.ece(t.predictions))


@query("m05_brier", sql_with("predictions", f"SELECT {R('avg((max_prob - CAST(pred = label AS INTEGER)) ** 2)')} AS brier FROM predictions"))
def _(t):
    return rounded(mt.brier(t.predictions))


LIM = {"lim": "SELECT quantile_cont(confidence, 0.7) AS tau, quantile_cont(max_prob, 0.6) AS gamma FROM predictions",
       "al": "SELECT predictions.*, tau, gamma, confidence >= tau AND max_prob >= gamma AS alert FROM predictions, lim"}


def _limits(t):
    return mt.thresholds(t.predictions, "pred_id")


@query("m06_alert_precision", sql_with("predictions", f"""SELECT {R('count(*) FILTER (alert AND pred = label) / count(*) FILTER (alert)')} AS alert_precision,
    {R('count(*) FILTER (alert) / count(*)')} AS alert_coverage, {R('1 - count(*) FILTER (alert AND pred = label) / count(*) FILTER (alert)')} AS selective_risk FROM al""", LIM))
def _(t):
    return rounded(mt.alert_precision(t.predictions, _limits(t)))


@query("m06_thresholds", sql_with("predictions", f"SELECT {Rs('tau gamma')} FROM lim", LIM))
def _(t):
    return rounded(_limits(t))


def auc_sql(score: str, pos: str, src: str) -> str:
    return f"""SELECT (sum(CASE WHEN pos THEN r END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS a
        FROM (SELECT {pos} AS pos, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {src})"""


@query("m07_macro_auc", sql_with("predictions", f"SELECT {R('(a0.a + a1.a + a2.a) / 3')} AS auc FROM a0, a1, a2", {
    f"a{c}": auc_sql(f"probs[{c + 1}]", f"label = {c}", "predictions") for c in range(3)}))
def _(t):
    return rounded(mt.macro_auc(t.predictions))


@query("m08_aurc", sql_with("predictions", f"SELECT {R('sum((cov - lag_cov) * (risk + lag_risk) / 2)')} AS aurc FROM z", {
    "th": "SELECT i, CASE WHEN i = 19 THEN lo ELSE hi + i * ((lo - hi) / 19) END AS t FROM (SELECT max(max_prob) AS hi, min(max_prob) AS lo FROM predictions), range(20) q(i)",
    "cu": "SELECT i, count(*) / (SELECT count(*) FROM predictions) AS cov, 1 - avg(CAST(pred = label AS INTEGER)) AS risk FROM th JOIN predictions ON max_prob >= t GROUP BY i",
    "z": "SELECT *, lag(cov) OVER (ORDER BY i) AS lag_cov, lag(risk) OVER (ORDER BY i) AS lag_risk FROM cu"}))
def _(t):
    return rounded(mt.aurc(t.predictions))


def dd_ctes(src: str, col: str, part: str = "") -> dict[str, str]:
    p = f"PARTITION BY {part} " if part else ""
    k = f"{part}, " if part else ""
    return {"eq": f"SELECT {k}ts, pred_id, {col}, sum(ln(1 + {col})) OVER ({p}ORDER BY ts, pred_id) AS lg FROM {src}",
            "pk": f"SELECT *, max(lg) OVER ({p}ORDER BY ts, pred_id ROWS UNBOUNDED PRECEDING) AS top FROM eq",
            "dd": f"SELECT {k}CASE WHEN count(*) < 2 THEN 0 ELSE min(exp(lg - top) - 1) END AS mdd FROM pk" + (f" GROUP BY {part}" if part else "")}


RATIOS = ("CASE WHEN count(*) < 2 OR stddev_pop(ret) < 1e-6 THEN 0 ELSE avg(ret) / stddev_pop(ret) END",
          "avg(ret) / sqrt(avg(least(ret, 0) ** 2))")


@query("m09_risk_ratios", sql_with("predictions", f"""SELECT {R(RATIOS[0])} AS sharpe, {R(RATIOS[1])} AS sortino, {R('avg(ret) * 8760 / abs(any_value(mdd))')} AS calmar,
    {R('any_value(mdd)')} AS max_drawdown FROM predictions, dd""", dd_ctes("predictions", "ret")))
def _(t):
    return rounded(mt.risk_ratios(t.predictions, ORDER))


@query("m10_max_drawdown", sql_with("predictions", f"SELECT {R('mdd')} AS max_drawdown FROM dd", dd_ctes("predictions", "ret")))
def _(t):
    return rounded(mt.max_drawdown(t.predictions, ORDER))


POL = {
    "fired": "SELECT g.policy_id, p.*, CASE pred WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS sgn FROM grid g JOIN predictions p ON confidence >= g.tau AND max_prob >= g.gamma",
    "net": "SELECT *, sgn * ret - CASE WHEN sgn <> 0 THEN 0.001 ELSE 0 END AS net FROM fired",
    "held": "SELECT * FROM net WHERE sgn <> 0",
    **dd_ctes("held", "net", "policy_id"),
    "pa": "SELECT policy_id, count(*) AS a, count(*) FILTER (pred = label) AS hit, count(*) FILTER (pred = 0) AS a0, count(*) FILTER (pred = 1) AS a1, count(*) FILTER (pred = 2) AS a2, sum(net) AS pnl FROM net GROUP BY policy_id",
    "pt": "SELECT policy_id, count(*) AS k, avg(net) AS mean, stddev_pop(net) AS sd, sqrt(avg(least(net, 0) ** 2)) AS down, sum(net) AS pos_pnl, count(*) FILTER (net > 0) AS wins FROM held GROUP BY policy_id",
    "px": """SELECT g.policy_id, g.tau, g.gamma, n, coalesce(a, 0) AS a, coalesce(k, 0) AS k, hit, a0, a1, a2, coalesce(pnl, 0) AS pnl, mean, sd, down, coalesce(pos_pnl, 0) AS position_pnl, wins, mdd,
        coalesce(a, 0) = 0 OR coalesce(k, 0) < greatest(20, floor(0.05 * n)) AS sup
        FROM grid g LEFT JOIN pa USING (policy_id) LEFT JOIN pt USING (policy_id) LEFT JOIN dd USING (policy_id), (SELECT count(*) AS n FROM predictions)""",
    "pol": """SELECT policy_id, tau, gamma, coalesce(hit / nullif(a, 0), 0) AS alert_precision, a / n AS alert_coverage, 1 - coalesce(hit / nullif(a, 0), 0) AS selective_risk,
        CASE WHEN sup THEN 0 WHEN k < 2 OR sd < 1e-6 THEN 0 ELSE mean / sd END AS alert_sharpe, CASE WHEN sup OR k < 2 THEN 0 WHEN down = 0 THEN CASE WHEN mean <= 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE mean / down END AS alert_sortino,
        CASE WHEN sup THEN 0 ELSE coalesce(mean * 8760 / nullif(abs(mdd), 0), 0) END AS alert_calmar, CASE WHEN sup THEN 0 ELSE mdd END AS alert_max_dd,
        CASE WHEN sup THEN 0 ELSE coalesce(wins / nullif(k, 0), 0) END AS hit_rate, pnl, k / n AS trade_coverage, coalesce(a1 / nullif(a, 0), 0) AS neutral_share,
        CAST(k AS BIGINT) AS n_position_alerts, position_pnl, sup AS sharpe_suppressed, coalesce(a0 / nullif(a, 0), 0) AS alert_down, coalesce(a1 / nullif(a, 0), 0) AS alert_neutral, coalesce(a2 / nullif(a, 0), 0) AS alert_up FROM px""",
}
ONE = {"lim": LIM["lim"], "grid": "SELECT 0 AS policy_id, tau, gamma FROM lim", **POL}
BT = "tau gamma alert_coverage alert_sharpe alert_sortino alert_calmar alert_max_dd hit_rate pnl trade_coverage neutral_share position_pnl"
EV = BT + " alert_precision selective_risk alert_down alert_neutral alert_up"


@query("m11_alert_backtest", sql_with("predictions", f"SELECT {Rs(BT)}, n_position_alerts, sharpe_suppressed FROM pol", ONE))
def _(t):
    return rounded(mt.alert_backtest(t.predictions, _limits(t), ORDER))


@query("m11_alert_backtest_suppressed", sql_with("predictions", f"SELECT {Rs(BT)}, n_position_alerts, sharpe_suppressed FROM pol", {
    "grid": "SELECT 0 AS policy_id, CAST(0.85 AS DOUBLE) AS tau, CAST(0.3 AS DOUBLE) AS gamma", **POL}))
def _(t):
    return rounded(mt.alert_backtest(t.predictions, mt.fixed_thresholds(t.predictions, 0.85, 0.3), ORDER))


@query("m12_evaluate_policy", sql_with("predictions", f"SELECT {Rs(EV)}, n_position_alerts, sharpe_suppressed FROM pol", ONE))
def _(t):
    return rounded(mt.evaluate_policy(t.predictions, _limits(t), ORDER))


_TQ = ", ".join(f"quantile_cont(confidence, {p})" for p in mt.TAU_GRID)
_GQ = ", ".join(f"quantile_cont(max_prob, {p})" for p in mt.GAMMA_GRID)
GRID = {"gq": f"SELECT list_sort(list_distinct([{_TQ}])) AS ts, list_sort(list_distinct([{_GQ}])) AS gs FROM predictions",
        "grid": "SELECT CAST((i - 1) * 10 + j - 1 AS INTEGER) AS policy_id, ts[i] AS tau, gs[j] AS gamma FROM gq, range(1, 5) a(i), range(1, 5) b(j) WHERE i <= len(ts) AND j <= len(gs)"}
SCORE = lambda sh, cov: f"""(0.40 * least(1, greatest(0, macro_f1)) + 0.35 * least(1, greatest(-1, ({sh}) / 2)) - 0.15 * (1 - least(1, greatest(0, 1 - ece)))
    + 0.10 * least(1, greatest(0, (mcc + 1) / 2)) - CASE WHEN {cov} < 0.05 THEN 0.30 * (0.05 - {cov}) / 0.05 ELSE 0 END - CASE WHEN abs({sh}) < 1e-6 AND {cov} >= 0.05 THEN 0.05 ELSE 0 END)"""
SEARCH = {
    **GRID, **POL, **ECE, "cc": CNT + " FROM predictions", "fm": f"SELECT {F1} AS macro_f1, {MCC} AS mcc FROM cc",
    "ob": f"""SELECT pol.*, {SCORE('CASE WHEN sharpe_suppressed THEN 0 ELSE alert_sharpe END', 'alert_coverage')} AS model_score,
        0.04 * alert_precision + 0.03 * hit_rate + CASE WHEN sharpe_suppressed THEN 0 ELSE 0.20 * least(0.5, greatest(-0.5, alert_sharpe)) + 0.05 * least(0.8, greatest(-0.5, alert_sortino)) + 0.04 * least(1, greatest(-0.5, alert_calmar)) END
        - (0.70 * greatest(0, 0.35 - alert_coverage) + 0.20 * greatest(0, alert_coverage - 0.40) + 0.60 * greatest(0, 0.07 - alert_coverage) + 0.80 * greatest(0, 0.07 - trade_coverage))
        - CASE WHEN sharpe_suppressed THEN 0.20 ELSE 0.18 * greatest(0, -alert_sharpe) END
        + CASE WHEN trade_coverage >= 0.05 THEN 0.05 + CASE WHEN (position_pnl >= 0 OR alert_sharpe >= 0) AND hit_rate >= 0.4 THEN 0.05 ELSE 0 END
            + CASE WHEN (position_pnl >= 0 OR alert_sharpe >= 0) AND hit_rate >= 0.5 THEN 0.05 ELSE 0 END ELSE 0 END
        - CASE WHEN neutral_share > 0.7 THEN 0.15 * least(1, (neutral_share - 0.7) / 0.3) ELSE 0 END
        - CASE WHEN trade_coverage >= 0.05 AND alert_sharpe < 0 THEN least(0.05, abs(alert_sharpe) * 0.15) ELSE 0 END AS rest,
        NOT sharpe_suppressed AND alert_coverage >= 0.07 AND trade_coverage >= 0.07 AS compliant FROM pol, fm, ece""",
    "ranked": """SELECT *, model_score + rest AS policy_objective, row_number() OVER (ORDER BY CASE WHEN compliant THEN 2 WHEN trade_coverage > 0 THEN 1 ELSE 0 END DESC,
        CASE WHEN compliant THEN model_score + rest ELSE trade_coverage END DESC, CASE WHEN compliant THEN 0 ELSE n_position_alerts END DESC, model_score + rest DESC, policy_id) AS place FROM ob""",
}


@query("m13_search_policy", sql_with("predictions", f"SELECT policy_id, {Rs('tau gamma alert_coverage trade_coverage model_score policy_objective')}, compliant FROM ranked WHERE place = 1", SEARCH))
def _(t):
    best = mt.search_policy(t.predictions, ORDER, "pred_id")
    return rounded(best.select(F.col("policy_id").cast("int").alias("policy_id"), "tau", "gamma", "alert_coverage", "trade_coverage", "model_score", "policy_objective", "compliant"))


@query("j18_cross_grid", sql_with("predictions", f"SELECT policy_id, count(*) AS alerts, {R('avg(ret)')} AS mean_ret FROM fired GROUP BY policy_id", {**GRID, "fired": POL["fired"]}))
def _(t):
    rows = mt.cross_grid(t.predictions.select("confidence", "max_prob", "ret"), mt.policy_grid(t.predictions, "pred_id"))
    rows = rows.filter((F.col("confidence") >= F.col("tau")) & (F.col("max_prob") >= F.col("gamma")))
    return rounded(rows.groupBy(F.col("policy_id").cast("int").alias("policy_id")).agg(F.count(F.lit(1)).alias("alerts"), F.avg("ret").alias("mean_ret")))


@query("m14_selection_score", sql_with("predictions", f"SELECT policy_id, {R('model_score')} AS model_score FROM ob", SEARCH))
def _(t):
    p = t.predictions
    base = mt.class_counts(p).select(mt.f1_expr().alias("macro_f1"), mt.mcc_expr().alias("mcc")).join(F.broadcast(mt.ece(p).select("ece")))
    rows = mt.policy_table(p, mt.policy_grid(p, "pred_id"), ORDER).join(F.broadcast(base))
    sharpe = F.when(F.col("sharpe_suppressed"), 0.0).otherwise(F.col("alert_sharpe"))
    return rounded(rows.select(F.col("policy_id").cast("int").alias("policy_id"), mt.selection_score(F.col("macro_f1"), F.col("mcc"), F.col("ece"), sharpe, F.col("alert_coverage")).alias("model_score")))


TEMP = {"tg": f"SELECT unnest({list(mt.TEMPERATURES)}) AS temperature",
        "nl": "SELECT temperature, avg(-ln(greatest(exp(logits[label + 1] / temperature) / list_sum(list_transform(logits, lambda x: exp(x / temperature))), 1e-8))) AS nll FROM predictions, tg GROUP BY temperature"}


@query("m15_temperature_nll", sql_with("predictions", f"SELECT CAST(temperature AS DOUBLE) AS temperature, {R('nll')} AS nll FROM nl", TEMP))
def _(t):
    return rounded(mt.temperature_nll(t.predictions).select("temperature", "nll"))


@query("m15_fit_temperature", sql_with("predictions", f"SELECT {R('least(2.5, greatest(0.5, arg_min(temperature, nll)))')} AS temperature, {R('min(nll)')} AS temperature_nll FROM nl", TEMP))
def _(t):
    return rounded(mt.fit_temperature(t.predictions))


@query("m16_deletion_insertion", sql_with("predictions", f"""SELECT {R('avg(greatest(probs[label + 1] - masked_probs[label + 1], 0))')} AS deletion_drop,
    {R('avg(greatest(probs[label + 1] - 1 / 3::DOUBLE, 0))')} AS insertion_gain, {R('avg(greatest(masked_probs[label + 1] - probs[label + 1], 0))')} AS sufficiency_drop FROM predictions"""))
def _(t):
    p = t.predictions.withColumn("empty", F.array(*[F.lit(1 / 3)] * 3))
    a = mt.deletion_insertion(p, "probs", "masked_probs").select("deletion_drop")
    b = mt.deletion_insertion(p, "masked_probs", "probs", "empty", "probs").select("insertion_gain", "sufficiency_drop")
    return rounded(a.join(F.broadcast(b)))


OCC = "SELECT *, list_max(probs) - list_max(masked_probs) AS gap FROM predictions"


@query("m17_occlusion_stats", sql_with("predictions", f"""SELECT count(*) AS num_samples, {R('avg(gap)')} AS gap_mean, {R('stddev_pop(gap)')} AS gap_std, {R('min(gap)')} AS gap_min, {R('max(gap)')} AS gap_max,
    {R('median(gap)')} AS gap_median, {R('avg(CAST(gap > 0.05 AS INTEGER))')} AS fidelity_ratio, {R('avg(CAST(gap > 0 AS INTEGER))')} AS positive_ratio,
    {R('avg(CAST(list_position(probs, list_max(probs)) <> list_position(masked_probs, list_max(masked_probs)) AS INTEGER))')} AS direction_change_ratio FROM g""", {"g": OCC}))
def _(t):
    return rounded(mt.occlusion_stats(t.predictions, "pred_id"))


@query("m17_attention_gap_correlation", sql_with("predictions", f"SELECT {R('corr(confidence, gap)')} AS correlation FROM g", {"g": OCC}))
def _(t):
    return rounded(mt.correlation(t.predictions.withColumn("gap", F.array_max("probs") - F.array_max("masked_probs")), "confidence", "gap"))


TOPS = {"tp": """SELECT article_id, (list_transform(list_reverse_sort(list_transform(range(1, 11), lambda i: {'v': factors[i], 'i': -i})), lambda x: -x.i))[1:3] AS a,
    (list_transform(list_reverse_sort(list_transform(range(1, 11), lambda i: {'v': factors[i] + entity[i] / 10, 'i': -i})), lambda x: -x.i))[1:3] AS b
    FROM factor_probs JOIN entity_sentiment USING (article_id)"""}


def _top3(t):
    rows = t.factor_probs.join(t.entity_sentiment, ["article_id"])
    top = lambda arr: F.transform(F.slice(F.reverse(F.array_sort(F.transform(arr, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))), 1, 3), lambda x: -x["i"])
    mixed = F.zip_with("factors", "entity", lambda f, e: f + e / 10)
    return rows.select("article_id", top(F.col("factors")).alias("a"), top(mixed).alias("b"))


@query("m18_factor_consistency", sql_with("factor_probs entity_sentiment", f"SELECT count(*) AS num_samples, {R('avg(j)')} AS jaccard_mean, {R('median(j)')} AS jaccard_median FROM (SELECT len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM tp)", TOPS))
def _(t):
    return rounded(mt.factor_consistency(_top3(t), "a", "b", "article_id"))


@query("m18_mode_agreement", sql_with("factor_probs entity_sentiment", f"SELECT {R('avg(m)')} AS factor_consistency FROM (SELECT s, max(k) / sum(k) AS m FROM (SELECT article_id // 5 AS s, a[1] AS f, count(*) AS k FROM tp GROUP BY 1, 2) GROUP BY s)", TOPS))
def _(t):
    rows = _top3(t).select(F.floor(F.col("article_id") / 5).alias("s"), F.col("a")[0].alias("f"))
    return rounded(mt.mode_agreement(rows, "s", "f"))


@query("m19_hit_rate", sql_with("predictions", f"SELECT {R('avg(CAST(ret > 0 AS INTEGER)) FILTER (confidence >= tau)')} AS hit_rate FROM predictions, lim", {"lim": LIM["lim"]}))
def _(t):
    return rounded(mt.hit_rate(t.predictions, _limits(t)))


REG = " , ".join([f"count(*) FILTER (alert AND pred = {c}) AS a{c}" for c in range(3)])


@query("m20_regime_report", sql_with("predictions", f"""SELECT regime, n, {R(f'CASE WHEN n > 1 THEN {F1} ELSE 0 END')} AS f1, {R(f'CASE WHEN n > 1 THEN {MCC} ELSE 0 END')} AS mcc,
    {R('p0 / n')} AS pred_down, {R('p1 / n')} AS pred_neutral, {R('p2 / n')} AS pred_up, {R('coalesce(a0 / nullif(a, 0), 0)')} AS alert_down, {R('coalesce(a1 / nullif(a, 0), 0)')} AS alert_neutral,
    {R('coalesce(a2 / nullif(a, 0), 0)')} AS alert_up, {R('a / n')} AS alert_cov, {R('k / n')} AS trade_cov, CAST(k AS BIGINT) AS n_pos, {R('coalesce(w / nullif(k, 0), 0)')} AS pos_hit, {R('coalesce(pnl, 0)')} AS pos_pnl FROM q""", {
    **LIM, "q": CNT.replace("SELECT", "SELECT pred_id % 4 AS regime,", 1) + f""", {REG}, count(*) FILTER (alert) AS a, count(*) FILTER (alert AND pred <> 1) AS k,
    count(*) FILTER (alert AND pred <> 1 AND (pred - 1) * ret - 0.001 > 0) AS w, sum((pred - 1) * ret - 0.001) FILTER (alert AND pred <> 1) AS pnl FROM al GROUP BY 1"""}))
def _(t):
    return rounded(mt.regime_report(t.predictions.withColumn("regime", F.pmod("pred_id", F.lit(4))), _limits(t)))


_CR = []
for _c, _x in enumerate(("down", "neutral", "up")):
    _CR += [f"{R(f'avg(CAST(pred = {_c} AS INTEGER))')} AS pred_{_x}", f"{R(f'count(*) FILTER (label = {_c} AND pred = {_c}) / count(*) FILTER (label = {_c})')} AS recall_{_x}",
            f"{R(f'coalesce(avg(confidence) FILTER (pred = {_c}), 0)')} AS conf_{_x}", f"{R(f'coalesce(avg(max_prob) FILTER (pred = {_c}), 0)')} AS maxprob_{_x}",
            f"{R(f'coalesce(avg(confidence) FILTER (alert AND pred = {_c}), 0)')} AS conf_alert_{_x}", f"{R(f'coalesce(avg(confidence * (1 - probs[2])) FILTER (pred = {_c}), 0)')} AS pos_conf_{_x}"]


@query("m21_class_report", sql_with("predictions", f"""SELECT {', '.join(_CR)}, {R('coalesce(avg(confidence - tau) FILTER (alert AND pred = 1), 0)')} AS neutral_conf_slack,
    {R('coalesce(avg(max_prob - gamma) FILTER (alert AND pred = 1), 0)')} AS neutral_prob_slack,
    count(*) FILTER (label = 0 AND pred = 0) / count(*) FILTER (label = 0) < 0.05 OR count(*) FILTER (label = 2 AND pred = 2) / count(*) FILTER (label = 2) < 0.05 AS recall_collapse,
    greatest(avg(CAST(pred = 0 AS INTEGER)), avg(CAST(pred = 1 AS INTEGER)), avg(CAST(pred = 2 AS INTEGER))) > 0.9 AS share_collapse FROM al""", LIM))
def _(t):
    return rounded(mt.class_report(t.predictions, _limits(t)))


@query("m22_deploy_gate", sql_with("predictions", """SELECT policy_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN trade_coverage < 0.05 THEN 'trade_cov<0.05' END,
    CASE WHEN sharpe_suppressed THEN 'sharpe_suppressed' END, CASE WHEN position_pnl < 0 AND alert_sharpe < 0 THEN 'pnl_and_sharpe_negative' END], lambda x: x IS NOT NULL), ','), ''), 'ok') AS reason,
    NOT (trade_coverage < 0.05 OR sharpe_suppressed OR (position_pnl < 0 AND alert_sharpe < 0)) AS deployable FROM pol""", {**GRID, **POL}))
def _(t):
    rows = mt.policy_table(t.predictions, mt.policy_grid(t.predictions, "pred_id"), ORDER)
    return mt.deploy_gate(rows).select(F.col("policy_id").cast("int").alias("policy_id"), "reason", "deployable")


@query("m23_majority_baseline", sql_with("predictions", f"SELECT {R(F1)} AS macro_f1, {R('tp0 + tp1 + tp2')} AS hits FROM c", {
    "mj": "SELECT label AS m FROM predictions GROUP BY label ORDER BY count(*) DESC, label LIMIT 1",
    "c": CNT + " FROM (SELECT label, m AS pred FROM predictions, mj)"}))
def _(t):
    rows = mt.majority_baseline(t.predictions)
    return rounded(mt.class_counts(rows).select(mt.f1_expr().alias("macro_f1"), (F.col("tp0") + F.col("tp1") + F.col("tp2")).cast("double").alias("hits")))


SPLIT = {"sp": "SELECT *, row_number() OVER (ORDER BY ts, pred_id) AS rn, count(*) OVER () AS n FROM predictions"}


@query("m24_momentum_baseline", sql_with("predictions", f"""SELECT pred_id, CAST(CASE WHEN logits[1] >= hi THEN 2 WHEN logits[1] <= lo THEN 0 ELSE 1 END AS INTEGER) AS pred,
    {R('least(0.99, greatest(0.5, 0.5 + 0.25 * abs(logits[1] - mid) / sd))')} AS confidence FROM sp,
    (SELECT quantile_cont(logits[1], 0.33) AS lo, quantile_cont(logits[1], 0.67) AS hi, median(logits[1]) AS mid, stddev_pop(logits[1]) + 1e-8 AS sd FROM sp WHERE rn <= floor(n * 0.7)) WHERE rn > floor(n * 0.7)""", SPLIT))
def _(t):
    rows = ds.chrono_split(t.predictions.withColumn("signal", F.col("logits")[0]), ORDER, (0.7,), ("train", "test"))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    return rounded(mt.momentum_baseline(train, test, "signal", "pred_id").select("pred_id", "pred", "confidence"))


@query("m35_move_size_report", sql_with("predictions", f"""SELECT {R(F1)} AS bin_f1, {R('acc')} AS bin_accuracy, {R('sprec')} AS strong_precision, {R('sdir')} AS strong_direction_accuracy,
    {R('p0 / n')} AS share_none, {R('p1 / n')} AS share_marginal, {R('p2 / n')} AS share_strong FROM c, x""", {
    "b": "SELECT CASE WHEN abs(ret) >= 0.01 THEN 2 WHEN abs(ret) > 0.005 THEN 1 ELSE 0 END AS label, pred_id % 3 AS pred, pred = label AS ok FROM predictions",
    "c": CNT + " FROM b", "x": """SELECT avg(CAST(label = pred AS INTEGER)) AS acc, count(*) FILTER (pred = 2 AND label = 2) / count(*) FILTER (pred = 2) AS sprec,
    count(*) FILTER (pred = 2 AND ok) / count(*) FILTER (pred = 2) AS sdir FROM b"""}))
def _(t):
    return rounded(mt.move_size_report(t.predictions.withColumn("bin_pred", F.pmod("pred_id", F.lit(3))), 0.005))


EDGE = {"ed": "SELECT label, 1 / (1 + exp(-20 * logits[3])) AS u, 1 / (1 + exp(-20 * logits[1])) AS d FROM predictions"}


@query("m36_edge_report", sql_with("predictions", f"""SELECT {R('avg(CAST(u > 0.5 AS INTEGER))')} AS up_rate, {R('avg(CAST(d > 0.5 AS INTEGER))')} AS down_rate, {R('avg(CAST(u > 0.5 OR d > 0.5 AS INTEGER))')} AS coverage,
    {R('avg(CAST(u > 0.5 AND d > 0.5 AS INTEGER))')} AS conflict, {R('count(*) FILTER (u > 0.5 AND label = 2) / count(*) FILTER (u > 0.5)')} AS up_precision,
    {R('count(*) FILTER (d > 0.5 AND label = 0) / count(*) FILTER (d > 0.5)')} AS down_precision, {R('any_value(ua.a)')} AS up_auc, {R('any_value(da.a)')} AS down_auc FROM ed, ua, da""", {
    **EDGE, "ua": auc_sql("u", "label = 2", "ed"), "da": auc_sql("d", "label = 0", "ed")}))
def _(t):
    s = lambda i: 1 / (1 + F.exp(-20 * F.col("logits")[i]))
    return rounded(mt.edge_report(t.predictions.withColumns({"up_score": s(2), "down_score": s(0)})))


@query("m37_return_correlation_trade_ece", sql_with("predictions", f"SELECT {R('(SELECT corr(confidence, ret) FROM predictions)')} AS correlation, {R('sum(abs(cm - acc) * k) / sum(k)')} AS ece_trade FROM (SELECT {BIN} AS b, count(*) AS k, avg(max_prob) AS cm, avg(CAST(pred = label AS INTEGER)) AS acc FROM predictions WHERE pred <> 1 GROUP BY 1)"))
def _(t):
    p = t.predictions
    return rounded(mt.correlation(p, "confidence", "ret").join(F.broadcast(mt.trade_ece(p))))


def _split_sql() -> str:
    fit = {k: v.replace("predictions", "fitp") for k, v in SEARCH.items()}
    ev = {f"e_{k}": v.replace("predictions", "evp") for k, v in POL.items()}
    names = list(POL)
    import re
    for k in ev:
        for n in sorted(names, key=len, reverse=True):
            ev[k] = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 e_{n}", ev[k])
        ev[k] = re.sub(r"\b(FROM|JOIN) grid\b", r"\1 e_grid", ev[k])
    return sql_with("predictions", f"""SELECT {Rs('tau gamma alert_coverage trade_coverage pnl')}, (SELECT {R('least(2.5, greatest(0.5, arg_min(temperature, nll)))')} FROM nl) AS temperature FROM e_pol""", {
        **SPLIT, "fitp": "SELECT * FROM sp WHERE rn <= floor(n * 0.5)", "evp": "SELECT * FROM sp WHERE rn > floor(n * 0.5)", **fit,
        "tg": TEMP["tg"], "nl": TEMP["nl"].replace("predictions", "fitp"), "e_grid": "SELECT 0 AS policy_id, tau, gamma FROM ranked WHERE place = 1", **ev})


@query("m38_split_calibrate", _split_sql())
def _(t):
    out = mt.split_calibrate(t.predictions, ORDER, "pred_id", 0.5)
    return rounded(out.select("tau", "gamma", "alert_coverage", "trade_coverage", "pnl", "temperature"))


# ------------------------------------------------------------------ dataset tables


FOLDS = "SELECT pred_id % 6 AS fold, avg(confidence) AS model_score, avg(max_prob) AS val_acc, avg(ret) AS val_loss, CASE pred_id % 6 WHEN 5 THEN NULL ELSE sum(ret) > 0 END AS deployable FROM predictions GROUP BY pred_id % 6"


def _folds(t):
    f = F.pmod("pred_id", F.lit(6))
    g = t.predictions.groupBy(f.alias("fold")).agg(F.avg("confidence").alias("model_score"), F.avg("max_prob").alias("val_acc"), F.avg("ret").alias("val_loss"), (F.sum("ret") > 0).alias("_d"))
    return g.withColumn("deployable", F.when(F.col("fold") != 5, F.col("_d"))).drop("_d")


@query("a23_fold_summary", sql_with("predictions", " UNION ALL ".join(f"SELECT '{c}' AS metric, {R(f'avg({c})', 9)} AS mean, {R(f'stddev_samp({c})', 9)} AS std, count({c}) AS folds FROM f" for c in ("model_score", "val_acc", "val_loss")), {"f": FOLDS}))
def _(t):
    return rounded(mt.fold_summary(_folds(t), ("model_score", "val_acc", "val_loss")), 9)


@query("a24_choose_deploy_fold", sql_with("predictions", f"""SELECT first(fold ORDER BY coalesce(deployable, false) DESC, model_score DESC, fold) AS fold, {R('first(model_score ORDER BY coalesce(deployable, false) DESC, model_score DESC, fold)')} AS score,
    count(*) FILTER (deployable) AS n_deployable, count(deployable) AS n_known, CASE WHEN count(*) FILTER (deployable) > 0 THEN 'ok' WHEN count(deployable) > 0 THEN 'not_recommended' ELSE 'unknown' END AS deploy_status FROM f""", {"f": FOLDS}))
def _(t):
    return rounded(mt.choose_deploy_fold(_folds(t)))


@query("a16_entity_sentiment_stats", sql_with("entity_sentiment", f"""SELECT CAST(f - 1 AS INTEGER) AS factor, {R('avg(entity[f])')} AS mean, {R('stddev_pop(entity[f])')} AS std,
    {R('avg(CAST(entity[f] > 0.1 AS INTEGER))')} AS positive_share, {R('avg(CAST(entity[f] < -0.1 AS INTEGER))')} AS negative_share FROM entity_sentiment, range(1, 11) q(f) GROUP BY f"""))
def _(t):
    return rounded(ds.entity_sentiment_stats(t.entity_sentiment))


@query("a17_factor_class_weights", sql_with("factor_probs", f"SELECT CAST(f AS INTEGER) AS factor, n, {R('w / avg(w) OVER ()')} AS weight FROM w", {
    "c": "SELECT list_position(factors, list_max(factors)) - 1 AS f, count(*) AS n FROM factor_probs GROUP BY 1",
    "w": "SELECT q.f, coalesce(n, 0) AS n, 1 / sqrt(greatest(coalesce(n, 0) / (SELECT sum(n) FROM c), 1e-4)) AS w FROM range(10) q(f) LEFT JOIN c ON c.f = q.f"}))
def _(t):
    return rounded(ds.factor_class_weights(t.factor_probs, 10))


LAB = {"la": "SELECT *, (lead(close, 1) OVER w - lead(open, 1) OVER w) / lead(open, 1) OVER w AS ret FROM i1h WINDOW w AS (PARTITION BY symbol ORDER BY rn)",
       "lb": "SELECT *, CAST(CASE WHEN ret > 0.002 THEN 2 WHEN ret < -0.002 THEN 0 WHEN ret IS NOT NULL THEN 1 END AS INTEGER) AS direction FROM la"}


@query("j17_look_ahead", sql_with("i1h", f"""SELECT symbol, ts, {R('lead(open, 1) OVER w')} AS exec_open, {R('lead(close, 4) OVER w')} AS label_close,
    {R('(lead(close, 4) OVER w - lead(open, 1) OVER w) / lead(open, 1) OVER w')} AS ret FROM i1h WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""))
def _(t):
    return rounded(ds.look_ahead(t.indexed(), 4).select("symbol", "ts", "exec_open", "label_close", "ret"))


for _h, _k, _e in (("1h", 1, 0.002), ("4h", 4, 0.005), ("24h", 24, 0.01)):
    query(f"f25_direction_label_{_h}", sql_with("i1h", f"""SELECT symbol, ts, CAST(CASE WHEN ret > {_e} THEN 2 WHEN ret < -{_e} THEN 0 WHEN ret IS NOT NULL THEN 1 END AS INTEGER) AS direction
        FROM (SELECT *, (lead(close, {_k}) OVER w - lead(open, 1) OVER w) / lead(open, 1) OVER w AS ret FROM i1h WINDOW w AS (PARTITION BY symbol ORDER BY rn))"""))(
        lambda t, h=_h: ds.labels(t.indexed(), h).select("symbol", "ts", "direction"))


@query("w35_volatility_label", sql_with("i1h", f"""SELECT symbol, ts, {R('v')} AS volatility FROM (SELECT *, CASE WHEN count(r) OVER w >= 2 THEN stddev_pop(r) OVER w END AS v FROM (
    SELECT *, (close - open) / greatest(open, 1e-8) AS r FROM i1h) WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) WHERE v IS NOT NULL"""))
def _(t):
    return rounded(ds.volatility_label(t.indexed(), 4).select("symbol", "ts", "volatility"))


@query("a18_direction_weights", sql_with("i1h", f"""SELECT direction AS class, n, {R('sqrt(s / (3 * n)) / avg(sqrt(s / (3 * n))) OVER ()')} AS weight FROM (
    SELECT direction, count(*) AS n, sum(count(*)) OVER () AS s FROM lb WHERE direction IS NOT NULL GROUP BY direction)""", LAB))
def _(t):
    return rounded(ds.direction_weights(ds.labels(t.indexed(), "1h").filter("direction is not null")))


@query("a18_return_scale", sql_with("predictions", f"SELECT {R('quantile_cont(abs(ret), 0.75)')} AS q75, {R('stddev_pop(ret)')} AS std, {R('greatest(quantile_cont(abs(ret), 0.75), stddev_pop(ret), 1e-4)')} AS scale FROM predictions"))
def _(t):
    return rounded(ds.return_scale(t.predictions, "pred_id"))


@query("a19_scaler", sql_with("e64", f"SELECT CAST(d - 1 AS INTEGER) AS dim, {R('avg(e[d])', 9)} AS mean, {R('CASE WHEN stddev_pop(e[d]) < 1e-6 THEN 1 ELSE stddev_pop(e[d]) END', 9)} AS std FROM e64, range(1, 65) q(d) GROUP BY d"))
def _(t):
    v = t.raw("embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rounded(ds.fit_scaler(v), 9)


@query("a19_apply_scaler", sql_with("e64", f"""SELECT vec_id, {R('least(2, greatest(-2, (e[1] - m1) / s1))')} AS z0, {R('least(2, greatest(-2, (e[64] - m64) / s64))')} AS z63 FROM e64,
    (SELECT avg(e[1]) AS m1, stddev_pop(e[1]) AS s1, avg(e[64]) AS m64, stddev_pop(e[64]) AS s64 FROM e64)"""))
def _(t):
    v = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    out = ds.apply_scaler(v, ds.fit_scaler(v), limit=2.0)
    return out.select("vec_id", rd(F.col("features")[0]).alias("z0"), rd(F.col("features")[63]).alias("z63"))


def bars_sql(tf: str, width: int, n: int = 20) -> dict[str, str]:
    return {f"b{tf}": bar_sql(f"i{tf}"),
            f"l{tf}": f"""SELECT '{tf}' AS timeframe, d.symbol, d.ts, b.rn, {', '.join('b.' + x for x in cd.BAR_FEATURES)},
            d.back FROM (SELECT d.symbol, d.ts, e.rn AS upto, unnest(range(1, {n + 1})) AS back FROM c1h d ASOF JOIN (SELECT symbol, rn, ts + INTERVAL {width} SECOND AS closed FROM b{tf}) e
            ON e.symbol = d.symbol AND d.ts + INTERVAL 1 HOUR >= e.closed) d JOIN b{tf} b ON b.symbol = d.symbol AND b.rn = d.upto - d.back + 1"""}


_TFS = (("1m", 60), ("5m", 300), ("15m", 900), ("1h", 3600), ("4h", 14400))
_BARS = {k: v for tf, w in _TFS for k, v in bars_sql(tf, w).items()}


def _last_bars(t):
    out = None
    for tf, _w in _TFS:
        part = ds.last_closed_bars(t.candles(), t.indexed(tf), tf)
        out = part if out is None else out.unionByName(part)
    return out


@query("j05_last_closed_bars", sql_with("c1h i1m i5m i15m i1h i4h", " UNION ALL ".join(f"""SELECT '{tf}' AS timeframe, d.symbol, d.ts, CAST(count(l.rn) AS INTEGER) AS filled, {R('coalesce(sum(log_close), 0)')} AS sum_close,
    {R('coalesce(max(CASE WHEN back = 1 THEN log_close END), 0)')} AS last_close, {R('coalesce(max(CASE WHEN back = 20 THEN body END), 0)')} AS first_body
    FROM c1h d LEFT JOIN l{tf} l ON l.symbol = d.symbol AND l.ts = d.ts GROUP BY d.symbol, d.ts""" for tf, _ in _TFS), _BARS))
def _(t):
    b = _last_bars(t)
    total = F.aggregate(F.transform("bars", lambda x: x["log_close"]), F.lit(0.0), lambda a, x: a + x)
    return b.select("timeframe", "symbol", "ts", "filled", rd(total).alias("sum_close"), rd(F.element_at("bars", -1)["log_close"]).alias("last_close"),
                    rd(F.element_at("bars", 1)["body"]).alias("first_body"))


@query("j06_asof_tail", sql_with("c1h i1m i5m i15m i1h i4h", " UNION ALL ".join(f"""SELECT '{tf}' AS timeframe, d.symbol, d.ts, greatest(max(b.rn) - {n - 1}, 1) AS first, max(b.rn) AS last
    FROM c1h d JOIN i{tf} b ON b.symbol = d.symbol AND b.ts <= d.ts GROUP BY d.symbol, d.ts""" for tf, n in ds.TAIL.items())))
def _(t):
    return reduce(DataFrame.unionByName, [ds.asof_tail(t.candles(), t.indexed(tf), tf) for tf in ds.TAIL])


# ratios of prices in whole cents can end exactly half-way between two rounded values; both sides move off it alike
_TIE = 1e-9


def _frames_sql() -> str:
    extra, value, rsi = {}, [], []
    for tf, n in ds.TAIL.items():
        extra |= {f"d{tf}": DELTA["d"].replace("i1h", f"i{tf}"), f"g{tf}": DELTA["g"].replace("FROM d", f"FROM d{tf}"),
                  f"f{tf}": tf_sql(BASE_SCALE, "", n).replace("FROM g)", f"FROM g{tf})")}
        at = f"f{tf}.rn >= {ds.FRAME_ROWS}"
        value += [f"CASE WHEN {at} THEN f{tf}.{x} ELSE 0 END" for x in FEATURE_NAMES]
        rsi.append(f"CASE WHEN {at} THEN f{tf}.rsi ELSE 50 END")
    value += [f"({' + '.join(rsi)}) / 5", f"{rsi[4]} - {rsi[0]}", f"least(10, greatest(0, ({value[11]}) / (({value[59]}) + 1e-8)))"]
    joins = " ".join(f"ASOF LEFT JOIN f{tf} ON f{tf}.symbol = c1h.symbol AND c1h.ts >= f{tf}.ts" for tf in ds.TAIL)
    cols = ", ".join(f"{R(f'{v} + {_TIE!r}')} AS x{k:02d}" for k, v in enumerate(value))
    return sql_with("c1h i1m i5m i15m i1h i4h", f"SELECT c1h.symbol, c1h.ts, {cols} FROM c1h {joins}", extra)


@query("w27_vector_from_frames", _frames_sql())
def _(t):
    v = ds.frames_vector(t.candles(), {tf: t.indexed(tf) for tf in ds.TAIL})
    return v.select("symbol", "ts", *[rd(F.col("features")[k] + _TIE).alias(f"x{k:02d}") for k in range(63)])


def _relative_sql(tf: str) -> dict[str, str]:
    """Bars relative to the last close, and mean and deviation of each feature over all slots, empty ones included."""
    rel = ", ".join(f"{f} - lc AS {f}" if i < 4 else f for i, f in enumerate(cd.BAR_FEATURES))
    mean, square = "sum({f}) / (SELECT count(*) * 20 FROM c1h)", "sum({f} * {f}) / (SELECT count(*) * 20 FROM c1h)"
    stats = ", ".join(f"{mean.format(f=f)} AS m_{f}, sqrt({square.format(f=f)} - ({mean.format(f=f)}) ** 2) AS d_{f}" for f in cd.BAR_FEATURES)
    return {f"r{tf}": f"SELECT symbol, ts, back, {rel} FROM (SELECT *, max(CASE WHEN back = 1 THEN log_close END) OVER (PARTITION BY symbol, ts) AS lc FROM l{tf})",
            f"s{tf}": f"SELECT {', '.join(f'm_{f}, CASE WHEN d_{f} < 1e-6 THEN 1 ELSE d_{f} END AS s_{f}' for f in cd.BAR_FEATURES)} FROM (SELECT {stats} FROM r{tf})"}


_SCALED = ("15m", "1h", "4h")
_REL = {k: v for tf, w in _TFS if tf in _SCALED for k, v in {**bars_sql(tf, w), **_relative_sql(tf)}.items()}


def _scaled_bars(t):
    return reduce(DataFrame.unionByName, [ds.last_closed_bars(t.candles(), t.indexed(tf), tf) for tf in _SCALED])


@query("a20_bar_scaler", sql_with("c1h i15m i1h i4h", " UNION ALL ".join(
    f"SELECT '{tf}' AS timeframe, '{f}' AS feature, {R('m_' + f)} AS mean, {R('s_' + f)} AS std FROM s{tf}" for tf in _SCALED for f in cd.BAR_FEATURES), _REL))
def _(t):
    return rounded(ds.fit_bar_scaler(_scaled_bars(t)).select("timeframe", "feature", "mean", "std"))


_Z = "least(8, greatest(-8, ({f} - m_{f}) / s_{f}))"


@query("a20_apply_bar_scaler", sql_with("c1h i15m i1h i4h", " UNION ALL ".join(
    f"SELECT '{tf}' AS timeframe, symbol, ts, " + ", ".join(
        f"{R(f'max(CASE WHEN back = 1 THEN {_Z.format(f=f)} END)')} AS last_{f}, {R(f'sum({_Z.format(f=f)})', 5)} AS sum_{f}" for f in cd.BAR_FEATURES)
    + f" FROM r{tf}, s{tf} GROUP BY symbol, ts" for tf in _SCALED), _REL))
def _(t):
    b = durable(_scaled_bars(t))
    out = ds.apply_bar_scaler(b, ds.fit_bar_scaler(b)).filter("filled > 0")
    total = lambda f: F.aggregate("bars", F.lit(0.0), lambda a, x: a + x[f])
    return out.select("timeframe", "symbol", "ts", *[
        c for f in cd.BAR_FEATURES for c in (rd(F.element_at("bars", -1)[f]).alias(f"last_{f}"), rd(total(f), 5).alias(f"sum_{f}"))])


@query("a21_dataset_summary", sql_with("i1h articles", f"""SELECT (SELECT count(*) FROM lb WHERE direction IS NOT NULL) AS rows, (SELECT min(ts) FROM lb WHERE direction IS NOT NULL) AS ts_min, (SELECT max(ts) FROM lb WHERE direction IS NOT NULL) AS ts_max,
    (SELECT {R('avg(CAST(direction = 0 AS INTEGER))')} FROM lb WHERE direction IS NOT NULL) AS down, (SELECT {R('avg(CAST(direction = 1 AS INTEGER))')} FROM lb WHERE direction IS NOT NULL) AS neutral,
    (SELECT {R('avg(CAST(direction = 2 AS INTEGER))')} FROM lb WHERE direction IS NOT NULL) AS up, {R('avg(n)')} AS articles_avg, min(n) AS articles_min, max(n) AS articles_max, {R('median(n)')} AS articles_median
    FROM (SELECT candle_ts, count(*) AS n FROM vis GROUP BY candle_ts)""", {**LAB, **VISIBLE}))
def _(t):
    counts = _visible(t).groupBy("candle_ts").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ds.dataset_summary(ds.labels(t.indexed(), "1h").filter("direction is not null"), counts))


@query("a22_top_factors", sql_with("c1h articles factor_probs", f"SELECT candle_ts, CAST(f - 1 AS INTEGER) AS factor, rank, {R('m / t')} AS prob FROM r WHERE rank <= 3", {
    **VISIBLE, "mx": "SELECT candle_ts, f, sum(factors[f] / (rank + 1)) AS m FROM vis JOIN factor_probs USING (article_id), range(1, 11) q(f) GROUP BY candle_ts, f",
    "r": "SELECT *, sum(m) OVER (PARTITION BY candle_ts) AS t, row_number() OVER (PARTITION BY candle_ts ORDER BY m DESC, f) AS rank FROM mx"}))
def _(t):
    pairs = _visible(t).join(t.factor_probs, ["article_id"]).withColumn("attention", 1 / (F.col("rank") + 1))
    return rounded(ds.top_factors(pairs, 3, "candle_ts").withColumn("rank", F.col("rank").cast("bigint")))


@query("o10_walk_forward", sql_with("id", """SELECT fold, part, count(*) AS n, min(p) AS first, max(p) AS last FROM (SELECT row_number() OVER (ORDER BY ts, symbol) - 1 AS p, count(*) OVER () AS n FROM id),
    LATERAL (SELECT CAST(floor(n * 0.4) AS BIGINT) AS t0, (n - CAST(floor(n * 0.4) AS BIGINT)) // 5 AS step), range(5) q(f),
    LATERAL (SELECT t0 + f * step AS te, (step - 48) // 2 AS vw, (step - 48) - (step - 48) // 2 AS tw),
    LATERAL (SELECT CAST(f AS INTEGER) AS fold, CASE WHEN p < te THEN 'train' WHEN p >= te + 24 AND p < te + 24 + vw THEN 'val' WHEN p >= te + 48 + vw AND p < te + 48 + vw + tw THEN 'test' END AS part)
    WHERE part IS NOT NULL AND te + 48 + vw + tw <= n GROUP BY fold, part"""))
def _(t):
    rows = ds.walk_forward(t.daily_indexed().drop("rn"), ["ts", "symbol"])
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), (F.min("rn") - 1).alias("first"), (F.max("rn") - 1).alias("last"))


@query("o11_chrono_split", sql_with("predictions", """SELECT pred_id, CASE WHEN rn <= floor(0.7 * n) THEN 'train' WHEN rn <= floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS part FROM sp""", SPLIT))
def _(t):
    return ds.chrono_split(t.predictions, ORDER).select("pred_id", "part")


@query("o11_tail_fraction", sql_with("predictions", "SELECT pred_id FROM sp WHERE rn > n - floor(n * 0.15)", SPLIT))
def _(t):
    return ds.tail_fraction(t.predictions, ORDER).select("pred_id")


@query("o13_result_windows", sql_with("predictions", """SELECT pred_id, CAST(least((rn - 1) // (n // least(5, greatest(1, n // 20))), least(5, greatest(1, n // 20)) - 1) AS INTEGER) AS window_idx FROM sp""", SPLIT))
def _(t):
    from candela.operators.ordering import ordered_index
    return ds.result_windows(ordered_index(t.predictions, ORDER)).select("pred_id", "window_idx")


@query("o12_balanced_batches", sql_with("predictions", """SELECT b AS batch, c AS class, 2 + CASE WHEN ((c - b % 3) % 3 + 3) % 3 < 2 THEN 1 ELSE 0 END AS n
    FROM range(CAST((SELECT ceil(count(*) / 8) FROM predictions) AS BIGINT)) q(b), range(3) r(c)"""))
def _(t):
    plan = ds.balanced_batches(t.predictions, "label", "pred_id")
    return plan.groupBy("batch", F.col("class").cast("bigint").alias("class")).agg(F.count("id").cast("int").alias("n"))


@query("o09_sample_cases", sql_with("predictions", """SELECT pred_id, symbol, pred FROM predictions
    WHERE left(md5('42:' || pred_id), 8) < (SELECT printf('%08x', CAST(floor(greatest(0.05, 50 / CAST(greatest(count(*), 50) AS DOUBLE)) * 4294967295) AS BIGINT)) FROM predictions) ORDER BY pred_id LIMIT 50"""))
def _(t):
    return ds.sample_cases(t.predictions, "pred_id").select("pred_id", "symbol", "pred")


@query("f32_temperature_softmax", sql_with("predictions", f"SELECT pred_id, {R('s[1]')} AS p0, {R('s[2]')} AS p1, {R('s[3]')} AS p2 FROM (SELECT pred_id, {_softmax('list_transform(logits, lambda x: x / 0.6)')} AS s FROM predictions)"))
def _(t):
    s = t.predictions.select("pred_id", ar.temperature_softmax(F.col("logits"), 0.6).alias("s"))
    return s.select("pred_id", *[rd(F.col("s")[i]).alias(f"p{i}") for i in range(3)])


@query("f24_epsilon_override", sql_with("i1h", """SELECT symbol, count(*) FILTER (ret > 0.03) AS up, count(*) FILTER (ret < -0.03) AS down, count(*) FILTER (ret BETWEEN -0.03 AND 0.03) AS neutral FROM la GROUP BY symbol""", {"la": LAB["la"]}))
def _(t):
    rows = ds.look_ahead(t.indexed(), 1).withColumn("direction", ds.direction_label(F.col("ret"), ds.epsilon("1h", 0.03)))
    count = lambda c: F.sum(F.when(F.col("direction") == c, 1).otherwise(0))
    return rows.groupBy("symbol").agg(count(2).alias("up"), count(0).alias("down"), count(1).alias("neutral"))


@query("f26_horizon_steps", sql_with("i1h", """SELECT symbol, CAST(round(14400 / median(g)) AS INTEGER) AS steps FROM (SELECT symbol, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY rn) AS g FROM i1h)
    WHERE g IS NOT NULL GROUP BY symbol"""))
def _(t):
    return ds.horizon_steps_from(cd.infer_interval(t.indexed()), "4h").select("symbol", "steps")
