"""Evaluation of predictions: classification, calibration, alerts, explanations.

A prediction row has ``label`` and ``pred`` (0 down, 1 neutral, 2 up), ``probs``,
``max_prob``, ``confidence`` and ``ret``.  Everything is one aggregation with
map-side partial sums, or uses row positions from ``ordered_index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.functions.arrays import clip, temperature_softmax
from candela.operators.ordering import exact_quantiles, ordered_index, running
from candela.session import durable

CLASSES = (0, 1, 2)
PERIODS_PER_YEAR = 8760


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


# ------------------------------------------------------------------ classification

def class_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred",
                 classes: Sequence[int] = CLASSES) -> DataFrame:
    """True positives, predictions and labels per class, in one row per key."""
    lab, pre = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in classes:
        aggs += [_count((lab == c) & (pre == c)).alias(f"tp{c}"), _count(pre == c).alias(f"p{c}"), _count(lab == c).alias(f"l{c}")]
    return df.groupBy(*keys).agg(*aggs)


def f1_expr(classes: Sequence[int] = CLASSES) -> Column:
    """Macro F1 over the classes that occur."""
    parts = [ratio(2 * F.col(f"tp{c}"), F.col(f"p{c}") + F.col(f"l{c}")) for c in classes]
    present = sum((F.when(F.col(f"p{c}") + F.col(f"l{c}") > 0, 1).otherwise(0) for c in classes), F.lit(0))
    return ratio(sum(parts[1:], parts[0]), present)


def mcc_expr(classes: Sequence[int] = CLASSES) -> Column:
    total = lambda f: sum((f(c) for c in classes[1:]), f(classes[0]))
    s = F.col("n").cast("double")
    d = lambda x: F.col(x).cast("double")
    hit = total(lambda c: d(f"tp{c}"))
    cross = total(lambda c: d(f"p{c}") * d(f"l{c}"))
    pp, ll = total(lambda c: d(f"p{c}") * d(f"p{c}")), total(lambda c: d(f"l{c}") * d(f"l{c}"))
    return ratio(hit * s - cross, F.sqrt((s * s - pp) * (s * s - ll)))


def macro_f1(df: DataFrame, keys: Sequence[str] = (), **names) -> DataFrame:
    return class_counts(df, keys, **names).select(*keys, f1_expr().alias("macro_f1"))


def mcc(df: DataFrame, keys: Sequence[str] = (), **names) -> DataFrame:
    return class_counts(df, keys, **names).select(*keys, mcc_expr().alias("mcc"))


def mae_rmse(df: DataFrame, pred: str = "ret_pred", actual: str = "ret") -> DataFrame:
    e = F.col(pred) - F.col(actual)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


# ------------------------------------------------------------------ calibration

def confidence_bin(conf: Column, bins: int = 10) -> Column:
    """Bin number: lower edge closed, the last bin closed on both sides."""
    step = 1.0 / bins
    return sum((F.when(conf >= i * step, 1).otherwise(0) for i in range(1, bins)), F.lit(0))


def calibration_table(df: DataFrame, bins: int = 10, conf: str = "max_prob") -> DataFrame:
    hit = (F.col("pred") == F.col("label")).cast("double")
    rows = df.filter(F.col(conf).between(0, 1)).groupBy(confidence_bin(F.col(conf), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(conf).alias("conf_mean"), F.avg(hit).alias("acc"))
    return rows.withColumn("gap", F.abs(F.col("conf_mean") - F.col("acc")))


def ece(df: DataFrame, bins: int = 10, conf: str = "max_prob") -> DataFrame:
    """Expected calibration error and the bin with the largest gap."""
    return calibration_table(df, bins, conf).agg(
        (F.sum(F.col("gap") * F.col("count")) / F.sum("count")).alias("ece"),
        F.max("gap").alias("worst_gap"), F.max_by("bin", F.struct("gap", -F.col("bin"))).alias("worst_bin"))


def brier(df: DataFrame, conf: str = "max_prob") -> DataFrame:
    e = F.col(conf) - (F.col("pred") == F.col("label")).cast("double")
    return df.agg(F.avg(e * e).alias("brier"))


# Temperatures tried, and the range the result is held in.
TEMPERATURES = (0.60, 0.75, 0.85, 0.95, 1.0, 1.1, 1.2, 1.35, 1.5, 1.7, 2.0, 2.5, 3.0, 4.0)
TEMPERATURE_RANGE = (0.5, 2.5)


def temperature_nll(df: DataFrame, grid: Sequence[float] = TEMPERATURES) -> DataFrame:
    """Mean negative log-likelihood of the true class per temperature: one mean each, side by side."""
    def nll(t: float) -> Column:
        return -F.log(clip(F.element_at(temperature_softmax(F.col("logits"), F.lit(t)), F.col("label") + 1), 1e-8, 1.0))
    means = df.agg(*[F.avg(nll(float(g))).alias(f"_n{i}") for i, g in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(float(g)).alias("temperature"), F.col(f"_n{i}").alias("nll")) for i, g in enumerate(grid)])
    return means.select(F.posexplode(pairs).alias("i", "x")).select("i", "x.temperature", "x.nll").filter("nll is not null")


def fit_temperature(df: DataFrame, grid: Sequence[float] = TEMPERATURES) -> DataFrame:
    best = temperature_nll(df, grid).agg(F.min_by("temperature", F.struct("nll", "i")).alias("_t"), F.min("nll").alias("temperature_nll"))
    return best.select(clip(F.col("_t"), *TEMPERATURE_RANGE).alias("temperature"), "temperature_nll")


# ------------------------------------------------------------------ ranking

def binary_auc(df: DataFrame, score: str, positive: Column, name: str = "auc") -> DataFrame:
    """Area under the ROC curve with average ranks; 0.5 when a side is missing.

    Scores are first counted per value, then a prefix sum over the ordered
    values replaces the ranks.
    """
    per = df.groupBy(F.col(score).alias("_x")).agg(_count(positive).alias("_p"), _count(~positive).alias("_n"))
    pre = running(ordered_index(per, ["_x"]), {"_below": ("sum", F.col("_n").cast("double"))})
    area = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") + F.col("_n") / 2.0))
    pos, neg = F.sum("_p"), F.sum("_n")
    return pre.agg(F.when((pos > 0) & (neg > 0), area / F.nullif((pos * neg).cast("double"), F.lit(0.0))).otherwise(0.5).alias(name))


def macro_auc(df: DataFrame) -> DataFrame:
    """Mean one-versus-rest AUC; 0.5 unless every class occurs."""
    parts = None
    for c in CLASSES:
        one = binary_auc(df.withColumn("_s", F.element_at("probs", c + 1)), "_s", F.col("label") == c, f"auc{c}")
        parts = one if parts is None else parts.join(F.broadcast(one))  # one row each
    seen = df.agg(*[_count(F.col("label") == c).alias(f"_l{c}") for c in CLASSES])
    every = F.lit(True)
    for c in CLASSES:
        every = every & (F.col(f"_l{c}") > 0)
    mean = (F.col("auc0") + F.col("auc1") + F.col("auc2")) / 3
    return parts.join(F.broadcast(seen)).select(F.when(every, mean).otherwise(0.5).alias("auc"))


def aurc(df: DataFrame, n: int = 20, conf: str = "max_prob") -> DataFrame:
    """Area under the coverage-risk curve over ``n`` thresholds from the highest to the lowest confidence."""
    ends = df.agg(F.max(conf).alias("_hi"), F.min(conf).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    step = (F.col("_lo") - F.col("_hi")) / (n - 1)
    levels = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, F.col("_lo")).otherwise(F.col("_hi") + i * step))
    ends = ends.withColumn("_t", levels)
    rows = df.join(F.broadcast(ends)).select(  # one row
        F.size(F.filter("_t", lambda t: t > F.col(conf))).alias("level"), (F.col("pred") == F.col("label")).cast("double").alias("_c"))
    per = rows.groupBy("level").agg(F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("_s"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("level"))
    upto = Window.partitionBy(F.lit(0)).orderBy("level")  # n rows
    curve = every.join(per, ["level"], "left").select(
        "level", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_k"), F.coalesce(F.sum("_s").over(upto), F.lit(0.0)).alias("_s"))
    curve = curve.filter("_k > 0").join(F.broadcast(ends.select("_n"))).select(
        "level", (F.col("_k") / F.col("_n")).alias("coverage"), (1 - F.col("_s") / F.col("_k")).alias("risk"))
    slab = (F.col("coverage") - F.lag("coverage").over(upto)) * (F.col("risk") + F.lag("risk").over(upto)) / 2
    return curve.select(slab.alias("_a")).agg(
        F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(F.sum("_a")).alias("aurc"))


# ------------------------------------------------------------------ returns

def drawdown(df: DataFrame, order: Sequence[str], column: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """Largest relative fall of compounded returns per key (0 with fewer than two rows)."""
    rows = ordered_index(df.select(*keys, *order, F.col(column).alias("_r")), list(order), keys)
    rows = running(rows, {"_log": ("sum", F.log(1 + F.col("_r")))}, keys)
    rows = running(rows, {"_top": ("max", "_log")}, keys)
    fall = F.min(F.exp(F.col("_log") - F.col("_top")) - 1)
    return rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(fall).alias("max_drawdown"))


def max_drawdown(df: DataFrame, order: Sequence[str], column: str = "ret") -> DataFrame:
    return drawdown(df, order, column)


def _ratio_parts(column: str) -> list[Column]:
    r = F.col(column)
    low = F.least(r, F.lit(0.0))
    return [F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_std"), F.sqrt(F.avg(low * low)).alias("_down")]


def _sharpe() -> Column:
    return F.when((F.col("_n") < 2) | (F.col("_std") < 1e-6), F.lit(0.0)).otherwise(F.col("_mean") / F.nullif(F.col("_std"), F.lit(0.0)))


def _sortino() -> Column:
    return (F.when(F.col("_n") < 2, F.lit(0.0)).when(F.col("_down") == 0, F.when(F.col("_mean") <= 0, 0.0).otherwise(float("inf")))
            .otherwise(F.col("_mean") / F.nullif(F.col("_down"), F.lit(0.0))))


def _calmar(mdd: Column) -> Column:
    return ratio(F.col("_mean") * PERIODS_PER_YEAR, F.abs(mdd))


def risk_ratios(df: DataFrame, order: Sequence[str], column: str = "ret") -> DataFrame:
    """Sharpe, Sortino and Calmar of a return series (population deviation)."""
    base = df.agg(*_ratio_parts(column)).join(F.broadcast(drawdown(df, order, column)))  # one row each
    return base.select(_sharpe().alias("sharpe"), _sortino().alias("sortino"), _calmar(F.col("max_drawdown")).alias("calmar"), "max_drawdown")


# ------------------------------------------------------------------ alerts

ALERT_COST = 0.001


def thresholds(df: DataFrame, order_id: str, tau: float = 0.70, gamma: float = 0.60, conf: str = "confidence") -> DataFrame:
    """Adaptive thresholds: quantiles of confidence and of the largest probability."""
    a = exact_quantiles(df, conf, {"tau": tau})
    return a.join(F.broadcast(exact_quantiles(df, "max_prob", {"gamma": gamma})))  # one row each


def fixed_thresholds(df: DataFrame, tau: float, gamma: float) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(float(tau)).alias("tau"), F.lit(float(gamma)).alias("gamma"))


def with_alert(df: DataFrame, limits: DataFrame, conf: str = "confidence") -> DataFrame:
    """Rows with thresholds (one row) and the alert flag."""
    return df.join(F.broadcast(limits)).withColumn("alert", (F.col(conf) >= F.col("tau")) & (F.col("max_prob") >= F.col("gamma")))


def alert_precision(df: DataFrame, limits: DataFrame, conf: str = "confidence") -> DataFrame:
    """Precision, coverage and selective risk of the alerts; none gives (0, 0, 1)."""
    rows = with_alert(df, limits, conf)
    hit = _count(F.col("alert") & (F.col("pred") == F.col("label")))
    n = _count(F.col("alert"))
    out = rows.agg(ratio(hit, n).alias("alert_precision"), ratio(n, F.count(F.lit(1))).alias("alert_coverage"))
    return out.withColumn("selective_risk", 1 - F.col("alert_precision"))


def position(pred: Column) -> Column:
    return F.when(pred == 2, 1.0).when(pred == 0, -1.0).otherwise(0.0)


POLICY_SLOTS = 16   # policies that share one pass, a bit for each (31 at most)
_FALL_BLOCK = 4096  # rows of one block of the series


def policy_drawdowns(rows: DataFrame, slots: int, order: Sequence[str], block: int = _FALL_BLOCK) -> DataFrame:
    """(slot, max_drawdown): largest fall of each policy's compounded returns, with one sort for all policies.

    ``rows`` carries ``growth``, the log growth of the trade, and ``fires``, a bit for each slot whose policy takes it.
    Rows are put in order once.  A block is summed up per slot by its growth, its peak, its deepest point and its own
    largest fall; these four compose along the list of blocks, so no policy needs rows of its own.
    """
    at = range(slots)
    placed = ordered_index(rows.select(*order, "growth", "fires"), list(order))
    placed = placed.select("rn", F.floor((F.col("rn") - 1) / F.lit(block)).alias("_blk"), *[
        F.expr(f"IF(fires & {1 << k} != 0, growth, NULL)").alias(f"_g{k}") for k in at])
    upto = Window.partitionBy("_blk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("_blk", "rn", *[F.when(F.col(f"_g{k}").isNotNull(), F.sum(f"_g{k}").over(upto)).alias(f"_s{k}") for k in at])
    inside = inside.select("_blk", *[f"_s{k}" for k in at], "rn", *[(F.col(f"_s{k}") - F.max(f"_s{k}").over(upto)).alias(f"_f{k}") for k in at])
    sums = inside.groupBy("_blk").agg(F.array(*[F.struct(
        F.lit(k).alias("slot"), F.count(f"_s{k}").alias("k"), F.max_by(f"_s{k}", F.when(F.col(f"_s{k}").isNotNull(), F.col("rn"))).alias("grown"),
        F.max(f"_s{k}").alias("peak"), F.min(f"_s{k}").alias("low"), F.min(f"_f{k}").alias("fall")) for k in at]).alias("_b"))
    # a row per block and slot
    blocks = sums.select("_blk", F.explode("_b").alias("_b")).select("_blk", "_b.*").filter("k > 0")
    before = Window.partitionBy("slot").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_from", F.coalesce(F.sum("grown").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_top", F.max(F.col("_from") + F.col("peak")).over(before))
    fall = F.least("fall", F.col("_from") + F.col("low") - F.col("_top"))  # the first block has no peak before it
    return blocks.groupBy("slot").agg(F.when(F.sum("k") < 2, F.lit(0.0)).otherwise(F.exp(F.min(fall)) - 1).alias("max_drawdown"))


def policy_table(df: DataFrame, policies: DataFrame, order: Sequence[str], cost: float = ALERT_COST,
                 conf: str = "confidence", slots: int = POLICY_SLOTS) -> DataFrame:
    """All alert and trading figures per policy.

    ``policies`` is one row with an array ``policies`` of at most ``slots`` (policy_id, tau, gamma).  Counts and sums are
    partial aggregates of the scan; the order of rows matters for the drawdowns only, which share one sort.
    """
    policies = durable(policies)  # one row, met by every pass below
    slim = df.select(*order, "pred", "label", "ret", "max_prob", F.col(conf).alias("_conf"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    grid = policies.select(F.posexplode("policies").alias("slot", "_p")).select("slot", "_p.policy_id", "_p.tau", "_p.gamma")
    sign = position(F.col("pred"))
    slim = slim.withColumns({"_pos": sign != 0, "_net": sign * F.col("ret") - F.when(sign != 0, cost).otherwise(0.0)})
    fires = lambda p: (F.col("_conf") >= p["tau"]) & (F.col("max_prob") >= p["gamma"])
    rows = slim.join(F.broadcast(policies))  # one row
    fired = F.filter(F.transform("policies", lambda p, i: F.when(fires(p), i)), lambda i: i.isNotNull())
    held = lambda c: F.when(F.col("_pos"), c)
    alerts = rows.withColumn("slot", F.explode(fired)).withColumn("_held", held(F.col("_net"))).groupBy("slot").agg(
        F.count(F.lit(1)).alias("_a"), _count(F.col("pred") == F.col("label")).alias("_hit"),
        *[_count(F.col("pred") == c).alias(f"_a{c}") for c in CLASSES], F.sum("_net").alias("_pnl"),
        _count(F.col("_pos")).alias("_n"), F.avg("_held").alias("_mean"), F.stddev_pop("_held").alias("_std"),
        F.sqrt(F.avg(held(F.pow(F.least("_net", F.lit(0.0)), F.lit(2))))).alias("_down"), F.sum("_held").alias("_pos_pnl"), _count(F.col("_held") > 0).alias("_wins"))
    bits = F.aggregate(fired, F.lit(0), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), i)))
    # a trade without a return counts as one that changes nothing
    series = rows.filter("_pos").select(*order, F.coalesce(F.log(1 + F.col("_net")), F.lit(0.0)).alias("growth"), bits.alias("fires"))
    falls = policy_drawdowns(series.filter("fires != 0"), slots, order)
    joined = (grid.join(F.broadcast(alerts), ["slot"], "left").join(F.broadcast(falls), ["slot"], "left")  # a row per policy
              .join(F.broadcast(total)))  # one row
    n, a, k = F.col("n"), F.coalesce("_a", F.lit(0)), F.coalesce("_n", F.lit(0))
    suppressed = (a == 0) | (k < F.greatest(F.lit(20), F.floor(0.05 * n)))
    real = lambda c: F.when(suppressed, F.lit(0.0)).otherwise(c)
    return joined.select(
        "policy_id", "tau", "gamma", ratio(F.col("_hit"), a).alias("alert_precision"), ratio(a, n).alias("alert_coverage"),
        (1 - ratio(F.col("_hit"), a)).alias("selective_risk"), real(_sharpe()).alias("alert_sharpe"), real(_sortino()).alias("alert_sortino"),
        real(_calmar(F.col("max_drawdown"))).alias("alert_calmar"), real(F.col("max_drawdown")).alias("alert_max_dd"),
        real(ratio(F.col("_wins"), k)).alias("hit_rate"), F.coalesce("_pnl", F.lit(0.0)).alias("pnl"),
        ratio(k, n).alias("trade_coverage"), ratio(F.col("_a1"), a).alias("neutral_share"), k.alias("n_position_alerts"),
        F.coalesce("_pos_pnl", F.lit(0.0)).alias("position_pnl"), suppressed.alias("sharpe_suppressed"),
        ratio(F.col("_a0"), a).alias("alert_down"), ratio(F.col("_a1"), a).alias("alert_neutral"), ratio(F.col("_a2"), a).alias("alert_up"))


def single_policy(limits: DataFrame) -> DataFrame:
    return limits.select(F.array(F.struct(F.lit(0).alias("policy_id"), "tau", "gamma")).alias("policies"))


def alert_backtest(df: DataFrame, limits: DataFrame, order: Sequence[str], cost: float = ALERT_COST, slippage: float = 0.0,
                   spread: float = 0.0) -> DataFrame:
    """Trading result of one alert policy after costs."""
    return policy_table(df, single_policy(limits), order, cost + slippage + spread, slots=1).drop(
        "policy_id", "alert_precision", "selective_risk", "alert_down", "alert_neutral", "alert_up")


def evaluate_policy(df: DataFrame, limits: DataFrame, order: Sequence[str]) -> DataFrame:
    return policy_table(df, single_policy(limits), order, slots=1).drop("policy_id")


# Weights of the model selection score.
SCORE_WEIGHTS = {"f1": 0.40, "sharpe": 0.35, "ece": 0.15, "mcc": 0.10, "pnl": 0.0}


def selection_score(f1: Column, mcc: Column, ece: Column, sharpe: Column, coverage: Column, pnl: Column | None = None,
                    weights: dict[str, float] = SCORE_WEIGHTS, pnl_scale: float = 0.5) -> Column:
    """Weighted score with penalties for too few alerts and for a flat Sharpe."""
    def safe(c, default):
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)
    f1, mcc, ece = safe(f1, 0.0), safe(mcc, 0.0), safe(ece, 1.0)
    sharpe, coverage = safe(sharpe, 0.0), safe(coverage, 0.0)
    score = (weights["f1"] * clip(f1, 0, 1) + weights["sharpe"] * clip(sharpe / 2, -1, 1)
             - weights["ece"] * (1 - clip(1 - ece, 0, 1)) + weights["mcc"] * clip((mcc + 1) / 2, 0, 1))
    if pnl is not None and weights["pnl"] > 0:
        score = score + weights["pnl"] * clip(safe(pnl, 0.0) / max(pnl_scale, 1e-6), -1, 1)
    score = score - F.when(coverage < 0.05, 0.30 * (0.05 - coverage) / 0.05).otherwise(0.0)
    return score - F.when((F.abs(sharpe) < 1e-6) & (coverage >= 0.05), 0.05).otherwise(0.0)


def policy_objective(target: float = 0.35) -> dict[str, Column]:
    """Objective of a policy row that also carries macro_f1, mcc and ece."""
    c = F.col
    floor_alert, floor_trade = max(0.05, target * 0.20), max(0.03, target * 0.20)
    sup, cov, trade, sharpe = c("sharpe_suppressed"), c("alert_coverage"), c("trade_coverage"), c("alert_sharpe")
    pos = lambda x: F.greatest(F.lit(0.0), x)
    score = selection_score(c("macro_f1"), c("mcc"), c("ece"), F.when(sup, 0.0).otherwise(sharpe), cov, c("position_pnl"))
    coverage_penalty = (0.70 * pos(target - cov) + 0.20 * pos(cov - (target + 0.05)) + 0.60 * pos(floor_alert - cov)
                        + 0.80 * pos(floor_trade - trade))
    bonus = 0.04 * c("alert_precision") + 0.03 * c("hit_rate") + F.when(sup, 0.0).otherwise(
        0.20 * clip(sharpe, -0.5, 0.5) + 0.05 * clip(c("alert_sortino"), -0.5, 0.8) + 0.04 * clip(c("alert_calmar"), -0.5, 1.0))
    negative = F.when(sup, 0.0).otherwise(0.18 * pos(-sharpe))
    suppression = F.when(sup, 0.20).otherwise(0.0)
    good = (c("position_pnl") >= 0) | (sharpe >= 0)
    active = trade >= 0.05
    action = F.when(active, 0.05 + F.when(good & (c("hit_rate") >= 0.40), 0.05).otherwise(0.0)
                    + F.when(good & (c("hit_rate") >= 0.50), 0.05).otherwise(0.0)).otherwise(0.0)
    losing = F.when(active & (sharpe < 0), F.least(F.lit(0.05), F.abs(sharpe) * 0.15)).otherwise(0.0)
    neutral = F.when(c("neutral_share") > 0.70, 0.15 * F.least(F.lit(1.0), (c("neutral_share") - 0.70) / 0.30)).otherwise(0.0)
    objective = score + bonus - coverage_penalty - negative - suppression + action - neutral - losing
    return {"model_score": score, "policy_objective": objective,
            "compliant": ~sup & (cov >= floor_alert) & (trade >= floor_trade)}


TAU_GRID, GAMMA_GRID = (0.35, 0.50, 0.70, 0.80), (0.35, 0.50, 0.60, 0.80)


def policy_grid(df: DataFrame, order_id: str, conf: str = "confidence") -> DataFrame:
    """One row with the array of all (tau, gamma) pairs of the quantile grid."""
    # both columns in one pass, told apart by a key
    scores = df.select(F.explode(F.array(
        F.struct(F.lit("t").alias("_of"), F.col(conf).alias("_score")), F.struct(F.lit("g").alias("_of"), F.col("max_prob").alias("_score")))).alias("_s")).select("_s.*")
    both = exact_quantiles(scores, "_score", {f"q{i}": p for i, p in enumerate((*TAU_GRID, *GAMMA_GRID))}, ["_of"])
    found = both.agg(*[F.max(F.when(F.col("_of") == of, F.col(f"q{i + shift}"))).alias(f"{of}{i}")
                       for of, shift in (("t", 0), ("g", 4)) for i in range(4)])
    taus = F.array_sort(F.array_distinct(F.array(*[F.col(f"t{i}") for i in range(4)])))
    gammas = F.array_sort(F.array_distinct(F.array(*[F.col(f"g{i}") for i in range(4)])))
    pairs = F.flatten(F.transform(taus, lambda a, i: F.transform(gammas, lambda b, j: F.struct(
        (i * 10 + j).alias("policy_id"), a.alias("tau"), b.alias("gamma")))))
    return found.select(pairs.alias("policies"))


def search_policy(df: DataFrame, order: Sequence[str], order_id: str, target: float = 0.35) -> DataFrame:
    """Best policy: compliant ones by objective, else by trade coverage, else by alert coverage."""
    base = class_counts(df).select(f1_expr().alias("macro_f1"), mcc_expr().alias("mcc")).join(F.broadcast(ece(df).select("ece")))
    rows = policy_table(df, policy_grid(df, order_id), order).join(F.broadcast(base))  # one row
    rows = rows.withColumns(policy_objective(target))
    key = F.struct(
        F.when(F.col("compliant"), 2).when(F.col("trade_coverage") > 0, 1).otherwise(0).alias("k"),
        F.when(F.col("compliant"), F.col("policy_objective")).otherwise(F.col("trade_coverage")).alias("a"),
        F.when(F.col("compliant"), F.lit(0)).otherwise(F.col("n_position_alerts")).alias("b"),
        F.when(F.col("compliant"), F.lit(0.0)).when(F.col("trade_coverage") > 0, F.col("policy_objective")).otherwise(F.col("alert_coverage")).alias("c"),
        F.when(F.col("compliant"), F.lit(0.0)).otherwise(F.col("position_pnl")).alias("d"), (-F.col("policy_id")).alias("e"))
    return rows.agg(F.max_by(F.struct(*rows.columns), key).alias("_r")).select("_r.*")


def cross_grid(df: DataFrame, grid: DataFrame, column: str = "policies") -> DataFrame:
    """Rows times a small grid that is held in one array."""
    return df.join(F.broadcast(grid)).withColumn("_g", F.explode(column)).select(*df.columns, "_g.*")  # one row


def split_calibrate(df: DataFrame, order: Sequence[str], order_id: str, fraction: float = 0.5, smoothing: float | None = None,
                    previous: tuple[float, float] | None = None) -> DataFrame:
    """Fit temperature and thresholds on the first part, score them on the rest.

    Off (everything is both) when either part has fewer than 40 rows.
    """
    indexed = ordered_index(df, order)
    n = indexed.count()
    cut = int(n * fraction)
    use = 0 < fraction < 1 and cut >= 40 and n - cut >= 40
    fit = indexed.filter(F.col("rn") <= cut) if use else indexed
    rest = indexed.filter(F.col("rn") > cut) if use else indexed
    best = search_policy(fit, order, order_id).select("tau", "gamma")
    if previous is not None and smoothing is not None:
        best = best.select((smoothing * F.col("tau") + (1 - smoothing) * previous[0]).alias("tau"),
                           (smoothing * F.col("gamma") + (1 - smoothing) * previous[1]).alias("gamma"))
    return evaluate_policy(rest, best, order).join(F.broadcast(fit_temperature(fit)))  # one row each


def hit_rate(df: DataFrame, limit: DataFrame | float, conf: str = "confidence") -> DataFrame:
    """Share of positive returns among rows at or above ``tau``."""
    limits = limit if isinstance(limit, DataFrame) else df.sparkSession.range(1).select(F.lit(float(limit)).alias("tau"))
    rows = df.join(F.broadcast(limits.select("tau")))  # one row
    fired = F.col(conf) >= F.col("tau")
    return rows.agg(ratio(_count(fired & (F.col("ret") > 0)), _count(fired)).alias("hit_rate"))


# ------------------------------------------------------------------ explanations

def _at(probs: str, cls: str = "label") -> Column:
    return F.element_at(probs, F.col(cls) + 1)


def deletion_insertion(df: DataFrame, full: str = "probs", masked: str = "masked_probs", empty: str | None = None,
                       selected: str | None = None) -> DataFrame:
    """Mean positive drop of the true class when evidence is removed, gain when it is added."""
    drop = F.avg(F.greatest(_at(full) - _at(masked), F.lit(0.0)))
    aggs = [drop.alias("deletion_drop")]
    if empty and selected:
        aggs.append(F.avg(F.greatest(_at(selected) - _at(empty), F.lit(0.0))).alias("insertion_gain"))
        aggs.append(F.avg(F.greatest(_at(full) - _at(selected), F.lit(0.0))).alias("sufficiency_drop"))
    else:
        aggs.append(drop.alias("insertion_gain"))
    return df.agg(*aggs)


def occlusion_stats(df: DataFrame, order_id: str, margin: float = 0.05, full: str = "probs", masked: str = "masked_probs") -> DataFrame:
    """How far the largest probability falls without the evidence, and how often the direction changes."""
    from candela.functions.arrays import argmax
    rows = df.select(order_id, (F.array_max(full) - F.array_max(masked)).alias("gap"),
                     (argmax(F.col(full)) != argmax(F.col(masked))).cast("int").alias("_c"))
    stats = rows.agg(F.count(F.lit(1)).alias("num_samples"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("gap_std"),
                     F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.avg((F.col("gap") > margin).cast("int")).alias("fidelity_ratio"),
                     F.avg((F.col("gap") > 0).cast("int")).alias("positive_ratio"), F.avg("_c").alias("direction_change_ratio"))
    return stats.join(F.broadcast(exact_quantiles(rows, "gap", {"gap_median": 0.5})))  # one row each


def correlation(df: DataFrame, a: str, b: str, name: str = "correlation") -> DataFrame:
    return df.agg(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias(name))


def factor_consistency(df: DataFrame, a: str, b: str, order_id: str) -> DataFrame:
    """Jaccard overlap of two top-factor sets."""
    union = F.size(F.array_union(a, b))
    rows = df.select(order_id, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union).alias("j"))
    return rows.agg(F.count(F.lit(1)).alias("num_samples"), F.avg("j").alias("jaccard_mean")).join(
        F.broadcast(exact_quantiles(rows, "j", {"jaccard_median": 0.5})))  # one row each


def mode_agreement(df: DataFrame, sample: str, factor: str) -> DataFrame:
    """Mean share of the most frequent factor per sample across windows."""
    per = df.groupBy(sample, factor).agg(F.count(F.lit(1)).alias("_k")).groupBy(sample).agg(
        (F.max("_k") / F.sum("_k")).alias("_a"))
    return per.agg(F.avg("_a").alias("factor_consistency"))


# ------------------------------------------------------------------ reports

def regime_report(df: DataFrame, limits: DataFrame, regime: str = "regime", cost: float = ALERT_COST) -> DataFrame:
    """Classification, alert and trading figures per regime."""
    rows = with_alert(df, limits).withColumn("_pos", F.col("alert") & (F.col("pred") != 1)).withColumn(
        "_net", F.when(F.col("_pos"), position(F.col("pred")) * F.col("ret") - cost))
    lab, pre, al = F.col("label"), F.col("pred"), F.col("alert")
    aggs = [F.count(F.lit(1)).alias("n"), _count(al).alias("_a"), _count(F.col("_pos")).alias("n_pos"),
            _count(F.col("_net") > 0).alias("_w"), F.coalesce(F.sum("_net"), F.lit(0.0)).alias("pos_pnl")]
    for c in CLASSES:
        aggs += [_count((lab == c) & (pre == c)).alias(f"tp{c}"), _count(pre == c).alias(f"p{c}"), _count(lab == c).alias(f"l{c}"),
                 _count(al & (pre == c)).alias(f"a{c}")]
    g = rows.groupBy(regime).agg(*aggs)
    more = F.col("n") > 1
    names = ("down", "neutral", "up")
    return g.select(
        regime, "n", F.when(more, f1_expr()).otherwise(0.0).alias("f1"), F.when(more, mcc_expr()).otherwise(0.0).alias("mcc"),
        *[ratio(F.col(f"p{c}"), F.col("n")).alias(f"pred_{x}") for c, x in zip(CLASSES, names)],
        *[ratio(F.col(f"a{c}"), F.col("_a")).alias(f"alert_{x}") for c, x in zip(CLASSES, names)],
        ratio(F.col("_a"), F.col("n")).alias("alert_cov"), ratio(F.col("n_pos"), F.col("n")).alias("trade_cov"), "n_pos",
        ratio(F.col("_w"), F.col("n_pos")).alias("pos_hit"), "pos_pnl")


def class_report(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Recall, mean confidences and collapse flags per class, in one row."""
    rows = with_alert(df, limits)
    lab, pre, al, conf = F.col("label"), F.col("pred"), F.col("alert"), F.col("confidence")
    pos = conf * (1 - F.element_at("probs", 2))
    mean = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0))
    aggs = []
    for c, x in zip(CLASSES, ("down", "neutral", "up")):
        aggs += [F.avg((pre == c).cast("int")).alias(f"pred_{x}"), ratio(_count((lab == c) & (pre == c)), _count(lab == c)).alias(f"recall_{x}"),
                 mean(pre == c, conf).alias(f"conf_{x}"), mean(pre == c, F.col("max_prob")).alias(f"maxprob_{x}"),
                 mean(al & (pre == c), conf).alias(f"conf_alert_{x}"), mean(pre == c, pos).alias(f"pos_conf_{x}")]
    aggs += [mean(al & (pre == 1), conf - F.col("tau")).alias("neutral_conf_slack"),
             mean(al & (pre == 1), F.col("max_prob") - F.col("gamma")).alias("neutral_prob_slack")]
    out = rows.agg(*aggs)
    return out.withColumns({
        "recall_collapse": (F.col("recall_down") < 0.05) | (F.col("recall_up") < 0.05),
        "share_collapse": F.greatest("pred_down", "pred_neutral", "pred_up") > 0.9})


def deploy_gate(df: DataFrame) -> DataFrame:
    """Reasons against deployment; none means deployable."""
    reasons = F.array_compact(F.array(
        F.when(F.col("trade_coverage") < 0.05, "trade_cov<0.05"), F.when(F.col("sharpe_suppressed"), "sharpe_suppressed"),
        F.when((F.col("position_pnl") < 0) & (F.col("alert_sharpe") < 0), "pnl_and_sharpe_negative")))
    return df.withColumn("_r", reasons).withColumns({
        "deployable": F.size("_r") == 0, "reason": F.when(F.size("_r") == 0, "ok").otherwise(F.array_join("_r", ","))}).drop("_r")


def majority_baseline(df: DataFrame) -> DataFrame:
    """Every row predicted as the most frequent class with full confidence."""
    top = df.groupBy("label").agg(F.count(F.lit(1)).alias("_k")).agg(F.max_by("label", F.struct("_k", -F.col("label"))).alias("_m"))
    return df.drop("pred", "confidence", "probs", "max_prob").join(F.broadcast(top)).withColumns({  # one row
        "pred": F.col("_m"), "confidence": F.lit(1.0), "max_prob": F.lit(1.0),
        "probs": F.array(*[F.when(F.col("_m") == c, 1.0).otherwise(0.0) for c in CLASSES])}).drop("_m")


def momentum_baseline(train: DataFrame, test: DataFrame, signal: str, order_id: str) -> DataFrame:
    """Down, neutral or up by the train quantiles of one signal."""
    q = exact_quantiles(train, signal, {"q_low": 0.33, "q_high": 0.67, "_mid": 0.5})
    spread = train.agg((F.stddev_pop(signal) + 1e-8).alias("_sd"))
    x = F.col(signal)
    rows = test.drop("pred", "confidence", "probs", "max_prob").join(F.broadcast(q.join(F.broadcast(spread))))  # one row
    rows = rows.withColumn("pred", F.when(x >= F.col("q_high"), 2).when(x <= F.col("q_low"), 0).otherwise(1))
    fixed = {0: (0.7, 0.2, 0.1), 1: (0.1, 0.8, 0.1), 2: (0.1, 0.2, 0.7)}
    arr = lambda p: F.array(*[F.lit(v) for v in p])
    probs = F.when(F.col("pred") == 0, arr(fixed[0])).when(F.col("pred") == 2, arr(fixed[2])).otherwise(arr(fixed[1]))
    return rows.withColumns({"confidence": clip(0.5 + 0.25 * F.abs(x - F.col("_mid")) / F.col("_sd"), 0.5, 0.99), "probs": probs}).withColumn(
        "max_prob", F.array_max("probs")).drop("_mid", "_sd")


def move_size(ret: Column, eps: float) -> Column:
    """0 no edge, 1 marginal, 2 strong."""
    return F.when(F.abs(ret) >= 2 * eps, 2).when(F.abs(ret) > eps, 1).otherwise(0)


def move_size_report(df: DataFrame, eps: float, bin_pred: str = "bin_pred") -> DataFrame:
    rows = df.withColumn("bin_true", move_size(F.col("ret"), eps))
    counts = class_counts(rows, label="bin_true", pred=bin_pred)
    strong = F.col(bin_pred) == 2
    extra = rows.agg(
        F.avg((F.col(bin_pred) == F.col("bin_true")).cast("int")).alias("bin_accuracy"),
        ratio(_count(strong & (F.col("bin_true") == 2)), _count(strong)).alias("strong_precision"),
        ratio(_count(strong & (F.col("pred") == F.col("label"))), _count(strong)).alias("strong_direction_accuracy"),
        *[F.avg((F.col(bin_pred) == c).cast("int")).alias(f"share_{x}") for c, x in zip(CLASSES, ("none", "marginal", "strong"))])
    return counts.select(f1_expr().alias("bin_f1")).join(F.broadcast(extra))  # one row each


def edge_report(df: DataFrame, up: str = "up_score", down: str = "down_score") -> DataFrame:
    """Two-sided edge scores: AUC, rate and precision of each side, coverage and conflicts."""
    u, d = F.col(up) > 0.5, F.col(down) > 0.5
    flag = lambda c: F.avg(c.cast("int"))
    stats = df.agg(
        flag(u).alias("up_rate"), flag(d).alias("down_rate"), flag(u | d).alias("coverage"), flag(u & d).alias("conflict"),
        ratio(_count(u & (F.col("label") == 2)), _count(u)).alias("up_precision"),
        ratio(_count(d & (F.col("label") == 0)), _count(d)).alias("down_precision"))
    up_auc = binary_auc(df, up, F.col("label") == 2, "up_auc")
    down_auc = binary_auc(df, down, F.col("label") == 0, "down_auc")
    return stats.join(F.broadcast(up_auc)).join(F.broadcast(down_auc))  # one row each


def trade_ece(df: DataFrame, least: int = 10) -> DataFrame:
    """Calibration over UP and DOWN predictions; too few of them give the global value."""
    trades = df.filter(F.col("pred") != 1)
    n = trades.agg(F.count(F.lit(1)).alias("_n"))
    return n.join(F.broadcast(ece(trades).select(F.col("ece").alias("_t")))).join(F.broadcast(ece(df).select(F.col("ece").alias("_g")))).select(
        F.when(F.col("_n") >= least, F.col("_t")).otherwise(F.col("_g")).alias("ece_trade"))  # one row each


def fold_summary(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    cells = folds.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return cells.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("folds"))


def choose_deploy_fold(folds: DataFrame) -> DataFrame:
    """Best-scoring deployable fold, else the best of all; with a status."""
    good = F.coalesce(F.col("deployable"), F.lit(False))
    score = F.coalesce(F.col("model_score"), F.col("val_acc") - 0.05 * F.col("val_loss"))
    key = F.struct(good.cast("int").alias("d"), score.alias("s"), (-F.col("fold")).alias("f"))
    n_good, known = _count(good), F.count("deployable")
    return folds.agg(
        F.max_by("fold", key).alias("fold"), F.max_by(score, key).alias("score"), n_good.alias("n_deployable"), known.alias("n_known"),
        F.when(n_good > 0, "ok").when(known > 0, "not_recommended").otherwise("unknown").alias("deploy_status"))
