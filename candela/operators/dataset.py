"""Training and decision tables: bars per decision, labels, scalers, splits, factor statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.functions import lexicons as lx
from candela.functions.arrays import argmax, clip, entropy
from candela.functions.text import any_hit, sentences
from candela.operators import indicators as ind
from candela.operators.candles import BAR_FEATURES, bar_features
from candela.operators.joins import asof_join
from candela.operators.ordering import blocked, exact_quantiles, ordered_index, seconds
from candela.session import durable

# ------------------------------------------------------------------ factor statistics and sentiment


def factor_sentence_rows(articles: DataFrame, ontology=lx.FACTORS, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """(article, factor, matching sentences) for every factor an article mentions.

    ``chars`` cuts the content and ``limit`` the sentences for a model with a bounded input; by default nothing is cut.
    """
    content = F.coalesce("content", F.lit(""))
    staged = articles.select("article_id", F.concat(
        F.flatten(F.array_repeat(sentences(F.col("title")), 3)),
        sentences(content if chars is None else F.substring(content, 1, chars))).alias("_all"))

    def matched(words: Sequence[str]) -> Column:
        found = F.filter("_all", lambda s: any_hit(F.lower(s), words))
        return found if limit is None else F.slice(found, 1, limit)

    per = F.explode(F.array(*[
        F.struct(F.lit(i).alias("factor"), matched(words).alias("matched")) for i, words in enumerate(ontology.values())]))
    return staged.select("article_id", per.alias("_p")).select("article_id", "_p.*").filter(F.size("matched") > 0)


def entity_sentiment(articles: DataFrame, scorer: Callable[[Column], Column], ontology=lx.FACTORS, long: bool = False) -> DataFrame:
    """Mean positive minus mean negative score of the matching sentences per factor; no match gives 0."""
    rows = factor_sentence_rows(articles, ontology).select("article_id", "factor", F.explode("matched").alias("sentence"))
    scored = rows.withColumn("_v", scorer(F.col("sentence")))
    net = F.avg(F.greatest("_v", F.lit(0.0))) - F.avg(F.greatest(-F.col("_v"), F.lit(0.0)))
    per = scored.groupBy("article_id", "factor").agg(clip(net, -1, 1).alias("sentiment"))
    if long:
        return per
    maps = per.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("factor", "sentiment"))).alias("_m"))  # one entry per factor
    vector = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(0.0)) for i in range(len(ontology))])
    return articles.select("article_id").join(maps, ["article_id"], "left").select("article_id", vector.alias("entity"))


def factor_label_stats(labels: DataFrame, size: int) -> DataFrame:
    """Coverage, dominance, entropy and the top-factor histogram of factor distributions."""
    rows = labels.select("article_id", "matched", F.array_max("factors").alias("top"), argmax(F.col("factors")).alias("arg"),
                         entropy(F.col("factors")).alias("ent"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("total"), F.avg(F.col("matched").cast("int")).alias("matched_share"),
        F.avg((F.col("top") > 0.4).cast("int")).alias("dominant_share"), F.avg("top").alias("mean_max_prob"),
        F.avg("ent").alias("mean_entropy"), *[F.sum((F.col("arg") == i).cast("bigint")).alias(f"top{i}") for i in range(size)])
    median = exact_quantiles(rows, "top", {"median_max_prob": 0.5})
    return stats.join(F.broadcast(median))  # one row each


def entity_sentiment_stats(vectors: DataFrame, column: str = "entity") -> DataFrame:
    rows = vectors.select(F.posexplode(column).alias("factor", "v"))
    return rows.groupBy("factor").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg((F.col("v") > 0.1).cast("int")).alias("positive_share"),
        F.avg((F.col("v") < -0.1).cast("int")).alias("negative_share"))


def factor_class_weights(labels: DataFrame, size: int, column: str = "factors") -> DataFrame:
    """Inverse square root of the top-1 frequency (at least 1e-4), mean one."""
    counts = labels.groupBy(argmax(F.col(column)).alias("factor")).agg(F.count(F.lit(1)).alias("n"))
    every = labels.sparkSession.range(size).select(F.col("id").cast("int").alias("factor"))
    whole = Window.partitionBy(F.lit(0))  # one row per factor
    rows = every.join(counts, ["factor"], "left").fillna(0, ["n"])
    raw = 1 / F.sqrt(F.greatest(F.col("n") / F.greatest(F.sum("n").over(whole), F.lit(1)), F.lit(1e-4)))
    return rows.withColumn("_w", raw).select("factor", "n", (F.col("_w") / F.avg("_w").over(whole)).alias("weight"))


def top_factors(pairs: DataFrame, p: int = 3, key: str = "decision") -> DataFrame:
    """Attention-weighted factor mix per decision and its ``p`` largest parts.

    ``pairs`` has one row per decision and article: key, attention, factors.
    """
    mixed = pairs.select(key, "attention", F.posexplode("factors").alias("factor", "prob")).groupBy(key, "factor").agg(
        F.sum(F.col("attention") * F.col("prob")).alias("mass"))
    sums = mixed.groupBy(key).agg(F.greatest(F.sum("mass"), F.lit(1e-8)).alias("_t"))
    order = Window.partitionBy(key).orderBy(F.col("mass").desc(), "factor")  # one row per factor
    return (mixed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p).join(sums, [key])
            .select(key, "factor", "rank", (F.col("mass") / F.col("_t")).alias("prob")))


# ------------------------------------------------------------------ bars per decision


def last_closed_bars(decisions: DataFrame, bars: DataFrame, timeframe: str, n: int = 20, decision_interval: str = "1h",
                     features: Sequence[str] = BAR_FEATURES) -> DataFrame:
    """The last ``n`` bars that closed by the decision's own close, oldest first, zero-padded in front.

    ``bars`` needs ``rn`` (``candle_index``).  Each bar gets the list of itself and
    the bars before it once; the as-of join gives the position of the last closed
    bar, and its list is fetched by position.
    """
    close = F.timestamp_seconds(F.unix_seconds("ts") + seconds(timeframe))
    ends = bars.select("symbol", close.alias("_close"), F.col("rn").alias("_end"))
    keyed = decisions.select("symbol", F.col("ts")).withColumn(
        "_at", F.timestamp_seconds(F.unix_seconds("ts") + seconds(decision_interval)))
    found = asof_join(keyed, ends, "_at", "_close").select("symbol", "ts", "_end")
    cells = bar_features(bars).select("symbol", "rn", F.struct(*[F.col(f) for f in features]).alias("_bar"))
    lists = blocked(cells, n - 1, lambda d, w: d.withColumn("_rows", F.collect_list("_bar").over(w.rowsBetween(-(n - 1), 0)))).select(
        "symbol", F.col("rn").alias("_end"), "_rows")  # n bars each
    zero = F.struct(*[F.lit(0.0).alias(f) for f in features])
    rows = F.col("_rows")
    return found.join(lists, ["symbol", "_end"], "left").select(
        "symbol", "ts", F.lit(timeframe).alias("timeframe"),
        F.when(F.col("_rows").isNull(), 0).otherwise(F.size("_rows")).alias("filled"),
        F.when(F.col("_rows").isNull(), F.array_repeat(zero, n)).otherwise(
            F.concat(F.array_repeat(zero, F.lit(n) - F.size("_rows")), rows)).alias("bars"))


# Tail length per timeframe of the multi-timeframe feature job.
TAIL = {"1m": 500, "5m": 200, "15m": 200, "1h": 200, "4h": 120}


def asof_tail(decisions: DataFrame, bars: DataFrame, timeframe: str, n: int | None = None) -> DataFrame:
    """Position range ``[first, last]`` of the bars at or before a decision (at most ``n``)."""
    n = n or TAIL[timeframe]
    ends = bars.select("symbol", F.col("ts").alias("_bar"), F.col("rn").alias("last"))
    found = asof_join(decisions.select("symbol", "ts"), ends, "ts", "_bar")
    return found.select("symbol", "ts", F.lit(timeframe).alias("timeframe"),
                        F.greatest(F.col("last") - (n - 1), F.lit(1)).alias("first"), "last").filter("last is not null")


FRAME_ROWS = 30  # bars a timeframe needs before it counts


def frames_vector(decisions: DataFrame, bars: Mapping[str, DataFrame], tails: Mapping[str, int] = TAIL) -> DataFrame:
    """63 numbers per decision from real timeframes: twelve features of the bars at or before it in each, three across.

    ``bars`` are indexed tables (``candle_index``) of the timeframes in ``tails``.  Features are computed once per bar over
    the tail of its timeframe; all timeframes share one as-of join.  A timeframe of fewer than ``FRAME_ROWS`` bars counts
    as zeros with a neutral RSI.
    """
    made = reduce(DataFrame.unionByName, [
        ind.timeframe_features(bars[tf], size=n).filter(F.col("rn") >= FRAME_ROWS).select(
            "symbol", F.lit(tf).alias("timeframe"), F.col("ts").alias("_bar"), F.array(*ind.FEATURE_NAMES).alias("_f"))
        for tf, n in tails.items()])
    # stored, as the range bounds of the join are sampled from it first
    wanted = decisions.select("symbol", "ts").withColumn("timeframe", F.explode(F.array(*[F.lit(tf) for tf in tails])))
    found = asof_join(wanted, durable(made), "ts", "_bar", ["symbol", "timeframe"])
    wide = found.groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("timeframe") == tf, F.col("_f"))).alias(f"_{tf}") for tf in tails])
    names = [f"_{tf}" for tf in tails]
    rsi = [F.coalesce(F.col(c)[0], F.lit(50.0)) for c in names]
    spread = [F.coalesce(F.col(c)[11], F.lit(0.0)) for c in (names[0], names[-1])]
    across = [sum(rsi[1:], rsi[0]) / float(len(rsi)), rsi[-1] - rsi[0],
              F.least(F.lit(10.0), F.greatest(F.lit(0.0), spread[0] / (spread[1] + 1e-8)))]
    zeros = F.array_repeat(F.lit(0.0), len(ind.FEATURE_NAMES))
    return wide.select("symbol", "ts", F.concat(*[F.coalesce(c, zeros) for c in names], F.array(*across)).alias("features"))


# ------------------------------------------------------------------ labels


def epsilon(horizon: str, override: float | None = None) -> float:
    base = lx.EPSILON[horizon]
    if override is None:
        return base
    low, high = lx.EPSILON_RANGE
    if not low <= float(override) <= high:
        raise ValueError(f"epsilon must be in [{low}, {high}], got {override}")
    return float(override)


HORIZON_SECONDS = {"15m": 900, "1h": 3600, "4h": 14400, "24h": 86400}


def horizon_steps(horizon: str, interval_seconds: float) -> int:
    """Horizon in bars; it must be a whole number of them."""
    ratio = HORIZON_SECONDS[horizon] / interval_seconds
    if round(ratio) < 1 or abs(ratio - round(ratio)) > 1e-3:
        raise ValueError(f"horizon {horizon} is not a multiple of {interval_seconds} s bars")
    return round(ratio)


def horizon_steps_from(intervals: DataFrame, horizon: str) -> DataFrame:
    """Steps per key from inferred bar intervals; a horizon that is no whole number of bars raises an error."""
    ratio = F.lit(float(HORIZON_SECONDS[horizon])) / F.col("median_gap")
    whole = (F.round(ratio) >= 1) & (F.abs(ratio - F.round(ratio)) <= 1e-3)
    return intervals.withColumn("steps", F.when(whole, F.round(ratio).cast("int")).otherwise(
        F.raise_error(F.lit(f"horizon {horizon} is not a multiple of the bar interval")).cast("int")))


def look_ahead(df: DataFrame, h: int) -> DataFrame:
    """Entry price (next open), exit price (close ``h`` bars on) and their return."""
    def compute(d, w):
        d = d.withColumns({"exec_open": F.lead("open", 1).over(w), "label_close": F.lead("close", h).over(w)})
        return d.withColumn("ret", (F.col("label_close") - F.col("exec_open")) / F.col("exec_open"))
    return blocked(df, 0, compute, ahead=h)


def direction_label(ret: Column, eps: float) -> Column:
    """0 down, 1 neutral, 2 up; null without a return."""
    return F.when(ret.isNull(), F.lit(None)).when(ret > eps, 2).when(ret < -eps, 0).otherwise(1).cast("int")


def labels(df: DataFrame, horizon: str, interval: str = "1h") -> DataFrame:
    h = horizon_steps(horizon, seconds(interval))
    return look_ahead(df, h).withColumn("direction", direction_label(F.col("ret"), epsilon(horizon)))


def volatility_label(df: DataFrame, h: int) -> DataFrame:
    """Deviation of the bar returns over the next ``h`` bars; one bar gives the size of the return."""
    if h == 1:
        return look_ahead(df, 1).withColumn("volatility", F.abs("ret"))

    def compute(d, w):
        d = d.withColumn("_r", (F.col("close") - F.col("open")) / F.greatest(F.col("open"), F.lit(1e-8)))
        frame = w.rowsBetween(1, h)
        return d.withColumn("volatility", F.when(F.count("_r").over(frame) >= 2, F.stddev_pop("_r").over(frame))).drop("_r")
    return blocked(df, 0, compute, ahead=h).filter("volatility is not null")


# ------------------------------------------------------------------ scalers and weights


def fit_scaler(train: DataFrame, column: str = "features") -> DataFrame:
    """Mean and population deviation per dimension (1 where it is below 1e-6); one row per dimension."""
    cells = train.select(F.posexplode(column).alias("dim", "_x")).withColumn(
        "_x", F.when(F.isnan("_x"), F.lit(0.0)).when(F.abs("_x") == float("inf"), F.signum("_x") * 1e4).otherwise(F.col("_x")))
    std = F.stddev_pop("_x")
    return cells.groupBy("dim").agg(F.avg("_x").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, column: str = "features", limit: float = 8.0) -> DataFrame:
    """Clipped z-scores; the scaler (one row per dimension) travels as one array."""
    packed = scaler.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    z = F.zip_with(F.col(column), F.col("_s"), lambda x, s: clip((x - s["mean"]) / s["std"], -limit, limit))
    return df.join(F.broadcast(packed)).withColumn(column, z).drop("_s")  # one row


def relative_bars(df: DataFrame, column: str = "bars") -> DataFrame:
    """Price logs relative to the last close of the sequence; empty rows stay empty."""
    names = BAR_FEATURES
    empty = lambda b: sum((F.abs(b[f]) for f in names), F.lit(0.0)) == 0
    last = F.element_at(F.col(column), -1)["log_close"]

    def shift(b):
        cols = [F.when(empty(b), F.lit(0.0)).otherwise(b[f] - F.col("_last")).alias(f) if i < 4 else b[f].alias(f) for i, f in enumerate(names)]
        return F.struct(*cols)
    return df.withColumn("_last", last).withColumn(column, F.transform(column, shift)).drop("_last")


def fit_bar_scaler(train: DataFrame, column: str = "bars") -> DataFrame:
    """Mean and population deviation per (timeframe, feature) of relative bars."""
    bars = relative_bars(train, column).select("timeframe", F.explode(column).alias("_b"))
    stats = bars.groupBy("timeframe").agg(*[
        F.struct(F.lit(f).alias("feature"), F.avg(F.col("_b")[f]).alias("mean"), F.stddev_pop(F.col("_b")[f]).alias("std")).alias(f) for f in BAR_FEATURES])
    rows = stats.select("timeframe", F.explode(F.array(*BAR_FEATURES)).alias("_s")).select("timeframe", "_s.*")
    return rows.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def apply_bar_scaler(df: DataFrame, scaler: DataFrame, column: str = "bars", limit: float = 8.0) -> DataFrame:
    """Clipped z-scores of relative bars; empty rows stay zero."""
    stat = lambda f: F.max(F.when(F.col("feature") == f, F.struct("mean", "std"))).alias(f)
    packed = scaler.groupBy("timeframe").agg(*[stat(f) for f in BAR_FEATURES])
    packed = packed.select("timeframe", F.struct(*BAR_FEATURES).alias("_s"))
    empty = lambda b: sum((F.abs(b[f]) for f in BAR_FEATURES), F.lit(0.0)) == 0

    def scale(original, b):  # a flat bar without volume is zero only after the shift, and is scaled
        return F.struct(*[F.when(empty(original), F.lit(0.0)).otherwise(
            clip((b[f] - F.col("_s")[f]["mean"]) / F.col("_s")[f]["std"], -limit, limit)).alias(f) for f in BAR_FEATURES])
    shifted = relative_bars(df.withColumn("_given", F.col(column)), column).join(packed, ["timeframe"])
    return shifted.withColumn(column, F.zip_with("_given", column, scale)).drop("_s", "_given")


def direction_weights(train: DataFrame, mode: str = "sqrt", classes: int = 3) -> DataFrame:
    """Balanced class weights, optionally square-rooted, with mean one."""
    counts = train.groupBy(F.col("direction").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    base = F.sum("n").over(whole) / (classes * F.col("n"))
    raw = F.lit(1.0) if mode == "none" else (F.sqrt(base) if mode == "sqrt" else base)
    return counts.withColumn("_w", raw).select("class", "n", (F.col("_w") / F.avg("_w").over(whole)).alias("weight"))


def return_scale(train: DataFrame, order_id: str, column: str = "ret") -> DataFrame:
    """Largest of the 75 % quantile of absolute returns, their deviation and 1e-4."""
    rows = train.select(F.col(order_id), F.abs(column).alias("_a"))
    q = exact_quantiles(rows, "_a", {"q75": 0.75})
    dev = train.agg(F.stddev_pop(column).alias("std"))
    return q.join(F.broadcast(dev)).withColumn("scale", F.greatest("q75", "std", F.lit(1e-4)))  # one row each


def dataset_summary(samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows, time range, class balance and articles per candle."""
    balance = [F.avg((F.col("direction") == c).cast("int")).alias(n) for c, n in ((0, "down"), (1, "neutral"), (2, "up"))]
    base = samples.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), *balance)
    spread = counts.agg(F.avg("n").alias("articles_avg"), F.min("n").alias("articles_min"), F.max("n").alias("articles_max"))
    median = exact_quantiles(counts.withColumn("n", F.col("n").cast("double")), "n", {"articles_median": 0.5})
    return base.join(F.broadcast(spread)).join(F.broadcast(median))  # one row each


# ------------------------------------------------------------------ splits and batches


def fold_bounds(
    rows: int, folds: int = 5, embargo: int = 24, min_train: float = 0.40, fewest: int = 200, least_usable: int = 20,
) -> list[tuple[int, str, int, int]]:
    """(fold, part, first, end) of an expanding walk-forward split with embargo.

    The rows after the first training share are cut into ``folds`` equal stretches.  Fold ``k`` trains on everything
    before stretch ``k``; the stretch is embargo, validation, embargo, test.  Tables of fewer than ``fewest`` rows, or
    stretches that leave fewer than ``least_usable`` rows beside the embargoes, give no fold.
    """
    head = int(rows * min_train)
    width = (rows - head) // folds
    usable = width - 2 * embargo
    if rows < fewest or usable < least_usable:
        return []
    half = usable // 2
    inside = {"val": (embargo, embargo + half), "test": (2 * embargo + half, width)}
    return [bound for k in range(folds) for at in [head + k * width]
            for bound in [(k, "train", 0, at), *((k, part, at + a, at + b) for part, (a, b) in inside.items())]]


def walk_forward(df: DataFrame, order: Sequence[str], folds: int = 5, embargo: int = 24, min_train: float = 0.40) -> DataFrame:
    """Rows with ``fold`` and ``part``; a row belongs to one part of a fold at most."""
    indexed = ordered_index(df, order)
    bounds = fold_bounds(indexed.count(), folds, embargo, min_train)
    at = F.col("rn") - 1
    marks = [F.when((at >= a) & (at < b), F.struct(F.lit(f).alias("fold"), F.lit(p).alias("part"))) for f, p, a, b in bounds]
    if not marks:
        return indexed.withColumns({"fold": F.lit(0), "part": F.lit("")}).limit(0)
    return indexed.withColumn("_m", F.explode(F.array_compact(F.array(*marks)))).select(*indexed.columns, "_m.*")


def chrono_split(df: DataFrame, order: Sequence[str], fractions: Sequence[float] = (0.70, 0.15),
                 names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Earliest rows first: whole-number shares, the rest goes to the last part."""
    indexed = ordered_index(df, order)
    size = indexed.agg(F.count(F.lit(1)).alias("_n"))
    rows = indexed.join(F.broadcast(size))  # one row
    expr, end = None, F.lit(0)
    for share, name in zip(fractions, names):
        end = end + F.floor(F.lit(share) * F.col("_n"))
        cond = F.col("rn") <= end
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return rows.withColumn("part", expr.otherwise(names[len(fractions)])).drop("_n")


def tail_fraction(df: DataFrame, order: Sequence[str], fraction: float = 0.15) -> DataFrame:
    """The latest ``floor(n * fraction)`` rows."""
    indexed = ordered_index(df, order)
    size = indexed.agg(F.count(F.lit(1)).alias("_n"))
    return indexed.join(F.broadcast(size)).filter(F.col("rn") > F.col("_n") - F.floor(F.lit(fraction) * F.col("_n"))).drop("_n")  # one row


def result_windows(df: DataFrame, n: int = 5, rn: str = "rn") -> DataFrame:
    """Window number of each row: ``min(n, len // 20)`` equal parts, the last takes the rest."""
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(F.broadcast(size))  # one row
    k = F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.col("_n") / 20)))
    width = F.floor(F.col("_n") / k)
    return rows.withColumn("window_idx", F.least(F.floor((F.col(rn) - 1) / width), k - 1).cast("int")).drop("_n")


def quota(batch: int, index: Column, cls: int, classes: int) -> Column:
    """Draws of one class in a batch: the larger share rotates."""
    base, rem = divmod(batch, classes)
    return F.lit(base) + F.when(F.pmod(F.lit(cls) - F.pmod(index, F.lit(classes)), F.lit(classes)) < rem, 1).otherwise(0)


def balanced_batches(df: DataFrame, label: str, id_col: str, batch: int = 8, classes: int = 3, seed: int = 42) -> DataFrame:
    """Class-balanced batch plan: (batch, class, slot, id).

    Draw ``k`` of a class takes the row at position ``k`` modulo the class size
    in a seeded hash order, so a class that runs out starts again.  Rows with a
    negative label are dropped.
    """
    rows = df.filter(F.col(label) >= 0).select(F.col(id_col).alias("id"), F.col(label).alias("class")).withColumn(
        "_h", F.xxhash64(F.lit(seed), "id"))
    placed = ordered_index(rows, ["_h", "id"], ["class"])
    sizes = placed.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.ceil(F.sum("_n") / batch).alias("_b"))
    per, rem = divmod(batch, classes)
    # draws before batch b of class c, in closed form: full rotations, then the started one
    spark = df.sparkSession
    n_batches = total.first()["_b"]
    plan = spark.range(n_batches).withColumnRenamed("id", "batch").withColumn("class", F.explode(F.array(*[F.lit(c) for c in range(classes)])))
    full = F.floor(F.col("batch") / classes)
    started = F.pmod(F.col("batch"), F.lit(classes))
    extra = sum((F.when((F.lit(r) < started) & (F.pmod(F.col("class") - r, F.lit(classes)) < rem), 1).otherwise(0) for r in range(classes)), F.lit(0))
    before = F.col("batch") * per + full * rem + extra
    mine = F.lit(per) + F.when(F.pmod(F.col("class") - started, F.lit(classes)) < rem, 1).otherwise(0)
    draws = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), mine - 1))).withColumn("_draw", before + F.col("slot"))
    draws = draws.join(F.broadcast(sizes), ["class"]).withColumn("rn", F.pmod("_draw", "_n") + 1)  # one row per class
    return draws.join(placed.select("class", "rn", "id"), ["class", "rn"]).select("batch", "class", "slot", "id")


def sample_cases(df: DataFrame, id_col: str, n: int = 50, seed: int = 42) -> DataFrame:
    """About ``n`` rows picked by a seeded hash with probability max(0.05, n/N), at most ``n``."""
    place = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), 1, 8)
    share = F.greatest(F.lit(0.05), F.lit(n) / F.greatest(F.count(F.lit(1)), F.lit(n)))
    size = df.agg(F.format_string("%08x", F.floor(share * 4294967295).cast("bigint")).alias("_p"))
    return df.join(F.broadcast(size)).filter(place < F.col("_p")).drop("_p").orderBy(id_col).limit(n)  # one row
