"""Quality rules: fixed base rules and robust multivariate outliers.

Statistics of each text are transformed to a vector.  For each language and source the minimum covariance determinant
is estimated by concentration steps: start at medians and absolute deviations, keep the ``KEEP`` share of documents with
the smallest Mahalanobis distance, take their mean and covariance, repeat.  Distances are rescaled by their median, and
a document is rejected when its squared distance is beyond ``CUTOFF``, the quantile of the chi-square law that normal
vectors pass but for a share of ``FALSE_REJECTIONS``.

Statistics such as the share of symbols are exactly zero in most clean texts, so their covariance alone would be
singular; the variance that is tolerated anyway (``FLOORS``) is added to the diagonal.  Groups of fewer than ``SMALL``
eligible documents use the estimate of their language, and languages below that the one of the whole table; with no
estimate at all only the base rules decide.

Null texts have no words and fail the base rules; null language or source is a group of its own.  Only one table of
numbers is stored and read again; the group tables are broadcast after their rows were counted.  Repeated rows count as often as they
come and get equal verdicts.  An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import spaced_words, stored

MIN_WORDS = 50
FEATURES = ("x0", "x1", "x2", "x3", "x4")
# tolerated standard deviations: log word length, log symbol rate, root of repeated lines, root of repeated words, root of capitals
FLOORS = (0.06, 0.45, 0.12, 0.12, 0.10)
KEEP = 0.75
STEPS = 4
SMALL = 60
# share of normal vectors that may be rejected
FALSE_REJECTIONS = 0.001


def chi_square_cutoff(share: float) -> float:
    """Squared distance that a share of normal vectors exceeds: chi-square with five degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > share else (low, x)
    return high


CUTOFF = chi_square_cutoff(FALSE_REJECTIONS)  # 20.515
# the median of chi-square with five degrees of freedom
MEDIAN = 4.351
BROADCAST_GROUPS = 100_000
ACCURACY = 2000


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts of each text: one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"),
                       text.alias("_text"), spaced_words(F.col("text")).alias("_words"))
    rows = rows.withColumn("_n", F.size("_words")).withColumn(
        "_grams", F.when(F.col("_n") >= 3, F.transform(F.slice("_words", F.lit(1), F.col("_n") - 2), lambda w, i: F.xxhash64(
            w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return _with_repeats(rows).select(
        "doc_id", "_lang", "_source", F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("_n_lines"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("_capitals"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words covered by windows of three that occur more than once (``_grams``: their hashes).

    Windows are sorted by (hash, position); those next to an equal hash are repeated.  Of the repeated windows in order
    of position, each covers the words up to the next one, three at most.  Each step is a column of its own, as a lambda
    would compute an inner array again for every element.
    """
    pairs = F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(pairs)))
    rows = rows.withColumn("_hit", F.transform("_sorted", lambda s, k: F.when(
        F.coalesce(F.get("_sorted", k + 1)["g"] == s["g"], F.lit(False))
        | F.coalesce(F.get("_sorted", k - 1)["g"] == s["g"], F.lit(False)), s["i"])))
    covered = F.aggregate(
        F.sort_array(F.filter("_hit", lambda i: i.isNotNull())), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _vectors(stats: DataFrame) -> DataFrame:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return stats.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x0": F.log(chars / words), "x1": F.log1p(100.0 * F.col("n_symbols") / chars),
        "x2": F.sqrt(F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))),
        "x3": F.sqrt(F.col("n_repeat_words") / words), "x4": F.sqrt(F.col("_capitals") / chars)})


def _names() -> list[str]:
    p = range(len(FEATURES))
    return [f"m{i}" for i in p] + [f"l{i}{j}" for i in p for j in range(i + 1)]


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor ``l`` of the covariance ``c`` plus the tolerated variance, as columns."""
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return groups


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(FEATURES):
        v = F.col(x) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            v = v - F.col(f"l{i}{j}") * y
        solved.append(v / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


BY = ["_level", "_lang", "_source"]


def _attach(rows: DataFrame, groups: DataFrame, how: str = "inner", by: list[str] = BY) -> DataFrame:
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, by, how)


def _estimates(rows: DataFrame, steps: int) -> DataFrame:
    """One row per group: ``n``, mean, Cholesky factor and the scale of its distances."""
    p = range(len(FEATURES))
    means = [f"m{i}" for i in p]
    middle = stored(rows.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, ACCURACY).alias(m) for x, m in zip(FEATURES, means)]), "mcd-middle")
    spread = _attach(rows, middle).groupBy(*BY, "n", *means).agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, ACCURACY).alias(f"d{i}") for i, (x, m) in enumerate(zip(FEATURES, means))])
    start = spread.select(*BY, "n", *means, *[
        (F.pow(F.col(f"d{i}") * 1.4826, F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    groups = stored(_factor(start).select(*BY, "n", *_names()), "mcd-start")
    for step in range(steps):
        near = _attach(rows, groups).withColumn("_d", _distance()).select(*BY, "n", "_d", *FEATURES)
        radius = stored(near.groupBy(*BY).agg(F.percentile_approx("_d", KEEP, ACCURACY).alias("_r")), f"mcd-radius{step}")
        moments = _attach(near, radius).filter(F.col("_d") <= F.col("_r")).groupBy(*BY).agg(
            F.max("n").alias("n"), *[F.avg(x).alias(m) for x, m in zip(FEATURES, means)],
            *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
        groups = stored(_factor(moments).select(*BY, "n", *_names()), f"mcd-step{step}")
    scale = _attach(rows, groups).withColumn("_d", _distance()).groupBy(*BY).agg(
        (F.percentile_approx("_d", 0.5, ACCURACY) / F.lit(MEDIAN)).alias("scale"))
    # a scale below one would make the tolerated deviations smaller than stated
    return stored(groups.join(scale, BY).withColumn("scale", F.greatest("scale", F.lit(1.0))), "mcd")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Statistics, base verdict, squared distance and verdict per document."""
    rows = stored(_vectors(text_statistics(docs)), "text-statistics")
    none = F.lit("")
    levels = F.array(*[F.struct(F.lit(k).alias("_level"), lang.alias("_lang"), source.alias("_source")) for k, lang, source in (
        (0, F.col("_lang"), F.col("_source")), (1, F.col("_lang"), none), (2, none, none))])
    eligible = rows.filter(~F.col("base_failed")).select(F.explode(levels).alias("_g"), *FEATURES).select("_g.*", *FEATURES)
    groups = _estimates(eligible, steps).filter((F.col("n") >= SMALL) | (F.col("_level") == 2)).drop("n")
    names = _names() + ["scale"]
    joined = rows.withColumn("_every", none)
    for level, by in enumerate((["_lang", "_source"], ["_lang"], ["_every"])):
        side = groups.filter(F.col("_level") == level).withColumn("_every", none).select(*by, *[F.col(n).alias(f"{n}_{level}") for n in names])
        joined = _attach(joined, side, "left", by)
    scored = joined.withColumns({n: F.coalesce(*[f"{n}_{level}" for level in range(3)]) for n in names}).withColumn(
        "distance", _distance() / F.col("scale"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")
