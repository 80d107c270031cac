"""Archives to import rows, and inserts that skip what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions.arrays import clip, total
from candela.functions.text import canonical_url, strip, symbol_tags
from candela.operators.candles import dedupe_earliest

NO_TITLE = "Không có tiêu đề"


def import_news_json(df: DataFrame, cutoff: str, now: str | Column) -> DataFrame:
    """News archive rows inside ``[cutoff, now]`` with clean url, clamped score and raw JSON."""
    upper = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    time = F.col("timestamp").try_cast("timestamp")
    score = F.col("sentimentScore").try_cast("double")
    identity = F.concat_ws("|", F.col("timestamp").cast("string"), "source", "title")
    return df.withColumn("time", time).filter(F.col("time").between(F.lit(cutoff).cast("timestamp"), upper)).select(
        "time", canonical_url(F.col("url"), identity).alias("url"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        F.when(score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(clip(score, -1, 1)).alias("sentiment_score"),
        F.to_json(F.struct(
            "id", F.coalesce(F.nullif("summary", F.lit("")), "snippet", F.lit("")).alias("content"),
            F.coalesce("snippet", F.lit("")).alias("snippet"), "sentiment", F.col("coin").alias("coins"), "tag",
            F.lit("new.json").alias("origin")), {"ignoreNullFields": "false"}).alias("raw_score"))


def signed_mean(entity: Column) -> Column:
    """Sum of factor sentiments over the number of non-zero ones."""
    n = F.size(F.filter(entity, lambda x: x != 0))
    return F.when(n > 0, total(entity) / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))


def weighted_mean(weights: Column, values: Column) -> Column:
    s = total(weights)
    dot = total(F.zip_with(weights, values, lambda w, v: w * v))
    return F.when(s > 0, clip(dot / F.nullif(s, F.lit(0.0)), -1, 1)).otherwise(F.lit(0.0))


def import_articles(articles: DataFrame, entity: DataFrame) -> DataFrame:
    """Article archive to import rows: signed mean sentiment and a hashed synthetic url."""
    rows = articles.filter("published_at is not null").join(entity, ["article_id"])
    stamp = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "article_id", F.col("published_at").alias("time"),
        F.concat(F.lit("dataset://articles_max/"), F.sha2(F.concat_ws("|", stamp, "source", "title"), 256)).alias("url"),
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        signed_mean(F.col("entity")).alias("sentiment_score"),
        F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("sentiment_score").alias("dataset_confidence"),
                           F.lit("articles_max.csv").alias("origin")), {"ignoreNullFields": "false"}).alias("raw_score"))


def import_weighted_news(articles: DataFrame, factors: DataFrame, entity: DataFrame, start: str, end: str) -> DataFrame:
    """Articles of ``[start, end)`` with factor-weighted sentiment and inferred symbols."""
    rows = articles.filter((F.col("published_at") >= F.lit(start).cast("timestamp")) & (F.col("published_at") < F.lit(end).cast("timestamp")))
    rows = rows.join(factors, ["article_id"]).join(entity, ["article_id"])
    title, content = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("content", F.lit("")))
    stamp = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    digest = F.substring(F.sha2(F.concat(stamp, F.lit("\n"), title), 256), 1, 24)
    return rows.select(
        "article_id", F.col("published_at").alias("time"), F.concat(F.lit("historical://articles-max/"), digest).alias("url"),
        strip(F.coalesce("source", F.lit("unknown"))).alias("source"), title.alias("title"),
        weighted_mean(F.col("factors"), F.col("entity")).alias("signed_sentiment"),
        F.to_json(F.struct(
            symbol_tags(F.concat(title, F.lit(" "), content), "words").alias("symbols"),
            F.lit("articles_max_v2").alias("import_source"), F.col("sentiment_score").alias("original_score"),
            F.lit(True).alias("factor_grounded"))).alias("raw_score"))


def staged_insert(staged: DataFrame, target: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Rows to append: one per key, keys not null, not stored yet."""
    keys = list(keys)
    return dedupe_earliest(staged.dropna(subset=keys), keys, order).join(target.select(*keys), keys, "left_anti").select(*staged.columns)


def insert_new(batch: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """Batch rows whose key is not stored."""
    return batch.join(existing.select(key).distinct(), [key], "left_anti").select(*batch.columns)


def lookup_labels(articles: DataFrame, labels: DataFrame, value: str = "label") -> DataFrame:
    """Label by url, else by (lower title, date); the last stored duplicate wins."""
    day = lambda c: F.to_date(c)
    low = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    by_url = labels.filter(F.trim(F.coalesce("url", F.lit(""))) != "").groupBy(F.trim("url").alias("_u")).agg(
        F.max_by(value, "row_id").alias("_vu"))
    by_title = labels.filter(low != "").groupBy(low.alias("_t"), day("published_at").alias("_d")).agg(
        F.max_by(value, "row_id").alias("_vt"))
    rows = articles.withColumns({"_u": F.trim(F.coalesce("url", F.lit(""))), "_t": low, "_d": day("published_at")})
    rows = rows.join(by_url, ["_u"], "left").join(by_title, ["_t", "_d"], "left")
    return rows.withColumn(value, F.coalesce("_vu", "_vt")).drop("_u", "_t", "_d", "_vu", "_vt")
