"""File sources and sinks: candle and article CSV, JSON lines, feature and report tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from candela.functions.text import to_ts
from candela.operators.candles import OHLCV, dedupe_latest

# Names a time column may have, in order of preference.
TIME_ALIASES = ("time", "date", "datetime", "open_time", "open_time_ms", "timestamp_ms", "ts", "published_at", "publishedat")
PREDICTION_SCHEMA = ("time string, symbol string, horizon string, direction string, confidence double, "
                     "max_probability double, probabilities struct<DOWN:double,NEUTRAL:double,UP:double>, `return` double")


def clean_name(name: str) -> str:
    return name.strip().lstrip("﻿").strip().lower()


def find_time_column(columns: Sequence[str]) -> str | None:
    """``timestamp``, else the first alias, else the first name that contains ``time``."""
    names = {clean_name(c): c for c in reversed(columns)}
    for wanted in ("timestamp", *TIME_ALIASES):
        if wanted in names:
            return names[wanted]
    return next((c for c in columns if "time" in clean_name(c)), None)


def rename_time_column(df: DataFrame, to: str = "timestamp") -> DataFrame:
    found = find_time_column(df.columns)
    return df if found is None else df.withColumnRenamed(found, to)


def read_ohlcv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Candle CSV: find the time column, drop unreadable times, keep the last row per time."""
    read = spark.read.csv(path, header=True)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # file order
    raw = read.select("*", at.alias("_at")).toDF(*[c.strip().lstrip("﻿") for c in read.columns], "_at")
    raw = rename_time_column(raw)
    names = {clean_name(c): c for c in raw.columns}
    missing = [c for c in OHLCV if c not in names]
    if missing or "timestamp" not in raw.columns:
        raise ValueError(f"candle file lacks columns: {missing or ['timestamp']}")
    rows = raw.select(F.lit(symbol).alias("symbol"), to_ts(F.col("timestamp"), 1e12).alias("ts"),
                      *[F.col(names[c]).try_cast("double").alias(c) for c in OHLCV], "_at")
    return dedupe_latest(rows.filter("ts is not null"), ["symbol", "ts"], "_at").drop("_at")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of the header line."""
    head = spark.read.text(path).limit(1).collect()
    return csv.Sniffer().sniff(head[0][0], ",;\t|").delimiter if head else ","


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): CSV records as text, line ends inside quotes kept, and whether a record begins its file.

    Files are read in splits.  Quotes are counted per line and summed up over the lines of a split and the splits of a
    file: a line after an even number of quotes begins a record.  Only records of several lines are gathered.  Quotes
    stand around whole fields, doubled inside them (RFC 4180).
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value")
    lines = raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("n"), F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("file", "split", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "nm"])
    inside = Window.partitionBy("file", "split").orderBy("line")  # a split is bounded
    known = lines.join(splits, ["file", "split"]).select(
        "file", (F.row_number().over(inside) + F.col("m_before")).alias("at"), "value", "quotes",
        (F.sum("quotes").over(inside) + F.col("n_before")).alias("upto"))
    open_before, open_after = (F.col("upto") - F.col("quotes")) % 2 == 1, F.col("upto") % 2 == 1
    alone = known.filter(~open_before & ~open_after).select((F.col("at") == 1).alias("first"), F.col("value").alias("record"))
    parts = known.filter(open_before | open_after).select("file", "at", "value", (~open_before).alias("head"))
    return alone.unionByName(_joined_lines(parts))


def _joined_lines(parts: DataFrame, block: int = 4096) -> DataFrame:
    """Records of the lines (file, at, value, head) with a quote open before or after them; ``head`` marks first lines.

    A line belongs to the last head at or before it, looked up over blocks of lines so that no file is one task.
    """
    heads = parts.withColumn("block", F.floor(F.col("at") / block)).withColumn("head", F.when(F.col("head"), F.col("at")))
    last = heads.groupBy("file", "block").agg(F.max("head").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    last = last.select("file", "block", F.max("last").over(earlier).alias("carried"))
    upto = Window.partitionBy("file", "block").orderBy("at")
    rows = heads.join(last, ["file", "block"]).withColumn("head", F.coalesce(F.max("head").over(upto), "carried"))
    joined = rows.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines"))  # one record
    return joined.select((F.col("head") == 1).alias("first"), F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Quoted CSV with a header per file, read in splits although quoted fields hold line ends; all columns are text."""
    names = spark.read.csv(path, header=True, sep=sep, escape='"').columns
    body = csv_records(spark, path).filter(~F.col("first") & (F.trim(F.col("record"), F.lit("\r ")) != ""))
    fields = F.from_csv(F.rtrim("record", F.lit("\r")), ", ".join(f"c{i} string" for i in range(len(names))),
                        {"sep": sep, "escape": '"', "multiLine": "true"})
    return body.select(fields.alias("r")).select("r.*").toDF(*names)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article CSV; the publication column may be called published_at, publishedat or date."""
    raw = read_csv(spark, path, sniff_delimiter(spark, path))
    raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    names = {clean_name(c): c for c in raw.columns}
    found = next((names[n] for n in ("published_at", "publishedat", "date") if n in names), None)
    if found is None:
        raise ValueError("no publication time column")
    return raw.withColumnRenamed(found, "published_at").withColumn("published_at", to_ts(F.col("published_at")))


def read_prediction_log(spark: SparkSession, path: str, horizon: str) -> DataFrame:
    """JSON lines of one horizon; a missing file gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    empty = spark.createDataFrame([], PREDICTION_SCHEMA)
    df = spark.read.schema(PREDICTION_SCHEMA).json(path) if exists else empty
    return df.withColumn("horizon", F.lit(horizon)).withColumn("ts", F.try_to_timestamp("time"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_articles_csv(df: DataFrame, path: str) -> None:
    """Every time as text, the key as text, one CSV folder with header."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    cols: list[Column] = []
    for c, t in df.dtypes:
        if t in ("timestamp", "timestamp_ntz"):
            cols.append(stamp(c))
        elif t.startswith(("array", "map", "struct")):
            cols.append(F.to_json(c).alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c) if c == "_id" else F.col(c))
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_features(df: DataFrame, path: str, ts: str = "ts", vector: str = "features") -> DataFrame:
    """Feature table as Parquet; returns its one-row description."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"),
                      F.max(F.size(vector)).alias("dim"))


def write_report(strategy: DataFrame, benchmark: DataFrame, path: str) -> DataFrame:
    """Metric table of a strategy next to its benchmark, as CSV and JSON."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns]))
        return df.select(pairs.alias("x")).select("x.*")
    table = long(strategy, "strategy").join(long(benchmark, "buy_hold"), ["metric"], "full_outer")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/comparison")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    return table
