"""Views of the test tables in the shape the operators expect.

Every view is a plain projection or aggregation of the given parquet tables and
has a SQL twin in ``CTES``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.operators.candles import resample, ticks_as_bars
from candela.operators.ordering import candle_index, seconds

SYMBOLS = ("click", "error", "purchase", "signup", "view")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def texts(self, name: str) -> DataFrame:
        """A text table for jobs that parse its rows: a scan of fewer splits than cores is dealt out first.

        This is a matter of layout only; rows and results are the same either way.
        """
        df = self.raw(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def ticks(self) -> DataFrame:
        return self._ticks(self.raw("events"))

    @cached_property
    def spread_ticks(self) -> DataFrame:
        """Ticks for jobs that parse text per row."""
        return self._ticks(self.texts("events"))

    def _ticks(self, events: DataFrame) -> DataFrame:
        return events.select(
            "event_id", F.col("event_type").alias("symbol"), "ts", "user_id", (F.col("value") + 1).alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("volume"))

    def candles(self, interval: str = "1h") -> DataFrame:
        return resample(ticks_as_bars(self.ticks), interval, order=("ts", "event_id"))

    def indexed(self, interval: str = "1h") -> DataFrame:
        return candle_index(self.candles(interval), interval)

    @cached_property
    def daily(self) -> DataFrame:
        rows = self.raw("orders").select(
            F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey",
            F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))
        return resample(ticks_as_bars(rows), "1d", order=("ts", "o_orderkey"))

    def daily_indexed(self) -> DataFrame:
        return candle_index(self.daily, "1d")

    @cached_property
    def articles(self) -> DataFrame:
        minutes = F.pmod(F.col("doc_id") * 7919, F.lit(43200))
        return self.texts("documents").select(
            F.col("doc_id").alias("article_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"), "source", "lang",
            F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("published_at"),
            ((F.pmod(F.col("doc_id") * 31, F.lit(201)) - 100) / 100).alias("sentiment_score"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"),
                     F.pmod("doc_id", F.lit(700))).alias("url"))

    @cached_property
    def predictions(self) -> DataFrame:
        e = lambda i: F.element_at("embedding", i + 1).cast("double")
        rows = self.raw("embeddings").select(
            F.col("vec_id").alias("pred_id"),
            F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.pmod("vec_id", F.lit(5)) + 1).cast("int")).alias("symbol"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600).alias("ts"),
            F.when(F.pmod("vec_id", F.lit(2)) == 0, "1h").otherwise("4h").alias("horizon"),
            F.pmod("label", F.lit(3)).cast("int").alias("label"),
            F.array(e(0), e(1), e(2)).alias("logits"), F.array(e(5), e(6), e(7)).alias("masked_logits"),
            (1 / (1 + F.exp(-5 * e(3)))).alias("confidence"), (0.05 * e(4)).alias("ret"))
        from candela.functions.arrays import argmax, softmax
        return rows.withColumns({
            "probs": softmax(F.col("logits")), "masked_probs": softmax(F.col("masked_logits")),
            "pred": argmax(F.col("logits")),
        }).withColumn("max_prob", F.array_max("probs"))

    @cached_property
    def factor_probs(self) -> DataFrame:
        from candela.functions.arrays import softmax
        picked = F.transform(F.slice("embedding", 9, 10), lambda x: x.cast("double"))
        return self.raw("embeddings").select(F.col("vec_id").alias("article_id"), softmax(picked).alias("factors"))

    @cached_property
    def entity_sentiment(self) -> DataFrame:
        picked = F.transform(F.slice("embedding", 21, 10), lambda x: F.when(F.abs(x) > 0.05, x.cast("double")).otherwise(0.0))
        return self.raw("embeddings").select(F.col("vec_id").alias("article_id"), picked.alias("entity"))

    @cached_property
    def positions(self) -> DataFrame:
        o, l, p = self.raw("orders"), self.raw("lineitem"), self.raw("part")
        return (
            l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position_id"),
                F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("symbol"),
                F.col("l_extendedprice").alias("usdt_amount"), F.col("p_retailprice").alias("buy_price"),
                F.col("o_orderdate").alias("buy_time"), F.col("l_shipdate").alias("target_sell_time"),
                F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"),
                (F.col("l_discount") * 100 - 5).alias("change_percent"))
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
            (F.col("c_acctbal") > 0).alias("email_verified"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "Disabled").when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
            .otherwise("Active").alias("status"))

    @cached_property
    def prefs(self) -> DataFrame:
        return self.raw("events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(
            F.max("ts").alias("updated_at"), (F.max("value") > 50).alias("enabled"),
        ).withColumn("type", F.when(F.col("symbol") == "view", "INVESTMENT").otherwise("PREDICTION")).withColumn(
            "email", F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com")))


def _bars(source: str, width: int, order: str) -> str:
    start = f"make_timestamp((epoch_us(ts) // {width * 1000000}) * {width * 1000000})"
    return (f"SELECT symbol, {start} AS ts, first(price ORDER BY {order}) AS open, max(price) AS high, "
            f"min(price) AS low, last(price ORDER BY {order}) AS close, sum(volume) AS volume "
            f"FROM {source} GROUP BY symbol, {start}")


def _softmax(arr: str) -> str:
    e = f"list_transform({arr}, lambda x: exp(x - list_max({arr})))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), """SELECT event_id, event_type AS symbol, ts, user_id, value + 1 AS price,
        CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS volume FROM events"""),
    "daily_ticks": ((), """SELECT o_orderkey, o_orderpriority AS symbol, o_orderdate AS ts,
        o_totalprice AS price, CAST(1 AS DOUBLE) AS volume FROM orders"""),
    "daily": (("daily_ticks",), _bars("daily_ticks", 86400, "ts, o_orderkey")),
    "id": (("daily",), "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM daily"),
    "articles": ((), """SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, text AS content,
        source, lang, make_timestamp((1704067200 + ((doc_id * 7919) % 43200) * 60) * 1000000) AS published_at,
        (((doc_id * 31) % 201) - 100) / CAST(100 AS DOUBLE) AS sentiment_score,
        'https://' || source || '.example.com/a/' || (doc_id % 700) AS url FROM documents"""),
    "e64": ((), "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"),
    "predictions": (("e64",), f"""SELECT vec_id AS pred_id,
        ['click','error','purchase','signup','view'][(vec_id % 5) + 1] AS symbol,
        make_timestamp((1704067200 + vec_id * 3600) * 1000000) AS ts,
        CASE WHEN vec_id % 2 = 0 THEN '1h' ELSE '4h' END AS horizon, CAST(label % 3 AS INTEGER) AS label,
        e[1:3] AS logits, e[6:8] AS masked_logits, 1 / (1 + exp(-5 * e[4])) AS confidence, CAST(0.05 AS DOUBLE) * e[5] AS ret,
        {_softmax('e[1:3]')} AS probs, {_softmax('e[6:8]')} AS masked_probs,
        CASE WHEN e[1] >= e[2] AND e[1] >= e[3] THEN 0 WHEN e[2] >= e[3] THEN 1 ELSE 2 END AS pred,
        list_max({_softmax('e[1:3]')}) AS max_prob FROM e64"""),
    "factor_probs": (("e64",), f"SELECT vec_id AS article_id, {_softmax('e[9:18]')} AS factors FROM e64"),
    "entity_sentiment": (("e64",), """SELECT vec_id AS article_id,
        list_transform(e[21:30], lambda x: CASE WHEN abs(x) > CAST(0.05 AS DOUBLE) THEN x ELSE CAST(0 AS DOUBLE) END) AS entity FROM e64"""),
    "positions": ((), """SELECT l_orderkey * 10 + l_linenumber AS position_id, o_custkey AS user_id, p_brand AS symbol,
        l_extendedprice AS usdt_amount, p_retailprice AS buy_price, o_orderdate AS buy_time,
        l_shipdate AS target_sell_time, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'closed' END AS status,
        l_discount * 100 - 5 AS change_percent
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "users": ((), """SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email, c_acctbal > 0 AS email_verified,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Disabled' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'Active' END AS status
        FROM customer"""),
    "prefs": ((), """SELECT user_id, event_type AS symbol, max(ts) AS updated_at, max(value) > 50 AS enabled,
        CASE WHEN event_type = 'view' THEN 'INVESTMENT' ELSE 'PREDICTION' END AS type,
        'u' || user_id || '@example.com' AS email FROM events GROUP BY user_id, event_type"""),
}
for _i in ("1m", "5m", "15m", "1h", "4h", "1d"):
    CTES[f"c{_i}"] = (("ticks",), _bars("ticks", seconds(_i), "ts, event_id"))
    CTES[f"i{_i}"] = ((f"c{_i}",), f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM c{_i}")


def sql_with(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views (and what they need), then ``extra`` CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            add(need)
        ordered.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    recursive = ""
    for n, s in (extra or {}).items():
        if n.startswith("recursive "):
            recursive, n = "RECURSIVE ", n[len("recursive "):]
            parts.append(f"{n} AS ({s})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({s})" if "(" not in n else f"{n} AS ({s})")
    head = f"WITH {recursive}" + ", ".join(parts) + " " if parts else ""
    return head + body
