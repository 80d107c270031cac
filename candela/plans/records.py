"""Queries over messages, imports, pages, users and positions, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions import arrays as ar, decisions as dc, lexicons as lx, models, text as tx
from candela.operators import candles as cd, tables as tb
from candela.plans.news import LIST, Q, any_sql, hits_sql, sentiment_sql, REF_LISTS
from candela.plans.registry import R, Rs, query, rd, rounded
from candela.plans.tables import _softmax, sql_with
from candela.plans.trading import CONS, DIR_SQL, PAIR, _pair
from candela.session import durable, scratch_path
from candela.sources import files, imports as im, messages as ms, pages as pg
from candela.streaming import jobs, logs

# ------------------------------------------------------------------ kline messages

HOUR_MS = "(unix_millis(ts) div 3600000) * 3600000"


def _messages(t):
    """Kline messages in three known shapes and an unknown one, from the ticks."""
    p, v, o = "cast(price as string)", "cast(volume as string)", f"cast({HOUR_MS} as string)"
    seq = "case when event_id % 2 = 0 then concat(',\"seq\":', event_id) else '' end"
    nested = f"""concat('{{"symbol":"', symbol, '","interval":"1h","kline":{{"openTime":', {o}, ',"closeTime":', {o}, ',"open":"', {p}, '","high":"', {p}, '","low":"', {p}, '","close":"', {p}, '","volume":"', {v}, '","isFinal":', event_id % 3 = 0, '}}', {seq}, '}}')"""
    stream = f"""concat('{{"data":{{"k":{{"s":"', symbol, '","t":', {o}, ',"T":', {o}, ',"o":"', {p}, '","h":"', {p}, '","l":"', {p}, '","c":"', {p}, '","v":"', {v}, '","x":', event_id % 3 = 0, '}}}}', {seq}, '}}')"""
    flat = f"""concat('{{"s":"', symbol, '","t":', {o}, ',"T":', {o}, ',"o":"', {p}, '","h":"', {p}, '","l":"', {p}, '","c":"', {p}, '","v":"', {v}, '","x":', event_id % 3 = 0, {seq}, '}}')"""
    value = f"case event_id % 4 when 0 then {nested} when 1 then {stream} when 2 then {flat} else '{{\"foo\":1}}' end"
    return t.spread_ticks.select(F.col("event_id").alias("offset"), F.expr(value).alias("value"))


KL = {"kl": """SELECT event_id AS "offset", upper(symbol) AS symbol, CASE WHEN event_id % 4 = 0 THEN '1h' ELSE '1m' END AS interval, make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS ts, price AS open, price AS high, price AS low, price AS close, volume,
    CASE WHEN event_id % 2 = 0 THEN nullif(event_id, 0) END AS sequence, event_id % 3 = 0 AS is_final FROM ticks WHERE event_id % 4 < 3"""}


@query("s05_normalize_klines", sql_with("ticks", "SELECT * FROM kl", KL))
def _(t):
    return ms.normalize_klines(_messages(t)).drop("close_time")


@query("s05_normalize_cached_klines", sql_with("ticks", 'SELECT "offset", symbol, ts, open, high, low, close, volume FROM kl', KL))
def _(t):
    return ms.normalize_cached_klines(_messages(t)).drop("interval")


@query("t14_final_only", sql_with("ticks", "SELECT symbol, count(*) AS n FROM kl WHERE is_final GROUP BY symbol", KL))
def _(t):
    return ms.final_only(ms.normalize_klines(_messages(t))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("o05_dedupe_latest", sql_with("ticks", 'SELECT symbol, ts, max("offset") AS "offset", arg_max(close, "offset") AS close FROM kl GROUP BY symbol, ts', KL))
def _(t):
    rows = ms.normalize_klines(_messages(t)).select("symbol", "ts", "offset", "close")
    return cd.dedupe_latest(rows, ["symbol", "ts"], "offset")


MERGED = """SELECT symbol, ts, arg_min(open, "offset") AS open, max(high) AS high, min(low) AS low, arg_max(close, "offset") AS close, arg_max(volume, "offset") AS volume,
    arg_max(sequence, CASE WHEN sequence IS NOT NULL THEN "offset" END) AS sequence FROM kl GROUP BY symbol, ts"""


@query("t02_merge_klines", sql_with("ticks", MERGED, KL))
def _(t):
    return cd.replay_updates(ms.normalize_klines(_messages(t)))


@query("t02_merge_updates_batches", sql_with("ticks", """SELECT symbol, ts, arg_min(open, b) AS open, max(high) AS high, min(low) AS low, arg_max(close, b) AS close, arg_max(volume, b) AS volume,
    arg_max(sequence, CASE WHEN sequence IS NOT NULL THEN b END) AS sequence FROM (SELECT *, CASE WHEN "offset" < 5000 THEN 0 ELSE 1 END AS b FROM kl
    QUALIFY row_number() OVER (PARTITION BY symbol, ts, CASE WHEN "offset" < 5000 THEN 0 ELSE 1 END ORDER BY "offset" DESC) = 1) GROUP BY symbol, ts""", KL))
def _(t):
    rows = ms.normalize_klines(_messages(t))
    first = cd.merge_updates(None, rows.filter("offset < 5000"))
    return cd.merge_updates(first, rows.filter("offset >= 5000"))


def _stream_dir(t, rows, label: str) -> str:
    """Messages as text files with one JSON object {offset, value} per line."""
    path = scratch_path(t.spark, label)
    rows.select(F.to_json(F.struct("offset", "value")).alias("value")).repartitionByRange(4, "value").write.text(path)
    return path


def _stream(t, rows, label: str):
    src = jobs.read_stream(t.spark, "json", {"path": _stream_dir(t, rows, label), "maxFilesPerTrigger": "2"}, "offset bigint, value string")
    return src, scratch_path(t.spark, label + "-sink"), scratch_path(t.spark, label + "-ck")


@query("t01_stream_klines", sql_with("ticks", MERGED, KL))
def _(t):
    src, sink, ck = _stream(t, _messages(t), "klines")
    jobs.stream_klines(src, sink, ck, order="offset").awaitTermination()
    return jobs.read_klines(t.spark, sink)


@query("t10_late_updates", sql_with("ticks", MERGED, KL))
def _(t):
    """The newest messages arrive first; late ones still merge."""
    path = scratch_path(t.spark, "late")
    rows = _messages(t)
    for test in ("offset >= 4000", "offset < 4000"):
        rows.filter(test).select(F.to_json(F.struct("offset", "value")).alias("value")).write.mode("append").text(path)
    src = jobs.read_stream(t.spark, "json", {"path": path, "maxFilesPerTrigger": "4"}, "offset bigint, value string")
    sink = scratch_path(t.spark, "late-sink")
    jobs.stream_klines(src, sink, scratch_path(t.spark, "late-ck"), order="offset").awaitTermination()
    return jobs.read_klines(t.spark, sink)


@query("s02_rename_time_column", sql_with("ticks", "SELECT event_id, ts AS timestamp FROM ticks"))
def _(t):
    return files.rename_time_column(t.ticks.select("event_id", F.col("ts").alias("Open_Time "))).select("event_id", "timestamp")


@query("s16_read_stream", sql_with("ticks", "SELECT event_id % 4 AS shape, count(*) AS n FROM ticks GROUP BY 1"))
def _(t):
    src, sink, ck = _stream(t, _messages(t), "raw")
    logs.start(src, lambda b, i: logs.write_batch(b, sink, i), ck).awaitTermination()
    return logs.read_log(t.spark, sink).groupBy(F.pmod("offset", F.lit(4)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("t07_last_n_state", sql_with("ticks", """SELECT * FROM (SELECT symbol, interval, ts, arg_max(close, sequence) FILTER (WHERE sequence IS NOT NULL) AS close FROM kl GROUP BY symbol, interval, ts)
    QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY ts DESC) <= 50""", KL))
def _(t):
    src, sink, ck = _stream(t, _messages(t), "lastn")
    jobs.stream_last_n(src, sink, ck, 50).awaitTermination()
    # which update of a candle without numbers is last depends on the order of arrival, so only its place is compared
    return jobs.read_state(t.spark, sink, 50).select("symbol", "interval", "ts", F.when(F.col("sequence").isNotNull(), F.col("close")).alias("close"))


@query("o04_last_n_candles", sql_with("c1h", "SELECT symbol, ts, close FROM c1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 24"))
def _(t):
    return cd.last_n_per_key(t.candles(), ["symbol"], 24).select("symbol", "ts", "close")


GAPS = {"sq": "SELECT symbol, event_id AS s, lag(event_id) OVER (PARTITION BY symbol ORDER BY event_id) AS p FROM ticks",
        "gp": "SELECT symbol, p AS from_seq, s - 1 AS to_seq, s - p - 1 AS gap_size FROM sq WHERE s > p + 1"}


@query("w31_detect_gaps", sql_with("ticks", "SELECT * FROM gp", GAPS))
def _(t):
    return cd.detect_gaps(t.ticks.select("symbol", F.col("event_id").alias("sequence")))


# three numbered lanes that lost every fifth number; every second lost one came back
LANES = {"ln": "SELECT CAST(event_id % 3 AS VARCHAR) AS symbol, event_id // 3 AS s FROM ticks",
         "lk": "SELECT symbol, s, lag(s) OVER (PARTITION BY symbol ORDER BY s) AS p FROM ln WHERE s % 5 <> 0",
         "lg": "SELECT symbol, p AS from_seq, s - 1 AS to_seq, s - p - 1 AS gap_size FROM lk WHERE s > p + 1"}


@query("w32_gap_stats", sql_with("ticks", """SELECT symbol, count(*) AS total_gaps, CAST(sum(gap_size) AS BIGINT) AS total_missed, arg_max(from_seq, to_seq) AS last_from, max(to_seq) AS last_to,
    (SELECT count(*) FROM lg g JOIN ln k ON k.symbol = g.symbol AND k.s BETWEEN g.from_seq + 1 AND g.to_seq AND k.s % 10 = 0 WHERE g.symbol = lg.symbol) AS total_recovered FROM lg GROUP BY symbol""", LANES))
def _(t):
    lanes = t.ticks.select(F.pmod("event_id", F.lit(3)).cast("string").alias("symbol"), F.floor(F.col("event_id") / 3).alias("sequence"))
    return cd.gap_stats(cd.detect_gaps(lanes.filter("sequence % 5 <> 0")), lanes.filter("sequence % 10 = 0"))


@query("t08_stream_gaps", sql_with("ticks", """SELECT symbol, count(*) AS gaps, CAST(sum(s - p - 1) AS BIGINT) AS missed FROM (SELECT symbol, sequence AS s, lag(sequence) OVER (PARTITION BY symbol ORDER BY sequence) AS p
    FROM kl WHERE sequence IS NOT NULL) WHERE s > p + 1 GROUP BY symbol""", KL))
def _(t):
    path = scratch_path(t.spark, "gaps")
    # five files of mixed numbers, one per batch: gaps open and late numbers close them
    _messages(t).select(F.to_json(F.struct("offset", "value")).alias("value")).repartition(5, F.col("value")).write.text(path)
    src = jobs.read_stream(t.spark, "json", {"path": path, "maxFilesPerTrigger": "1"}, "offset bigint, value string")
    sink = scratch_path(t.spark, "gaps-sink")
    jobs.stream_gaps(src, sink, scratch_path(t.spark, "gaps-ck")).awaitTermination()
    return jobs.read_gaps(t.spark, sink).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap_size").alias("missed"))


@query("t09_stream_candles", sql_with("c1h", "SELECT symbol, ts, open, high, low, close, volume FROM c1h"))
def _(t):
    path = scratch_path(t.spark, "ticks")
    # five files of mixed times, one per batch: ticks come late
    t.ticks.select("event_id", "symbol", "ts", "price", "volume").repartition(5, "event_id").write.parquet(path)
    src = jobs.read_stream(t.spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"}, "event_id bigint, symbol string, ts timestamp, price double, volume double")
    sink = scratch_path(t.spark, "bars")
    jobs.stream_candles(src, sink, scratch_path(t.spark, "bars-ck")).awaitTermination()
    return jobs.read_candles(t.spark, sink)


@query("t06_number_events", sql_with("ticks", """SELECT event_id, symbol, 1000 + row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS sequence FROM ticks"""))
def _(t):
    last = t.ticks.select("symbol").distinct().withColumn("last_seq", F.lit(1000).cast("bigint"))
    return cd.number_events(t.ticks.select("event_id", "symbol", "ts"), ["ts", "event_id"], last).select("event_id", "symbol", "sequence")


@query("p05_missed_klines", sql_with("ticks", "SELECT event_id AS sequence, price FROM ticks WHERE symbol = 'click' AND event_id > 100 AND event_id <= 600 ORDER BY event_id LIMIT 100"))
def _(t):
    rows = t.ticks.select(F.upper("symbol").alias("symbol"), F.col("event_id").alias("sequence"), "price")
    return cd.missed_klines(rows, "click", 100, 600).select("sequence", "price")


@query("p06_history_page", sql_with("c1h", "SELECT * FROM (SELECT ts, close FROM c1h WHERE symbol = 'view' AND ts < TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC LIMIT 200)"))
def _(t):
    return cd.history_page(t.candles(), "view", "2024-01-15 12:00:00", 200).select("ts", "close")


@query("p07_candles_between", sql_with("c1h", "SELECT ts, close FROM c1h WHERE symbol = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"))
def _(t):
    return cd.candles_between(t.candles(), "view", "2024-01-05 00:00:00", "2024-01-10 00:00:00").select("ts", "close")


# ------------------------------------------------------------------ news messages

NEWS_MSG = """concat('{"', case when article_id % 5 = 0 then 'link' else 'url' end, '":"', case when article_id % 11 = 0 then '' else url end, '","source":"', source, '","published_at":',
    case article_id % 3 when 0 then cast(unix_seconds(published_at) as string) when 1 then cast(unix_millis(published_at) as string) else concat('"', date_format(published_at, 'yyyy-MM-dd HH:mm:ss'), '"') end,
    case article_id % 6 when 0 then concat(',"sentiment_score":{"pos":0.7,"neg":', article_id % 10, '}') when 1 then ',"raw":{"pos":0.2,"neg":0.6,"raw":{"x":1}}'
    when 2 then ',"raw":0.25' when 3 then ',"sentiment_label":"Negative","sentiment_score":0.4' when 4 then ',"label":"neutral","score":0.9' else concat(',"sentiment_score":', sentiment_score) end, '}')"""
NM = {"nm": """SELECT article_id AS "offset", published_at AS time, url, source, CASE article_id % 6 WHEN 0 THEN 0.7 - article_id % 10 WHEN 1 THEN 0.2 - 0.6 WHEN 2 THEN 0.25 WHEN 3 THEN -0.4 WHEN 4 THEN 0
    ELSE sentiment_score END AS sentiment_score FROM articles WHERE article_id % 11 <> 0"""}


def _news_messages(t):
    return t.articles.select(F.col("article_id").alias("offset"), F.expr(NEWS_MSG).alias("value"))


@query("s06_f18_normalize_news", sql_with("articles", f"""SELECT "offset", time, url, source, {R('sentiment_score')} AS sentiment_score FROM nm""", NM))
def _(t):
    return rounded(ms.normalize_news(_news_messages(t)).select("offset", "time", "url", "source", "sentiment_score"))


@query("f19_unwrap_raw", sql_with("articles", """SELECT article_id, CASE article_id % 3 WHEN 0 THEN '{"a":' || article_id || '}' WHEN 1 THEN '{"b":1}' ELSE '{"raw":null,"c":2}' END AS body FROM articles"""))
def _(t):
    body = F.expr("""case article_id % 3 when 0 then concat('{"raw":{"raw":{"a":', article_id, '}}}') when 1 then concat(repeat('{"raw":', 10), '{"b":1}', repeat('}', 10)) else '{"raw":null,"c":2}' end""")
    return t.articles.select("article_id", ms.unwrap_raw(body).alias("body"))


@query("f20_to_ts", sql_with("articles", "SELECT article_id, published_at AS ts FROM articles"))
def _(t):
    raw = F.expr("case article_id % 3 when 0 then cast(unix_seconds(published_at) as string) when 1 then cast(unix_millis(published_at) as string) else date_format(published_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end")
    return t.articles.select("article_id", tx.to_ts(raw).alias("ts"))


@query("t03_stream_news", sql_with("articles", "SELECT DISTINCT url FROM nm", NM))
def _(t):
    src, sink, ck = _stream(t, _news_messages(t), "news")
    jobs.stream_news(src, sink, ck).awaitTermination()
    return logs.read_log(t.spark, sink).select("url")


@query("t04_seen_urls", sql_with("articles", "SELECT url, count(DISTINCT url) AS n FROM nm GROUP BY url", NM))
def _(t):
    src, sink, ck = _stream(t, _news_messages(t), "seen")
    rows = jobs.seen_urls(ms.normalize_news(src), "60 days")
    logs.start(rows, lambda b, i: logs.write_batch(b, sink, i), ck).awaitTermination()
    return logs.read_log(t.spark, sink).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("j09_insert_new", sql_with("articles", "SELECT article_id FROM articles WHERE lang = 'en' AND url NOT IN (SELECT url FROM articles WHERE lang <> 'en')"))
def _(t):
    a = t.articles.select("article_id", "url", "lang")
    return im.insert_new(a.filter("lang = 'en'"), a.filter("lang <> 'en'")).select("article_id")


@query("s11_staged_insert", sql_with("articles", """SELECT min(article_id) AS article_id, url FROM articles WHERE lang = 'en' AND (published_at, url) NOT IN (SELECT (published_at, url) FROM articles WHERE lang = 'de') GROUP BY published_at, url"""))
def _(t):
    a = t.articles.select("article_id", "url", "lang", "published_at")
    return im.staged_insert(a.filter("lang = 'en'"), a.filter("lang = 'de'"), ["published_at", "url"], "article_id").select("article_id", "url")


@query("j10_lookup_labels", sql_with("articles", """SELECT a.article_id, coalesce(u.l, v.l) AS label FROM articles a LEFT JOIN (SELECT url, arg_max(quality, doc_id) AS l FROM labels JOIN articles ON article_id = doc_id GROUP BY url) u ON u.url = a.url
    LEFT JOIN (SELECT lower(trim(title)) AS t, CAST(published_at AS DATE) AS d, arg_max(quality, doc_id) AS l FROM labels JOIN articles ON article_id = doc_id WHERE trim(title) <> '' GROUP BY 1, 2) v
    ON v.t = lower(trim(a.title)) AND v.d = CAST(a.published_at AS DATE)"""))
def _(t):
    labels = t.raw("labels").select(F.col("doc_id").alias("article_id"), F.col("quality").alias("label")).join(t.articles, ["article_id"])
    labels = labels.select(F.col("article_id").alias("row_id"), "label", "url", "title", "published_at")
    return im.lookup_labels(t.articles.select("article_id", "url", "title", "published_at"), labels).select("article_id", "label")


# ------------------------------------------------------------------ imports

DIGEST = lambda sep: f"strftime(published_at, '%Y-%m-%d %H:%M:%S') || {sep}"


@query("s08_import_news_json", sql_with("articles", f"""SELECT article_id AS id, published_at AS time, CASE WHEN article_id % 4 = 3 THEN 'dataset://new-json/' || sha256(strftime(published_at, '%Y-%m-%d %H:%M:%S') || '|' || source || '|' || title)
    WHEN article_id % 4 = 2 THEN url || '?a=1' ELSE url END AS url, source, {R("CASE article_id % 3 WHEN 0 THEN 0 ELSE least(1, greatest(-1, sentiment_score * 2)) END")} AS sentiment_score
    FROM articles WHERE published_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25'"""))
def _(t):
    raw = t.articles.select(
        F.col("article_id").alias("id"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "source", "title",
        F.expr("case article_id % 4 when 3 then 'not a url' when 2 then concat(url, '?utm_source=x&a=1&UTM_medium=y#frag') else concat(url, '#top') end").alias("url"),
        F.expr("case when article_id % 3 = 0 then 'n/a' else cast(sentiment_score * 2 as string) end").alias("sentimentScore"),
        F.lit("").alias("summary"), F.col("title").alias("snippet"), F.lit(None).cast("string").alias("sentiment"),
        F.array("source").alias("coin"), F.lit(None).cast("string").alias("tag"))
    out = im.import_news_json(raw, "2024-01-10", "2024-01-25")
    return rounded(out.select(F.get_json_object("raw_score", "$.id").cast("bigint").alias("id"), "time", "url", "source", "sentiment_score"))


@query("s09_import_articles", sql_with("articles entity_sentiment", f"""SELECT article_id, published_at AS time, 'dataset://articles_max/' || sha256({DIGEST("'|'")} || source || '|' || title) AS url,
    {R('coalesce(list_sum(entity) / nullif(len(list_filter(entity, lambda x: x <> 0)), 0), 0)')} AS sentiment_score FROM articles JOIN entity_sentiment USING (article_id)"""))
def _(t):
    return rounded(im.import_articles(t.articles, t.entity_sentiment).select("article_id", "time", "url", "sentiment_score"))


@query("s10_import_weighted_news", sql_with("articles factor_probs entity_sentiment", f"""SELECT article_id, published_at AS time, 'historical://articles-max/' || left(sha256({DIGEST('chr(10)')} || trim(title, ' ' || chr(9) || chr(10) || chr(13))), 24) AS url,
    {R('list_sum(list_transform(list_zip(factors, entity), lambda z: z[1] * z[2])) / list_sum(factors)')} AS signed_sentiment FROM articles JOIN factor_probs USING (article_id) JOIN entity_sentiment USING (article_id)
    WHERE published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-20'"""))
def _(t):
    out = im.import_weighted_news(t.articles, t.factor_probs, t.entity_sentiment, "2024-01-05", "2024-01-20")
    return rounded(out.select("article_id", "time", "url", "signed_sentiment"))


# ------------------------------------------------------------------ files


@query("s01_read_ohlcv", sql_with("c1h", "SELECT 'X' AS symbol, ts, arg_max(close, symbol) AS close, arg_max(volume, symbol) AS volume FROM c1h GROUP BY ts"))
def _(t):
    path = scratch_path(t.spark, "ohlcv")
    rows = t.candles().select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" DateTime "), *cd.OHLCV)
    rows.orderBy("symbol").drop("symbol").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_ohlcv(t.spark, path, "X").select("symbol", "ts", "close", "volume")


@query("s03_read_articles", sql_with("articles", "SELECT article_id, published_at, length(title) AS title_len FROM articles"))
def _(t):
    path = scratch_path(t.spark, "articles")
    t.articles.select("article_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("PublishedAt"), "source", "title").write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    out = files.read_articles(t.spark, path)
    return out.select(F.col("article_id").cast("bigint").alias("article_id"), "published_at", F.length(F.coalesce("title", F.lit(""))).cast("bigint").alias("title_len"))


@query("s04_s13_prediction_jsonl", sql_with("predictions", f"SELECT symbol, ts, horizon, {DIR_SQL} AS direction, {R('confidence')} AS confidence, {R('probs[3]')} AS p_up FROM predictions WHERE horizon = '1h'"))
def _(t):
    word = F.element_at(F.array(*[F.lit(x) for x in ("DOWN", "NEUTRAL", "UP")]), F.col("pred") + 1)
    p = t.predictions.filter("horizon = '1h'").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "symbol", "horizon", word.alias("direction"), "confidence",
        F.col("max_prob").alias("max_probability"), F.struct(F.col("probs")[0].alias("DOWN"), F.col("probs")[1].alias("NEUTRAL"), F.col("probs")[2].alias("UP")).alias("probabilities"), F.col("ret").alias("return"))
    path = scratch_path(t.spark, "log")
    files.write_jsonl(p, path)
    got = files.read_prediction_log(t.spark, path, "1h").unionByName(files.read_prediction_log(t.spark, path + "-missing", "4h"))
    return rounded(got.select("symbol", "ts", "horizon", "direction", "confidence", F.col("probabilities.UP").alias("p_up")))


@query("s12_export_articles_csv", sql_with("articles", "SELECT CAST(article_id AS VARCHAR) AS id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, source FROM articles"))
def _(t):
    path = scratch_path(t.spark, "export")
    files.export_articles_csv(t.articles.select(F.col("article_id").alias("_id"), "published_at", "source", F.array("lang").alias("tags")), path)
    return t.spark.read.option("header", True).csv(path).select(F.col("_id").alias("id"), "published_at", "source")


@query("s14_write_features", sql_with("c1h", "SELECT count(*) AS rows, min(ts) AS ts_min, max(ts) AS ts_max, CAST(10 AS INTEGER) AS dim FROM c1h"))
def _(t):
    rows = cd.bar_features(t.candles()).select("symbol", "ts", F.array(*cd.BAR_FEATURES).alias("features"))
    return files.write_features(rows, scratch_path(t.spark, "features"))


@query("s15_write_report", sql_with("predictions", f"SELECT 'mean' AS metric, {R('avg(ret)')} AS strategy, {R('avg(confidence)')} AS buy_hold FROM predictions UNION ALL SELECT 'top', {R('max(ret)')}, {R('max(confidence)')} FROM predictions"))
def _(t):
    a = t.predictions.agg(F.avg("ret").alias("mean"), F.max("ret").alias("top"))
    b = t.predictions.agg(F.avg("confidence").alias("mean"), F.max("confidence").alias("top"))
    path = scratch_path(t.spark, "report")
    files.write_report(a, b, path)
    return rounded(t.spark.read.option("header", True).csv(f"{path}/comparison").select("metric", F.col("strategy").cast("double"), F.col("buy_hold").cast("double")))


# ------------------------------------------------------------------ pages and urls

ENT = lambda e: ("replace(" * len(pg.ENTITIES)) + e + "".join(f", {Q(a)}, {Q(b)})" for a, b in pg.ENTITIES)
PLAIN = lambda e: f"regexp_replace({ENT(f'''regexp_replace({e}, '(?s)<[^>]*>', '', 'g')''')}, '^\\s+|\\s+$', '', 'g')"
TITLE = PLAIN("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")
BODY = "regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g')"
PART = PLAIN("regexp_extract(x, '(?is)^(.*?)(?:</(?:p|article|div|section|main|body)>|$)', 1)")
CONTENT = f"array_to_string(list_filter(list_transform(regexp_split_to_array({BODY}, '(?i)<p\\b[^>]*>')[2:], lambda x: {PART}), lambda v: length(v) > 50), chr(10) || chr(10))"
PAGE = {"pgs": f"SELECT page_id, url, html, coalesce(nullif({TITLE}, ''), 'Untitled') AS title, {CONTENT} AS content FROM pages"}


@query("s17_extract_articles", sql_with("", f"""SELECT page_id, md5(title) AS title, length(content) AS chars, md5(content) AS content, {R(f"least(1, round(0.2 + 0.3 * {hits_sql('x', lx.HIGH_IMPACT_WORDS)} + 0.1 * {hits_sql('x', lx.CRYPTO_WORDS)}, 2))", 2)} AS relevance_score,
    {R(sentiment_sql('x', REF_LISTS), 2)} AS sentiment_score FROM (SELECT *, lower(title || ' ' || content) AS x FROM pgs)""", PAGE))
def _(t):
    out = pg.extract_articles(t.texts("pages"))
    return rounded(out.select("page_id", F.md5("title").alias("title"), F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content"), "relevance_score", "sentiment_score"), 2)


_BARE = "regexp_replace(trim(url), '#.*$', '')"
_BASE = f"regexp_extract({_BARE}, '^([^?]*)', 1)"
_KEPT = f"list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^utm_'))"


@query("f21_canonical_url", sql_with("", f"""SELECT page_id, CASE WHEN regexp_matches({_BASE}, '^[^:]+://[^/]+$') THEN {_BASE} || '/' ELSE {_BASE} END || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS url FROM pages"""))
def _(t):
    return t.raw("pages").select("page_id", tx.canonical_url(F.col("url"), F.col("url")).alias("url"))


@query("f22_host_key", sql_with("", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, sha256(url) AS key FROM pages"))
def _(t):
    return t.raw("pages").select("page_id", tx.host(F.col("url")).alias("host"), tx.url_key(F.col("url")).alias("key"))


LINKS = {
    "hr": "SELECT DISTINCT url AS page, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base, regexp_extract(url, '^([^:]+:)', 1) AS scheme, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) AS folder, "
          + ENT("unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href\\s*=\\s*[\"'']([^\"'']*)', 1))") + " AS href FROM pages",
    "fu": """SELECT page, base, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN base || href
        ELSE base || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS link FROM hr WHERE NOT starts_with(href, 'javascript:') AND NOT starts_with(href, '#')""",
    "pa": "SELECT *, lower(regexp_extract(link, '^[^:]+://[^/?#]+([^?#]*)', 1)) AS path FROM fu"}


@query("f23_discover_links", sql_with("", f"""SELECT DISTINCT page, link FROM pa WHERE regexp_extract(link, '^[^:]+://([^/?#]+)', 1) = regexp_extract(base, '://(.*)$', 1)
    AND NOT {any_sql('path', lx.LINK_EXCLUDE)} AND (length(path) > 10 OR {any_sql('path', lx.LINK_FOLLOW)})""", LINKS))
def _(t):
    return pg.discover_links(t.texts("pages"))


# ------------------------------------------------------------------ insights

INSIGHT = f"""concat('{{"type":"causal_event"', case when pred_id % 4 < 3 then concat(',"meta":{{"symbol":"', upper(symbol), '"}},"predictions":[{{"symbol":"', upper(symbol), '","should_alert":', pred_id % 3 = 0, ',"current_price":', pred_id, ',"forecast":{{"next_1h":{{"direction":"', {DIR_SQL}, '","confidence":', pred_id % 100, '}}', case when pred_id % 2 = 0 then concat(',"next_24h":{{"direction":"UP","confidence":', (pred_id * 7) % 100, '}}') else '' end, '}}}},{{"symbol":"BTCUSDT","should_alert":false}}]') else ',"insight":{{"title":"x"}}' end, '}}')"""


def _insight_messages(t):
    return t.predictions.select(F.col("pred_id").alias("offset"), "ts", F.expr(INSIGHT).alias("value"))


@query("s07_normalize_insights", sql_with("predictions", """SELECT pred_id AS "offset", CASE WHEN pred_id % 4 < 3 THEN 'aggregated_prediction' ELSE 'causal_event' END AS type, CASE WHEN pred_id % 4 < 3 THEN upper(symbol) END AS symbol,
    CASE WHEN pred_id % 4 = 3 THEN '{"title":"x"}' END AS body FROM predictions"""))
def _(t):
    out = ms.normalize_insights(_insight_messages(t).drop("ts"))
    return out.select("offset", "type", "symbol", F.when(F.col("type") == "causal_event", F.col("payload")).alias("body"))


def _insights(t):
    return ms.normalize_insights(_insight_messages(t).withColumnRenamed("ts", "time"))


@query("p01_query_insights", sql_with("predictions", """SELECT pred_id AS "offset", ts AS time FROM predictions WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-15' AND pred_id % 4 < 3 AND symbol = 'click' ORDER BY ts DESC LIMIT 25"""))
def _(t):
    return tb.query_insights(_insights(t), "2024-01-02", "2024-01-15", "aggregated_prediction", "click", 25).select("offset", "time")


@query("o03_latest_per_key", sql_with("predictions", "SELECT upper(symbol) AS symbol, max(pred_id) AS \"offset\" FROM predictions WHERE pred_id % 4 < 3 GROUP BY symbol"))
def _(t):
    return cd.latest_per_key(_insights(t).filter("symbol is not null"), ["symbol"], "time").select("symbol", "offset")


@query("j11_latest_prediction_in_payload", sql_with("predictions", """SELECT symbol, max(ts) AS time FROM (SELECT unnest([upper(symbol), 'BTCUSDT']) AS symbol, ts FROM (SELECT * FROM predictions WHERE pred_id % 4 < 3)) GROUP BY symbol"""))
def _(t):
    return tb.latest_prediction_in_payload(_insights(t)).select("symbol", "time")


ALERTS = {"alr": f"""SELECT pred_id, upper(symbol) AS symbol, CASE WHEN pred_id % 2 = 0 THEN (pred_id * 7) % 100 ELSE pred_id % 100 END AS confidence, CASE WHEN pred_id % 2 = 0 THEN 'UP' ELSE {DIR_SQL} END AS direction FROM predictions
    WHERE pred_id % 4 < 3 AND pred_id % 3 = 0 AND CASE WHEN pred_id % 2 = 0 THEN (pred_id * 7) % 100 ELSE pred_id % 100 END >= 50"""}


@query("p19_notifiable", sql_with("predictions", "SELECT pred_id, symbol, CAST(confidence AS DOUBLE) AS confidence, direction FROM alr", ALERTS))
def _(t):
    rows = tb.notifiable(tb.payload_predictions(_insights(t).drop("symbol")))
    return rows.select(F.col("offset").alias("pred_id"), F.col("prediction.symbol").alias("symbol"), "forecast.confidence", "forecast.direction")


@query("j15_fan_out", sql_with("predictions users", "SELECT user_id, count(*) AS alerts, count(DISTINCT pred_id) AS kinds FROM alr, users WHERE email_verified AND lower(coalesce(status, 'active')) = 'active' GROUP BY user_id", ALERTS))
def _(t):
    alerts = tb.notifiable(tb.payload_predictions(_insights(t).drop("symbol"))).select(F.col("offset").alias("pred_id"))
    members = tb.recipient_members(t.users)
    return tb.per_recipient(tb.addressed(alerts, members), members, alerts=F.count(F.lit(1)), kinds=F.count_distinct("pred_id"))


@query("j15_alerts_by_user_and_symbol", sql_with("predictions users", "SELECT user_id, symbol, count(*) AS alerts, max(confidence)::DOUBLE AS top FROM alr, users WHERE email_verified AND lower(coalesce(status, 'active')) = 'active' GROUP BY user_id, symbol", ALERTS))
def _(t):
    alerts = tb.notifiable(tb.payload_predictions(_insights(t).drop("symbol"))).select("prediction.symbol", "forecast.confidence")
    members = tb.recipient_members(t.users)
    return tb.per_recipient(tb.addressed(alerts, members), members, ["symbol"], alerts=F.count(F.lit(1)), top=F.max("confidence").cast("double"))


@query("j15_result_recipients", sql_with("users", "SELECT o_orderkey AS id, u.email FROM orders JOIN users u ON u.user_id = o_custkey WHERE email_verified AND lower(coalesce(status, 'active')) = 'active'"))
def _(t):
    results = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return tb.result_recipients(results, t.users).select("id", "email")


@query("t05_stream_insights", sql_with("predictions", "SELECT CASE WHEN pred_id % 4 < 3 THEN 'aggregated_prediction' ELSE 'causal_event' END AS type, count(*) AS n FROM predictions GROUP BY 1"))
def _(t):
    src, sink, ck = _stream(t, _insight_messages(t), "insights")
    jobs.stream_insights(src, sink, ck).awaitTermination()
    return logs.read_log(t.spark, sink).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("t12_stream_alerts", sql_with("predictions users", "SELECT symbol, direction, count(*) AS n FROM alr, users WHERE email_verified AND lower(coalesce(status, 'active')) = 'active' GROUP BY symbol, direction", ALERTS))
def _(t):
    src, sink, ck = _stream(t, _insight_messages(t), "alerts")
    jobs.stream_alerts(src.drop("offset"), durable(t.users), sink, ck).awaitTermination()
    return logs.read_log(t.spark, sink).groupBy("symbol", "direction").agg(F.sum("n_recipients").alias("n"))


@query("f40_payload_field", sql_with("predictions", f"SELECT pred_id, CASE WHEN pred_id % 4 < 3 THEN {DIR_SQL} END AS direction FROM predictions"))
def _(t):
    return _insight_messages(t).select(F.col("offset").alias("pred_id"), ms.payload_field(F.col("value"), "predictions[0].forecast.next_1h.direction").alias("direction"))


# ------------------------------------------------------------------ users, settings, positions


@query("a09_page", sql_with("", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total, CAST(ceil((SELECT count(*) FROM customer) / 20) AS BIGINT) AS pages FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40"))
def _(t):
    return tb.page(t.raw("customer"), [F.col("c_acctbal").desc(), "c_custkey"], 3, 20).select("c_custkey", "total", "pages")


@query("a09_far_page", sql_with("", "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total, CAST(ceil((SELECT count(*) FROM lineitem) / 20) AS BIGINT) AS pages FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 59980"))
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return tb.page(t.raw("lineitem"), order, 3000, 20).select("l_orderkey", "l_linenumber", "total", "pages")


SETTINGS = """SELECT user_id, max(email) AS email, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (type = 'PREDICTION' AND enabled), '') AS symbols, bool_or(type = 'INVESTMENT' AND enabled) AS investment_enabled, max(updated_at) AS updated_at FROM prefs GROUP BY user_id"""


@query("a10_consolidate_settings", sql_with("prefs", SETTINGS))
def _(t):
    s = tb.consolidate_settings(t.prefs)
    return s.select("user_id", "email", F.array_join("prediction_symbols", ",").alias("symbols"), "investment_enabled", "updated_at")


@query("f41_flatten_settings", sql_with("prefs", "SELECT user_id, 'PREDICTION' AS type, symbol, true AS enabled FROM prefs WHERE type = 'PREDICTION' AND enabled UNION ALL SELECT user_id, 'INVESTMENT', 'ALL', true FROM prefs WHERE type = 'INVESTMENT' AND enabled"))
def _(t):
    return tb.flatten_settings(tb.consolidate_settings(t.prefs))


@query("f39_set_edits", sql_with("prefs", """SELECT user_id, array_to_string(list_sort(list_distinct(list_append(s, 'click'))), ',') AS added, array_to_string(list_filter(s, lambda x: x <> 'click'), ',') AS removed
    FROM (SELECT user_id, coalesce(list(symbol ORDER BY symbol) FILTER (type = 'PREDICTION' AND enabled), []) AS s FROM prefs GROUP BY user_id)"""))
def _(t):
    s = tb.consolidate_settings(t.prefs)
    x = F.lit("click")
    return s.select("user_id", F.array_join(F.array_sort(ar.set_add(F.col("prediction_symbols"), x)), ",").alias("added"), F.array_join(ar.set_remove(F.col("prediction_symbols"), x), ",").alias("removed"))


@query("t11_stream_settings", sql_with("", """SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_type, event_id) AS symbol, arg_max(event_id % 2 = 0, event_id) AS investment_enabled FROM events WHERE event_id % 7 <> 0 GROUP BY user_id"""))
def _(t):
    value = F.expr("""concat('{"user_id":"', user_id, '"', case when event_id % 7 = 0 then '' else ',"email":"a@b.c"' end, ',"notification_settings":{"prediction_symbols":["', symbol, '"],"investment_enabled":', event_id % 2 = 0, '}}')""")
    src, sink, ck = _stream(t, t.ticks.select(F.col("event_id").alias("offset"), value.alias("value")), "settings")
    jobs.stream_settings(src, sink, ck).awaitTermination()
    return jobs.read_settings(t.spark, sink).select("user_id", F.element_at("prediction_symbols", 1).alias("symbol"), "investment_enabled")


@query("a11_duplicate_keys", sql_with("articles", "SELECT url AS key, count(*) AS n FROM articles GROUP BY url HAVING count(*) > 1"))
def _(t):
    return tb.duplicate_keys(t.articles, "url")


TOKENS = {"tk": "SELECT o_orderkey AS id, o_orderdate AS expires_at, o_orderstatus = 'F' AS is_revoked FROM orders"}


@query("p18_retain_valid", sql_with("", "SELECT id FROM tk WHERE NOT (expires_at < TIMESTAMP '1998-01-01' OR is_revoked)", TOKENS))
def _(t):
    tokens = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"), (F.col("o_orderstatus") == "F").alias("is_revoked"))
    return tb.retain_valid(tokens, "1998-01-01").select("id")


@query("p18_valid_tokens", sql_with("", "SELECT o_orderkey AS token_id FROM orders WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1997-01-01' AND o_orderstatus <> 'F'"))
def _(t):
    tokens = t.raw("orders").select(
        F.col("o_orderkey").alias("token_id"), (F.col("o_orderdate") + F.expr("interval 7 days")).alias("expires_at"),
        (F.col("o_orderstatus") == "F").alias("is_revoked"))
    return tb.valid_tokens(tokens, "1997-01-01").select("token_id")


@query("a25_source_health", sql_with("articles", """SELECT source, count(*) AS crawl_count, max(rn) - coalesce(max(CASE WHEN NOT error THEN rn END), 0) AS error_count, max(published_at) AS last_crawled_at FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at, article_id) AS rn, sentiment_score < 0.3 AS error FROM articles) GROUP BY source"""))
def _(t):
    crawls = t.articles.select("source", F.col("published_at").alias("crawled_at"), F.col("article_id").alias("crawl_id"), (F.col("sentiment_score") < 0.3).alias("error"))
    return tb.source_health(crawls, "source")


@query("p17_due_positions", sql_with("positions", "SELECT position_id FROM positions WHERE status = 'active' AND target_sell_time <= TIMESTAMP '1999-06-01'"))
def _(t):
    return tb.due_positions(t.positions, "1999-06-01").select("position_id")


@query("f36_position_pnl", sql_with("positions", f"SELECT position_id, {R('usdt_amount / buy_price')} AS coin_amount, {R('buy_price * (1 + change_percent / 100)', 4)} AS predicted_price, {R('(buy_price * (1 + change_percent / 100) - buy_price) * (usdt_amount / buy_price)', 4)} AS predicted_profit_usdt FROM positions"))
def _(t):
    p = dc.position_pnl(t.positions)
    return rounded(p.select("position_id", "coin_amount", "predicted_price", "predicted_profit_usdt"), {"predicted_price": 4, "predicted_profit_usdt": 4})


CLOSE = {
    "px": "SELECT p_brand AS symbol, make_timestamp((epoch_us(l_shipdate) // 2592000000000) * 2592000000000) AS ts, max(p_retailprice) + count(*) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "cl": "SELECT p.*, px.close AS sell_price FROM positions p ASOF JOIN px ON p.symbol = px.symbol AND p.target_sell_time >= px.ts",
    "cp": "SELECT *, (sell_price * (usdt_amount / buy_price) - usdt_amount) AS profit, (sell_price * (usdt_amount / buy_price) - usdt_amount) / usdt_amount * 100 AS pct FROM cl",
    "cq": """SELECT *, exp(-abs(pct - change_percent) / greatest(0.3, abs(pct), abs(change_percent))) AS sim, CASE WHEN pct > 0 THEN 'UP' WHEN pct < 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS got,
        CASE WHEN change_percent > 0 THEN 'UP' WHEN change_percent < 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS want FROM cp"""}


@query("j16_close_positions", sql_with("positions", f"""SELECT position_id, sell_price, {R('profit', 3)} AS actual_profit_usdt, {R('pct', 4)} AS actual_profit_percent, {R("CASE WHEN want = got THEN 50 + 50 * sim WHEN want <> 'NEUTRAL' AND got <> 'NEUTRAL' THEN 0 ELSE 50 * sim END", 1)} AS accuracy FROM cq""", CLOSE))
def _(t):
    l, p = t.raw("lineitem"), t.raw("part")
    width = 2592000
    prices = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("symbol"), F.timestamp_seconds(F.floor(F.unix_seconds("l_shipdate") / width) * width).alias("ts")).agg(
        (F.max("p_retailprice") + F.count(F.lit(1))).alias("close"))
    out = tb.close_positions(t.positions, prices)
    return rounded(out.select("position_id", "sell_price", "actual_profit_usdt", "actual_profit_percent", "accuracy"), {"actual_profit_usdt": 3, "actual_profit_percent": 4, "accuracy": 1})


# ------------------------------------------------------------------ user models and the decision batch


def _vowel_model():
    return lambda texts: [sum(ch in "aeiou" for ch in x) / max(len(x), 1) for x in texts]


@query("x01_score_text", sql_with("articles", f"SELECT article_id, {R('CASE WHEN trim(title) = ' + chr(39) * 2 + ' THEN 0 ELSE (length(title) - length(regexp_replace(title, ' + Q('[aeiou]') + ', ' + Q('') + ', ' + Q('g') + '))) / length(title) END')} AS score FROM articles"))
def _(t):
    return rounded(models.score_text(t.articles.select("article_id", "title"), _vowel_model, "title").select("article_id", "score"))


def _length_model():
    return lambda texts: [[len(x), x.count("e"), 1.0] for x in texts]


@query("x02_embed_text", sql_with("articles", "SELECT article_id, CAST(length(title) AS DOUBLE) AS e0, CAST(length(title) - length(replace(title, 'e', '')) AS DOUBLE) AS e1 FROM articles"))
def _(t):
    rows = models.embed_text(t.articles.select("article_id", "title"), _length_model, "title")
    return rows.select("article_id", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"))


@query("t13_decision_batch", sql_with("c1h predictions", """SELECT c.symbol, c.ts, (confidence >= 0.5 AND pred <> 1) AS alert FROM c1h c JOIN predictions p ON p.symbol = c.symbol AND p.ts = c.ts"""))
def _(t):
    word = F.element_at(F.array(*[F.lit(x) for x in ("SELL", "HOLD", "BUY")]), F.col("pred") + 1)
    out = t.predictions.select("symbol", "ts", word.alias("signal_1h"), F.lit("HOLD").alias("signal_4h"), F.col("confidence").alias("confidence_1h"), F.lit(0.0).alias("confidence_4h"),
                               F.col("max_prob").alias("max_prob_1h"), F.lit(0.0).alias("max_prob_4h"), *[F.lit(v).alias(f"{k}_{h}") for h in ("1h", "4h") for k, v in (("tau", 0.5), ("gamma", 0.0))])
    return jobs.decision_batch(durable(t.indexed()), t.articles, out).select("symbol", "ts", "alert")


@query("x03_strategy_json", sql_with("c1h", "SELECT symbol, ts, CASE WHEN close > 100 OR close < 20 THEN 'SELL' ELSE 'HOLD' END AS signal FROM c1h"))
def _(t):
    from candela.operators.strategy import compile_strategy
    text = '{"name":"edges","logic":"OR","action":"SELL","conditions":[{"type":"price","operator":">","value":"100"},{"type":"price","operator":"<","value":20}]}'
    c = t.candles()
    return c.select("symbol", "ts", compile_strategy(text, c.columns).alias("signal"))


@query("x04_user_lexicons", sql_with("articles", f"""SELECT article_id, {R("least(1, (CASE WHEN contains(lower(content), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'zzz') THEN 1 ELSE 0 END) / CAST(1 AS DOUBLE))")} AS presence,
    CAST(CASE WHEN contains(source, 'src1') THEN 0.9 WHEN contains(source, 'src2') THEN 0.8 ELSE 0.5 END AS DOUBLE) AS credibility FROM articles"""))
def _(t):
    return t.articles.select("article_id", rd(tx.keyword_presence(F.col("content"), ("tion", "zzz"))).alias("presence"),
                             tx.source_credibility(F.col("source"), (("src1", 0.9), ("src2", 0.8))).alias("credibility"))
