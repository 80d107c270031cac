"""Queries over articles: windows around decisions, selection, scores, novelty."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candela.functions import arrays as ar, lexicons as lx, text as tx
from candela.operators import indicators as ind, joins, news as nw
from candela.plans.registry import R, Rs, query, rd, rounded
from candela.plans.tables import _softmax, sql_with

Q = lambda s: "'" + s.replace("'", "''") + "'"
LIST = lambda xs: "[" + ", ".join(Q(x) for x in xs) + "]"
hits_sql = lambda text, words: "(" + " + ".join(f"CASE WHEN contains({text}, {Q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"
any_sql = lambda text, words: "(" + " OR ".join(f"contains({text}, {Q(w)})" for w in words) + ")"
DEC = {"dec": "SELECT DISTINCT ts FROM c1h"}
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
LOW = "lower(title || ' ' || content)"

# Frequent fragments of the test texts for the sentiment lists.
TEST_LISTS = (("tion",), ("the", "ea"), ("zzz", "und"), ("and", "le"))
STATS = "vader_mean vader_std vader_max vader_min bullish_ratio bearish_ratio nlp_score_mean nlp_score_max_abs"


def stats_sql(hours: float, closed: str = "left", shift: float = 0.0) -> str:
    hi = "<=" if closed == "both" else "<"
    return f"""SELECT d.symbol, d.ts, count(a.article_id) AS news_count, coalesce(avg(s), 0) AS vader_mean,
        CASE WHEN count(a.article_id) > 1 THEN stddev_samp(s) ELSE 0 END AS vader_std, coalesce(max(s), 0) AS vader_max,
        coalesce(min(s), 0) AS vader_min, coalesce(avg(CASE WHEN s > 0.1 THEN 1 ELSE 0 END), 0) AS bullish_ratio,
        coalesce(avg(CASE WHEN s < -0.1 THEN 1 ELSE 0 END), 0) AS bearish_ratio, coalesce(avg(s), 0) AS nlp_score_mean,
        coalesce(max(abs(s)), 0) AS nlp_score_max_abs
        FROM c1h d LEFT JOIN (SELECT *, sentiment_score AS s FROM articles) a
        ON a.published_at >= d.ts - INTERVAL {int((hours + shift) * 60)} MINUTE AND a.published_at {hi} d.ts - INTERVAL {int(shift * 60)} MINUTE
        GROUP BY d.symbol, d.ts"""


def _decisions(t):
    return t.candles().select("symbol", "ts")


@query("a04_news_window_stats", sql_with("c1h articles", f"""SELECT symbol, ts, news_count, {Rs(STATS.replace('vader_std ', ''), 9)}, {R('vader_std', 7)} AS vader_std FROM s""", {"s": stats_sql(4)}))
def _(t):
    return rounded(nw.news_window_stats(_decisions(t), t.articles, 4).drop("finbert_mean"), {"vader_std": 7} | {c: 9 for c in STATS.split() if c != "vader_std"})


@query("j02_recent_news", sql_with("c1h articles", f"""SELECT symbol, ts, news_count, {R('vader_mean', 9)} AS news_sentiment FROM s""", {"s": stats_sql(24, "both")}))
def _(t):
    return rounded(nw.recent_news(_decisions(t), t.articles, 24), 9)


@query("j03_window_half_open", sql_with("c1h articles", " UNION ALL ".join(
    f"""SELECT '{h}' AS horizon, dec.ts, count(*) AS n, min(article_id) AS first_id, max(article_id) AS last_id FROM dec JOIN articles
    ON published_at >= dec.ts - INTERVAL {m} MINUTE AND published_at < dec.ts GROUP BY dec.ts""" for h, (m, _) in lx.SELECTION.items()), DEC))
def _(t):
    dec = t.candles().select("ts").distinct()
    out = None
    for h, (minutes, _k) in lx.SELECTION.items():
        pairs = joins.interval_join(dec, t.articles.select("article_id", "published_at"), nw.shift_hours("ts", -minutes / 60),
                                    F.col("ts"), "published_at", closed="left")
        part = pairs.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"),
                                       F.max("article_id").alias("last_id")).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


QUALITY = {
    "fl": f"""SELECT *, trim(title, ' ' || chr(9) || chr(10) || chr(13)) AS tt FROM articles""",
    "fq": f"""SELECT *, length(tt) < {lx.MIN_TITLE} AS short_title, length(content) < {lx.MIN_CONTENT} AS short_content,
        {any_sql('lower(tt)', lx.BAD_TITLES)} AS bad_title FROM fl""",
    "fd": """SELECT *, NOT (short_title OR short_content OR bad_title) AS fine, row_number() OVER (PARTITION BY lower(tt), lower(trim(source)),
        NOT (short_title OR short_content OR bad_title) ORDER BY published_at, article_id) AS copy FROM fq""",
    "quality": "SELECT *, fine AND copy > 1 AS duplicate, fine AND copy = 1 AS keep FROM fd",
}


@query("p09_article_quality", sql_with("articles", "SELECT article_id, short_title, short_content, bad_title, duplicate, keep FROM quality", QUALITY))
def _(t):
    return nw.article_quality(t.articles).select("article_id", "short_title", "short_content", "bad_title", "duplicate", "keep")


@query("p09_quality_report", sql_with("articles", "SELECT count(*) AS total, " + ", ".join(
    f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS {c}" for c in ("short_title", "short_content", "bad_title", "duplicate", "keep")) + " FROM quality", QUALITY))
def _(t):
    return nw.quality_report(nw.article_quality(t.articles))


@query("o07_dedupe_earliest", sql_with("articles", "SELECT lower(tt) AS title_key, source, article_id FROM quality WHERE keep", QUALITY))
def _(t):
    kept = nw.article_quality(t.articles).filter("keep")
    return kept.select(F.lower(tx.strip(F.col("title"))).alias("title_key"), "source", "article_id")


VISIBLE = {**DEC, **QUALITY, "vis": """SELECT * FROM (SELECT dec.ts AS candle_ts, article_id, published_at,
    row_number() OVER (PARTITION BY dec.ts ORDER BY published_at DESC, article_id) AS rank FROM dec JOIN quality
    ON published_at >= dec.ts + INTERVAL 1 HOUR - INTERVAL 24 HOUR AND published_at + INTERVAL 15 MINUTE <= dec.ts + INTERVAL 1 HOUR AND keep)"""}


def _visible(t):
    good = nw.article_quality(t.articles).filter("keep")
    return nw.articles_for_decisions(t.candles(), good)


@query("j04_articles_for_decisions", sql_with("c1h articles", "SELECT candle_ts, article_id, rank FROM vis", VISIBLE))
def _(t):
    return _visible(t).select("candle_ts", "article_id", F.col("rank").cast("bigint").alias("rank"))


@query("w36_recency_rank", sql_with("c1h articles", f"""SELECT candle_ts, article_id,
    {R('(count(*) OVER (PARTITION BY candle_ts) - rank) / greatest(count(*) OVER (PARTITION BY candle_ts) - 1, 1)')} AS rank_norm FROM vis""", VISIBLE))
def _(t):
    return rounded(nw.recency_rank(_visible(t)).select("candle_ts", "article_id", "rank_norm"))


@query("p11_factor_confidence_filter", sql_with("c1h articles factor_probs", """SELECT candle_ts, article_id FROM (
    SELECT v.*, list_max(factors) AS p, max(list_max(factors)) OVER (PARTITION BY candle_ts) AS top,
    row_number() OVER (PARTITION BY candle_ts ORDER BY list_max(factors) DESC NULLS LAST, v.rank) AS best
    FROM vis v LEFT JOIN factor_probs f USING (article_id)) WHERE top IS NULL OR (top >= 0.13 AND p >= 0.13) OR (top < 0.13 AND best = 1)""", VISIBLE))
def _(t):
    return nw.factor_confidence_filter(_visible(t), t.factor_probs, 0.13).select("candle_ts", "article_id")


@query("p22_alignment_gaps", sql_with("articles factor_probs", "SELECT article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM factor_probs)"))
def _(t):
    return nw.alignment_gaps(t.articles, t.factor_probs)


@query("p21_source_coverage", sql_with("articles", f"""SELECT count(*) AS total, count(*) FILTER (trim(coalesce(source, '')) = '') AS blank,
    {R("count(*) FILTER (trim(coalesce(source, '')) = '') / count(*)")} AS blank_ratio,
    count(*) FILTER (trim(coalesce(source, '')) = '') / count(*) > 0.1 AS warn FROM articles"""))
def _(t):
    return rounded(nw.source_coverage(t.articles))


# ------------------------------------------------------------------ relevance and selection


def presence_sql(text: str, words) -> str:
    return f"least(CAST(1 AS DOUBLE), {hits_sql(f'lower({text})', words)} / CAST({max(1.0, 0.1 * len(words))!r} AS DOUBLE))"


def match_sql(text: str, table, default: float) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {Q(k)}) THEN {v!r}" for k, v in table) + f" ELSE {default!r} END"


CRED = match_sql("trim(lower(source))", lx.SOURCE_CREDIBILITY, lx.DEFAULT_CREDIBILITY)


def relevance_sql(age: str, horizon: str, cred: str = "cred", kw: str = "kw") -> str:
    wr, wc, wk, half = lx.RELEVANCE_WEIGHTS[horizon]
    return f"least(1, greatest(0, {wr!r} * exp({-math.log(2) / half!r} * greatest({age}, 0)) + {wc!r} * {cred} + {wk!r} * {kw}))"


def selection_sql(config, h: str) -> str:
    minutes, k = config[h]
    age = "(epoch_us(dec.ts) - epoch_us(published_at)) / 3600000000.0"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_ts ORDER BY relevance DESC, published_at DESC, article_id) AS rank
        FROM (SELECT '{h}' AS horizon, dec.ts AS decision_ts, a.*, {relevance_sql(age, h)} AS relevance FROM dec JOIN
        (SELECT *, CAST({CRED} AS DOUBLE) AS cred, {presence_sql('title', lx.PRICE_KEYWORDS)} AS kw FROM articles) a
        ON published_at >= dec.ts - INTERVAL {minutes} MINUTE AND published_at < dec.ts)) WHERE rank <= {k}"""


for _name, _config, _fn in (("o01_top_k_news", lx.SELECTION, nw.top_k_news), ("o02_candidate_news", lx.CANDIDATES, nw.candidate_news)):
    def _select(t, fn=_fn, config=_config):
        out = None
        for h in config:
            part = fn(t.candles(), t.articles, h).select("decision_ts", "article_id", F.col("rank").cast("bigint").alias("rank"),
                                                          rd("relevance").alias("relevance")).withColumn("horizon", F.lit(h))
            out = part if out is None else out.unionByName(part)
        return out
    query(_name, sql_with("c1h articles", " UNION ALL ".join(
        f"SELECT horizon, decision_ts, article_id, rank, {R('relevance')} AS relevance FROM ({selection_sql(_config, h)})" for h in _config), DEC))(_select)


SEL = ("selected_news_count top1_sentiment top3_avg_sentiment max_sentiment_strength weighted_sentiment selected_distinct_sources "
       "selected_avg_title_len selected_avg_content_len selected_avg_relevance").split()


@query("a05_selected_news_stats", sql_with("c1h articles", "SELECT dec.ts, coalesce(n, 0) AS selected_news_count, coalesce(src, 0) AS selected_distinct_sources, "
    + ", ".join(f"{R(f'coalesce({c}, 0)')} AS {c}" for c in SEL if c not in ("selected_news_count", "selected_distinct_sources"))
    + " FROM dec LEFT JOIN g ON g.decision_ts = dec.ts", {**DEC, "sel": selection_sql(lx.SELECTION, "4h"), "g": """SELECT decision_ts, count(*) AS n,
    arg_min(sentiment_score, rank) AS top1_sentiment, avg(sentiment_score) AS top3_avg_sentiment, max(abs(sentiment_score)) AS max_sentiment_strength,
    CASE WHEN sum(relevance) > 0 THEN sum(sentiment_score * relevance) / sum(relevance) ELSE avg(sentiment_score) END AS weighted_sentiment,
    count(DISTINCT source) AS src, avg(length(title)) AS selected_avg_title_len, avg(length(content)) AS selected_avg_content_len,
    avg(relevance) AS selected_avg_relevance FROM sel GROUP BY decision_ts"""}))
def _(t):
    dec = t.candles().select("ts").distinct()
    return rounded(nw.selected_news_stats(dec, nw.top_k_news(dec, t.articles, "4h"), t.articles))


@query("f13_f14_relevance", sql_with("articles", " UNION ALL ".join(
    f"""SELECT '{h}' AS horizon, article_id, {R(relevance_sql(f'(epoch_us({NOW}) - epoch_us(published_at)) / 3600000000.0', h, f'CAST({CRED} AS DOUBLE)', presence_sql('title', lx.PRICE_KEYWORDS)))} AS relevance
    FROM articles""" for h in lx.RELEVANCE_WEIGHTS)))
def _(t):
    age = (F.lit(1706659200) - F.unix_seconds("published_at")) / 3600.0
    parts = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), tx.relevance(
        tx.recency(age, lx.RELEVANCE_WEIGHTS[h][3]), tx.source_credibility(F.col("source")), tx.keyword_presence(F.col("title")), h).alias("relevance"))
        for h in lx.RELEVANCE_WEIGHTS]))
    return rounded(t.articles.select("article_id", parts.alias("p")).select("article_id", "p.*"))


@query("j14_source_credibility", sql_with("articles", f"""SELECT article_id, CAST({CRED} AS DOUBLE) AS credibility,
    CAST({match_sql('source', (('src1', .95), ('src2', .9), ('src3', .85)), .5)} AS DOUBLE) AS test_credibility FROM articles"""))
def _(t):
    return t.articles.select("article_id", tx.source_credibility(F.col("source")).alias("credibility"),
                             tx.source_credibility(F.col("source"), (("src1", .95), ("src2", .9), ("src3", .85))).alias("test_credibility"))


@query("a14_credibility_map", sql_with("articles", f"""SELECT p.source, p.n, {R(f'''CASE WHEN {any_sql("p.source", lx.TIER_ONE)} THEN 0.9
    WHEN {any_sql("p.source", lx.TIER_TWO)} THEN 0.7 ELSE least(0.6, 0.6 * ln(1 + n) / ln(1 + max(n) OVER ()) + 0.4 * least(1, ml / max(ml) OVER ())) END''')} AS credibility
    FROM p""", {"p": "SELECT lower(trim(source)) AS source, count(*) AS n, avg(length(content)) AS ml FROM articles GROUP BY 1"}))
def _(t):
    return rounded(nw.credibility_map(t.articles))


# ------------------------------------------------------------------ lists, timelines, statistics


@query("a06_news_timeline", sql_with("articles", """SELECT time_bucket(INTERVAL 4 HOUR, published_at) AS bucket, count(*) AS count,
    """ + R("avg(sentiment_score)", 9) + """ AS average_sentiment, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY published_at, article_id) FILTER (r <= 5) AS articles
    FROM (SELECT *, row_number() OVER (PARTITION BY time_bucket(INTERVAL 4 HOUR, published_at) ORDER BY published_at, article_id) AS r FROM articles) GROUP BY 1"""))
def _(t):
    tl = nw.news_timeline(t.articles, "4h")
    return rounded(tl.withColumn("articles", F.array_join(F.transform("articles", lambda x: x["article_id"].cast("string")), ",")), 9)


TIMELINE = {
    "tl": """SELECT time_bucket(INTERVAL 1 HOUR, published_at) AS bucket, count(*) AS n, avg(sentiment_score) AS s FROM articles GROUP BY 1""",
    "tg": "SELECT *, (rn - 1) // g AS grp, (rn - 1) % g AS place FROM (SELECT *, row_number() OVER (ORDER BY bucket) AS rn, CAST(ceil(count(*) OVER () / 100) AS BIGINT) AS g FROM tl)",
}


@query("a07_downsample_timeline", sql_with("articles", f"""SELECT CAST(sum(n) AS BIGINT) AS count, {R('sum(s * n) / sum(n)', 9)} AS average_sentiment,
    (list(bucket ORDER BY place))[count(*) // 2 + 1] AS time FROM tg GROUP BY grp""", TIMELINE))
def _(t):
    return rounded(nw.downsample_timeline(nw.news_timeline(t.articles, "1h")).select("count", "average_sentiment", "time"), 9)


@query("a08_news_stats", sql_with("articles", """SELECT count(*) AS total, count(*) FILTER (sentiment_score > 0.1) AS positive,
    count(*) FILTER (sentiment_score < -0.1) AS negative, count(*) FILTER (sentiment_score BETWEEN -0.1 AND 0.1) AS neutral,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(published_at) AS newest, min(published_at) AS oldest FROM articles"""))
def _(t):
    return nw.news_stats(t.articles)


@query("p02_query_news", sql_with("articles", """SELECT article_id, source, published_at FROM articles WHERE published_at >= TIMESTAMP '2024-01-05'
    AND published_at <= TIMESTAMP '2024-01-25' AND source = 'src3' ORDER BY published_at DESC, article_id LIMIT 20 OFFSET 5"""))
def _(t):
    return nw.query_news(t.articles, "2024-01-05", "2024-01-25", "src3", 20, 5).select("article_id", "source", "published_at")


@query("p03_search_news", sql_with("articles", """SELECT article_id, source, sentiment_score FROM articles
    WHERE contains(lower(title || ' ' || source), 'the') AND sentiment_score > 0.1"""))
def _(t):
    return nw.search_news(t.articles, " The ", "positive").select("article_id", "source", "sentiment_score")


@query("p04_sentiment_bucket", sql_with("articles", """SELECT article_id, CASE WHEN sentiment_score > 0.1 THEN 'positive'
    WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS bucket FROM articles"""))
def _(t):
    return t.articles.select("article_id", tx.sentiment_bucket(F.col("sentiment_score")).alias("bucket"))


@query("p10_topic_filter", sql_with("articles", f"""SELECT article_id, 'topic' AS list FROM articles WHERE {any_sql('lower(title)', lx.TOPIC_KEYWORDS)} OR {any_sql('lower(content)', lx.TOPIC_KEYWORDS)}
    UNION ALL SELECT article_id, 'test' FROM articles WHERE {any_sql('lower(title)', ('tionth', 'zur'))} OR {any_sql('lower(content)', ('tionth', 'zur'))}"""))
def _(t):
    one = nw.topic_filter(t.articles).select("article_id", F.lit("topic").alias("list"))
    return one.unionByName(nw.topic_filter(t.articles, ("tionth", "zur")).select("article_id", F.lit("test").alias("list")))


RAW_JSON = """CASE WHEN article_id % 5 = 0 THEN NULL WHEN article_id % 5 = 1 THEN '{"symbols":["BTCUSDT","' || upper(source) || '"]}'
    WHEN article_id % 5 = 2 THEN '{"symbols":["ALL"]}' WHEN article_id % 5 = 3 THEN '{"coins":["' || upper(source) || '"],"tag":"x-' || source || '"}'
    ELSE '{"origin":"new.json","tag":"' || lang || '"}' END"""


@query("p08_news_for_symbol", sql_with("articles", f"""SELECT article_id FROM (SELECT *, {RAW_JSON} AS raw FROM articles) WHERE raw IS NULL
    OR contains(raw, '"SRC3"') OR contains(raw, '"ALL"') OR contains(lower(regexp_extract(raw, '"tag":"([^"]*)"', 1)), 'src3')"""))
def _(t):
    return nw.news_for_symbol(t.articles.withColumn("raw_score", F.expr(RAW_JSON)), "SRC3").select("article_id")


@query("o06_distinct_on", sql_with("articles", """SELECT 'time_url' AS key, min(article_id) AS article_id, url FROM articles GROUP BY published_at, url
    UNION ALL SELECT 'url', arg_max(article_id, published_at), url FROM articles GROUP BY url"""))
def _(t):
    from candela.operators.candles import dedupe_earliest, dedupe_latest
    a = t.articles.select("article_id", "url", "published_at")
    first = dedupe_earliest(a, ["published_at", "url"], "article_id").select(F.lit("time_url").alias("key"), "article_id", "url")
    return first.unionByName(dedupe_latest(a, ["url"], "published_at").select(F.lit("url").alias("key"), "article_id", "url"))


@query("o08_merge_news", sql_with("articles", """SELECT arg_min(article_id, (p, -epoch_us(published_at), article_id)) AS article_id, url FROM (
    SELECT *, 0 AS p FROM articles WHERE lang = 'en' UNION ALL SELECT *, 1 AS p FROM articles WHERE lang <> 'de') GROUP BY url"""))
def _(t):
    return nw.merge_news(t.articles.filter("lang = 'en'"), t.articles.filter("lang <> 'de'")).select("article_id", "url")


# ------------------------------------------------------------------ tokens, TF-IDF, novelty

TOK = {
    "tok": f"""SELECT article_id, published_at, w FROM (SELECT article_id, published_at,
        unnest(list_transform(regexp_extract_all(title, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w FROM articles)
        WHERE length(w) > 1 AND w NOT IN ({', '.join(Q(s) for s in lx.STOP_WORDS)})""",
    "tf": "SELECT article_id, w, count(*) AS tf FROM tok GROUP BY article_id, w",
    "idf": "SELECT w, count(*) AS df, ln((SELECT count(*) FROM articles) / count(*)) AS idf FROM tf GROUP BY w HAVING count(*) >= 2",
    "vec": "SELECT article_id, w, (1 + ln(tf)) * idf AS weight FROM tf JOIN idf USING (w)",
    "nrm": "SELECT article_id, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY article_id",
    "sim": """SELECT a.article_id, max(s) AS s FROM (SELECT x.article_id, y.article_id AS other, sum(x.weight * y.weight) AS dot FROM vec x JOIN vec y USING (w)
        JOIN articles p ON p.article_id = x.article_id JOIN articles q ON q.article_id = y.article_id
        WHERE (q.published_at, q.article_id) < (p.published_at, p.article_id) AND q.published_at >= p.published_at - INTERVAL 24 HOUR
        GROUP BY x.article_id, y.article_id) a JOIN nrm n1 ON n1.article_id = a.article_id JOIN nrm n2 ON n2.article_id = a.other,
        LATERAL (SELECT CASE WHEN n1.norm > 0 AND n2.norm > 0 THEN dot / (n1.norm * n2.norm) ELSE 0 END AS s) GROUP BY a.article_id""",
}


@query("f01_tokens", sql_with("articles", "SELECT article_id, w AS token, tf FROM tf", TOK))
def _(t):
    return nw.token_rows(t.articles)


@query("f01_tokens_content", sql_with("", f"""SELECT doc_id AS article_id, count(*) AS n, count(DISTINCT w) AS kinds FROM (SELECT doc_id,
    unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w FROM documents)
    WHERE length(w) > 1 AND w NOT IN ({', '.join(Q(s) for s in lx.STOP_WORDS)}) GROUP BY doc_id"""))
def _(t):
    words = t.articles.select("article_id", tx.tokens(F.col("content")).alias("w"))
    return words.filter("size(w) > 0").select("article_id", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds"))


@query("a12_idf", sql_with("articles", f"SELECT w AS token, df, {R('idf')} AS idf FROM idf", TOK))
def _(t):
    return rounded(nw.idf(nw.token_rows(t.articles), t.articles))


@query("a13_tfidf_norms", sql_with("articles", f"SELECT article_id, {R('norm')} AS norm FROM nrm", TOK))
def _(t):
    rows = nw.token_rows(t.articles)
    return rounded(nw.tfidf_norms(nw.tfidf(rows, nw.idf(rows, t.articles))))


NOVELTY_SQL = sql_with("articles", f"SELECT article_id, {R('coalesce(s, 0)')} AS similarity, {R('1 - coalesce(s, 0)')} AS novelty FROM articles LEFT JOIN sim USING (article_id)", TOK)


@query("f42_novelty", NOVELTY_SQL)
def _(t):
    return rounded(nw.novelty(t.articles))


NOVELTY_BODY = f"SELECT article_id, {R('coalesce(s, 0)')} AS similarity, {R('1 - coalesce(s, 0)')} AS novelty FROM articles LEFT JOIN sim USING (article_id)"
TOK_OF = lambda text: {k: v.replace("regexp_extract_all(title", f"regexp_extract_all({text}") for k, v in TOK.items()}


@query("f42_novelty_content", sql_with("articles", NOVELTY_BODY, TOK_OF("content")))
def _(t):
    return rounded(nw.novelty(t.articles, column="content"))


@query("f42_novelty_title_and_content", sql_with("articles", NOVELTY_BODY, TOK_OF("title || ' ' || content")))
def _(t):
    return rounded(nw.novelty(t.articles.withColumn("both", F.concat_ws(" ", "title", "content")), column="both"))


@query("j13_similarity_join", sql_with("articles", f"SELECT article_id, {R('coalesce(s, 0)')} AS similarity FROM articles LEFT JOIN sim USING (article_id)", TOK))
def _(t):
    return rounded(nw.similarity_join(t.articles.select("article_id", "title", "published_at")))


# ------------------------------------------------------------------ keyword and factor scores


@query("f03_keyword_presence", sql_with("articles", f"SELECT article_id, {R(presence_sql('content', lx.PRICE_KEYWORDS))} AS score, {R(presence_sql('content', ('tion', 'the', 'zzz')))} AS test_score FROM articles"))
def _(t):
    return rounded(t.articles.select("article_id", tx.keyword_presence(F.col("content")).alias("score"),
                                     tx.keyword_presence(F.col("content"), ("tion", "the", "zzz")).alias("test_score")))


COMBINED = "lower(title) || ' ' || lower(title) || ' ' || lower(title) || ' ' || lower(content)"


def counts_sql(ontology) -> str:
    one = lambda k: f"(length(x) - length(replace(x, {Q(k)}, ''))) / CAST({len(k)} AS DOUBLE)"
    return "[" + ", ".join("(" + " + ".join(one(k) for k in ws) + ")" for ws in ontology.values()) + "]"


def prior_sql(n: int) -> str:
    def arr(boosts):
        base = [1.0 / n + boosts.get(i, 0.0) for i in range(n)]
        return "[" + ", ".join(f"CAST({b / sum(base)!r} AS DOUBLE)" for b in base) + "]"
    return "CASE " + " ".join(f"WHEN contains(lower(source), {Q(k)}) THEN {arr(b)}" for k, b in lx.SOURCE_PRIORS) + f" ELSE {arr({})} END"


def factor_ctes(ontology) -> dict[str, str]:
    n = len(ontology)
    soft = _softmax("list_transform(sc, lambda x: x / 0.5)")
    return {
        "fs": f"SELECT article_id, source, x, {counts_sql(ontology)} AS sc, {prior_sql(n)} AS prior FROM (SELECT *, {COMBINED} AS x FROM articles)",
        "fw": f"SELECT *, list_sum(sc) AS st, {soft} AS sp, CASE WHEN list_sum(sc) <= 2 THEN 0.18 WHEN list_sum(sc) <= 5 THEN 0.10 ELSE 0.05 END AS pw FROM fs",
        "fm": "SELECT *, list_transform(list_zip(sp, prior), lambda z: (1 - pw) * z[1] + pw * z[2]) AS mixed FROM fw",
        "fp": "SELECT article_id, sc, st, CASE WHEN st <= 0 THEN prior ELSE list_transform(mixed, lambda x: x / list_sum(mixed)) END AS p FROM fm",
    }


REF, TST = factor_ctes(lx.FACTORS), factor_ctes(lx.TEST_FACTORS)
ARR = lambda e, n, p: ", ".join(f"{R(f'{e}[{i + 1}]')} AS {p}{i}" for i in range(n))


def _spread(df, col: str, n: int, prefix: str, digits: int = 6):
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, *[rd(F.col(col)[i], digits).alias(f"{prefix}{i}") for i in range(n)])


@query("f04_keyword_counts", sql_with("articles", f"SELECT article_id, {ARR('sc', 10, 'k')} FROM fs", {"fs": REF["fs"]}))
def _(t):
    return _spread(t.articles.select("article_id", tx.keyword_counts(F.col("title"), F.col("content")).alias("c")), "c", 10, "k")


@query("f04_keyword_counts_test", sql_with("articles", f"SELECT article_id, {ARR('sc', 5, 'k')} FROM fs", {"fs": TST["fs"]}))
def _(t):
    return _spread(t.articles.select("article_id", tx.keyword_counts(F.col("title"), F.col("content"), lx.TEST_FACTORS).alias("c")), "c", 5, "k")


@query("f06_factor_distribution", sql_with("articles", f"SELECT article_id, {ARR('p', 10, 'p')} FROM fp", REF))
def _(t):
    return _spread(t.articles.select("article_id", tx.factor_distribution(F.col("title"), F.col("content"), F.col("source")).alias("p")), "p", 10, "p")


@query("f05_softmax", sql_with("e64", f"SELECT vec_id AS article_id, {ARR('s', 10, 'p')} FROM (SELECT vec_id, {_softmax('list_transform(e[9:18], lambda x: x / 0.5)')} AS s FROM e64)"))
def _(t):
    x = F.transform(F.slice("embedding", 9, 10), lambda v: v.cast("double"))
    return _spread(t.raw("embeddings").select(F.col("vec_id").alias("article_id"), ar.softmax(x, 0.5).alias("p")), "p", 10, "p")


SOFT = {
    "sh": f"SELECT vec_id AS article_id, {_softmax('list_transform(e[9:18], lambda x: x * 40)')} AS p FROM e64",
    "so": """SELECT article_id, p, list_max(p) AS top, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-8)))) AS ent,
        least(0.12, greatest(0, (list_max(p) - 0.97) / greatest(list_max(p) - 0.1, 1e-6))) AS mix FROM (
        SELECT article_id, list_transform(q, lambda x: x / list_sum(q)) AS p FROM (SELECT article_id, list_transform(p, lambda x: least(1, greatest(x, 1e-8))) AS q FROM sh))""",
    "sr": """SELECT article_id, CASE WHEN top <= 0.97 AND ent >= 0.12 THEN p ELSE list_transform(b, lambda x: x / list_sum(b)) END AS r FROM (
        SELECT *, list_transform(p, lambda x: (1 - mix) * x + mix * 0.1) AS b FROM so)""",
}


@query("f07_soften_factors", sql_with("e64", f"SELECT article_id, {ARR('r', 10, 'p')} FROM sr", SOFT))
def _(t):
    x = F.transform(F.slice("embedding", 9, 10), lambda v: v.cast("double") * 40)
    rows = t.raw("embeddings").select(F.col("vec_id").alias("article_id"), ar.softmax(x).alias("s"))
    return _spread(rows.select("article_id", tx.soften_factors(F.col("s")).alias("p")), "p", 10, "p")


def shares_sql(ontology, default: int) -> str:
    h = "[" + ", ".join(f"CAST({hits_sql('x', w)} AS DOUBLE)" for w in ontology.values()) + "]"
    d = "[" + ", ".join(f"CAST({1 if i == default else 0} AS DOUBLE)" for i in range(len(ontology))) + "]"
    return f"SELECT article_id, CASE WHEN list_sum(h) = 0 THEN {d} ELSE list_transform(h, lambda v: v / list_sum(h)) END AS p FROM (SELECT article_id, {h} AS h FROM (SELECT article_id, lower(title) AS x FROM articles))"


@query("f08_factor_shares", sql_with("articles", f"SELECT article_id, {ARR('p', 10, 'p')} FROM s", {"s": shares_sql(lx.FACTORS, lx.DEFAULT_FACTOR)}))
def _(t):
    return _spread(t.articles.select("article_id", tx.factor_shares(F.col("title")).alias("p")), "p", 10, "p")


@query("f08_factor_shares_test", sql_with("articles", f"SELECT article_id, {ARR('p', 5, 'p')} FROM s", {"s": shares_sql(lx.TEST_FACTORS, 4)}))
def _(t):
    return _spread(t.articles.select("article_id", tx.factor_shares(F.col("title"), lx.TEST_FACTORS, 4).alias("p")), "p", 5, "p")


@query("f09_blend_labels", sql_with("articles factor_probs", f"""SELECT article_id, {ARR('b', 10, 'p')} FROM (SELECT article_id,
    CASE WHEN list_max(factors) >= 0.13 THEN factors ELSE p END AS b FROM fp JOIN factor_probs USING (article_id))""", REF))
def _(t):
    kw = t.articles.select("article_id", tx.factor_distribution(F.col("title"), F.col("content"), F.col("source")).alias("a"))
    rows = kw.join(t.factor_probs, ["article_id"])
    return _spread(rows.select("article_id", tx.blend_labels(F.col("a"), F.col("factors"), 0.13).alias("b")), "b", 10, "p")


@query("a15_factor_label_stats", sql_with("articles", f"""SELECT count(*) AS total, {R('avg(CAST(st > 0 AS INTEGER))')} AS matched_share,
    {R('avg(CAST(list_max(p) > 0.4 AS INTEGER))')} AS dominant_share, {R('avg(list_max(p))')} AS mean_max_prob, {R('median(list_max(p))')} AS median_max_prob,
    {R('avg(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))))')} AS mean_entropy, """ + ", ".join(
    f"count(*) FILTER (list_position(p, list_max(p)) = {i + 1}) AS top{i}" for i in range(5)) + " FROM fp", TST))
def _(t):
    from candela.operators.dataset import factor_label_stats
    rows = t.articles.select("article_id", tx.keyword_counts(F.col("title"), F.col("content"), lx.TEST_FACTORS).alias("sc"), "source")
    rows = rows.select("article_id", "sc", tx.blend_with_prior(F.col("sc"), tx.source_prior(F.col("source"), 5)).alias("factors"))
    return rounded(factor_label_stats(rows.withColumn("matched", ar.total(F.col("sc")) > 0), 5))


# ------------------------------------------------------------------ sentences and sentiment

SENT = {
    "snt": """SELECT article_id, unnest(list_filter(list_transform(string_split(regexp_replace(trim(content, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 15)) AS s FROM articles"""}


@query("f02_sentences", sql_with("articles", "SELECT article_id, count(*) AS n, max(length(s)) AS longest, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM snt GROUP BY article_id", SENT))
def _(t):
    rows = t.articles.select("article_id", tx.sentences(F.col("content")).alias("s")).filter("size(s) > 0")
    return rows.select("article_id", F.size("s").cast("bigint").alias("n"), F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"),
                       F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


def split_sql(col: str) -> str:
    ws = "' ' || chr(9) || chr(10) || chr(13)"
    return (f"list_filter(list_transform(string_split(regexp_replace(trim({col}, {ws}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda x: trim(x, {ws})), lambda x: length(x) > 15)")


def factor_sentence_ctes(ontology) -> dict[str, str]:
    cases = " UNION ALL ".join(
        f"SELECT article_id, {i} AS f, list_filter(al, lambda s: {any_sql('lower(s)', ws)}) AS m FROM al" for i, ws in enumerate(ontology.values()))
    return {"al": f"SELECT article_id, list_concat(list_concat(list_concat({split_sql('title')}, {split_sql('title')}), {split_sql('title')}), {split_sql('content')}) AS al FROM articles",
            "fsn": cases}


FSN = factor_sentence_ctes(lx.TEST_FACTORS)


@query("f27_factor_sentences", sql_with("articles", "SELECT article_id, f AS factor, CAST(len(m) AS INTEGER) AS n, md5(array_to_string(m, '|')) AS digest FROM fsn WHERE len(m) > 0", FSN))
def _(t):
    from candela.operators.dataset import factor_sentence_rows
    rows = factor_sentence_rows(t.articles, lx.TEST_FACTORS)
    return rows.select("article_id", "factor", F.size("matched").alias("n"), F.md5(F.array_join("matched", "|")).alias("digest"))


def sentiment_sql(low: str, lists) -> str:
    vp, p, vn, n = lists
    pos, neg = f"(2 * {hits_sql(low, vp)} + {hits_sql(low, p)})", f"(2 * {hits_sql(low, vn)} + {hits_sql(low, n)})"
    return f"CASE WHEN {pos} + {neg} = 0 THEN 0 ELSE ({pos} - {neg}) / CAST({pos} + {neg} AS DOUBLE) * 0.8 END"


REF_LISTS = (lx.VERY_POSITIVE, lx.POSITIVE, lx.VERY_NEGATIVE, lx.NEGATIVE)
for _name, _lists in (("", REF_LISTS), ("_test", TEST_LISTS)):
    query(f"f10_lexicon_sentiment{_name}", sql_with("articles", f"""SELECT article_id, CASE WHEN r >= 0.3 THEN 'Positive' WHEN r <= -0.3 THEN 'Negative' ELSE 'Neutral' END AS label,
        {R('r', 2)} AS score FROM (SELECT article_id, {sentiment_sql('x', _lists)} AS r FROM (SELECT article_id, {LOW} AS x FROM articles))"""))(
        lambda t, ls=_lists: t.articles.select("article_id", tx.lexicon_sentiment(F.concat_ws(" ", "title", "content"), ls).alias("s")).select(
            "article_id", "s.label", rd("s.score", 2).alias("score")))


@query("f28_entity_sentiment", sql_with("articles", f"""SELECT article_id, f AS factor, {R('least(1, greatest(-1, avg(greatest(v, 0)) - avg(greatest(-v, 0))))')} AS sentiment FROM (
    SELECT article_id, f, {sentiment_sql('lower(s)', TEST_LISTS)} AS v FROM (SELECT article_id, f, unnest(m) AS s FROM fsn WHERE len(m) > 0)) GROUP BY article_id, f""", FSN))
def _(t):
    from candela.operators.dataset import entity_sentiment
    rows = entity_sentiment(t.articles, lambda c: tx.lexicon_sentiment_raw(c, TEST_LISTS), lx.TEST_FACTORS, long=True)
    return rounded(rows)


@query("f11_lexicon_relevance", sql_with("articles", f"""SELECT article_id, {R('r', 2)} AS relevance, CASE WHEN r >= 0.5 THEN 'Crypto' WHEN r >= 0.4 THEN 'Finance' ELSE 'General' END AS category
    FROM (SELECT article_id, least(1, round(0.2 + 0.3 * {hits_sql('x', lx.HIGH_IMPACT_WORDS)} + 0.1 * {hits_sql('x', lx.CRYPTO_WORDS)}, 2)) AS r FROM (SELECT article_id, {LOW} AS x FROM articles))"""))
def _(t):
    return t.articles.select("article_id", rd(tx.lexicon_relevance(F.concat_ws(" ", "title", "content")), 2).alias("relevance")).withColumn(
        "category", tx.relevance_category(F.col("relevance")))


def tags_sql() -> str:
    table: dict[str, list[str]] = {}
    for w, s in lx.SYMBOL_WORDS:
        table.setdefault(s, []).append(w)
    sub = ", ".join(f"CASE WHEN {any_sql('x', ws)} THEN {Q(s)} END" for s, ws in table.items())
    words = ", ".join(f"CASE WHEN regexp_matches(raw, '(?i)" + "|".join(rf"\b{n}\b" for n in names) + "') OR regexp_matches(raw, '" + "|".join(rf"\b{k}\b" for k in ticks) + f"') THEN {Q(s)} END"
                      for s, names, ticks in lx.SYMBOL_PATTERNS)
    pick = lambda a: f"array_to_string(list_sort(list_filter([{a}], lambda v: v IS NOT NULL)), ',')"
    return f"""SELECT article_id, coalesce(nullif({pick(sub)}, ''), 'BTCUSDT') AS tags, coalesce(nullif({pick(words)}, ''), 'ALL') AS word_tags
        FROM (SELECT article_id, {LOW} AS x, title || ' ' || content AS raw FROM articles)"""


@query("f12_symbol_tags", sql_with("articles", tags_sql()))
def _(t):
    text = F.concat_ws(" ", "title", "content")
    return t.articles.select("article_id", F.array_join(tx.symbol_tags(text), ",").alias("tags"), F.array_join(tx.symbol_tags(text, "words"), ",").alias("word_tags"))


@query("f17_combined_sentiment", sql_with("articles e64", f"""SELECT article_id, {R('v')} AS vader, {R('0.3 * v + 0.7 * e[1]')} AS finbert, {R('0.5 * v + 0.5 * e[2]')} AS bart,
    {R('0.2 * v + 0.5 * e[1] + 0.3 * e[2]')} AS every FROM (SELECT article_id, sentiment_score AS v, e FROM articles JOIN e64 ON vec_id = article_id)"""))
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding")[0].cast("double").alias("f"), F.col("embedding")[1].cast("double").alias("b"))
    v, f, b = F.col("sentiment_score"), F.col("f"), F.col("b")
    return rounded(t.articles.join(e, ["article_id"]).select("article_id", tx.combined_sentiment(v).alias("vader"), tx.combined_sentiment(v, f).alias("finbert"),
                                                             tx.combined_sentiment(v, bullish=b).alias("bart"), tx.combined_sentiment(v, f, b).alias("every")))


@query("f15_article_meta", sql_with("c1h articles entity_sentiment", f"""SELECT candle_ts, article_id, {R('least(1, greatest(0, 1 - age / 24))')} AS m0,
    {R('least(1, length(content) / CAST(500 AS DOUBLE))')} AS m1, {R('0.3')} AS m2, {R('rank_norm')} AS m3, {R('coalesce(entity[1], 0)')} AS m4, {R('coalesce(entity[10], 0)')} AS m13 FROM (
    SELECT vis.*, content, entity, (epoch_us(candle_ts + INTERVAL 1 HOUR) - epoch_us(vis.published_at)) / 3600000000.0 AS age,
    (count(*) OVER (PARTITION BY candle_ts) - rank) / greatest(count(*) OVER (PARTITION BY candle_ts) - 1, 1) AS rank_norm
    FROM vis JOIN articles USING (article_id) LEFT JOIN entity_sentiment USING (article_id))""", VISIBLE))
def _(t):
    rows = nw.recency_rank(_visible(t)).join(t.articles.select("article_id", "content"), ["article_id"]).join(t.entity_sentiment, ["article_id"], "left")
    age = (F.unix_micros("decision_ts") - F.unix_micros("published_at")) / 3.6e9
    meta = tx.article_meta(age, F.col("content"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("rank_norm"), F.col("entity"))
    rows = rows.select("candle_ts", "article_id", meta.alias("m"))
    return rows.select("candle_ts", "article_id", *[rd(F.col("m")[i]).alias(f"m{i}") for i in (0, 1, 2, 3, 4, 13)])


@query("f16_article_meta_live", sql_with("articles", f"""SELECT article_id, {R('exp(-greatest(age, 0) / 25)')} AS m0, {R('least(1, length(content) / CAST(2000 AS DOUBLE))')} AS m1,
    {R('0.3')} AS m2, {R('least(1, abs(sentiment_score))')} AS m3 FROM (SELECT *, (epoch_us({NOW}) - epoch_us(published_at)) / 3600000000.0 AS age FROM articles)"""))
def _(t):
    age = (F.lit(1706659200) - F.unix_seconds("published_at")) / 3600.0
    rows = t.articles.select("article_id", tx.article_meta_live(age, F.col("content"), F.col("source"), F.col("sentiment_score"), 24).alias("m"))
    return _spread(rows, "m", 4, "m")


@query("f29_l2_normalize", sql_with("e64", f"SELECT vec_id, {R('sqrt(list_sum(list_transform(n, lambda x: x * x)))')} AS norm, {ARR('n', 4, 'n')} FROM (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-8)) AS n FROM e64)"))
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.raw("embeddings").select("vec_id", ar.l2_normalize(v).alias("n"))
    return rows.select("vec_id", rd(ar.l2_norm(F.col("n"))).alias("norm"), *[rd(F.col("n")[i]).alias(f"n{i}") for i in range(4)])


@query("w23_news_lags", sql_with("c1h articles", "SELECT symbol, ts, " + ", ".join(
    f"{R(f'lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY ts)')} AS {c}_lag{k}" for c in ("vader_mean", "bullish_ratio") for k in (1, 2, 3)) + " FROM s", {"s": stats_sql(1)}))
def _(t):
    df = nw.news_window_stats(t.indexed().select("symbol", "ts", "rn"), t.articles, 1)
    df = ind.news_lags(df, ("vader_mean", "bullish_ratio"))
    return rounded(df.select("symbol", "ts", *[f"{c}_lag{k}" for c in ("vader_mean", "bullish_ratio") for k in (1, 2, 3)]))


@query("w23_news_lags_live", sql_with("c1h articles", f"SELECT symbol, ts, {R('vader_mean')} AS vader_mean_lag2, {R('bearish_ratio')} AS bearish_ratio_lag2 FROM s", {"s": stats_sql(1, shift=2)}))
def _(t):
    df = nw.news_window_stats(_decisions(t), t.articles, 1, lag_hours=2)
    return rounded(df.select("symbol", "ts", F.col("vader_mean").alias("vader_mean_lag2"), F.col("bearish_ratio").alias("bearish_ratio_lag2")))
