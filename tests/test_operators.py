"""Hand-written rows and brute-force comparisons on small random data."""

import datetime as dt
import gc
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import decisions as dc, text as tx
from candela.operators import backtest as bt, candles as cd, dataset as ds, indicators as ind, joins, metrics as mt, news as nw
from candela.operators.ordering import blocked, candle_index, exact_quantiles, ordered_index, running
from candela.operators.scan import Scan, affine_scan
from candela.sources import files, messages as ms, pages as pg
from candela.streaming import jobs, logs

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def bars(spark, closes, symbol="x", volume=1.0, gaps=()):
    rows, t = [], T0
    for i, c in enumerate(closes):
        rows.append((symbol, t, float(c), float(c) + 1, float(c) - 1, float(c), float(volume)))
        t += HOUR * (1 + (i in gaps) * 7)
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    rnd = random.Random(seed)
    out, x = [], 100.0
    for _ in range(n):
        x = max(1.0, x + rnd.uniform(-3, 3))
        out.append(round(x, 2))
    return out


# ------------------------------------------------------------------ ordering


def test_ordered_index_with_one_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 5000).alias("v"), F.when(F.col("id") < 4000, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    rows = ordered_index(df, ["v"], ["k"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append((r.v, r.rn))
    for values in by.values():
        assert [rn for _, rn in sorted(values)] == list(range(1, len(values) + 1))


def test_candle_index_with_gaps_and_small_chunks(spark):
    df = candle_index(bars(spark, walk(60), gaps=(5, 17, 40)), "1h", chunk=8)
    assert [r.rn for r in df.orderBy("ts").collect()] == list(range(1, 61))


@pytest.mark.parametrize("block", [4, 7, 64])
def test_blocked_frames_equal_plain_windows(spark, block):
    df = candle_index(bars(spark, walk(50)), "1h")
    got = blocked(df, 3, lambda d, w: d.withColumns({"s": F.sum("close").over(w.rowsBetween(-3, 0)), "n": F.lead("close", 2).over(w)}), block=block, ahead=2)
    rows = got.orderBy("ts").collect()
    closes = [r.close for r in rows]
    for i, r in enumerate(rows):
        assert math.isclose(r.s, sum(closes[max(0, i - 3):i + 1]))
        assert r.n == (closes[i + 2] if i + 2 < len(closes) else None)


def test_running_with_small_blocks(spark):
    values = [3, 1, None, 7, 2, None, None, 9, 4, 5]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "rn bigint, v int")
    rows = running(df, {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, block=3).orderBy("rn").collect()
    total, top, last = 0, None, None
    for r, v in zip(rows, values):
        if v is not None:
            total, top, last = total + v, v if top is None else max(top, v), v
        assert (r.s, r.m, r.l) == (total, top, last)


def test_exact_quantiles_match_interpolation(spark):
    xs = [5.0, 1.0, 9.0, 9.0, 2.5, 7.0]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    got = exact_quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    s = sorted(xs)
    for p, g in zip((0.25, 0.5, 0.9), got):
        at = p * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        assert math.isclose(g, lo + (hi - lo) * (at - math.floor(at)))


@pytest.mark.parametrize("decay", [1 / 3, 0.9, 0.99])
def test_affine_scan_equals_recursion_over_many_blocks(spark, decay):
    xs = walk(900, 3)
    df = spark.createDataFrame([("k", i + 1, x - 100) for i, x in enumerate(xs)], "symbol string, rn bigint, b double")
    rows = affine_scan(df, [Scan("y", decay, F.when(F.col("rn") >= 3, F.col("b")))]).orderBy("rn").collect()
    y = None
    for r in rows:
        if r.rn < 3:
            assert r.y is None
            continue
        y = r.b if y is None else decay * y + r.b
        assert math.isclose(r.y, y, rel_tol=1e-9, abs_tol=1e-9)


# ------------------------------------------------------------------ joins


def _times(n, seed, span=400):
    rnd = random.Random(seed)
    return [T0 + dt.timedelta(minutes=rnd.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("crowd", [0, 900])
def test_asof_and_nearest_against_brute_force(spark, crowd):
    left = [(("a", "b")[i % 2], t, i) for i, t in enumerate(_times(80, 1))]
    left += [("a", T0 + dt.timedelta(minutes=200 + i % 3), 1000 + i) for i in range(crowd)]  # nine tenths at one key and moment
    right = sorted({(("a", "b")[i % 2], t) for i, t in enumerate(_times(30, 2))})
    l = spark.createDataFrame(left, "symbol string, ts timestamp, id int")
    r = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(right)], "symbol string, rt timestamp, rid int")
    back = {x.id: x.rt for x in joins.asof_join(l, r, "ts", "rt").collect()}
    ahead = {x.id: x.rt for x in joins.asof_join(l, r, "ts", "rt", forward=True).collect()}
    near = {x.id: x.rt for x in joins.nearest_join(l, r, "ts", "rt").collect()}
    for s, t, i in left:
        mine = [x for k, x in right if k == s]
        assert back[i] == max((x for x in mine if x <= t), default=None)
        assert ahead[i] == min((x for x in mine if x >= t), default=None)
        assert near[i] == min(mine, key=lambda x: (abs(x - t), x))


@pytest.mark.parametrize("closed", ["both", "left"])
def test_interval_join_against_brute_force(spark, closed):
    left, right = _times(30, 5), _times(60, 6)
    l = spark.createDataFrame([(i, t) for i, t in enumerate(left)], "id int, ts timestamp")
    r = spark.createDataFrame([(i, t) for i, t in enumerate(right)], "rid int, at timestamp")
    got = {(x.id, x.rid) for x in joins.interval_join(l, r, nw.shift_hours("ts", -1), F.col("ts"), "at", closed=closed).collect()}
    want = {(i, j) for i, t in enumerate(left) for j, u in enumerate(right)
            if t - HOUR <= u and (u <= t if closed == "both" else u < t)}
    assert got == want


def test_articles_respect_close_time_and_delay(spark):
    decisions = spark.createDataFrame([(T0,)], "ts timestamp")
    times = {"in_delay": 30, "too_late": 50, "edge": 45, "old": 60 - 24 * 60 - 1, "first": 60 - 24 * 60}
    news = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in times.items()], "article_id string, published_at timestamp")
    got = {r.article_id for r in nw.articles_for_decisions(decisions, news).collect()}
    assert got == {"in_delay", "edge", "first"}
    late = {r.article_id for r in nw.articles_for_decisions(decisions, news, delay_minutes=60).collect()}
    assert late == {"first"}


# ------------------------------------------------------------------ indicators


def test_rsi_without_losses(spark):
    df = candle_index(bars(spark, range(1, 41)), "1h")
    row = lambda f: f(df).orderBy(F.col("ts").desc()).first()
    assert row(ind.rsi_pd)["rsi_pd"] is None
    assert row(ind.rsi_bt)["rsi_bt"] == 100
    assert math.isclose(row(ind.rsi_ch)["rsi_ch"], 100 - 100 / 101)


def test_flat_window_and_zero_volume(spark):
    df = candle_index(bars(spark, [5] * 40, volume=0), "1h")
    last = ind.vwap_rolling(ind.vwap_cumulative(ind.bollinger(df))).orderBy(F.col("ts").desc()).first()
    assert last.bb_pos_pd is None and last.bb_upper_pd == 5 and last.vwap_pd is None and last.vwap_ch == 5


def test_backtest_weights_equal_the_recursion():
    closes = walk(51)
    line, signal = ind.macd_bt_weights()

    def ema(xs, n):
        y = xs[0]
        for x in xs[1:]:
            y = x * 2 / (n + 1) + y * (1 - 2 / (n + 1))
        return y
    series = [ema(closes[:k], 12) - ema(closes[:k], 26) for k in range(26, 52)]
    want = series[0]
    for x in series[1:]:
        want = x * 0.2 + want * 0.8
    assert math.isclose(sum(a * b for a, b in zip(line, closes)), series[-1], abs_tol=1e-9)
    assert math.isclose(sum(a * b for a, b in zip(signal, closes)), want, abs_tol=1e-9)


def test_fill_warmup_replaces_infinite_values(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, float("inf")), ("x", 3, 7.0), ("x", 4, float("nan"))], "symbol string, rn bigint, rsi_14 double")
    assert [r.rsi_14 for r in ind.fill_warmup(df, ["rsi_14"], "carry").orderBy("rn").collect()] == [50.0, 50.0, 7.0, 7.0]


# ------------------------------------------------------------------ news


def test_empty_window_gives_zeros_and_ties_go_to_the_newer_article(spark):
    decisions = spark.createDataFrame([("x", T0), ("x", T0 + 10 * HOUR)], "symbol string, ts timestamp")
    news = spark.createDataFrame([(1, "t", "c", "s", T0 + 9.5 * HOUR, 0.5), (2, "t", "c", "s", T0 + 9.5 * HOUR, -0.5)],
                                 "article_id int, title string, content string, source string, published_at timestamp, sentiment_score double")
    rows = {r.ts: r for r in nw.news_window_stats(decisions, news, 1.0).collect()}
    assert rows[T0].news_count == 0 and rows[T0].vader_mean == 0.0
    assert rows[T0 + 10 * HOUR].news_count == 2
    picked = nw.top_k_news(decisions, news, "1h").orderBy("rank").collect()
    assert [r.article_id for r in picked] == [1, 2]


@pytest.mark.parametrize("seed", [4, 5])
def test_novelty_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = []
    for i in range(60):
        words = ["market"] + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 4))]
        rows.append((i, " ".join(words) if i % 6 else "market alpha beta", T0 + dt.timedelta(minutes=rnd.randrange(4000))))
    news = spark.createDataFrame(rows, "article_id int, title string, published_at timestamp")
    got = {r.article_id: r.similarity for r in nw.novelty(news, tile=7 if seed else 2048).collect()}
    docs = {i: t.split() for i, t, _ in rows}
    df = {}
    for ws in docs.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    vec = {i: {w: (1 + math.log(ws.count(w))) * math.log(len(rows) / df[w]) for w in set(ws) if df[w] >= 2} for i, ws in docs.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    for i, _, t in rows:
        best = 0.0
        for j, _, u in rows:
            if (u, j) < (t, i) and u >= t - 24 * HOUR and norm[i] > 0 and norm[j] > 0:
                best = max(best, sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j])
        assert math.isclose(got[i], best, abs_tol=1e-9), i


def test_novelty_reads_only_lists_that_can_win(spark):
    """A burst in one hour, a word in all texts but one, and exact copies of every text later on."""
    rnd = random.Random(9)
    texts = [" ".join(["common", *(f"w{rnd.randrange(60)}" for _ in range(6))]) for _ in range(150)]
    rows = [(i, t, T0 + dt.timedelta(seconds=i)) for i, t in enumerate(texts)] + [(200 + i, t, T0 + 3 * HOUR + dt.timedelta(seconds=i)) for i, t in enumerate(texts)]
    rows.append((999, "w1 w2 w3", T0 + 30 * HOUR))
    news = spark.createDataFrame(rows, "article_id int, title string, published_at timestamp")
    groups = nw.copies_of(news)[1]
    found = {r.gid: r for r in nw.best_matches(groups, size=25).collect()}
    whole = {r.gid: r for r in nw.best_matches(groups).collect()}
    assert {g: round(r.best, 9) for g, r in found.items()} == {g: round(r.best, 9) for g, r in whole.items()}
    assert all(r.best > 0.999999 for g, r in found.items() if 200 <= g < 350) and found[999].best < 0.9
    # the copy stands six tiles back: own tile, those between, and its tile are read, those behind it are not
    assert all(r.read <= 8 for g, r in found.items() if 200 <= g < 350) and found[349].read < 349 // 25


def written_bytes(spark):
    """Bytes of shuffle files and checkpoints that this session holds on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    blocks = sum(files.apply(i).length() for i in range(files.size()))
    shared = spark.sparkContext.getCheckpointDir()
    top = (shared or "").removeprefix("file:")
    return blocks + sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("column", ["content", "both"])
def test_novelty_of_long_texts_writes_few_bytes_a_word(spark, column):
    """Texts of some hundred words: what goes to disk is a small multiple of the texts' words."""
    rnd = random.Random(6)
    texts = [" ".join(f"word{int(rnd.paretovariate(0.7)) % 20_000}" for _ in range(400)) for _ in range(600)]
    rows = [(i, t.split(" ", 1)[0], t, T0 + dt.timedelta(minutes=4 * i)) for i, t in enumerate(texts)]
    news = spark.createDataFrame(rows, "article_id long, title string, content string, published_at timestamp").withColumn("both", F.concat_ws(" ", "title", "content"))
    words = sum(len(set(t.split())) for t in texts)
    nw.novelty(news.limit(3), column=column).collect()
    gc.collect()
    before = written_bytes(spark)
    got = nw.novelty(news, column=column, tile=128).collect()
    assert len(got) == 600 and all(0 <= r.similarity < 1 for r in got)
    assert (written_bytes(spark) - before) / words < 50


def test_novelty_of_a_crowded_day_writes_few_bytes_a_word(spark):
    """A day of many tiles, each of which goes to several tasks: what goes to disk stays a small multiple of the texts' words."""
    rnd = random.Random(7)
    texts = [" ".join(f"word{rnd.randrange(40_000)}" for _ in range(400)) for _ in range(1280)]
    rows = [(i, t.split(" ", 1)[0], t, T0 + dt.timedelta(minutes=i)) for i, t in enumerate(texts)]
    news = spark.createDataFrame(rows, "article_id long, title string, content string, published_at timestamp").withColumn("both", F.concat_ws(" ", "title", "content"))
    words = sum(len(set(t.split())) for t in texts)
    nw.novelty(news.limit(3), column="both").collect()
    gc.collect()
    before = written_bytes(spark)
    assert len(nw.novelty(news, column="both", tile=64).collect()) == 1280
    assert (written_bytes(spark) - before) / words < 30


def test_word_hashes_are_those_of_tokens(spark):
    """Texts of all kinds of characters in one array, in chunks of some sizes: a hash for every token, the same one for the same token only."""
    import pyarrow as pa

    rnd = random.Random(8)
    texts = [None, "", "The the A b_c x1", "Caf\u00e9 K\u0130 \u212aelvin", "z" * 9 + " " + "y" * 300 + " " + "Y" * 300 + " " + "y" * 256, "ab", "cd"]
    texts += ["".join(rnd.choice("abAB_ 0\u00e9.\n\x00") for _ in range(rnd.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", tx.tokens(F.col("s")).alias("w")).orderBy("i").collect()
    known, words = {}, {}
    for size in (1, 100, 1 << 21):
        found = [hashes[s:e].tolist() for _, at, hashes in tx.word_hashes(pa.array(["cut off", *texts]).slice(1), size=size) for s, e in zip(at[:-1], at[1:])]
        assert [len(x) for x in found] == [len(r.w) for r in rows]
        for h, w in zip((h for x in found for h in x), (w for r in rows for w in r.w)):
            assert known.setdefault(w, h) == h and words.setdefault(h, w) == w
    assert len(known) > 100


def test_novelty_of_two_languages_is_compared_in_parts(spark):
    """Two vocabularies with common and rare words, texts of 1 to 400 words, near copies and copies hours later: parts by vocabulary, and the highest cosines as by brute force."""
    rnd = random.Random(11)
    word = lambda k: f"{'ab'[k]}{int(rnd.paretovariate(0.5)) % 3000}"
    texts = []
    for i in range(600):
        old = rnd.choice(texts).split() if i > 20 and i % 10 < 2 else []
        texts.append(" ".join(old[:-1] + [word(0)] if i % 10 == 0 and old else old or ["common"] * (i % 3 == 0) + [word(i % 2) for _ in range(rnd.choice([1, 5, 60, 200, 400]))]))
    rows = [(i, t, T0 + dt.timedelta(minutes=4 * i + rnd.randrange(9))) for i, t in enumerate(texts)]
    docs = [t.split() for t in texts]
    df = {}
    for ws in docs:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    place = {w: k for k, w in enumerate(df)}
    x = np.zeros((len(docs), len(df)))
    for i, ws in enumerate(docs):
        for w in set(ws):
            x[i, place[w]] = (1 + math.log(ws.count(w))) * (math.log(len(docs) / df[w]) if df[w] > 1 else 0)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x /= np.where(norm > 0, norm, 1)
    cosines, at = x @ x.T, [(t, i) for i, _, t in rows]
    news = spark.createDataFrame(rows, "article_id int, title string, published_at timestamp")
    for size in (128, 2048):
        got = {r.article_id: r.similarity for r in nw.novelty(news, tile=size).collect()}
        for i, (t, _) in enumerate(at):
            best = max((cosines[i, j] for j in range(len(at)) if at[j] < at[i] and at[j][0] >= t - 24 * HOUR), default=0)
            assert math.isclose(got[i], best, abs_tol=1e-12), i
    tile = nw.tiles(nw.copies_of(news)[1]).collect()
    assert len(tile) == 1
    part = np.frombuffer(tile[0].part, "u1")[tile[0].member]
    alike = [[part[tile[0].ids.index(i)] for i in range(600) if len(docs[i]) > 50 and i % 10 > 1 and i % 2 == k] for k in (0, 1)]
    most = [max(set(p), key=p.count) for p in alike]
    assert most[0] != most[1] and all(p.count(m) > 0.9 * len(p) for p, m in zip(alike, most))


@pytest.mark.parametrize("step", [0, 1, 200])
def test_novelty_of_bursts_and_copies(spark, step):
    """Crowded hours, minutes and seconds are cut finely; copies stand in one tile or in several, and some texts share no word that counts."""
    rnd = random.Random(step)
    texts = ["common " + " ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "once%d" % i]) for _ in range(rnd.randrange(5))) for i in range(70)]
    rows = [(i, texts[i % 50], T0 + dt.timedelta(seconds=step * rnd.randrange(1, 90))) for i in range(70)] + [(80, "", T0), (81, None, T0), (82, "common", T0), (83, "common ab", None)]
    news = spark.createDataFrame(rows, "article_id long, title string, published_at timestamp")
    docs = {i: (t or "").split() for i, t, _ in rows}
    df = {w: sum(w in ws for ws in docs.values()) for ws in docs.values() for w in ws}
    vec = {i: {w: (1 + math.log(ws.count(w))) * math.log(len(rows) / df[w]) for w in set(ws) if df[w] > 1} for i, ws in docs.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    for size in (4, 2048):
        got = {r.article_id: r.similarity for r in nw.novelty(news, tile=size).collect()}
        assert got.keys() == docs.keys()
        for i, _, t in rows:
            best = 0.0
            for j, _, u in rows:
                if t and u and (u, j) < (t, i) and u >= t - 24 * HOUR and norm[i] > 0 and norm[j] > 0:
                    best = max(best, sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j])
            assert math.isclose(got[i], best, abs_tol=1e-9), (size, i)


def test_last_filter_keeps_the_best_when_none_is_confident(spark):
    pairs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "candle_ts int, article_id int, rank int")
    probs = spark.createDataFrame([(10, [0.2, 0.3]), (11, [0.5, 0.1])], "article_id int, factors array<double>")
    got = {(r.candle_ts, r.article_id) for r in nw.factor_confidence_filter(pairs, probs, 0.6).collect()}
    assert got == {(1, 11), (2, 12)}


# ------------------------------------------------------------------ sources


def test_timestamps_in_seconds_milliseconds_and_text(spark):
    df = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("soon",)], "v string")
    assert [r.t for r in df.select(tx.to_ts(F.col("v")).alias("t")).collect()] == [T0, T0, T0, None]


def test_malformed_messages_are_dropped(spark):
    good = '{"symbol":"btc","kline":{"openTime":1704067200000,"open":"1","high":"2","low":"1","close":"2","volume":"0","isFinal":true},"seq":5}'
    df = spark.createDataFrame([(good,), ("{broken",), ('{"x":1}',), (None,)], "value string")
    row = ms.normalize_klines(df).collect()
    assert len(row) == 1 and row[0].symbol == "BTC" and row[0].volume == 0.0 and row[0].is_final and row[0].sequence == 5


def test_signed_sentiment_shapes(spark):
    df = spark.createDataFrame([("positive", "0.4", "{}"), ("neg", "0.4", None), ("neutral", "0.4", None), (None, '{"pos":0.7,"neg":0.2}', None),
                                (None, None, '{"positive":0.1,"negative":0.6}'), (None, None, "0.3"), (None, None, None)], "l string, s string, r string")
    got = [r.v for r in df.select(ms.signed_sentiment(F.col("l"), F.col("s"), F.col("r")).alias("v")).collect()]
    assert [round(v, 9) for v in got] == [0.4, -0.4, 0.0, 0.5, -0.5, 0.3, 0.0]


def test_canonical_url(spark):
    df = spark.createDataFrame([("https://a.com/x?utm_source=1&b=2#z",), ("https://a.com",), ("nonsense",)], "u string")
    got = [r.v for r in df.select(tx.canonical_url(F.col("u"), F.lit("id")).alias("v")).collect()]
    assert got[0] == "https://a.com/x?b=2" and got[1] == "https://a.com/" and got[2].startswith("dataset://new-json/")


def test_page_title_and_date_sources(spark):
    pages = [("a", '<meta property="og:title" content="OG &amp; Co"><title>T</title><meta name="pubdate" content="2024-01-01 00:00:00">'),
             ("b", '<h1>Head</h1><time datetime="2024-01-01T00:00:00Z">x</time>'), ("c", '<meta content="2024-01-01" property="article:published_time">')]
    df = spark.createDataFrame(pages, "url string, html string")
    rows = {r.url: r for r in pg.extract_articles(df).collect()}
    assert (rows["a"].title, rows["b"].title, rows["c"].title) == ("OG & Co", "Head", "Untitled")
    assert {r.published_at for r in rows.values()} == {T0}


def test_time_column_discovery():
    assert files.find_time_column(["Open", "Timestamp"]) == "Timestamp"
    assert files.find_time_column(["﻿open_time", "close"]) == "﻿open_time"
    assert files.find_time_column(["my_time_col", "x"]) == "my_time_col"
    assert files.find_time_column(["a", "b"]) is None


# ------------------------------------------------------------------ splits, metrics, back-tests


def test_walk_forward_bounds_keep_the_embargo():
    assert ds.fold_bounds(199) == [] and ds.fold_bounds(300) == []
    for rows in (2000, 12345):
        parts = ds.fold_bounds(rows)
        assert len(parts) == 15
        for k in range(0, 15, 3):
            (_, _, _, te), (_, _, v0, v1), (_, _, s0, s1) = parts[k:k + 3]
            assert v0 - te >= 24 and s0 - v1 >= 24 and s1 <= rows


def test_horizon_steps_and_epsilon():
    assert ds.horizon_steps("4h", 3600) == 4
    with pytest.raises(ValueError):
        ds.horizon_steps("1h", 2700)
    with pytest.raises(ValueError):
        ds.epsilon("1h", 0.5)


@pytest.mark.parametrize("short", [True, False])
def test_signal_pnl_equals_a_loop(spark, short):
    rnd = random.Random(9)
    data = [(i + 1, rnd.choice([-1, 0, 0, 1]), rnd.uniform(-0.02, 0.02)) for i in range(300)]
    df = spark.createDataFrame(data, "rn bigint, signal int, ret double")
    got = [r.pnl for r in bt.signal_pnl(df, allow_short=short).orderBy("rn").collect()]
    position, want = 0, []
    for _, s, r in data:
        new = s if s else position
        if not short:
            new = max(new, 0)
        want.append(position * r - 0.0015 * abs(new - position))
        position = new
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("block", [4, 512])
def test_barriers_stop_is_checked_first(spark, block):
    closes = walk(120, 7)
    c = candle_index(bars(spark, closes), "1h")
    entries = [("s", "x", i, side, closes[i - 1] * (0.97 if side == "long" else 1.03), closes[i - 1] * (1.03 if side == "long" else 0.97))
               for i in range(1, 120, 5) for side in ("long",)]
    e = spark.createDataFrame(entries + [("t", "x", 3, "long", 1e9, -1.0)], "strategy string, symbol string, rn bigint, side string, stop double, take double")
    got = {(r.strategy, r.entry_rn): (r.exit_rn, r.reason) for r in bt.barrier_touch(e, c, block).collect()}
    assert got[("t", 3)] == (4, "STOP_LOSS")
    for s, _, i, side, stop, take in entries:
        want = None
        for k in range(i, 120):
            low, high = closes[k] - 1, closes[k] + 1
            if low <= stop:
                want = (k + 1, "STOP_LOSS")
            elif high >= take:
                want = (k + 1, "TAKE_PROFIT")
            if want:
                break
        assert got.get((s, i)) == want


def test_barriers_over_several_levels_that_end_in_one_block(spark):
    """Five levels of four; every entry waits for the same late fall, but for those without a barrier in reach."""
    closes = [100.0] * 700 + [50.0] + [100.0] * 40
    c = candle_index(bars(spark, closes), "1h")
    rows = [("s", "x", i, "long", 60.0, 1000.0) for i in range(1, 730, 3)] + [("t", "x", i, "short", 1000.0, 60.0) for i in range(2, 700, 50)]
    rows += [("u", "x", 5, "long", None, None), ("v", "x", 741, "long", 99.5, 100.5), ("w", "y", 1, "long", 1.0, 2.0)]
    e = spark.createDataFrame(rows, "strategy string, symbol string, rn bigint, side string, stop double, take double")
    got = {(r.strategy, r.entry_rn): (r.exit_rn, r.exit_price, r.reason) for r in bt.barrier_touch(e, c, 4).collect()}
    want = {("s", i): (701, 60.0, "STOP_LOSS") for i in range(1, 701, 3)} | {("t", i): (701, 60.0, "TAKE_PROFIT") for i in range(2, 700, 50)}
    assert got == want


def test_sell_signal_closes_a_long(spark):
    c = candle_index(bars(spark, [100.0] * 60), "1h")
    marks = {51: "BUY", 52: "BUY", 55: "SELL", 57: "SELL"}
    sig = c.filter("rn > 50").withColumns({"strategy": F.lit("s"), "signal": F.create_map(*[F.lit(x) for k, v in marks.items() for x in (k, v)])[F.col("rn").cast("int")]}).fillna("HOLD", ["signal"])
    got = [(r.side, r.entry_rn, r.exit_rn, r.reason) for r in bt.trade_ledger(sig, {"s": {}}, c).orderBy("entry_rn").collect()]
    assert got == [("long", 51, 55, "SIGNAL_SELL"), ("short", 57, 60, "END_OF_DATA")]


def test_alert_decision_outcomes(spark):
    cases = [("HOLD", 1, "HOLD", 1), ("BUY", .1, "HOLD", 1), ("BUY", 1, "SELL", 1), ("BUY", 1, "HOLD", 1), ("BUY", 1, "BUY", 1)]
    df = spark.createDataFrame([(i, a, float(x), 1.0, .5, .5, b, float(y), 1.0, .5, .5) for i, (a, x, b, y) in enumerate(cases)],
                               "i int, signal_1h string, confidence_1h double, max_prob_1h double, tau_1h double, gamma_1h double, "
                               "signal_4h string, confidence_4h double, max_prob_4h double, tau_4h double, gamma_4h double")
    got = [(r.alert, r.level) for r in dc.alert_decision(df).orderBy("i").collect()]
    assert got == [(False, "abstain"), (False, "abstain"), (False, "abstain"), (True, "medium"), (True, "high")]


def test_drawdown_and_auc_edges(spark):
    one = spark.createDataFrame([(1, 0.1)], "id int, ret double")
    assert mt.max_drawdown(one, ["id"]).first()[0] == 0.0
    same = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.7, 1)], "s double, y int")
    assert mt.binary_auc(same, "s", F.col("y") == 1).first()[0] == 0.75
    assert mt.binary_auc(same.filter("y = 1"), "s", F.col("y") == 1).first()[0] == 0.5


def test_balanced_batches_cover_every_class(spark):
    df = spark.createDataFrame([(i, -1 if i == 0 else (0 if i < 5 else i % 3)) for i in range(60)], "id int, y int")
    rows = ds.balanced_batches(df, "y", "id").collect()
    assert not any(r.id == 0 for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch, []).append(r["class"])
    assert all(len(v) == 8 and set(v) == {0, 1, 2} for v in sizes.values())


# ------------------------------------------------------------------ streaming


def kline(seq, minute, price):
    ts = 1704067200000
    return f'{{"symbol":"x","kline":{{"openTime":{ts},"open":"{price}","high":"{price}","low":"{price}","close":"{price}","volume":"{minute}"}},"seq":{seq}}}'


def test_late_updates_replays_and_gaps(spark, tmp_path):
    src = str(tmp_path / "in")
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    schema = "offset bigint, value string"

    def put(rows):
        spark.createDataFrame([(o, v) for o, v in rows], schema).coalesce(1).write.mode("append").json(src)

    def run():
        stream = jobs.read_stream(spark, "json", {"path": src}, schema)
        jobs.stream_klines(stream, sink, ck, order="offset").awaitTermination()
        jobs.stream_gaps(stream, str(tmp_path / "gaps"), ck + "-g").awaitTermination()

    put([(1, kline(1, 1, 10)), (2, kline(2, 2, 12))])
    run()
    put([(5, kline(5, 5, 9)), (5, kline(5, 5, 9)), (4, kline(4, 4, 15))])  # late, and one twice
    run()
    run()  # nothing new
    row = jobs.read_klines(spark, sink).collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.sequence) for r in row] == [(10.0, 15.0, 9.0, 9.0, 5.0, 5)]
    assert [(r.from_seq, r.to_seq) for r in jobs.read_gaps(spark, str(tmp_path / "gaps")).collect()] == [(2, 3)]
    put([(3, kline(3, 3, 11))])  # closes the gap
    run()
    assert jobs.read_gaps(spark, str(tmp_path / "gaps")).count() == 0
    logs.compact(spark, sink, 3, jobs.merge_partials, every=1)
    assert logs.live(spark, sink) == (1, 3)
    assert jobs.read_klines(spark, sink).count() == 1


def test_log_reads_stay_bounded_and_survive_crashes(spark, tmp_path):
    def merge(log):
        return log.groupBy("k").agg(F.sum("n").alias("n"))

    def batch(i):
        return spark.range(1).select((F.col("id") + i % 3).alias("k"), F.lit(i).cast("long").alias("n"))

    sink = str(tmp_path / "log")
    files = []
    for i in range(14):
        logs.write_batch(batch(i), sink, i, merge, every=4)
        files.append(len(logs.read_log(spark, sink).inputFiles()))
        logs.write_batch(batch(i), sink, i, merge, every=4)  # the same batch again
    want = {k: sum(range(k, 14, 3)) for k in range(3)}
    assert {r.k: r.n for r in merge(logs.read_log(spark, sink)).collect()} == want
    assert max(files[8:]) <= max(files[4:8]) + 1
    assert logs.live(spark, sink) == (3, 12)

    # a crash after the snapshot and before its manifest row leaves the old generation in charge
    logs._write(batch(0), f"{sink}/snapshot=4", ())
    assert {r.k: r.n for r in merge(logs.read_log(spark, sink)).collect()} == want
    for i in (14, 15, 16):
        logs.write_batch(batch(i), sink, i, merge, every=4)
    assert logs.live(spark, sink) == (4, 16)
    assert {r.k: r.n for r in merge(logs.read_log(spark, sink)).collect()} == {k: sum(range(k, 17, 3)) for k in range(3)}


def test_runs_of_numbers():
    import numpy as np
    from candela.streaming.state import joined_runs
    rnd = random.Random(3)
    seen, starts, ends = set(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(30):
        new = np.unique([rnd.randrange(200) for _ in range(9)])
        seen |= set(new.tolist())
        starts, ends = joined_runs(np.concatenate([starts, new]), np.concatenate([ends, new]))
        assert [x for s, e in zip(starts, ends) for x in range(s, e + 1)] == sorted(seen)
        assert all(starts[1:] > ends[:-1] + 1)


def test_gaps_over_blocks(spark):
    from candela.streaming import state
    rnd = random.Random(4)
    numbers = sorted({rnd.randrange(400) for _ in range(120)} | {0, 9, 10, 399})
    blocks = {}
    for n in numbers:
        blocks.setdefault(n // 10, []).append(n)
    rows = []
    for b, some in blocks.items():
        runs = [n for n in some if n - 1 not in some], [n for n in some if n + 1 not in some]
        rows.append(("x", b, *runs, len(some)))
    table = spark.createDataFrame(rows, "symbol string, block long, starts array<long>, ends array<long>, seen long")
    got = sorted((r.from_seq, r.to_seq, r.gap_size) for r in state.gaps_of_runs(table).collect())
    assert got == [(a, b - 1, b - a - 1) for a, b in zip(numbers, numbers[1:]) if b > a + 1]


def test_merge_equals_replay(spark):
    rows = [("x", T0, 1.0, 1.0, 1.0, float(i), float(i), None if i % 2 else i, i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, sequence bigint, offset bigint")
    target = None
    for i in range(1, 6):
        target = cd.merge_updates(target, df.filter(F.col("offset") == i))
    assert target.collect() == cd.replay_updates(df).collect()


def test_asof_without_times_or_keys(spark):
    l = spark.createDataFrame([("a", None, 1), ("a", T0, 2), (None, T0, 3)], "symbol string, ts timestamp, id int")
    r = spark.createDataFrame([("a", None, 7), ("a", T0, 8), (None, T0, 9)], "symbol string, rt timestamp, rid int")
    for forward in (False, True):
        got = {x.id: x.rid for x in joins.asof_join(l, r, "ts", "rt", forward=forward).collect()}
        assert got == {1: None, 2: 8, 3: 9}


# ------------------------------------------------------------------ ratcheting bands, folds, links, nested messages


def test_ratcheted_bands_against_a_loop(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for symbol in "ab":
        band = math.inf
        for i in range(1, 400):
            edge, prev = 100 + rnd.gauss(0, 5), 100 + rnd.gauss(0, 5) - 6
            band = edge if prev > band else min(band, edge)
            rows.append((symbol, i, edge, prev))
            want[symbol, i] = band
    df = spark.createDataFrame(rows, "symbol string, rn long, edge double, prev double")
    for block in (7, 64, 4096):
        got = {(r.symbol, r.rn): r.band for r in ind.ratcheted(df, "edge", "prev", "band", block).collect()}
        assert got == want


def test_fold_bounds():
    assert ds.fold_bounds(199) == [] and ds.fold_bounds(300) == []
    bounds = ds.fold_bounds(2000)
    assert len(bounds) == 15 and bounds[:3] == [(0, "train", 0, 800), (0, "val", 824, 920), (0, "test", 944, 1040)]
    for fold in range(5):
        (_, _, _, end), (_, _, v0, v1), (_, _, t0, t1) = bounds[3 * fold: 3 * fold + 3]
        assert v0 - end == t0 - v1 == 24 and t1 <= 2000


def test_relative_links(spark):
    from candela.sources import pages as pg
    cases = [("/news/x/", "../y", "/news/y"), ("/news/x/a.html", "?page=2", "/news/x/a.html?page=2"), ("", "b", "/b"), ("/a/b", "./c#d", "/a/c#d"),
             ("/a/b", "../../../c", "/c"), ("/a/b/", "..", "/a/"), ("/a/b", "/x/./y/../z", "/x/z")]
    df = spark.createDataFrame([(i, p, h) for i, (p, h, _) in enumerate(cases)], "i int, place string, href string")
    got = {r.i: r.to for r in df.select("i", pg.resolved(F.col("place"), F.col("href")).alias("to")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_long_pages_keep_all_paragraphs(spark):
    from candela.sources import pages as pg
    html = "".join(f"<p>{'word ' * 200}{i}</p>" for i in range(30))
    df = spark.createDataFrame([(html,)], "html string")
    whole, some = df.select(pg.page_content(F.col("html")), pg.page_content(F.col("html"), most=2)).first()
    assert whole.count("\n\n") == 29 and some.count("\n\n") == 1


def test_unwrap_many_levels(spark):
    from candela.sources import messages as ms
    rows = [(k, '{"raw":' * k + '{"a":1}' + "}" * k) for k in (0, 1, 5, 12)] + [(99, '{"raw":"","b":2}')]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k int, v string").select("k", ms.unwrap_raw(F.col("v")).alias("v")).collect()}
    assert all(got[k] == '{"a":1}' for k in (0, 1, 5, 12)) and got[99] == '{"raw":"","b":2}'


# ------------------------------------------------------------------ streams


def _kline(symbol, minute, close, seq=None, interval="1m"):
    import json
    ms_ = int((T0 + dt.timedelta(minutes=minute)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    body = {"s": symbol, "t": ms_, "o": close, "h": close, "l": close, "c": close, "v": 1, "i": interval}
    return json.dumps(body | ({} if seq is None else {"seq": seq}))


def _messages_in_batches(spark, tmp_path, batches):
    """One file per batch; file times follow the order of the list."""
    import json
    import os
    folder = tmp_path / "in"
    folder.mkdir()
    for i, values in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("".join(json.dumps({"value": v}) + "\n" for v in values))
        os.utime(path, (1_700_000_000 + i * 10,) * 2)
    from candela.streaming import jobs
    return jobs.read_stream(spark, "json", {"path": str(folder), "maxFilesPerTrigger": "1"}, "value string")


def test_old_news_is_stored(spark, tmp_path):
    import json
    from candela.streaming import jobs, logs
    days = (40, 40, 0, 0, 0)
    news = [[json.dumps({"url": f"u{i}", "title": "t", "published_at": (T0 + dt.timedelta(days=d)).isoformat()})] for i, d in enumerate(days)]
    news.append(news[0])
    stream = _messages_in_batches(spark, tmp_path, news)
    jobs.stream_news(stream, str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
    stored = [r.url for r in logs.read_log(spark, str(tmp_path / "sink")).collect()]
    assert sorted(stored) == [f"u{i}" for i in range(5)]


def test_price_cache_keeps_unnumbered_candles_and_intervals(spark, tmp_path):
    from candela.streaming import jobs
    batches = [[_kline("A", 0, 1.0)], [_kline("A", 0, 2.0, seq=5)], [_kline("A", 0, 3.0, seq=4)], [_kline("A", 0, 4.0)], [_kline("A", 0, 9.0, interval="1h"), _kline("B", 1, 7.0)]]
    stream = _messages_in_batches(spark, tmp_path, batches)
    jobs.stream_last_n(stream, str(tmp_path / "sink"), str(tmp_path / "ck"), 3).awaitTermination()
    got = {(r.symbol, r.interval): r.close for r in jobs.read_state(spark, str(tmp_path / "sink"), 3).collect()}
    assert got == {("A", "1m"): 2.0, ("A", "1h"): 9.0, ("B", "1m"): 7.0}


def test_late_ticks_count(spark, tmp_path):
    from candela.operators import candles as cd
    from candela.streaming import jobs
    rnd = random.Random(8)
    ticks = [(i, "ab"[i % 2], T0 + dt.timedelta(minutes=rnd.randrange(6000)), rnd.random(), 1.0) for i in range(500)]
    schema = "event_id long, symbol string, ts timestamp, price double, volume double"
    for k in range(5):
        spark.createDataFrame(ticks[k::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, "parquet", {"path": str(tmp_path / "in"), "maxFilesPerTrigger": "1"}, schema)
    jobs.stream_candles(stream, str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in jobs.read_candles(spark, str(tmp_path / "sink")).collect()}
    bars = cd.resample(cd.ticks_as_bars(spark.createDataFrame(ticks, schema)), "1h", order=("ts", "event_id"))
    assert got == {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}


# ------------------------------------------------------------------ means over a window, drawdowns of many policies


def _mean(xs, span):
    keep = 1 - 2 / (span + 1)
    out = [xs[0]]
    for x in xs[1:]:
        out.append(keep * out[-1] + (1 - keep) * x)
    return out


def test_window_means_equal_recursions_over_the_window(spark):
    closes, size, first = walk(160, 11), 31, 12
    df = ind._open_means(candle_index(bars(spark, closes), "1h"), (4, 20), [(5, 9, 3)])
    got = blocked(df, size, lambda d, w: d.withColumns({
        "a": ind.window_mean(4, w, size), "b": ind.window_mean(20, w, size), "s": ind.window_signal(5, 9, 3, w, size),
        "late": ind.window_signal(5, 9, 3, w, size, first)}), block=40).orderBy("rn").collect()
    assert len(got) == len(closes)
    for r in got:
        seen = closes[max(0, r.rn - size):r.rn]
        line = [f - s for f, s in zip(_mean(seen, 5), _mean(seen, 9))]
        assert math.isclose(r.a, _mean(seen, 4)[-1], rel_tol=1e-9)
        assert math.isclose(r.b, _mean(seen, 20)[-1], rel_tol=1e-9)
        assert math.isclose(r.s, _mean(line, 3)[-1], abs_tol=1e-9)
        if r.rn >= size:
            assert math.isclose(r.late, _mean(line[first - 1:], 3)[-1], abs_tol=1e-9)


@pytest.mark.parametrize("block", [3, 64])
def test_policy_drawdowns_over_blocks(spark, block):
    rnd = random.Random(5)
    # the third policy takes one trade, the fourth none
    rows = [(i, rnd.uniform(-0.2, 0.18), rnd.randrange(4) | (4 if i == 17 else 0)) for i in range(50)]
    df = spark.createDataFrame([(i, math.log(1 + r), m) for i, r, m in rows if m], "id int, growth double, fires int")
    got = {r.slot: r.max_drawdown for r in mt.policy_drawdowns(df, 4, ["id"], block).collect()}
    assert set(got) == {0, 1, 2} and got[2] == 0
    for k in (0, 1):
        worth, top, fall = 1.0, None, 0.0
        for _, r, m in rows:
            if m >> k & 1:
                worth *= 1 + r
                top = worth if top is None else max(top, worth)
                fall = min(fall, worth / top - 1)
        assert math.isclose(got[k], fall, rel_tol=1e-9)


def test_csv_records_over_split_borders(spark, tmp_path):
    import csv
    rnd = random.Random(11)
    pieces = ['a "quoted" word', "line\nend", "x;y", "", "tail\n\n", "\r\nwindows", '"', "plain"]
    rows = [(str(i), "2024-01-01 00:00:00", rnd.choice(pieces) + rnd.choice(pieces)) for i in range(400)]
    rows[7] = ("7", rows[7][1], "\n".join(["many", "lines"] * 700))  # longer than several splits
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", newline="") as out:
            writer = csv.writer(out, delimiter=";", lineterminator=("\n", "\r\n")[k])
            writer.writerow(["id", "date", "title"])
            writer.writerows(rows[k::2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        table = files.read_articles(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {r.id: r.title for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: v or "" for k, v in got.items()} == {r[0]: r[2] for r in rows}


def test_far_rows_are_read_by_position(spark):
    from candela.operators.ordering import rows_at
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("x"), "id")
    want = [r.id for r in df.orderBy(F.col("x").desc()).collect()]
    for offset, limit in ((0, 5), (2490, 20), (4990, 50), (6000, 10)):
        near, far = (rows_at(df, [F.col("x").desc()], offset, limit, top) for top in (10_000, 0))
        assert [r.id for r in near[0].collect()] == [r.id for r in far[0].collect()] == want[offset : offset + limit]
        assert near[1].first().total == far[1].first().total == 5000


def test_downsampled_timeline(spark):
    rows = [(T0 + dt.timedelta(hours=i), i % 3 + 1, i / 10, [f"a{i}-{j}" for j in range(i % 4)]) for i in range(23)]
    df = spark.createDataFrame(rows, "bucket timestamp, count long, average_sentiment double, articles array<string>")
    got = sorted((r.time.replace(tzinfo=None), r["count"], list(r.articles or [])) for r in nw.downsample_timeline(df, 5, 4).collect())
    want = []
    for at in range(0, 23, 5):
        part = rows[at : at + 5]
        want.append((part[len(part) // 2][0].replace(tzinfo=None), sum(p[1] for p in part), [a for p in part for a in p[3]][:4]))
    assert got == want


def test_ranks_under_bursts(spark):
    rnd = random.Random(12)
    burst = T0 + dt.timedelta(hours=30)
    news = [(i, burst if i % 3 else T0 + dt.timedelta(minutes=rnd.randrange(4000))) for i in range(300)] + [(300, None), (None, burst)]
    decisions = [T0 + dt.timedelta(hours=h) for h in range(0, 80, 5)] * 2
    frame = spark.createDataFrame(news, "article_id long, published_at timestamp")
    times = spark.createDataFrame([(t,) for t in decisions], "ts timestamp")
    for limit in (None, 4):
        got = sorted((r.candle_ts.replace(tzinfo=None), r["rank"], r.article_id) for r in nw.articles_for_decisions(times, frame, limit=limit).collect())
        want = []
        for t in sorted(set(decisions)):
            at = t + dt.timedelta(hours=1)
            seen = [a for a in news if a[1] and at - dt.timedelta(hours=24) <= a[1] <= at - dt.timedelta(minutes=15)]
            seen.sort(key=lambda a: (-a[1].timestamp(), a[0] is not None, a[0] or 0))
            want += [(t.replace(tzinfo=None), i + 1, a[0]) for i, a in enumerate(seen[:limit])]
        assert got == sorted(want)
