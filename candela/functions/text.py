"""Text expressions: tokens, sentences, keyword scores, symbols, URLs, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from candela.functions import lexicons as lx
from candela.functions.arrays import clip, clipped_entropy, let, scaled_to_one, softmax, total


def lower_text(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


# ------------------------------------------------------------------ tokens and sentences

def tokens(col: Column, stop: Sequence[str] = lx.STOP_WORDS) -> Column:
    """Lower-case words of letters, digits and underscores without stop words and single letters."""
    words = F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*stop))


def word_hashes(texts, stop: Sequence[str] = lx.STOP_WORDS, size: int = 1 << 21):
    """The words that ``tokens`` gives, as 64-bit hashes, for an Arrow array of texts, about ``size`` bytes at once.

    Yields the number of the first text, where the words of each text begin (and the last one's end), and the hashes of all words in order.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, "<i8" if pa.types.is_large_string(texts.type) else "<i4")[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    joined = np.frombuffer(" ".join(stop).encode(), "u1")
    known = np.unique(_word_hashes(joined, np.array([0, len(joined)]))[1])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        begins, hashes = _word_hashes(data[at[i]:at[j]], at[i:j + 1] - at[i])
        if len(known):
            keep = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] != hashes
            begins, hashes = np.append(0, keep.cumsum())[begins], hashes[keep]
        yield i, begins, hashes
        i = j


_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b == 95 else 0 for b in range(256))  # 0 stands between words


def _word_hashes(data, bounds):
    """Where the words of each text begin, and hashes of all words of two and more letters; bounds: where the texts begin and end."""
    import hashlib

    import numpy as np

    n = len(data)
    low = np.zeros(n + 8, "u1")
    low[:n] = np.frombuffer(_LETTERS, "u1")[data]
    inside = low[:n] != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    first, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= first
    first, size = first[size > 1], size[size > 1]
    begins = np.searchsorted(first, bounds)
    eights = np.ndarray(n + 1, "<u8", low, 0, (1,))  # eight letters from each place on
    masks = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], "u8")
    hashes = _mixed(size.astype("u8") ^ (eights[first] & masks[np.minimum(size, 8)]) * np.uint64(0x9E3779B97F4A7C15))
    todo, k = np.flatnonzero(size > 8), 8
    while len(todo) and k < 256:
        hashes[todo] = _mixed(hashes[todo] ^ (eights[first[todo] + k] & masks[np.minimum(size[todo] - k, 8)]) * np.uint64(0x9E3779B97F4A7C15))
        k += 8
        todo = todo[size[todo] > k]
    for i in todo:
        hashes[i] = int.from_bytes(hashlib.blake2b(low[first[i]:first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return begins, hashes


def _mixed(x):
    """A one-to-one mixing of 64 bits."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sentences(col: Column) -> Column:
    """Split after ``.``, ``!`` or ``?``; keep sentences longer than 15 characters."""
    parts = F.transform(F.split(strip(F.coalesce(col, F.lit(""))), r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda x: F.length(x) > 15)


def strip(col: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


# ------------------------------------------------------------------ keywords

def word_list(words: Sequence[str]) -> Column:
    """A constant array (folded by Catalyst into one literal)."""
    return F.split(F.lit("\u0001".join(words)), "\u0001")


def hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in (lower-case) text."""
    return let(text, lambda x: F.size(F.filter(word_list(keywords), lambda k: F.contains(x, k))))


def any_hit(text: Column, keywords: Sequence[str], word_boundary: bool = False) -> Column:
    if word_boundary:
        return text.rlike("|".join(rf"\b\Q{k}\E\b" for k in keywords))
    return let(text, lambda x: F.exists(word_list(keywords), lambda k: F.contains(x, k)))


def occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a substring."""
    return (F.length(text) - F.length(F.replace(text, keyword, F.lit("")))) / F.length(keyword)


def keyword_presence(col: Column, keywords: Sequence[str] = lx.PRICE_KEYWORDS) -> Column:
    """Share of keywords present, one tenth of them giving the full score."""
    return F.least(F.lit(1.0), hits(F.lower(F.coalesce(col, F.lit(""))), keywords) / F.lit(max(1.0, 0.1 * len(keywords))))


def first_match(text: Column, table: Sequence[tuple[str, float]], default: float) -> Column:
    """Score of the first table entry that is a substring of ``text``."""
    expr = None
    for key, score in table:
        cond = F.contains(text, F.lit(key))
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    return expr.otherwise(F.lit(float(default)))


def source_credibility(source: Column, table=lx.SOURCE_CREDIBILITY) -> Column:
    return first_match(F.trim(F.lower(F.coalesce(source, F.lit("")))), table, lx.DEFAULT_CREDIBILITY)


def tier(source: Column, default: float | None = lx.UNKNOWN_DEFAULT) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return (F.when(any_hit(s, lx.TIER_ONE), F.lit(lx.TIER_ONE_SCORE))
            .when(any_hit(s, lx.TIER_TWO), F.lit(lx.TIER_TWO_SCORE)).otherwise(F.lit(default)))


def is_bad_title(low_title: Column) -> Column:
    return any_hit(low_title, lx.BAD_TITLES)


# ------------------------------------------------------------------ factors

def keyword_counts(title: Column, content: Column, ontology=lx.FACTORS) -> Column:
    """Occurrences per factor; the title counts three times."""
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    text = F.concat(*[t, F.lit(" ")] * lx.TITLE_WEIGHT, c)
    count = lambda x, words: F.aggregate(word_list(words), F.lit(0.0), lambda acc, k: acc + F.when(F.contains(x, k), occurrences(x, k)).otherwise(0.0))
    return let(text, lambda x: F.array(*[count(x, words) for words in ontology.values()]))


def source_prior(source: Column, size: int = len(lx.FACTORS), table=lx.SOURCE_PRIORS) -> Column:
    """Uniform distribution with the boosts of the first matching source."""
    def prior(boosts):
        base = [1.0 / size + boosts.get(i, 0.0) for i in range(size)]
        return F.array(*[F.lit(b / sum(base)) for b in base])
    s = F.lower(F.coalesce(source, F.lit("")))
    expr = F.when(F.lit(False), prior({}))
    for key, boosts in table:
        expr = expr.when(F.contains(s, F.lit(key)), prior(boosts))
    return expr.otherwise(prior({}))


def blend_with_prior(scores: Column, prior: Column) -> Column:
    """Keyword softmax mixed with the source prior; no keyword gives the prior."""
    def mixed(sc: Column, strength: Column) -> Column:
        w = F.when(strength <= 2, 0.18).when(strength <= 5, 0.10).otherwise(0.05)
        return scaled_to_one(F.zip_with(softmax(sc, lx.LABEL_TEMPERATURE), prior, lambda p, q: (1 - w) * p + w * q))
    return let(scores, lambda sc: let(total(sc), lambda st: F.when(st <= 0, prior).otherwise(mixed(sc, st))))


def factor_distribution(title: Column, content: Column, source: Column, ontology=lx.FACTORS) -> Column:
    return blend_with_prior(keyword_counts(title, content, ontology), source_prior(source, len(ontology)))


def soften_factors(arr: Column, cap: float = 0.97, floor: float = 0.12, mix_max: float = 0.12) -> Column:
    """Mix over-sharp distributions with the uniform one."""
    def softer(p: Column, top: Column) -> Column:
        uniform = 1.0 / F.size(p)
        mix = F.least(F.lit(mix_max), F.greatest(F.lit(0.0), (top - cap) / F.greatest(top - uniform, F.lit(1e-6))))
        blended = let(mix, lambda m: F.transform(p, lambda x: (1 - m) * x + m * uniform))
        return F.when((top <= cap) & (clipped_entropy(p) >= floor), p).otherwise(scaled_to_one(blended))
    safe = scaled_to_one(F.transform(arr, lambda x: clip(x, 1e-8, 1.0)))
    return let(safe, lambda p: let(F.array_max(p), lambda top: softer(p, top)))


def factor_shares(text: Column, ontology=lx.FACTORS, default: int = lx.DEFAULT_FACTOR) -> Column:
    """Share of present keywords per factor; none gives the default factor."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = F.array(*[hits(low, words).cast("double") for words in ontology.values()])
    fallback = F.array(*[F.lit(1.0 if i == default else 0.0) for i in range(len(ontology))])
    return let(counts, lambda c: F.when(total(c) == 0, fallback).otherwise(scaled_to_one(c)))


def blend_labels(a: Column, b: Column, min_conf: float = 0.7) -> Column:
    return F.when(F.array_max(b) >= min_conf, b).otherwise(a)


# ------------------------------------------------------------------ lexicon scores

def lexicon_sentiment_raw(text: Column, lists=None) -> Column:
    """Balance of positive and negative words; the lists of strong words count twice."""
    vp, p, vn, n = lists or (lx.VERY_POSITIVE, lx.POSITIVE, lx.VERY_NEGATIVE, lx.NEGATIVE)

    def balance(low: Column) -> Column:
        counts = F.struct((2 * hits(low, vp) + hits(low, p)).alias("pos"), (2 * hits(low, vn) + hits(low, n)).alias("neg"))
        return let(counts, lambda c: F.when(c["pos"] + c["neg"] == 0, F.lit(0.0)).otherwise(
            (c["pos"] - c["neg"]) / (c["pos"] + c["neg"]) * 0.8))
    return let(F.lower(F.coalesce(text, F.lit(""))), balance)


def lexicon_sentiment(text: Column, lists=None) -> Column:
    """Struct of label (±0.3) and score rounded to two digits."""
    def described(raw: Column) -> Column:
        label = F.when(raw >= 0.3, "Positive").when(raw <= -0.3, "Negative").otherwise("Neutral")
        return F.struct(label.alias("label"), F.round(raw, 2).alias("score"))
    return let(lexicon_sentiment_raw(text, lists), described)


def lexicon_relevance(text: Column, high=lx.HIGH_IMPACT_WORDS, crypto=lx.CRYPTO_WORDS) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.least(
        F.lit(1.0), F.round(0.2 + 0.3 * hits(low, high) + 0.1 * hits(low, crypto), 2)))


def relevance_category(score: Column) -> Column:
    return F.when(score >= 0.5, "Crypto").when(score >= 0.4, "Finance").otherwise("General")


def symbol_tags(text: Column, mode: str = "substring") -> Column:
    """Sorted symbols a text mentions; ``words`` matches whole words only."""
    if mode == "substring":
        table: dict[str, list[str]] = {}
        for word, symbol in lx.SYMBOL_WORDS:
            table.setdefault(symbol, []).append(word)
        marks = lambda low: [F.when(any_hit(low, words), F.lit(symbol)) for symbol, words in table.items()]
        source, default = F.lower(F.coalesce(text, F.lit(""))), lx.DEFAULT_SYMBOL
    else:
        marks = lambda raw: [
            F.when(raw.rlike("(?i)" + "|".join(rf"\b{w}\b" for w in names))
                   | raw.rlike("|".join(rf"\b{x}\b" for x in tickers)), F.lit(symbol))
            for symbol, names, tickers in lx.SYMBOL_PATTERNS
        ]
        source, default = F.coalesce(text, F.lit("")), "ALL"
    found = let(source, lambda x: F.array_sort(F.array_compact(F.array(*marks(x)))))
    return let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(default))).otherwise(f))


def sentiment_bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s > 0.1, "positive").when(s < -0.1, "negative").otherwise("neutral")


def combined_sentiment(vader: Column, finbert: Column | None = None, bullish: Column | None = None) -> Column:
    """Weights depend on which scorers are there."""
    if finbert is not None and bullish is not None:
        return 0.2 * vader + 0.5 * finbert + 0.3 * bullish
    if finbert is not None:
        return 0.3 * vader + 0.7 * finbert
    if bullish is not None:
        return 0.5 * vader + 0.5 * bullish
    return vader


# ------------------------------------------------------------------ relevance and article metadata

def recency(age_hours: Column, half_life: float) -> Column:
    import math
    return F.coalesce(F.exp(F.lit(-math.log(2) / max(half_life, 0.1)) * F.greatest(age_hours, F.lit(0.0))), F.lit(0.0))


def relevance(rec: Column, cred: Column, kw: Column, horizon: str) -> Column:
    wr, wc, wk, _ = lx.RELEVANCE_WEIGHTS[horizon]
    return clip(wr * rec + wc * cred + wk * kw, 0.0, 1.0)


def article_meta(age_hours: Column, content: Column, credibility: Column, novelty: Column, rank: Column,
                 entity: Column | None = None, lookback_hours: float = 24.0) -> Column:
    """Recency, length, credibility, novelty (or rank) and the factor sentiments."""
    head = F.array(
        clip(1 - age_hours / max(lookback_hours, 1e-6), 0.0, 1.0),
        F.least(F.lit(1.0), F.length(F.coalesce(content, F.lit(""))) / F.lit(500.0)),
        F.coalesce(credibility, F.lit(lx.UNKNOWN_DEFAULT)), F.coalesce(novelty, rank))
    if entity is None:
        return head
    return F.concat(head, F.coalesce(entity, F.array_repeat(F.lit(0.0), len(lx.FACTORS))))


def article_meta_live(age_hours: Column, content: Column, source: Column, sentiment: Column,
                      lookback_hours: float) -> Column:
    return F.array(
        F.exp(-F.greatest(age_hours, F.lit(0.0)) / (lookback_hours + 1)),
        F.least(F.lit(1.0), F.length(F.coalesce(content, F.lit(""))) / F.lit(2000.0)),
        tier(source), F.least(F.lit(1.0), F.abs(F.coalesce(sentiment, F.lit(0.0)))))


# ------------------------------------------------------------------ URLs and times

def canonical_url(url: Column, identity: Column) -> Column:
    """URL without ``utm_*`` parameters and fragment; invalid ones get a hashed identity."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    ok = raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/\s?#]+") & ~raw.rlike(r"\s")
    bare = F.regexp_replace(raw, "#.*$", "")
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    base = F.when(base.rlike(r"^[^:]+://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    has_query = F.contains(bare, F.lit("?"))
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike("(?i)^utm_") & (p != ""))
    clean = F.concat(base, F.when(has_query & (F.size(kept) > 0), F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(ok, clean).otherwise(F.concat(F.lit("dataset://new-json/"), F.sha2(identity, 256)))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def to_ts(col: Column, seconds_below: float = 1e11) -> Column:
    """Time from epoch seconds, epoch milliseconds or ISO text; null when none fits."""
    text = F.trim(col.cast("string"))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("bigint"))
    millis = F.when(number < seconds_below, number * 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_millis(millis)).otherwise(F.try_to_timestamp(text))
