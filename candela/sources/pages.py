"""Stored web pages to articles and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions import lexicons as lx
from candela.functions.text import (
    any_hit, lexicon_relevance, lexicon_sentiment, relevance_category, strip, symbol_tags, to_ts,
)

# Meta names that may hold a publication date, in order.
DATE_META = ("date", "pubdate", "publishdate", "article:published_time", "og:pubdate", "og:published_time",
             "article:published")
# Character references that are resolved (the ampersand last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"),
            ("&copy;", "©"), ("&amp;", "&"))


def unescape(col: Column) -> Column:
    for ref, char in ENTITIES:
        col = F.replace(col, F.lit(ref), F.lit(char))
    return col


def plain(col: Column) -> Column:
    """Text of an HTML fragment."""
    return strip(unescape(F.regexp_replace(col, r"(?s)<[^>]*>", "")))


def _tag(html: Column, tag: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(plain(found), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element, whichever attribute comes first."""
    key = rf"(?:name|property)\s*=\s*[\"']{name}[\"']"
    after = F.regexp_extract(html, rf"(?is)<meta\b[^>]*{key}[^>]*content\s*=\s*[\"']([^\"'>]*)", 1)
    before = F.regexp_extract(html, rf"(?is)<meta\b[^>]*content\s*=\s*[\"']([^\"'>]*)[\"'][^>]*{key}", 1)
    return F.nullif(strip(unescape(F.when(after != "", after).otherwise(before))), F.lit(""))


def page_title(html: Column) -> Column:
    return F.coalesce(meta(html, "og:title"), _tag(html, "title"), _tag(html, "h1"), F.lit("Untitled"))


def page_date(html: Column) -> Column:
    stamp = F.regexp_extract(html, r"(?is)<time\b[^>]*datetime\s*=\s*[\"']([^\"'>]+)", 1)
    inner = F.regexp_extract(html, r"(?is)<time\b[^>]*>(.*?)</time>", 1)
    fallback = F.nullif(F.when(stamp != "", stamp).otherwise(plain(inner)), F.lit(""))
    return F.coalesce(*[to_ts(meta(html, m)) for m in DATE_META], to_ts(fallback))


def page_content(html: Column, shortest: int = 50, most: int | None = None, chars: int | None = None) -> Column:
    """Paragraphs longer than ``shortest`` characters; ``most`` and ``chars`` cut them for a reader with bounded input.

    A paragraph ends at its end tag, at the next paragraph or with its block.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    pieces = F.split(body, r"(?i)<p\b[^>]*>")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    texts = F.transform(parts, lambda x: plain(F.regexp_extract(
        x, r"(?is)^(.*?)(?:</(?:p|article|div|section|main|body)>|$)", 1)))
    kept = F.filter(texts, lambda x: F.length(x) > shortest)
    text = F.array_join(kept if most is None else F.slice(kept, 1, most), "\n\n")
    return text if chars is None else F.substring(text, 1, chars)


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Page table to article table with relevance, category, sentiment and symbols."""
    rows = pages.withColumns({
        "title": page_title(F.col(html)), "published_at": page_date(F.col(html)), "content": page_content(F.col(html)),
    }).drop(html)
    full = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    rows = rows.withColumns({
        "relevance_score": lexicon_relevance(full), "_s": lexicon_sentiment(full), "symbols": symbol_tags(full)})
    return rows.withColumns({
        "category": relevance_category(F.col("relevance_score")),
        "sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score")}).drop("_s")


def resolved(place: Column, href: Column) -> Column:
    """Path of a reference without scheme and host, seen from a page at the path ``place``.

    A reference without a path stays on the page; ``.`` and ``..`` are taken out.
    """
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(place, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    parts = F.aggregate(
        F.split(full, "/"), F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        .when(part == ".", kept).otherwise(F.array_append(kept, part)))
    ends = F.when(full.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.when(path == "", place).otherwise(F.concat(F.array_join(parts, "/"), ends)), rest)


def discover_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links of a page to its own host that look like articles."""
    base = F.regexp_extract(F.col(url), r"^([^:]+://[^/?#]+)", 1)
    place = F.regexp_extract(F.col(url), r"^[^:]+://[^/?#]+([^?#]*)", 1)
    scheme = F.regexp_extract(F.col(url), r"^([^:]+:)", 1)
    href = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\b[^>]*href\s*=\s*[\"']([^\"']*)"), F.lit(1))))
    rows = pages.select(F.col(url).alias("page"), base.alias("_base"), place.alias("_place"), scheme.alias("_scheme"), href.alias("_href"))
    rows = rows.withColumn("_href", unescape(F.col("_href"))).filter(
        ~F.startswith(F.col("_href"), F.lit("javascript:")) & ~F.startswith(F.col("_href"), F.lit("#")))
    h = F.col("_href")
    full = (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat("_scheme", h))
            .otherwise(F.concat(F.col("_base"), resolved(F.col("_place"), h))))
    rows = rows.withColumn("link", full).withColumn("_host", F.regexp_extract("link", r"^([^:]+://[^/?#]+)", 1))
    path = F.lower(F.regexp_extract("link", r"^[^:]+://[^/?#]+([^?#]*)", 1))
    rows = rows.withColumn("_path", path).filter(
        (F.regexp_extract("_host", r"://(.*)$", 1) == F.regexp_extract("_base", r"://(.*)$", 1))
        & ~any_hit(F.col("_path"), lx.LINK_EXCLUDE)
        & ((F.length("_path") > 10) | any_hit(F.col("_path"), lx.LINK_FOLLOW)))
    return rows.select("page", "link").distinct()
