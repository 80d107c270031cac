"""Benchmark decontamination with spaced seeds.

A mask picks some of ``SPAN`` consecutive words; the words it skips may differ between a benchmark item and a text.
All masked windows of all texts are hashed and joined to those of the benchmark.  Hits are summed per (text, item,
diagonal), and every such diagonal is verified on the words: an overlap counts when some ``window`` aligned words agree
in at least ``similarity`` of the places.

The benchmark side of the join is broadcast only after its rows were counted (``BROADCAST_ROWS``); a larger benchmark is
joined by shuffling.  The candidate documents of the verification carry lists of any length, so Spark decides by their size.

Items shorter than the window get masks of their whole length for what the others miss (``short_masks``).  Null texts and
items have no words and give no rows.  Rows that repeat an id
with different texts are verified separately and reported under that id.  Of equally good places of an item the first one is
reported.  An empty table or benchmark gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import keyed, lower_words, same, stored, windows

SPAN = 8
MASKS = ("11011010", "10101101", "11100110")
WINDOW = 12
SIMILARITY = 0.8
BROADCAST_ROWS = 1_000_000


def seeds(rows: DataFrame, words: str, keep: list[str], masks=MASKS) -> DataFrame:
    """One row per position and mask: ``pos`` and the hash ``h`` of the words that the mask keeps."""
    width = len(masks[0])
    picked = [
        F.xxhash64(F.lit(m), *[F.col(f"w{i}") for i, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(masks)]
    full = windows(rows, words, width, keep).filter(F.col(f"w{width - 1}").isNotNull())
    return full.select(*keep, "pos", F.explode(F.array(*picked)).alias("h"))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its stored rows number at most ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def short_masks(n: int, masks=MASKS, similarity: float = SIMILARITY) -> list[str]:
    """Masks over all words of an item of ``n`` words, one for each choice of changed words that no mask of ``masks`` avoids."""
    width = len(masks[0])
    kept = [{at + i for i, bit in enumerate(m) if bit == "1"} for m in masks for at in range(n - width + 1)]
    changes = combinations(range(n), n - math.ceil(n * similarity))
    return ["".join("0" if i in c else "1" for i in range(n)) for c in changes if all(k & set(c) for k in kept)]


def candidates(docs: DataFrame, items: DataFrame, masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, item_key, diag) with at least one seed hit.  ``items``: item_key, item_words."""
    bench = stored(seeds(items, "item_words", ["item_key"], masks).withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    words = keyed(docs).select("doc_id", "text_key", lower_words(F.col("text")).alias("words"))
    found = seeds(words, "words", ["doc_id", "text_key"], masks).join(sized(bench), "h")
    size = F.size("item_words")
    for (n,) in items.filter((size > 0) & (size < window)).select(size).distinct().collect():  # fewer than ``window`` rows
        if more := short_masks(n, masks, similarity):
            short = stored(seeds(items.filter(size == n), "item_words", ["item_key"], more).withColumnRenamed("pos", "item_pos").distinct(), "seeds")
            found = found.unionByName(seeds(words, "words", ["doc_id", "text_key"], more).join(sized(short), "h"))
    return found.groupBy("doc_id", "text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("diag")).agg(
        F.count(F.lit(1)).alias("n_hits"))


def _aligned(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a == b).cast("int"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """Verified overlaps, one row per (doc_id, text_key, item_id): the diagonal on which most words agree.

    Columns: doc_id, text_key, item_id, start_word (of the overlap in the text), n_overlap, n_match, best_window,
    similarity (agreeing words / words of the item).
    """
    items = stored(
        benchmark.select("item_id", lower_words(F.col("text")).alias("item_words")).distinct()
        .withColumn("item_key", F.xxhash64(F.col("item_id").isNull(), "item_id", "item_words")), "items")
    found = stored(candidates(docs, items.select("item_key", "item_words"), masks, window, similarity), "candidates")
    per_doc = stored(found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_key", "diag")).alias("at")), "per-doc")
    # the lists above hold the hits of one text
    texts = keyed(docs).select("doc_id", "text_key", "text")
    lists = per_doc
    joined = texts.join(lists, same(texts, lists, "doc_id", "text_key")).select(
        texts["doc_id"], texts["text_key"], "at", lower_words(F.col("text")).alias("words"))
    longest = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    cut = joined.select("doc_id", "text_key", F.explode(F.transform("at", lambda c: F.struct(
        c["item_key"].alias("item_key"), c["diag"].alias("diag"),
        F.slice(F.col("words"), (F.greatest(c["diag"], F.lit(0)) + 1).cast("int"), F.lit(longest)).alias("part")))).alias("c"))
    pieces = cut.select("doc_id", "text_key", "c.item_key", "c.diag", "c.part")
    both = pieces.join(sized(items, 100_000), "item_key").withColumn(
        "_item", F.slice("item_words", (F.greatest(-F.col("diag"), F.lit(0)) + 1).cast("int"), F.size("item_words")))
    n = F.least(F.size("part"), F.size("_item"))
    same_words = both.withColumn("_n", n).withColumn("_eq", _aligned(F.slice("part", F.lit(1), F.col("_n")), F.slice("_item", F.lit(1), F.col("_n"))))
    wide = same_words.withColumn("_w", F.least(F.lit(window), F.size("item_words"))).filter(F.col("_n") >= F.col("_w"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    scored = wide.withColumn("best_window", F.array_max(F.transform(
        F.sequence(F.lit(1), F.col("_n") - F.col("_w") + 1), lambda i: total(F.slice(F.col("_eq"), i, F.col("_w")))))
    ).filter(F.col("best_window") >= F.ceil(F.col("_w") * F.lit(similarity))).withColumn("n_match", total(F.col("_eq")))
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct(
        "n_match", "best_window", (-F.greatest(F.col("diag"), F.lit(0))).alias("_start"), F.col("_n").alias("n_overlap"),
        F.size("item_words").alias("n_item"))).alias("m"))
    return best.select(
        "doc_id", "text_key", "item_id", (-F.col("m._start")).cast("long").alias("start_word"),
        F.col("m.n_overlap").cast("long").alias("n_overlap"), F.col("m.n_match").cast("long").alias("n_match"),
        F.col("m.best_window").cast("long").alias("best_window"), (F.col("m.n_match") / F.col("m.n_item")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; all columns are kept."""
    bad = stored(overlaps(docs, benchmark, **options).select("doc_id", "text_key").distinct(), "contaminated")
    bad = sized(bad.toDF("_bad_id", "_bad_key"))
    key = F.xxhash64(docs["text"].isNull(), docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"]), "left_anti")
