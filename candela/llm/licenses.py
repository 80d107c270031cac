"""License scans by diagonal voting over word bigrams.

Every word bigram of every text is hashed and joined to the positions of the same bigram in a fixed set of templates.
A hit votes for the diagonal (position in the text minus position in the template).  Votes are summed per diagonal.
From every diagonal on, those ahead that keep the span within ``STRETCH`` times the template and ``GAP`` words more are
merged, and the window counts when enough of the template's bigrams were found in it; so hits that lie close behind a
span cannot make it too long.  Windows that begin within ``GAP`` diagonals are one span.  The join compares the words, not only
hashes.

A *phrase* is a short template that must be found whole: all its bigrams on one diagonal.

Null and empty texts give no span, an empty table no row.  Very long texts are exploded by word; the windows of one text
and template are one sorted group.  Labels and places do not depend on the order of equal rows.  Extra columns are ignored.  Rows that repeat an id keep one result each, and rows that repeat id and text share theirs.
Nothing is collected, and the broadcast side is the fixed template table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from candela.llm.common import SEPARATORS, keyed, lower_words, same, values, windows

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening words of widely used notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("rights-reserved", "Copyright. All rights reserved"),
)

# Bigrams made of two of these words say nothing about licenses.
COMMON = frozenset("a all and any are as at by for in is it of on or that the this to with".split())

GAP = 3
COVERAGE = 0.85
STRETCH = 1.5


def template_words(text: str) -> list[str]:
    import re

    return re.findall("[0-9a-z]+", text.lower())


def template_rows(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(tid, label, phrase, n_grams, n_words, tpos, t0, t1): one row per bigram of every template."""
    rows = []
    for tid, (phrase, label, text) in enumerate([(True, b, a) for a, b in phrases] + [(False, a, b) for a, b in templates]):
        words = template_words(text)
        grams = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if phrase or not {a, b} <= COMMON]
        rows += [(tid, label, int(phrase), len(grams), len(words), i, a, b) for i, a, b in grams]
    return rows


def widest(phrases=PHRASES, templates=TEMPLATES) -> int:
    """Diagonals that the longest template may spread over."""
    return max((int(n_words * (STRETCH - 1)) + GAP for _, _, phrase, _, n_words, *_ in template_rows(phrases, templates) if not phrase), default=0)


def template_table(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``template_rows`` with the hash ``h`` of the bigram."""
    table = values(spark, template_rows(phrases, templates), "tid int,label string,phrase int,n_grams int,n_words int,tpos long,t0 string,t1 string")
    return table.withColumn("h", F.xxhash64("t0", "t1"))


def hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """All places where a bigram of a text equals one of a template."""
    words = keyed(docs).select("doc_id", "text_key", lower_words(F.col("text")).alias("words"))
    grams = windows(words, "words", 2, ["doc_id", "text_key"]).withColumn("h", F.xxhash64("w0", "w1"))
    return (
        grams.join(F.broadcast(table), "h")
        .filter((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")))
        .select("doc_id", "text_key", "tid", "label", "phrase", "n_grams", "n_words", "pos", "tpos",
                (F.col("pos") - F.col("tpos")).alias("diag"))
    )


def license_spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: doc_id, text_key, label, phrase, start_word, end_word, coverage."""
    table = template_table(docs.sparkSession, phrases, templates)
    of = ["doc_id", "text_key", "tid", "label", "phrase", "n_grams", "n_words"]
    votes = hits(docs, table).groupBy(*of, "diag").agg(  # at most one element per word of the template
        F.collect_set("tpos").alias("found"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    reach = F.when(F.col("phrase") == 1, 0).otherwise(F.floor(F.col("n_words") * F.lit(STRETCH - 1)).cast("long") + GAP)
    order = Window.partitionBy("doc_id", "text_key", "tid").orderBy("diag")
    ahead = votes.withColumn("_ahead", F.collect_list(F.struct("diag", "found", "first", "last")).over(order.rangeBetween(0, widest(phrases, templates))))
    near = F.filter("_ahead", lambda x: x["diag"] <= F.col("diag") + reach)
    field = lambda n: F.transform("_near", lambda x: x[n])
    windows_of = ahead.withColumn("_near", near).select(
        *of, "diag", F.size(F.array_distinct(F.flatten(field("found")))).alias("n_found"), F.array_min(field("first")).alias("start_word"),
        (F.array_max(field("last")) + 2).alias("end_word"))
    whole = (F.col("phrase") == 1) & (F.col("n_found") == F.col("n_grams"))
    enough = (F.col("phrase") == 0) & (F.col("n_found") >= F.col("n_grams") * F.lit(coverage))
    apart = (F.col("phrase") == 1) | (F.col("diag") - F.lag("diag").over(order) > GAP)
    islands = windows_of.filter(whole | enough).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*of, "_island").agg(
        F.max("n_found").alias("n_found"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select(
        "doc_id", "text_key", "label", "phrase", "start_word", "end_word", (F.col("n_found") / F.col("n_grams")).alias("coverage"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: words, phrase places, labels and the best coverage of any template."""
    spans = license_spans(docs, phrases, templates, coverage)
    base = F.col("phrase") == 1
    found = spans.groupBy("doc_id", "text_key").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start_word"))).alias("first_word"),
        F.max(F.when(base, F.col("start_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),  # few labels
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.sum((~base).cast("long")).alias("n_template_spans"))
    rows = keyed(docs).select("doc_id", "text_key", F.size(lower_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, same(rows, found, "doc_id", "text_key"), "left")
    return joined.select(
        rows["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_template_spans", F.lit(0)).cast("long").alias("n_template_spans"))
