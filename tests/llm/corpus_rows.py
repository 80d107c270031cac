"""Rows for the tests of the corpus operators."""

import random

SF = "/root/testdata/sf0.001"
# columns of the table, and names that the operators use for their own results
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot int, pos int, h long, "
          "text_key long, label string, component_id long, fp long, n long, words string, size long, predicted int, spans string")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 1, 2, 3, 4, 5, "x", 6, 7, 8, "w", 9, 1, "s")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota"]) + r.choice(["", "s", "ly", ","]) for _ in range(n))
