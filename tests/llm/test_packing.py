"""Packing by lexical retrieval: every id in one piece, full windows, BM25 against a plain version."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import SCHEMA, prose, row

from candela.llm import packing, queries, words


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_pieces(docs, pieces, library, window):
    """Pieces of each document follow each other; sequences have no gap and need no padding but the last few."""
    want = Counter()
    for doc_id, text in docs:
        ids = library(text)
        want[(doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    ids_of = defaultdict(list)
    for doc_id, text in docs:
        ids_of[(doc_id, len(library(text)))].append(library(text))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
    assert sum(p.length for p in pieces) == sum(n * k[1] for k, n in want.items())
    for key, found in by_doc.items():
        assert sum(p.length for p in found) == key[1] * len(ids_of[key])
        if len(ids_of[key]) == 1:
            found.sort(key=lambda p: p.start)
            assert [p.start for p in found] == [0, *np.cumsum([p.length for p in found])[:-1].tolist()]
            for p in found:
                part = ids_of[key][0][p.start : p.start + p.length]
                assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        size = sum(n for _, n in parts)
        assert size <= window and size & (size - 1) == 0
    return sequences


def test_pieces_of_all_documents(spark, documents, vocabulary, library):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = packing.pack_documents(documents, vocabulary).collect()
    sequences = check_pieces(rows, found, library, 2048)
    full = sum(sum(n for _, n in s) == 2048 for s in sequences.values())
    assert full * 2048 > 0.8 * sum(p.length for p in found)


def test_awkward_rows(spark, awkward, empty, vocabulary, library):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    for window, shard in ((2048, packing.SHARD), (64, 500)):
        check_pieces(rows, packing.pack_documents(awkward, vocabulary, window=window, shard=shard).collect(), library, window)
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_the_query_has_the_columns_of_the_contract(spark):
    df = queries.QUERIES["op11_retrieval_packing"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [(n, "bigint") for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def test_word_ids_are_those_of_the_library(documents, vocabulary, library):
    texts = [r.text for r in documents.select("text").collect()] + [
        None, "", " ", "don't can't it's, we'll... they'd' 'tis", "a\n\nb \n c\td e f\x1cg", "x.,y z., w.. v.' u,' t'.", "İstanbul ΑΣ ΣΑΣ. ﬁn ǅ",
        "été, क़ क़ . ̸", "12 3.4 a1b2 x² ½", "<|endoftext|> <|startoftext|>.", "🙂🙂. 漢字かな, العربية.", "Word. word, WORD.Word", "a. b. c.\nd, e,"]
    t = words.WordTokenizer(vocabulary, limit=500)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        ids, ends = t.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(x)[:-1] for x in some]


def test_byte_ids_are_those_of_the_library(documents):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [r.text for r in documents.select("text").collect()] + [
        None, "", " ", "\n", "a\n\nb", "a \nb", " a", "a ", "\na", "a\n", "x.\ny, z. ", "a b", "it's. don't, 'tis we'll.", "a\tb\tc", "a b c\u3000d", "été. naïve,\nÉté",
        "a.", "a. ", " .", "1. b 2, c", "\x85 a\x1cb", "\ue000 marked", "one two\ue000.", "a  b   c \n d", "🙂. 漢字,\nعربية.", "<|endoftext|> x\n<|endoftext|>.", "A\nB\nC.\nD"]
    t = words.ByteTokenizer(path, limit=500)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        ids, ends = t.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain.encode(x or "", add_special_tokens=False).ids for x in some]


def plain_scores(items, seed):
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(t for x in items for t in set(x))
    out = []
    for x in items:
        tf, total = Counter(x), 0.0
        for t in set(items[seed]):
            idf = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
            total += idf * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        out.append(total)
    return out


def test_scores_against_a_plain_version():
    rng = np.random.default_rng(1)
    items = [rng.zipf(1.3, rng.integers(1, 60)).clip(1, 300).astype("<u2") for _ in range(80)]
    ids, offsets = np.concatenate(items), np.concatenate([[0], np.cumsum([len(x) for x in items])])
    df = Counter(int(t) for x in items for t in set(x.tolist()))
    index = packing.Index(ids, offsets, packing.idf_table(len(items), df, 400), len(ids) / len(items))
    for seed in range(0, 80, 7):
        assert np.allclose(index.scores(seed), plain_scores([x.tolist() for x in items], seed), rtol=1e-5)


def test_windows_take_the_nearest_unused_items():
    """Each window against a plain greedy search over all open items."""
    rng = np.random.default_rng(4)
    items = [rng.zipf(1.3, rng.integers(5, 40)).clip(1, 300).astype("<u2") for _ in range(120)]
    df = Counter(int(t) for x in items for t in set(x.tolist()))
    mean = sum(map(len, items)) / len(items)
    shard = packing.Shard(64, packing.idf_table(len(items), df, 400), mean, 0)
    for i, x in enumerate(items):
        shard.add(i, x)
    shard.pack()
    got = defaultdict(list)
    for name, start, length, _, _, sequence, offset in shard.rows:
        got[sequence].append((offset, name, start, length))
    left, cut, want = {i: len(x) for i, x in enumerate(items)}, None, []
    while sum(left.values()) >= 64:
        seed = cut if cut is not None else min(left)
        scores = plain_scores([x.tolist() for x in items], seed)
        order = [seed] + sorted((i for i in left if i != seed), key=lambda i: (-round(scores[i], 4), i))
        cut, offset, window = None, 0, []
        for i in order:
            take = min(left[i], 64 - offset)
            if not take:
                break
            window.append((offset, i, len(items[i]) - left[i], take))
            offset += take
            left[i] -= take
            if left[i]:
                cut = i
            else:
                del left[i]
        want.append(window)
    assert [sorted(got[s]) for s in sorted(got)] == want


def test_neighbours_are_related(spark, vocabulary):
    """Documents of four subjects share windows with their own kind; a word of half of the items would weigh nothing."""
    rng = np.random.default_rng(5)
    kinds = [["alpha", "beta", "gamma", "delta", "omega", "sigma"], ["river", "stone", "meadow", "forest", "valley", "garden"],
             ["copper", "silver", "iron", "nickel", "cobalt", "carbon"], ["violin", "piano", "organ", "flute", "guitar", "trumpet"]]
    rows = [row(i, " ".join(rng.choice(kinds[i % 4] + ["the", "of"], 60))) for i in range(400)]
    found = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), vocabulary, window=256).collect()
    windows = defaultdict(set)
    for p in found:
        windows[p.sequence_id].add(p.doc_id % 4)
    assert sum(len(w) == 1 for w in windows.values()) > 0.8 * len(windows)


def test_copies_are_spread_and_whole(spark, vocabulary, library):
    rows = [row(i, prose(1, 40) if i % 3 else prose(i, 40)) for i in range(600)]
    found = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), vocabulary, window=512, shard=3000).collect()
    check_pieces([(r[0], r[1]) for r in rows], found, library, 512)
