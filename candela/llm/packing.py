"""Packing of documents into training windows by lexical retrieval.

A window starts with a seed document; the unused documents with the highest BM25 score for the seed's tokens follow until
the window is full, the last one cut where the window ends.  What is cut off seeds the next window.  A document longer than a
window first gives whole windows of its own.  So every window is full, but for what is left at the end of a task: that is
cut into sequences whose lengths are powers of two, which need no padding either.

* **Ids** are made once and stored as 16-bit numbers, with a sketch of the tokens (two minima of hashed ids).
* **Statistics** (number of items, their mean length, document frequency of each id) cover all documents: counts per task,
  then one aggregation over at most as many rows as the vocabulary has ids; so they are small enough to reach every task.
* **Shards.**  Documents are range-partitioned by sketch, so that related ones meet; ``doc_id`` and a checksum follow in the order, so
  that a large group of copies is spread over partitions.  A task reads its documents in order and indexes ``SHARD`` tokens
  at a time in numpy (postings by token, with the BM25 weight of each); unused documents go over into the next shard.
* Tokens held by more than half of the items weigh nothing (Okapi's logarithm is not positive there), so they have no postings.

Null and empty texts are the end id alone.  Documents without an id are packed like others.  Rows that repeat an id are
documents of their own.  Equal scores go by place in the order.  Very long texts are held one at a time, as ids.  An empty
table gives no piece.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from candela.llm.common import stored
from candela.llm.words import gathered, lines_of, with_ends, word_tokenizer

WINDOW = 2048
END_ID = 1
SHARD = 1 << 20
MOST_ITEMS = 1 << 13
K1, B = 1.2, 0.75
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sketches(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """Two minima of hashed ids for each document (all have the end id, which does not count)."""
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    every = np.arange(max(int(ids.max(initial=0)), end_id) + 1, dtype=np.uint64) + np.uint64(1)
    for m in MIX:
        mixed = every * m
        mixed = ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(40)).astype(np.int64)
        mixed[end_id] = np.iinfo(np.int64).max
        out.append(np.minimum.reduceat(mixed[ids], starts) if len(starts) else np.zeros(0, np.int64))
    return np.stack(out)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, 16 or 32 bits), crc, and the sketch s1, s2 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(vocabulary)
        for b in gathered(batches, 1):
            if not b.num_rows:
                continue
            out, ends = with_ends(*t.encode(b.column(1)), end_id)
            offsets = np.concatenate([[0], ends]) * t.kind.itemsize
            data = out.tobytes()
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            crcs = [zlib.crc32(data[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            s = sketches(out, ends, end_id)
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(crcs, pa.int64()), pa.array(s[0]), pa.array(s[1])], ["doc_id", "ids", "crc", "s1", "s2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, crc long, s1 long, s2 long")


def _joined(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // kind.itemsize


def tails(ids: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ids of each document, past its whole windows, and their offsets."""
    sizes = np.diff(offsets)
    rest = sizes % window
    firsts = np.stack([offsets[1:] - rest, offsets[1:]], 1).reshape(-1)
    out, ends = lines_of(firsts, ids, np.arange(0, 2 * len(sizes), 2))
    return out, np.concatenate([[0], ends])


def term_counts(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, id and count of every distinct id of each item, by item."""
    keys = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) << 32 | ids.astype(np.int64)
    keys.sort()
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool))[0]
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> 32, keys & 0xFFFFFFFF, counts


def statistics(tokens: DataFrame, kind: np.dtype, window: int = WINDOW) -> tuple[int, float, dict[int, int]]:
    """Number of items, their mean length, and in how many each id stands (at most as many as the vocabulary has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(0, np.int64)
        for b in batches:
            ids, offsets = tails(*_joined(b.column(0), kind), window)
            n, total = n + int((np.diff(offsets) > 0).sum()), total + len(ids)
            terms = np.bincount(term_counts(ids, offsets)[1])
            if len(terms) > len(df):
                terms, df = df, terms
            df[: len(terms)] += terms
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n, total, *df[held].tolist()], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = {r["id"]: r["n"] for r in rows.collect()}  # a row per id of the vocabulary
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    return n, total / n if n else 0.0, found


def idf_table(n: int, df: dict[int, int], size: int) -> np.ndarray:
    """Okapi's weight of each id, zero where it is not positive."""
    counts = np.zeros(size)
    counts[list(df)] = list(df.values())
    return np.maximum(0.0, np.log((n - counts + 0.5) / (counts + 0.5))).astype(np.float32)


class Index:
    """BM25 over the items of one shard."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(offsets) - 1
        items, terms, counts = term_counts(ids, offsets)
        keep = idf[terms] > 0
        items, terms, counts = items[keep], terms[keep], counts[keep]
        norm = K1 * (1 - B + B * np.diff(offsets)[items] / max(mean, 1e-9))
        weights = idf[terms] * counts * (K1 + 1) / (counts + norm)
        self.terms, self.of_item = terms, np.concatenate([[0], np.bincount(items, minlength=self.n).cumsum()])
        order = np.argsort(terms, kind="stable")
        self.items, self.weights = items[order], weights[order]
        self.of_term = np.concatenate([[0], np.bincount(terms, minlength=len(idf)).cumsum()])

    def scores(self, item: int) -> np.ndarray:
        """Score of every item for the tokens of one of them."""
        query = self.terms[self.of_item[item] : self.of_item[item + 1]]
        first = self.of_term[query]
        sizes = self.of_term[query + 1] - first
        ends = sizes.cumsum()
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
        return np.bincount(self.items[at], weights=self.weights[at], minlength=self.n)


class Shard:
    """Items (document, ids not yet placed, their first place in the document) that share an index."""

    def __init__(self, window: int, idf: np.ndarray, mean: float, part: int):
        self.window, self.idf, self.mean = window, idf, mean
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, all ids, ids placed
        self.size = 0
        self.sequence = part << 33
        self.rows: list[tuple] = []

    def _piece(self, doc: int, length: int, offset: int) -> None:
        name, ids, start = self.docs[doc]
        self.rows.append((name, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.sequence, offset))
        self.docs[doc] = (name, ids, start + length)
        self.size -= length

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.docs.append((name, ids, 0))
        self.size += len(ids)
        while len(ids) - self.docs[-1][2] >= self.window:
            self._piece(len(self.docs) - 1, self.window, 0)
            self.sequence += 1
        if len(ids) == self.docs[-1][2]:
            self.docs.pop()

    def pack(self) -> None:
        """Full windows as long as there are ids for one; the rest stays."""
        if self.size < self.window:
            return
        left = [ids[start:] for _, ids, start in self.docs]
        sizes = np.array([len(x) for x in left])
        index = Index(np.concatenate(left), np.concatenate([[0], sizes.cumsum()]), self.idf, self.mean)
        open_ = np.ones(len(sizes), bool)
        oldest, cut = 0, -1
        while self.size >= self.window:
            while not open_[oldest]:
                oldest += 1
            seed = cut if cut >= 0 else oldest
            scores = np.where(open_, index.scores(seed), -1.0)
            scores[seed] = np.inf
            near = self._nearest(scores, sizes)
            ends = sizes[near].cumsum()
            last = int(np.searchsorted(ends, self.window))
            offset, cut = 0, -1
            for doc in near[: last + 1].tolist():
                take = min(int(sizes[doc]), self.window - offset)
                self._piece(doc, take, offset)
                offset += take
                sizes[doc] -= take
                if sizes[doc]:
                    cut = doc
                else:
                    open_[doc] = False
            self.sequence += 1
        self.docs = [self.docs[i] for i in np.nonzero(open_)[0]]

    def _nearest(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Open items by falling score, at least as many as fill the window."""
        some = 32
        while some < len(scores):
            best = np.argpartition(-scores, some)[:some]
            best = best[np.lexsort((best, -scores[best]))]
            best = best[scores[best] >= 0]
            if int(sizes[best].sum()) >= self.window:
                return best
            some *= 4
        best = np.lexsort((np.arange(len(scores)), -scores))
        return best[scores[best] >= 0]

    def finish(self) -> None:
        """What is left, in sequences whose lengths are powers of two."""
        self.pack()
        while self.size:
            length, offset = 1 << (self.size.bit_length() - 1), 0
            for doc in range(len(self.docs)):
                name, ids, start = self.docs[doc]
                take = min(len(ids) - start, length - offset)
                if take:
                    self._piece(doc, take, offset)
                    offset += take
            self.sequence += 1

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    t = word_tokenizer(vocabulary)
    kind, size = t.kind, t.size
    tokens = stored(tokenized(docs, vocabulary, end_id), "packed-ids")
    n, mean, df = statistics(tokens, kind, window)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(n, df, size))  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(window, idf.value, mean, TaskContext.get().partitionId())
        for b in batches:
            ids, offsets = _joined(b.column(1), kind)
            for name, s, e in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                held.add(name, ids[s:e].copy())
                if held.size >= shard or len(held.docs) >= MOST_ITEMS:
                    held.pack()
                    yield held.taken()
        held.finish()
        yield held.taken()

    placed = tokens.repartitionByRange("s1", "s2", "doc_id", "crc").sortWithinPartitions("s1", "s2", "doc_id", "crc")
    return placed.select("doc_id", "ids").mapInArrow(run, PIECES)
