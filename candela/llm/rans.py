"""Token-id files coded with a static range asymmetric numeral system (rANS).

Documents are tokenized in ascending order of their id and cut into segments of about ``SEGMENT`` ids.  A segment holds
one frequency table, counted over all its ids, that its blocks share.  A block is coded alone, in ``LANES``
interleaved states that share one stream of 32-bit words; every ``CHECK`` steps the states and the place in the stream
are kept, so that all stretches between checkpoints decode in parallel.  Each block has a checksum of its ids.
Encoding and decoding advance all lanes of all blocks of a segment together in numpy.

The container is Parquet without compression, one row per segment: its place (part, segment), the ids and lengths of
its documents, and the bytes of the segment.  Spark commits the files, so a lost executor leaves no half-written ones.

Null and empty texts give the end id alone.  Documents without an id come first; rows that repeat an id stand next to
each other in any order.  An empty table gives files without a segment; extra columns are ignored.  A segment is held in memory, nothing larger (a document longer than a segment makes a larger one).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from candela.llm.common import long_id
from candela.llm.words import ByteTokenizer, gathered, with_ends, word_tokenizer

SEGMENT = 2_000_000
LANES = 32
STEPS = 2048
CHECK = 512
LOW = np.uint64(1 << 31)
MAGIC = b"RANS"
HEADER = struct.Struct("<4sQBIIII")
END_ID = 2
SEGMENT_ROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])


def _frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to ``2**bits``; none becomes zero."""
    total = 1 << bits
    f = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-f, kind="stable")
    rest = int(total - f.sum())
    if rest > 0:
        f[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(int(f[i]) - 1, -rest)
        f[i] -= take
        rest += take
    return f


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ids, the place of each id among them, and their counts."""
    if ids.max() >= 1 << 22:  # no vocabulary; sorting needs no table of that size
        return np.unique(ids, return_inverse=True, return_counts=True)
    every = np.bincount(ids)
    symbols = np.nonzero(every)[0]
    place = np.zeros(len(every), np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], every[symbols]


def encode_segment(ids: np.ndarray) -> bytes:
    """Bytes of one segment of ids (unsigned 32-bit)."""
    n = len(ids)
    if not n:
        return HEADER.pack(MAGIC, 0, 0, 0, 0, 0, 0)
    symbols, index, counts = _counted(ids)
    bits = min(24, max(12, int(len(symbols) * 4 - 1).bit_length()))
    freq = _frequencies(counts.astype(np.int64), bits)
    start = np.concatenate([[0], freq.cumsum()[:-1]])
    steps = min(STEPS, -(-n // LANES))
    blocks = -(-n // (steps * LANES))
    padded = np.full(blocks * steps * LANES, int(freq.argmax()), np.int64)
    padded[:n] = index
    padded = padded.reshape(blocks, steps, LANES)
    f64, c64 = freq.astype(np.uint64), start.astype(np.uint64)
    limit = f64 << np.uint64(63 - bits)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    marks = np.zeros((blocks, -(-steps // CHECK), LANES), np.uint64)
    low32, shift = np.uint64(0xFFFFFFFF), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = padded[:, t]
        f = f64[s]
        full = state >= limit[s]
        sent[:, t] = full
        words[:, t] = np.where(full, state & low32, 0)
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << shift) + (state - q * f) + c64[s]
        if t % CHECK == 0:
            marks[:, t // CHECK] = state
    stream = words[sent].tobytes()  # by block, step, lane: the order in which they are read
    per_step = sent.sum(2)
    before = np.zeros_like(per_step)
    before[:, 1:] = per_step.cumsum(1)[:, :-1]
    places = before[:, ::CHECK].astype("<u4")
    flat = np.zeros(blocks * steps * LANES, "<u4")
    flat[:n] = ids
    sums = np.array([zlib.crc32(b.tobytes()) for b in flat.reshape(blocks, -1)], "<u4")
    table = zlib.compress(np.diff(symbols.astype("<i8"), prepend=0).astype("<i8").tobytes() + freq.astype("<u4").tobytes())
    head = HEADER.pack(MAGIC, n, bits, len(symbols), steps, blocks, len(table))
    return b"".join([head, table, per_step.sum(1).astype("<u4").tobytes(), sums.tobytes(), places.tobytes(), marks.astype("<u8").tobytes(), stream])


def decode_segment(data: bytes) -> np.ndarray:
    """Ids of one segment; raises ValueError when a checksum does not match."""
    magic, n, bits, n_symbols, steps, blocks, n_table = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    if not n:
        return np.zeros(0, np.uint32)
    at = HEADER.size
    table = zlib.decompress(data[at : at + n_table])
    at += n_table
    symbols = np.frombuffer(table, "<i8", n_symbols).cumsum()
    freq = np.frombuffer(table, "<u4", n_symbols, 8 * n_symbols).astype(np.uint64)
    start = np.concatenate([[np.uint64(0)], freq.cumsum()[:-1]]).astype(np.uint64)
    checks = -(-steps // CHECK)

    def take(kind: str, shape: tuple[int, ...]) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
        at += out.nbytes
        return out

    lengths, sums = take("<u4", (blocks,)), take("<u4", (blocks,))
    places, marks = take("<u4", (blocks, checks)), take("<u8", (blocks, checks, LANES))
    stream = np.append(np.frombuffer(data, "<u4", int(lengths.sum()), at), np.uint32(0)).astype(np.uint64)
    slot_symbol = np.repeat(np.arange(n_symbols), freq.astype(np.int64))
    first = np.concatenate([[0], lengths.cumsum()[:-1]]).astype(np.int64)
    # every stretch between checkpoints is a group of lanes of its own
    place = (first[:, None] + places).reshape(-1)
    state = marks.reshape(-1, LANES).copy()
    out = np.zeros((blocks * checks, CHECK, LANES), np.int64)
    left = np.minimum(CHECK, steps - np.tile(np.arange(checks) * CHECK, blocks))
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(int(left.max())):
        on = np.nonzero(left > t)[0]
        every = len(on) == len(left)
        x = state if every else state[on]
        slot = x & mask
        s = slot_symbol[slot.astype(np.int64)]
        out[on, t] = s
        x = freq[s] * (x >> shift) + slot - start[s]
        need = x < LOW
        rank = need.cumsum(1)
        read = np.minimum(place[on][:, None] + rank - 1, len(stream) - 1)
        x = np.where(need, (x << np.uint64(32)) | stream[np.maximum(read, 0)], x)
        place[on] += rank[:, -1]
        state = x if every else state
        if not every:
            state[on] = x
    ids = symbols[out.reshape(blocks, checks * CHECK, LANES)[:, :steps].reshape(-1)].astype("<u4")
    ids[n:] = 0
    found = np.array([zlib.crc32(b.tobytes()) for b in ids.reshape(blocks, -1)], "<u4")
    if (found != sums).any():
        raise ValueError(f"checksum of block {int((found != sums).argmax())} does not match")
    return ids[:n]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write the ids of all documents, in ascending order of ``doc_id``, to the folder ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = word_tokenizer(vocabulary, ByteTokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[str | None] = []
        lengths: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, names, lengths, size, number
            tokens = np.concatenate(held).astype("<u4")
            row = pa.RecordBatch.from_pydict({
                "part": [part], "segment": [number], "n_tokens": [len(tokens)], "doc_ids": [names], "lengths": [lengths],
                "data": [encode_segment(tokens)]}, SEGMENT_ROW)
            held, names, lengths, size, number = [], [], [], 0, number + 1
            return row

        for b in gathered(batches, 1):
            if not b.num_rows:
                continue
            ids, ends = with_ends(*encoder.encode(b.column(1)), end_id)
            docs_of, sizes, at = b.column(0).to_pylist(), np.diff(ends, prepend=0), 0
            while at < len(ends):
                before = int(ends[at] - sizes[at])
                upto = min(len(ends), int(np.searchsorted(ends, before + segment - size)) + 1)
                held.append(ids[before : ends[upto - 1]])
                names += docs_of[at:upto]
                lengths += sizes[at:upto].tolist()
                size, at = size + len(held[-1]), upto
                if size >= segment:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        run, "part int, segment int, n_tokens long, doc_ids array<string>, lengths array<long>, data binary").write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (array) and ids_crc32."""
    return _placed(spark, path, True)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files`` without the ids: all blocks are decoded and checked, the ids stay in the tasks."""
    return _placed(spark, path, False)


def _placed(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, number, names, lengths, data in zip(b["part"], b["segment"], b["doc_ids"], b["lengths"], b["data"]):
                ids = decode_segment(data)
                ends = np.cumsum(np.asarray(lengths, np.int64))
                starts = ends - np.asarray(lengths, np.int64)
                parts = [ids[s:e] for s, e in zip(starts, ends)]
                out = pd.DataFrame({
                    "part": part, "segment": number, "doc_id": pd.Series(list(names), dtype=object),
                    "at": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts]})
                if with_ids:
                    out["ids"] = [p.astype(np.int64) for p in parts]
                yield out

    schema = "part int, segment int, doc_id string, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = files.select("part", "segment", "doc_ids", "lengths", "data").mapInPandas(run, schema)
    segments = files.select("part", "segment", "n_tokens")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row per file
    earlier = parts.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(earlier, "part").select(
        "part", "segment", (F.col("_before") + F.col("_in")).alias("_start"))
    return long_id(docs).join(places, ["part", "segment"]).select(
        "doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
