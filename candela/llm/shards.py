"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form a group that stays whole.  Groups sorted by size enter the bin with the tightest remaining
capacity that still holds them; the bins stand in a balanced tree ordered by remaining capacity.

All groups of a large corpus cannot be sorted in one place, so packing has two levels with the same rule.  Groups
smaller than ``1 / GRAIN`` of a shard are first packed into bundles of that size, inside each partition, as a stream
sorted by size.  Bundles and large groups together number at most about ``2 * GRAIN`` per shard plus one per partition,
whatever the corpus; these are packed into shards on the driver.

With a number of shards instead of a capacity, the smallest capacity for which that number suffices is found by
bisection; a group larger than an even share gets a shard of its own.  Null texts count as empty.  Rows that repeat are
members of one group.  Slots count the rows of a shard in order of doc_id.  Equal sizes go by the digest of the text, so ties are
settled alike in every run.  Very long texts count with all their bytes.  An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from candela.llm.common import stored
from candela.operators.ordering import ordered_index

GRAIN = 1024
OVERHEAD = 16


class CapacityTree:
    """Balanced (treap) tree of (remaining capacity, bin): insert, and take out the tightest that fits."""

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.rank: list[int] = []
        self.free: list[int] = []
        self.root = -1
        self.seed = 0x2545F491

    def _node(self, key: tuple[int, int]) -> int:
        self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
        if self.free:
            i = self.free.pop()
            self.key[i], self.left[i], self.right[i], self.rank[i] = key, -1, -1, self.seed
            return i
        self.key.append(key), self.left.append(-1), self.right.append(-1), self.rank.append(self.seed)
        return len(self.key) - 1

    def _split(self, t: int, key: tuple[int, int]) -> tuple[int, int]:
        if t < 0:
            return -1, -1
        if self.key[t] < key:
            low, high = self._split(self.right[t], key)
            self.right[t] = low
            return t, high
        low, high = self._split(self.left[t], key)
        self.left[t] = high
        return low, t

    def _merge(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def insert(self, remaining: int, bin_: int) -> None:
        low, high = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(low, self._node((remaining, bin_))), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that is at least ``size``."""
        t, best = self.root, -1
        while t >= 0:
            if self.key[t] >= (size, -1):
                best, t = t, self.left[t]
            else:
                t = self.right[t]
        if best < 0:
            return None
        key = self.key[best]
        low, rest = self._split(self.root, key)
        one, high = self._split(rest, (key[0], key[1] + 1))
        self.free.append(one)
        self.root = self._merge(low, high)
        return key


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each size (given in descending order) and the number of bins; what exceeds the capacity is alone."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        if size > capacity:
            out.append(bins)
            bins += 1
            continue
        found = tree.take(size)
        if found is None:
            found = (capacity, bins)
            bins += 1
        out.append(found[1])
        tree.insert(found[0] - size, found[1])
    return out, bins


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size (descending order): the least capacity that needs no more than ``shards`` bins."""
    rest, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= rest:
        rest -= sizes[alone]
        alone += 1
    left, room = sizes[alone:], shards - alone
    if not left:
        return list(range(alone))
    low = max(-(-rest // room), left[0])
    high = max(low, 2 * low)
    best = best_fit(left, high)[0]
    while low < high:
        middle = (low + high) // 2
        bins, n = best_fit(left, middle)
        if n <= room:
            best, high = bins, middle
        else:
            low = middle + 1
        if high - low < max(1, high // 20000):
            break
    return list(range(alone)) + [b + alone for b in best]


def _bundles(groups: DataFrame, unit: int) -> DataFrame:
    """(digest, bytes, part, bundle): groups below ``unit`` packed inside each partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, bins, part = CapacityTree(), 0, TaskContext.get().partitionId()
        for b in batches:
            numbers = []
            for size in b["bytes"]:
                found = tree.take(int(size))
                if found is None:
                    found = (unit, bins)
                    bins += 1
                numbers.append(found[1])
                if found[0] - size >= OVERHEAD:  # no group is smaller
                    tree.insert(found[0] - int(size), found[1])
            yield b.assign(part=part, bundle=numbers)

    rows = groups.filter(F.col("bytes") < unit).sortWithinPartitions(F.desc("bytes"), "digest")
    return rows.mapInPandas(run, "digest binary, bytes long, part int, bundle int")


def pack(docs: DataFrame, shards: int | None = None, capacity: int | None = None, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Give either ``shards`` or ``capacity`` (bytes of a shard; then their number is as small as best fit finds).
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", F.sha2(text, 256).alias("_hex"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")).select("doc_id", F.unhex("_hex").alias("digest"), "size", "text_crc32"), "sizes")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = capacity if capacity is not None else -(-total // shards)
    unit = max(OVERHEAD + 1, share // grain)
    dealt = groups.repartition("digest")
    small = stored(_bundles(dealt, unit), "bundles")
    large = groups.filter(F.col("bytes") >= unit)
    # a bounded number of rows: see the text above
    items = [(r[2], None, r[0], r[1]) for r in small.groupBy("part", "bundle").agg(F.sum("bytes")).collect()]
    items += [(r[1], bytes(r[0]), None, None) for r in large.select("digest", "bytes").collect()]
    items.sort(key=lambda i: (-i[0], i[1] or b"", i[2] or 0, i[3] or 0))
    sizes = [i[0] for i in items]
    placed = best_fit(sizes, capacity)[0] if capacity is not None else into_shards(sizes, shards)
    spark = docs.sparkSession
    of_bundle = spark.createDataFrame([(i[2], i[3], s) for i, s in zip(items, placed) if i[1] is None], "part int, bundle int, shard int")
    of_group = spark.createDataFrame([(bytearray(i[1]), s) for i, s in zip(items, placed) if i[1] is not None], "digest binary, shard int")
    where = stored(small.join(F.broadcast(of_bundle), ["part", "bundle"]).select("digest", "shard").unionByName(of_group), "placed")
    return ordered_index(rows.join(where, "digest").drop("digest"), ["doc_id"], ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
