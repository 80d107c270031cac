"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

1. Each text becomes a fingerprint: numpy counts the bits of the hashes of its shingles.  64 bits use XXH64 (seed 42),
   wider fingerprints the 128-bit XXH3 values of several seeds.
2. Equal fingerprints collapse to one row.  Rows are put into *cells*, and only cells that can hold pairs within the
   radius meet.  For a small radius a cell is the four population counts of the 16-bit parts: two fingerprints within the
   radius have counts whose differences sum to at most the radius.  For a large radius a cell is a range of the number of
   shingles: texts of the similarity that is asked for have numbers of shingles in the same or the next range.
3. Cells are cut into tiles of about ``tile`` fingerprints.  A pair of tiles is skipped when the ranges of their population counts
   are further apart than the radius, else it is compared in full with exclusive-or and bit counts in numpy.
   It gives a spanning forest of its links, never all pairs, so dense groups stay small and no link between components
   is lost.  Pairs of tiles are dealt out by tile, so a large cell is the work of many tasks.
4. Components come from rounds of large-star and small-star steps, each written to the shared folder.
5. For near copies these components only gather candidates: their fingerprints are made of distinct shingles, with a
   radius well beyond the similarity that is asked for.  Inside each of them the sets of shingles are compared, and only
   pairs that are similar enough are links; components of those links are the groups.  Components of many shingles are
   cut into tiles of about ``TILE_SHINGLES``, compared two by two.

Null and empty texts have fingerprint zero and are linked like any other.  Rows without an id take part; the component
id is the smallest id that is there (null if there is none).  Repeated rows get the same answer each.  An empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import long_id, stored

WIDTH = 3
RADIUS = 2
BITS = 64
PARTS = 4
TILE = 4096
ROWS_AT_ONCE = 512
TILE_SHINGLES = 1 << 19

# near copies: sets of five-word shingles of similarity 0.8 differ in about 15 % of the bits, 39 of 256 (48 for four shingles
# against five), with a deviation of 6; unrelated ones in 128
COPY_WIDTH, COPY_BITS, COPY_RADIUS, COPY_SIMILARITY = 5, 256, 76, 0.8


def _hashes(shingles: list[bytes], bits: int) -> np.ndarray:
    """One row of ``bits // 8`` bytes per shingle."""
    import xxhash

    if bits == 64:
        h = xxhash.xxh64_intdigest
        return np.array([h(s, 42) for s in shingles], "<u8").view(np.uint8).reshape(-1, 8)
    d = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([d(s, seed) for s in shingles for seed in range(bits // 128)]), np.uint8).reshape(-1, bits // 8)


def _shingles(words: list[bytes], width: int) -> Iterator[list[bytes]]:
    """All shingles, a long text in bounded pieces."""
    for at in range(0, max(1, len(words) - width + 1), 16384):
        some = words[at : at + 16384 + width - 1]
        if len(some) <= width:
            yield [b" ".join(some)]
        elif width == 3:
            yield [b"%b %b %b" % t for t in zip(some, some[1:], some[2:])]
        else:
            yield [b" ".join(t) for t in zip(*(some[i:] for i in range(width)))]


def fingerprint(data: bytes, width: int = WIDTH, bits: int = BITS) -> tuple[np.ndarray, int]:
    """64-bit words of the majority of each bit over all shingles, and the number of shingles; A-Z is lower-cased."""
    words = data.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(bits // 64, np.uint64), 0
    n = max(1, len(words) - width + 1)
    total = np.zeros(bits, np.int64)
    for shingles in _shingles(words, width):
        total += np.unpackbits(_hashes(shingles, bits), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view("<u8"), n


def shingle_set(data: bytes, width: int = COPY_WIDTH, bits: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles, and the ``bits`` wide hashes in the same order."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros((0, bits // 8), np.uint8)
    wide = np.concatenate([_hashes(shingles, bits) for shingles in _shingles(words, width)])
    short, at = np.unique(np.ascontiguousarray(wide[:, :8]).view("<u8")[:, 0], return_index=True)
    return short, wide[at]


def set_fingerprint(data: bytes, width: int, bits: int) -> tuple[int, np.ndarray, int]:
    """Key of the set of shingles, words of the majority of each bit over it, and its size."""
    import xxhash

    short, wide = shingle_set(data, width, bits)
    total = np.zeros(bits, np.int64)
    for at in range(0, len(wide), 16384):
        total += np.unpackbits(wide[at : at + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return xxhash.xxh64_intdigest(short.tobytes(), 42), np.packbits(2 * total > len(short), bitorder="little").view("<u8"), len(short)


def fingerprints(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """(doc_id, text_key, node, fp, n): ``fp`` the words of the fingerprint, ``node`` its key, ``n`` its shingles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fingerprint(t.encode() if isinstance(t, str) else b"", width, bits) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": [f.view(np.int64) for f, _ in found], "n": [n for _, n in found]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("text_key"))
    made = long_id(rows.mapInPandas(run, "doc_id string, text_key long, fp array<long>, n long"))
    return made.withColumn("node", F.col("fp")[0] if bits == 64 else F.xxhash64("fp"))


def set_fingerprints(docs: DataFrame, width: int = COPY_WIDTH, bits: int = COPY_BITS) -> DataFrame:
    """As ``fingerprints``, over distinct shingles; ``node`` is the key of the set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [set_fingerprint(t.encode() if isinstance(t, str) else b"", width, bits) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": [f.view(np.int64) for _, f, _ in found],
                                "n": [n for _, _, n in found], "node": np.array([k for k, _, _ in found], np.uint64).view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("text_key"))
    return long_id(rows.mapInPandas(run, "doc_id string, text_key long, fp array<long>, n long, node long"))


def _forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``hit`` (rows ``a``, columns ``b``) connects, one fewer than there are members."""
    rows, cols = np.nonzero(hit.any(1))[0], np.nonzero(hit.any(0))[0]
    if not len(rows):
        return []
    hit = hit[np.ix_(rows, cols)]
    seen_row, seen_col, links = np.zeros(len(rows), bool), np.zeros(len(cols), bool), []
    for start in range(len(rows)):
        if seen_row[start]:
            continue
        seen_row[start] = True
        stack = [start]
        while stack:  # each row and column enters once
            i = stack.pop()
            for j in np.nonzero(hit[i] & ~seen_col)[0]:
                seen_col[j] = True
                links.append((a[rows[i]], b[cols[j]]))
                new = np.nonzero(hit[:, j] & ~seen_row)[0]
                seen_row[new] = True
                links += [(a[rows[k]], b[cols[j]]) for k in new]
                stack += new.tolist()
    return links


def compare_tiles(a: np.ndarray, b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles: rows of words, and the node of each row."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    links: list[tuple[int, int]] = []
    for at in range(0, len(x), ROWS_AT_ONCE):
        some = x[at : at + ROWS_AT_ONCE]
        far = np.bitwise_count(some[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
        for k in range(1, x.shape[1]):
            far += np.bitwise_count(some[:, None, k] ^ y[None, :, k])
        links += _forest(far <= radius, names_a[at : at + ROWS_AT_ONCE], names_b)
    return [(int(p), int(q)) for p, q in links if p != q]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that a pair within ``radius`` can have; one of each opposite two."""
    all_steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return [s for s in all_steps if s >= (0,) * PARTS]


def cells_by_counts(rows: DataFrame, radius: int) -> tuple[Column, list[int]]:
    """Cell of a 64-bit fingerprint and the distances to the cells it must meet."""
    counts = [F.bit_count(F.shiftrightunsigned(rows["fp"][0], 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(PARTS)]
    base = 32  # counts are 0 to 16, with room for neighbours below and above
    return sum((c + 8) * base**i for i, c in enumerate(counts)).cast("int"), [sum(d * base**i for i, d in enumerate(s)) for s in _steps(radius)]


def cells_by_size(rows: DataFrame, similarity: float) -> tuple[Column, list[int]]:
    """Range of the number of shingles; texts at least that similar are in the same or the next range."""
    step = float(-np.log(similarity - 1e-9))  # a ratio of exactly the similarity must not be rounded beyond the next range
    return F.floor(F.log(F.greatest(rows["n"], F.lit(1)).cast("double")) / F.lit(step)).cast("int"), [0, 1]


def tile_links(rows: DataFrame, cell: Column, steps: list[int], radius: int, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning set of all links between different nodes of ``rows`` (node, fp)."""
    ones = F.aggregate("fp", F.lit(0), lambda a, x: a + F.bit_count(x))
    placed = rows.select("node", "fp", cell.alias("cell"), ones.alias("ones"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("n_tiles"))
    # at most 17^4 cells of counts, or some hundred of sizes: a fixed bound
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("n_tiles")).cast("int"))
    tiles = stored(dealt.groupBy("cell", "part").agg(  # about ``tile`` rows
        F.collect_list(F.struct("node", "fp")).alias("rows"), F.min("ones").alias("low"), F.max("ones").alias("high")).select(
        "cell", "part", "low", "high", F.col("rows.node").alias("nodes"), F.flatten("rows.fp").alias("words")), "tiles")
    place = tiles.select("cell", "part", "low", "high")
    a = place.select(F.col("cell").alias("ca"), F.col("part").alias("pa"), F.col("low").alias("la"), F.col("high").alias("ha"),
                     F.explode(F.array(*[F.lit(o) for o in steps])).alias("_o"))
    b = place.select(F.col("cell").alias("cb"), F.col("part").alias("pb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    pairs = a.join(b, F.col("ca") + F.col("_o") == F.col("cb")).filter(
        ((F.col("_o") != 0) | (F.col("pa") <= F.col("pb"))) & (F.col("la") - F.col("hb") <= radius) & (F.col("lb") - F.col("ha") <= radius)
    ).select("ca", "pa", "cb", "pb")
    left = tiles.select(F.col("cell").alias("ca"), F.col("part").alias("pa"), F.col("nodes").alias("na"), F.col("words").alias("wa"))
    right = tiles.select(F.col("cell").alias("cb"), F.col("part").alias("pb"), F.col("nodes").alias("nb"), F.col("words").alias("wb"))
    work = pairs.join(left, ["ca", "pa"]).join(right, ["cb", "pb"]).select("na", "wa", "nb", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                na, wa, nb, wb = (batch.column(k)[i].values.to_numpy() for k in range(4))
                found += compare_tiles(wa.reshape(len(na), -1), wb.reshape(len(nb), -1), na, nb, radius)
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): smallest node of the component of every node that has a link."""
    edges = stored(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        edges = stored(moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Tile:
    """Sets of shingles: nodes, their fingerprints, and hashes ``values[starts[i]:starts[i + 1]]``."""

    def __init__(self, nodes: np.ndarray, words: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.nodes, self.words, self.sizes, self.values = nodes, words.view(np.uint64).reshape(len(nodes), -1), sizes.astype(np.int64), values
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def similar_links(a: Tile, b: Tile, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the pairs of ``a`` and ``b`` of that similarity connect; pairs beyond the radius are not compared."""
    _, at = np.unique(np.concatenate([a.nodes, b.nodes]), return_inverse=True)
    at_a, at_b = at[: len(a.nodes)], at[len(a.nodes) :]
    group = np.arange(len(at))  # of each node: pairs that are connected already are not compared
    known, in_b = np.unique(b.values, return_inverse=True)
    in_a = np.minimum(np.searchsorted(known, a.values), max(len(known) - 1, 0))
    shared = known[in_a] == a.values if len(known) else np.zeros(len(a.values), bool)
    mark = np.zeros(len(known), bool)
    links: list[tuple[int, int]] = []
    for i, n in enumerate(a.sizes):
        others = group[at_b]
        fit = (others != group[at_a[i]]) & (np.minimum(n, b.sizes) + 1e-9 >= similarity * np.maximum(n, b.sizes))
        if a is b:
            fit[: i + 1] = False
        cols = np.nonzero(fit)[0]
        cols = cols[np.bitwise_count(a.words[i] ^ b.words[cols]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(cols):
            continue
        span = slice(a.starts[i], a.starts[i + 1])
        mine = in_a[span][shared[span]]
        mark[mine] = True
        sizes = b.sizes[cols]
        begin = np.cumsum(sizes) - sizes
        both = np.add.reduceat(mark[in_b[np.repeat(b.starts[cols] - begin, sizes) + np.arange(sizes.sum())]], begin, dtype=np.int64)
        mark[mine] = False
        cols = cols[both + 1e-9 >= similarity * (n + sizes - both)]
        joined, first = np.unique(others[cols], return_index=True)
        links += [(int(a.nodes[i]), int(b.nodes[j])) for j in cols[first]]
        group[np.isin(group, joined)] = group[at_a[i]]
    return links


def similar_pairs(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, radius: int, similarity: float, tile: int) -> DataFrame:
    """(u, v): a spanning set of the links between nodes of a component of candidates whose sets of shingles are similar."""
    wanted = stored(nodes.join(roots, "node").select("node", "fp", "n", "root", "one.*", cells_by_size(nodes, similarity)[0].alias("cell")), "candidates")
    totals = stored(wanted.groupBy("root", "cell").agg(F.sum("n").alias("total")), "totals")
    large = totals.groupBy("root").agg(F.sum("total").alias("all")).filter(F.col("all") > tile).select("root")
    # components of more than a tile, by size: fewer than all shingles / tile times the ranges of a component
    parts = stored(totals.join(F.broadcast(large), "root").select("root", "cell", F.ceil(F.col("total") / F.lit(tile)).cast("int").alias("n_parts")), "parts")
    placed = wanted.join(F.broadcast(parts), ["root", "cell"], "left").select(
        "node", "fp", "root", "id", "key", F.when(F.col("n_parts").isNotNull(), F.col("cell")).otherwise(0).alias("cell"),
        F.coalesce(F.pmod(F.xxhash64("node", F.lit("part")), F.col("n_parts")), F.lit(0)).cast("int").alias("part"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.xxhash64(docs["text"].isNull(), docs["text"]).alias("_key"))
    named = texts.join(placed, texts["_id"].eqNullSafe(placed["id"]) & (texts["_key"] == placed["key"])).select(
        "node", "fp", "root", "cell", "part", "text").dropDuplicates(["node"])

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["values"] = [shingle_set(t.encode() if isinstance(t, str) else b"", width)[0].view(np.int64) for t in b["text"]]
            yield b.drop(columns="text")

    sets = named.mapInPandas(shingled, "node long, fp array<long>, root long, cell int, part int, values array<long>")
    tiles = stored(sets.groupBy("root", "cell", "part").agg(F.collect_list(F.struct("node", "fp", "values")).alias("rows")).select(
        "root", "cell", "part", F.col("rows.node").alias("nodes"), F.flatten("rows.fp").alias("words"),
        F.transform("rows.values", F.size).alias("sizes"), F.flatten("rows.values").alias("values")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                sides = [Tile(*(batch.column(k + c)[i].values.to_numpy() for c in range(4))) for k in range(0, batch.num_columns, 4)]
                found += similar_links(sides[0], sides[-1], radius, similarity)
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    columns = ["nodes", "words", "sizes", "values"]
    inside = tiles.filter(F.size("nodes") > 1).select(*columns).mapInArrow(run, "u long, v long")
    place = tiles.select("root", "cell", "part")
    a, b = (place.select(F.col("root").alias(f"r{x}"), F.col("cell").alias(f"c{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
    pairs = a.join(b, (F.col("ra") == F.col("rb")) & (
        ((F.col("ca") == F.col("cb")) & (F.col("pa") < F.col("pb"))) | (F.col("ca") + 1 == F.col("cb"))))
    left, right = (tiles.select(F.col("root").alias(f"r{x}"), F.col("cell").alias(f"c{x}"), F.col("part").alias(f"p{x}"), *[
        F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    across = pairs.join(left, ["ra", "ca", "pa"]).join(right, ["rb", "cb", "pb"]).select(
        *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns]).mapInArrow(run, "u long, v long")
    return inside.unionByName(across)


def _nodes(rows: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    return stored(rows.groupBy("node").agg(
        F.first("fp").alias("fp"), F.min("n").alias("n"), F.min("doc_id").alias("first_id"), F.min(order).alias("one")), "distinct")


def _grouped(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) of stored fingerprints, their nodes and stored links."""
    roots = components(links)
    groups = stored(nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "groups")
    # stored, so that adaptive execution sees two plain shuffles and can split a component with most of the groups
    least = stored(groups.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = groups.join(least, "root").select("node", "root", "component_id")
    return rows.join(named, "node").select("doc_id", "text_key", F.col("fp")[0].alias("fp"), "component_id", "root")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_key, fp (64 bits), component_id, root (the component's key)."""
    if radius > 3:
        raise ValueError("the cells are made for a small radius; near_copies serves larger ones")
    rows = stored(fingerprints(docs, width), "fingerprints")
    nodes = _nodes(rows)
    return _grouped(rows, nodes, stored(tile_links(nodes, *cells_by_counts(nodes, radius), radius, tile), "links"))


def near_copies(docs: DataFrame, width: int = COPY_WIDTH, bits: int = COPY_BITS, radius: int = COPY_RADIUS,
                similarity: float = COPY_SIMILARITY, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """As ``near_duplicates``, for texts whose sets of shingles have at least that Jaccard similarity."""
    rows = stored(set_fingerprints(docs, width, bits), "fingerprints")
    nodes = _nodes(rows)
    candidates = components(stored(tile_links(nodes, *cells_by_size(nodes, similarity), radius, tile), "links"), "candidate-components")
    links = similar_pairs(docs, nodes, candidates, width, radius, similarity, tile_shingles)
    return _grouped(rows, nodes, stored(links, "similar"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies (smallest id, then smallest text key); all columns are kept."""
    marked = near_copies(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = stored(marked.groupBy("root").agg(F.min(order).alias("w")).select(
        F.col("w.doc_id").alias("_win_id"), F.col("w.text_key").alias("_win_key")), "winners")
    key = F.xxhash64(docs["text"].isNull(), docs["text"])
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_win_id"]) & (key == chosen["_win_key"]))
    return kept.dropDuplicates(["_win_id", "_win_key"]).drop("_win_id", "_win_key")
