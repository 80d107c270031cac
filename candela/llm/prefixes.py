"""Prefix trie of rebuilt conversations; subtree totals by parallel tree contraction.

A conversation ``c`` is rebuilt from the first ``h`` turns of its template ``c - c % 100`` and its own later turns, with
``h = crc32(c as text) % 6``.  Every distinct sequence of its first turns is a node of the trie.

* **Nodes.**  A prefix has as key its length and 128 bits: the exclusive-or over its turns of a hash of (place, MD5 of role
  and text).  Prefix values are made in blocks of places, so a conversation that holds a third of all rows is split; the
  key of the parent is the key without the last turn.  Nodes are grouped with map-side aggregation.
* **Totals.**  ``subtree_sums`` alternates two steps on the nodes that are left.  Rake: leaves hand their total to the
  parent (one aggregation, so a parent with very many children is summed before the shuffle).  Compress: nodes with one
  child left are linked past each other by doubling, until each chain is one link from its top to the node below it.
  Each of the two at least halves what is left of leaves or chains, so a chain of n nodes takes about log2(n) joins.
  Then the links are expanded, last ones first, which gives every node its total.
* **Hashes of members.**  SHA-256 runs over the ids in order.  Ids are sorted by range partitioning and joined to texts of
  bounded size, then these are fed to the hash one after the other, so no list of members is ever held.

Null roles and texts count as empty.  Rows without conv_id belong to no conversation and are left out.  Turns that tie
are ordered by role and text; repeated rows are turns of their own.  Texts of any length only pass as hashes after the
first sort.  An empty table gives no node.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import stored
from candela.operators.ordering import ordered_index

TEMPLATE = 100
LONGEST_HEAD = 6
BLOCK = 4096
JOINED_IDS = 4096
ROOT = "0.0.0"


def _pluck(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n) for n in names])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), body (hash of role and text), n_chars."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_row"))
    placed = ordered_index(rows, ["turn", "role", "text", "_row"], keys=["conv_id"])
    body = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return placed.select("conv_id", (F.col("rn") - 1).alias("pos"), body.alias("body"), F.length("text").cast("long").alias("n_chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, pos, body, n_chars, n_turns), and conv_id with n_turns of each."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LONGEST_HEAD))
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % TEMPLATE).alias("base"), head.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(bases, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn(
        "n_turns", F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(plan.select("conv_id", "h", "n_head", "n_turns"), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "body", "n_chars", "n_turns")
    first = turns.filter(F.col("pos") < LONGEST_HEAD - 1).select(F.col("conv_id").alias("base"), "pos", "body", "n_chars")
    heads = plan.select("conv_id", "base", "h", "n_turns").join(first, "base").filter("pos < h").select(
        "conv_id", "pos", "body", "n_chars", "n_turns")
    return own.unionByName(heads), plan.select("conv_id", "n_turns")


def prefix_rows(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and depth: conv_id, depth, key, parent_key, n_chars, is_end."""
    k1, k2 = F.xxhash64("pos", "body"), F.xxhash64("body", "pos")
    rows = turns.withColumns({"k1": k1, "k2": k2, "blk": F.floor(F.col("pos") / F.lit(block))})
    totals = rows.groupBy("conv_id", "blk").agg(F.bit_xor("k1").alias("t1"), F.bit_xor("k2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = totals.select("conv_id", "blk", *[
        F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    local = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"p{i}": F.bit_xor(f"k{i}").over(local) for i in (1, 2)}).join(carried, ["conv_id", "blk"])
    rows = rows.withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})

    def key(depth: Column, a: Column, b: Column) -> Column:
        return F.concat_ws(".", depth.cast("string"), a.cast("string"), b.cast("string"))

    nodes = rows.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), key(F.col("pos") + 1, F.col("p1"), F.col("p2")).alias("key"),
        key(F.col("pos"), F.col("p1").bitwiseXOR(F.col("k1")), F.col("p2").bitwiseXOR(F.col("k2"))).alias("parent_key"),
        "n_chars", (F.col("pos") + 1 == F.col("n_turns")).alias("is_end"))
    roots = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent_key"),
        F.lit(0).cast("long").alias("n_chars"), (F.col("n_turns") == 0).alias("is_end"))
    return nodes.unionByName(roots)


def subtree_sums(nodes: DataFrame, weights: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Totals of ``weights`` over the subtree of each node of a forest (``id``, ``parent``: null at a root).

    Returns (id, the totals) and (id, n_children).  Ids are unique; every parent is a node.
    """
    a, e, k, s = ([f"_{x}_{w}" for w in weights] for x in "aeks")

    def gathered(alive: DataFrame, leaves: DataFrame | None) -> DataFrame:
        """Nodes with what raked leaves hand over, and the number, one id and the edge values of the children left."""
        zero = F.lit(0).cast("long")
        none = F.lit(None).cast("string")
        parts = [
            alive.select("id", "parent", *a, *e, zero.alias("n_kids"), none.alias("kid"), *[zero.alias(x) for x in k]),
            alive.filter("parent is not null").select(
                F.col("parent").alias("id"), none.alias("parent"), *[zero.alias(x) for x in a + e], F.lit(1).cast("long").alias("n_kids"),
                F.col("id").alias("kid"), *[F.col(x).alias(y) for x, y in zip(e, k)])]
        if leaves is not None:
            parts.append(leaves.select(
                F.col("parent").alias("id"), none.alias("parent"), *[(F.col(x) + F.col(y)).alias(x) for x, y in zip(a, e)],
                *[zero.alias(x) for x in e], zero.alias("n_kids"), none.alias("kid"), *[zero.alias(x) for x in k]))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("id").agg(F.max("parent").alias("parent"), *[F.sum(x).alias(x) for x in a + e], F.sum("n_kids").alias("n_kids"),
                                      F.max("kid").alias("kid"), *[F.sum(x).alias(x) for x in k])

    def chains(unary: DataFrame) -> list[DataFrame]:
        """Parts of (id, end, s, top, parent, e): each chain node linked to the node below its chain."""
        below = unary.select(F.col("kid").alias("id"), F.lit(True).alias("_below"))
        active = stored(unary.join(below, "id", "left").select(
            "id", F.col("kid").alias("end"), *[(F.col(x) + F.col(y)).alias(z) for x, y, z in zip(a, k, s)],
            F.col("_below").isNull().alias("top"), "parent", *e), "chain")
        done: list[DataFrame] = []
        while not active.isEmpty():
            ahead = reduce(DataFrame.unionByName, [*done, active]).select(
                F.col("id").alias("end"), F.col("end").alias("_end"), *[F.col(x).alias("_" + x) for x in s])
            moved = stored(active.join(ahead, "end", "left").select(
                "id", F.coalesce("_end", "end").alias("end"), *[(F.col(x) + F.coalesce("_" + x, F.lit(0))).alias(x) for x in s],
                "top", "parent", *e, F.col("_end").isNotNull().alias("_moved")), "chain")
            done.append(moved.filter("not _moved").drop("_moved"))
            active = moved.filter("_moved").drop("_moved")
        return done

    alive = nodes.select("id", "parent", *[F.col(w).cast("long").alias(x) for w, x in zip(weights, a)], *[F.lit(0).cast("long").alias(x) for x in e])
    state = first = stored(gathered(alive, None), "trie")
    finished, links = [], []
    leaf, single = F.col("parent").isNotNull() & (F.col("n_kids") == 0), F.col("parent").isNotNull() & (F.col("n_kids") == 1)
    while True:
        leaves = state.filter(leaf)
        if leaves.isEmpty():  # then only roots are left
            finished.append(state)
            break
        finished.append(leaves)
        state = stored(gathered(state.filter(~leaf), leaves), "trie")
        unary = state.filter(single)
        if unary.isEmpty():
            continue
        linked = reduce(DataFrame.unionByName, chains(unary))
        links.append(linked)
        tops = linked.filter("top").select(
            F.col("end").alias("id"), F.col("parent").alias("_parent"), *[(F.col(x) + F.col(y)).alias("_" + y) for x, y in zip(s, e)])
        state = stored(state.filter(~single).join(tops, "id", "left").select(
            "id", F.coalesce("_parent", "parent").alias("parent"), *a, *[F.coalesce("_" + x, x).alias(x) for x in e], "n_kids"), "trie")
    totals = reduce(DataFrame.unionByName, [f.select("id", *[F.col(x).alias(w) for x, w in zip(a, weights)]) for f in finished])
    for linked in reversed(links):
        known = totals.select(F.col("id").alias("end"), *weights)
        found = stored(linked.select("id", "end", *s).join(known, "end").select(
            "id", *[(F.col(w) + F.col(x)).alias(w) for w, x in zip(weights, s)]), "trie-totals")
        totals = totals.unionByName(found)
    return totals, first.select("id", F.col("n_kids").alias("n_children"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of each node, in order, joined to texts of at most JOINED_IDS ids."""
    for b in batches:
        if b.empty:
            continue
        run = (b["key"] != b["key"].shift()).cumsum()
        part = b.groupby(run).cumcount() // JOINED_IDS
        grouped = b.groupby([run, part], sort=False)
        yield pd.DataFrame({
            "key": grouped["key"].first().to_numpy(), "first_id": grouped["conv_id"].first().to_numpy(),
            "ids": grouped["conv_id"].agg(lambda x: ",".join(map(str, x))).to_numpy()})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for b in batches:
        keys, digests = [], []
        for k, ids in zip(b["key"], b["ids"]):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key), digests.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "digest": pd.Series(digests, dtype=object)})
    if state is not None:
        yield pd.DataFrame({"key": [key], "digest": [state.hexdigest()]})


def member_digests(ends: DataFrame) -> DataFrame:
    """``key`` and the SHA-256 of its conv_ids, ascending and joined by commas."""
    joined = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(
        _chunks, "key string, first_id long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first_id").mapInPandas(_hashed, "key string, digest string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (characters of turns that
    further members share, over the subtree) and ends_sha256 (of the members that end here).
    """
    turns = stored(ordered_turns(conversations), "turns")
    rows = stored(prefix_rows(*rebuilt(turns)), "prefixes")
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"))
    nodes = stored(nodes, "nodes")
    parents = nodes.filter("parent_key is not null").select(F.col("parent_key").alias("key")).distinct().withColumn("_inner", F.lit(True))
    weighed = nodes.join(parents, "key", "left").select(
        F.col("key").alias("id"), F.col("parent_key").alias("parent"), F.when(F.col("_inner"), 0).otherwise(1).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    totals, children = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    digests = member_digests(rows.filter("is_end"))
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    own = nodes.join(totals.withColumnRenamed("id", "key"), "key").join(children.withColumnRenamed("id", "key"), "key").join(digests, "key", "left")
    return own.join(above, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
