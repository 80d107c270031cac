"""Repair of conversations: the cheapest edits that make roles alternate, by a grammar-compressed dynamic program.

A row of a conversation is a letter: its role's class and whether it must go (blank, repeated) or costs more (truncated).
The roles that remain must read ``(s?(ua)+)?``; an automaton with four states (nothing yet, after system, after user, after
assistant) says so, and each letter is a 4 x 4 matrix over (cost, audit) under "cheapest first, then ASCII-least".
Inserted turns are a closure that stands before each letter and at the end.

* **Order of the semiring.**  Audits of the same letters with equal cost are never proper prefixes of each other: each letter
  gives one of K, R and D, so the longer one would only have more I, and each of these costs 3.  So "least audit" survives
  what comes before and after, and products may be taken in any grouping.
* **Grammar.**  Blocks of letters are made distinct, with their counts.  Re-Pair replaces the most frequent pairs of
  neighbouring symbols by new symbols, many pairs a round (no symbol may be a left one and a right one in the same
  round, so no two places overlap).  The grammar has at most ``RULES`` rules; what it does not cover is multiplied letter by
  letter, so its size changes no result.  Each rule has one matrix, made from those of its two symbols, with the audits as
  ropes that are only written out when two costs tie or a result leaves.
* **Long conversations.**  A block has at most ``BLOCK`` rows.  Blocks of one conversation are multiplied in groups of
  ``FAN``, level by level, so no task holds the rows of a conversation.
* **Hash of the result.**  SHA-256 over the repaired rows is sequential by definition: rows stream in order past a
  running hash, and only the audit of the conversation is held.

Null roles, texts, turns and ids count as one space (turns sort first, gaps ignore them).  Rows that tie in turn are ordered
by role and text as they were before the damage.  A conversation without rows after the damage, and an empty table, give zeros and
no row.  Texts of any length pass only through hashes and the running hash.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import stored
from candela.operators.ordering import ordered_index

BLOCK = 256
FAN = 16
RULES = 512
PAIRS = 256
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
# letters: role class (s, u, a, other) without fault, the same truncated, and rows that must go
CLASSES = "suax"
LETTERS = CLASSES + CLASSES.upper() + "-"
FIRST_SYMBOL = 0xE000  # rules are characters of the private use area


# Matrices ---------------------------------------------------------------------------------------------------------------

class Rope:
    """A text made of two ropes; written out on demand, once."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left: "Rope | None", right: "Rope | None", text: str | None = None):
        self.left, self.right, self.text = left, right, text

    def __str__(self) -> str:
        if self.text is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.text is None:
                    todo += [rope.right, rope.left]
                else:
                    parts.append(rope.text)
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


Matrix = dict[tuple[int, int], tuple[int, Rope]]  # only the entries that are possible


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    if a is None or b[0] < a[0] or (b[0] == a[0] and str(b[1]) < str(a[1])):
        return b
    return a


def times(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (c, r) in x.items():
        for j in range(4):
            if (k, j) in y:
                d, q = y[k, j]
                out[i, j] = better(out.get((i, j)), (c + d, Rope(r, q)))
    return out


def _entry(cost: int, audit: str) -> tuple[int, Rope]:
    return cost, Rope(None, None, audit)


INSERTED: Matrix = {
    **{(i, i): _entry(0, "") for i in range(4)},
    **{(i, USER): _entry(INSERT, "I") for i in (START, SYSTEM, ASSISTANT)}, (USER, ASSISTANT): _entry(INSERT, "I"),
    **{(i, ASSISTANT): _entry(2 * INSERT, "II") for i in (START, SYSTEM)}}


def letter(symbol: str) -> Matrix:
    """The row of one letter, with the insertions before it."""
    row: Matrix = {(i, i): _entry(DELETE, "D") for i in range(4)}
    if symbol != "-":
        more = TRUNCATED if symbol.isupper() else 0
        moves = [(i, USER) for i in (START, SYSTEM, ASSISTANT)] + [(USER, ASSISTANT)]
        for i, j in moves:
            row[i, j] = better(row.get((i, j)), _entry(REROLE + more, "R"))
        kept = {"s": [(START, SYSTEM)], "u": moves[:3], "a": moves[3:]}.get(symbol.lower(), [])
        for i, j in kept:
            row[i, j] = better(row.get((i, j)), _entry(more, "K"))
    return times(INSERTED, row)


def to_text(m: Matrix) -> str:
    return "|".join(f"{m[i, j][0]}:{m[i, j][1]}" if (i, j) in m else "" for i in range(4) for j in range(4))


def from_text(text: str) -> Matrix:
    out: Matrix = {}
    for n, part in enumerate(text.split("|")):
        if part:
            cost, audit = part.split(":")
            out[divmod(n, 4)] = _entry(int(cost), audit)
    return out


def outcome(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    whole = times(m, INSERTED)
    best = None
    for j in (START, ASSISTANT):
        if (START, j) in whole:
            best = better(best, whole[START, j])
    return best[0], str(best[1])


# Grammar ----------------------------------------------------------------------------------------------------------------

def chosen_pairs(counts: list[tuple[str, int]], room: int) -> list[str]:
    """Most frequent pairs first; no symbol is left in one pair and right in another."""
    left: set[str] = set()
    right: set[str] = set()
    out = []
    for pair, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        if n < 2 or len(out) >= room:
            break
        a, b = pair
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a), right.add(b), out.append(pair)
    return out


def replaced(text: str, names: dict[str, str]) -> str:
    return re.sub("|".join(map(re.escape, names)), lambda m: names[m[0]], text) if names else text


def learn_grammar(texts: DataFrame, rules: int = RULES) -> tuple[dict[str, str], DataFrame]:
    """Re-Pair over the distinct ``letters`` of ``texts`` (with their counts ``n``).

    Returns the rules in the order they were made (symbol: its pair) and the table with the column ``symbols``.
    """
    state = stored(texts.select("letters", "n", F.col("letters").alias("symbols")), "grammar")
    grammar: dict[str, str] = {}
    while len(grammar) < rules:
        pairs = state.filter(F.length("symbols") > 1).select("n", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("symbols") - 1), lambda i: F.col("symbols").substr(i, F.lit(2)))).alias("pair"))
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        new = chosen_pairs([(r["pair"], r["n"]) for r in counts], rules - len(grammar))
        if not new:
            break
        names = {pair: chr(FIRST_SYMBOL + len(grammar) + i) for i, pair in enumerate(new)}
        grammar.update({symbol: pair for pair, symbol in names.items()})
        shorter = F.pandas_udf(lambda s, names=names: s.map(lambda x: replaced(x, names)), "string")
        state = stored(state.withColumn("symbols", shorter("symbols")), "grammar")
    return grammar, state


def rule_matrices(grammar: dict[str, str]) -> dict[str, Matrix]:
    """One matrix per symbol, bottom-up."""
    out = {x: letter(x) for x in LETTERS}
    for symbol, (a, b) in grammar.items():
        out[symbol] = times(out[a], out[b])
    return out


def block_matrices(texts: DataFrame, grammar: dict[str, str]) -> DataFrame:
    """``letters`` and the ``matrix`` of each distinct block, as text."""
    held: dict[str, dict[str, Matrix]] = {}

    def product(symbols: pd.Series) -> pd.Series:
        if not held:
            held["m"] = rule_matrices(grammar)
        return symbols.map(lambda x: to_text(reduce(times, [held["m"][c] for c in x])))

    return texts.select("letters", F.pandas_udf(product, "string")("symbols").alias("matrix"))


def _product(column: pd.Series) -> pd.Series:
    return column.map(lambda parts: to_text(reduce(times, map(from_text, parts))))


def _outcome(column: pd.Series) -> pd.DataFrame:
    found = [outcome(from_text(x)) for x in column]
    return pd.DataFrame({"cost": [c for c, _ in found], "audit": [a for _, a in found]})


def cheapest_edits(rows: DataFrame, block: int = BLOCK, fan: int = FAN, rules: int = RULES) -> DataFrame:
    """Cost and audit of each conversation; ``rows``: conv, pos (from 0, without gaps), letter."""
    blocks = stored(rows.select("conv", F.floor(F.col("pos") / F.lit(block)).alias("blk"), "pos", "letter").groupBy("conv", "blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("letters")), "blocks")
    grammar, texts = learn_grammar(blocks.groupBy("letters").agg(F.count(F.lit(1)).alias("n")), rules)
    matrices = stored(block_matrices(texts, grammar), "matrices")
    level = blocks.join(matrices, "letters").select("conv", "blk", "matrix")
    most = blocks.agg(F.max("blk")).first()[0]
    product = F.pandas_udf(_product, "string")
    while most:
        level = stored(level.groupBy("conv", F.floor(F.col("blk") / F.lit(fan)).alias("blk")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("blk", "matrix"))), lambda x: x["matrix"]).alias("parts")).select(
            "conv", "blk", product("parts").alias("matrix")), "levels")
        most //= fan
    found = F.pandas_udf(_outcome, "cost long, audit string")
    return level.select("conv", found("matrix").alias("_r")).select("conv", "_r.cost", "_r.audit")


# Damage, faults, repaired texts ---------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage: conv (id as text), pos (from 0), turn, role, text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        space("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
        F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("kind"),
        F.monotonically_increasing_id().alias("_row")).filter("kind != 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = ordered_index(rows.withColumn("_copy", F.explode(copies)), ["turn", "role", "text", "_row", "_copy"], keys=["conv"])
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return placed.select("conv", (F.col("rn") - 1).alias("pos"), "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                         text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """conv, pos, turn, initial, the first fault (blank, duplicate, truncated or null) and the letter of each row."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    seen = rows.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
                       (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("open"),
                       F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256).alias("body"))
    seen = stored(seen, "faults")
    first = seen.groupBy("conv", "body").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("-")).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return seen.join(first, ["conv", "pos"], "left").withColumn("fault", fault).select("conv", "pos", "turn", "initial", "fault", symbol.alias("letter"))


def illegal_pairs(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Number of neighbours whose initials are none of su, ua and au; blocks of rows, each with the last row before it."""
    own = F.floor(F.col("pos") / F.lit(block))
    targets = F.array_compact(F.array(own, F.when(F.pmod(F.col("pos"), F.lit(block)) == block - 1, own + 1)))
    spread = rows.select("conv", "pos", "initial", own.alias("own"), F.explode(targets).alias("blk"))
    before = F.lag("initial").over(Window.partitionBy("conv", "blk").orderBy("pos"))
    pairs = spread.withColumn("pair", F.concat(before, F.col("initial"))).filter("blk = own and pair is not null")
    return pairs.groupBy("conv").agg(F.sum((~F.col("pair").isin("su", "ua", "au")).cast("long")).alias("illegal"))


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state = None, None

    class State:
        def __init__(self, audit: str):
            self.audit, self.at, self.turn, self.some, self.hash = audit, 0, 0, False, hashlib.sha256()

        def put(self, role: str, text: str) -> None:
            if self.some:
                self.hash.update(b"\n")
            self.some = True
            self.hash.update(f"{role}:{text}".encode())

        def next_role(self) -> str:
            self.turn += 1
            return ("user", "assistant")[(self.turn - 1) % 2]

        def insertions(self) -> None:
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.put(self.next_role(), "")
                self.at += 1

        def row(self, role: str, text: str) -> None:
            self.insertions()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.turn += role[:1] != "s"
                self.put(role, text)
            elif edit == "R":
                self.put(self.next_role(), text)

    for b in batches:
        convs, digests = [], []
        for c, role, text, audit in zip(b["conv"], b["role"], b["text"], b["audit"]):
            if c != conv:
                if state is not None:
                    state.insertions()
                    convs.append(conv), digests.append(state.hash.hexdigest())
                conv, state = c, State(audit)  # the audit stands before the rows
            else:
                state.row(role, text)
        yield pd.DataFrame({"conv": pd.Series(convs, dtype=object), "digest": pd.Series(digests, dtype=object)})
    if state is not None:
        state.insertions()
        yield pd.DataFrame({"conv": [conv], "digest": [state.hash.hexdigest()]})


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """SHA-256 of the repaired rows ``role:text``, joined by line ends."""
    none = F.lit(None).cast("string")
    both = rows.select("conv", "pos", "role", "text", none.alias("audit")).unionByName(
        edits.select("conv", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit"))
    return both.repartition("conv").sortWithinPartitions("conv", "pos").mapInPandas(_repaired, "conv string, digest string")


def repair_conversations(conversations: DataFrame, block: int = BLOCK, fan: int = FAN, rules: int = RULES) -> DataFrame:
    """One row per conversation: faults after the damage, cheapest edits, and the hash of the repaired rows."""
    rows = stored(damaged(conversations), "damaged")
    marked = stored(faults(rows), "marked")
    counted = lambda f: F.sum((F.col("fault").eqNullSafe(F.lit(f))).cast("long")).alias(f)
    counts = marked.groupBy("conv").agg(
        counted("blank"), counted("duplicate"), counted("truncated"),
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    edits = stored(cheapest_edits(marked, block, fan, rules), "edits")
    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    found = every.join(counts, "conv", "left").join(illegal_pairs(marked), "conv", "left").join(edits, "conv", "left").join(
        repaired_digests(rows, edits), "conv", "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
