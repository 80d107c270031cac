"""Prefix trie and repair of conversations against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from candela.llm import prefixes, queries, repair

SCHEMA = ("conv_id long, turn long, role string, text string, pos long, key string, id string, n long, kind int, conv string, rn long, "
          "letter string, depth long, parent string, audit string, body string")
EXTRA = (1, "k", "i", 2, 3, "c", 4, "l", 5, "p", "a", "b")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def awkward_rows():
    r = random.Random(5)
    rows = []
    for c in [0, 3, 7, 99, 100, 101, 102, 150, 199, 205, 207, 2**60 + 200, 2**60 + 203]:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], r.choice(["Yes.", "No!", "And", "", "  \n", "é🙂?", "Yes.\t"])))
    rows += [(300, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(130)]  # a long chain, and one that leaves it late
    rows += [(301, t, ("user", "assistant")[t % 2], f"turn {t}." if t < 100 else "other") for t in range(120)]
    rows += [(400, 0, "user", "same."), (400, 0, "user", "same."), (400, 0, "assistant", "tie"), (400, None, None, None), (400, None, "system", "x" * 50_000)]
    rows += [(None, 0, "user", "no id."), (None, None, None, None), (500, None, None, None), (501, 5, "tool", "out of place"), (501, 9, "USER", "up.")]
    rows += [(600 + i, 0, "user", "Hello?") for i in range(30)] + [(600 + i, 1, "assistant", f"{i}.") for i in range(0, 30, 3)]
    return rows


def test_awkward_ids_meet_every_damage():
    kinds = {zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in awkward_rows()}
    assert {0, 1, 2, 3, 4} <= kinds


# 12 -----------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *sums[p],
                  hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
    return sorted(map(repr, out.values()))


@pytest.fixture(scope="module")
def plain_rows(spark):
    return [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]


def test_trie(spark, plain_rows):
    for rows in (awkward_rows(), plain_rows):
        assert sorted(repr(tuple(r)) for r in prefixes.prefix_trie(frame(spark, rows)).collect()) == brute_trie(rows)


def test_trie_of_no_rows(spark):
    assert prefixes.prefix_trie(frame(spark, [])).count() == 0


def test_prefixes_in_small_blocks(spark):
    turns = prefixes.ordered_turns(frame(spark, awkward_rows()))
    a, b = ({tuple(r) for r in prefixes.prefix_rows(*prefixes.rebuilt(turns), block=n).collect()} for n in (4, 4096))
    assert a == b


def test_sums_over_random_forests(spark):
    r = random.Random(1)
    rows = [(str(i), None if i < 2 else str(i - 1 if r.random() < 0.8 else r.randrange(i)), r.randrange(5), 1) for i in range(400)]
    want = {i: [w, v] for i, _, w, v in rows}
    for i, p, *_ in reversed(rows):
        if p is not None:
            want[p][0] += want[i][0]
            want[p][1] += want[i][1]
    totals, _ = prefixes.subtree_sums(spark.createDataFrame(rows, "id string, parent string, w long, v long"), ["w", "v"])
    assert {x.id: [x.w, x.v] for x in totals.collect()} == want


def test_long_lists_of_ids_are_hashed_in_parts(spark):
    n = 3 * prefixes.JOINED_IDS + 5
    ends = spark.range(n).selectExpr("if(id % 7 = 0, 'b', 'a') AS key", "id AS conv_id")
    got = {r.key: r.digest for r in prefixes.member_digests(ends).collect()}
    for key in "ab":
        ids = ",".join(str(i) for i in range(n) if (i % 7 == 0) == (key == "b"))
        assert got[key] == hashlib.sha256(ids.encode()).hexdigest()


# 13 -----------------------------------------------------------------------------------------------------------------

def legal(initials):
    if initials[:1] == "s":
        initials = initials[1:]
        return initials == "ua" * (len(initials) // 2) and initials != ""
    return initials == "ua" * (len(initials) // 2)


def brute_edits(letters):
    """All edits of a few rows."""
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    best = None
    options = []
    for x in letters:
        more = 3 if x.isupper() else 0
        one = [(4, "D", "")]
        if x != "-":
            one += [(more, "K", x.lower()), (3 + more, "R", "u"), (3 + more, "R", "a")]
        options.append(one)
    for edits in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(letters) + 1):
            initials = "".join(i[1] + e[2] for i, e in zip(ins, [*edits, (0, "", "")]))
            if not legal(initials):
                continue
            audit = "".join(i[0] + e[1] for i, e in zip(ins, [*edits, (0, "", "")]))
            best = min(best or (10**9, ""), (sum(e[0] for e in edits) + 3 * audit.count("I"), audit))
    return best


def test_matrices_against_all_edits():
    r = random.Random(2)
    cases = [""] + list(repair.LETTERS) + ["".join(r.choice(repair.LETTERS) for _ in range(n)) for n in (2, 3) for _ in range(25)]
    for letters in cases:
        m = {(i, i): (0, repair.Rope(None, None, "")) for i in range(4)}
        for x in letters:
            m = repair.times(m, repair.letter(x))
        assert repair.outcome(m) == brute_edits(letters), letters
        assert repair.to_text(repair.from_text(repair.to_text(m))) == repair.to_text(m)


def test_products_in_any_grouping():
    r = random.Random(3)
    for _ in range(200):
        ms = [repair.letter(r.choice(repair.LETTERS)) for _ in range(6)]
        left, right = ms[0], ms[-1]
        for m in ms[1:]:
            left = repair.times(left, m)
        for m in reversed(ms[:-1]):
            right = repair.times(m, right)
        assert repair.to_text(left) == repair.to_text(right)


def brute_repair(rows):
    convs = defaultdict(list)
    for n, (c, t, role, text) in enumerate(rows):
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs[c]
        if kind:
            new = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
            for copy in range(2 if kind == 3 else 1):
                convs[c].append(((t is not None, t or 0, role, text, n, copy), t, "user" if kind == 4 else role, new))
    out = []
    for c, items in convs.items():
        items.sort(key=lambda x: x[0])
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in items:
            bare = text.strip(repair.WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        turns = [t for _, t, _, _ in items if t is not None]
        initials = [role[:1] for _, _, role, _ in items]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        # forward pass over states with whole audits
        states = {"": (0, "", ())}

        def step(new, key, value):
            if key not in new or value[:2] < new[key][:2]:
                new[key] = value

        def inserted(states):
            for _ in range(2):
                for s, (cost, audit, done) in list(states.items()):
                    nxt = "a" if s == "u" else "u"
                    step(states, nxt, (cost + 3, audit + "I", (*done, ({"u": "user", "a": "assistant"}[nxt], ""))))

        for x, (_, _, role, text) in zip(letters, items):
            inserted(states)
            new = {}
            for s, (cost, audit, done) in states.items():
                step(new, s, (cost + 4, audit + "D", done))
                nxt = "a" if s == "u" else "u"
                if x != "-":
                    more = 3 if x.isupper() else 0
                    step(new, nxt, (cost + 3 + more, audit + "R", (*done, ({"u": "user", "a": "assistant"}[nxt], text))))
                    if x.lower() == nxt or (x.lower() == "s" and s == ""):
                        step(new, x.lower(), (cost + more, audit + "K", (*done, (role, text))))
            states = new
        inserted(states)
        cost, audit, done = min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("options", [{}, {"block": 2, "fan": 2, "rules": 4}, {"block": 7, "fan": 3, "rules": 0}])
def test_repair(spark, options):
    rows = awkward_rows()
    got = repair.repair_conversations(frame(spark, rows), **options).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_repair(rows)


def test_repair_of_plain_and_of_no_rows(spark, plain_rows):
    got = repair.repair_conversations(frame(spark, plain_rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_repair(plain_rows)
    assert repair.repair_conversations(frame(spark, [])).count() == 0


def test_dropped_conversations_stay(spark):
    c = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair_conversations(frame(spark, [(c, 0, "user", "Gone.")])).collect()
    assert [tuple(r) for r in got] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_grammar_expands_to_the_letters(spark):
    texts = spark.createDataFrame([("uauaua", 5), ("suaua", 3), ("u-u-u-", 2), ("aaaaaa", 4)], "letters string, n long")
    grammar, table = repair.learn_grammar(texts, 20)
    for r in table.collect():
        text = r.symbols
        while any(x in grammar for x in text):
            text = "".join(grammar.get(x, x) for x in text)
        assert text == r.letters
    assert max(len(r.symbols) for r in table.collect()) < 6
    assert repair.chosen_pairs([("ab", 5), ("bc", 4), ("cd", 3), ("ca", 9), ("xx", 1)], 9) == ["ca", "cd"]
