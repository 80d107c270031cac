"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from candela.llm import decontaminate, licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_scan() -> str:
    rows = ", ".join(f"({tid}, '{label}', {phrase}, {grams}, {words}, {tpos}, '{a}', '{b}')"
                     for tid, label, phrase, grams, words, tpos, a, b in licenses.template_rows())
    return f"""WITH t(tid, label, phrase, n_grams, n_words, tpos, a, b) AS (VALUES {rows}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
v AS (SELECT doc_id, tid, label, phrase, n_grams, n_words, pos - tpos AS diag, list(DISTINCT tpos) AS found, min(pos) AS first, max(pos) AS last
    FROM g JOIN t USING (a, b) GROUP BY ALL),
ah AS (SELECT *, list({{'diag': diag, 'found': found, 'first': first, 'last': last}}) OVER (PARTITION BY doc_id, tid ORDER BY diag
    RANGE BETWEEN CURRENT ROW AND {licenses.widest()} FOLLOWING) AS ahead, CASE WHEN phrase = 1 THEN 0 ELSE CAST(floor(n_words * CAST({licenses.STRETCH - 1} AS DOUBLE)) AS BIGINT) + {licenses.GAP} END AS reach FROM v),
m AS (SELECT doc_id, tid, label, phrase, n_grams, diag, len(list_distinct(flatten(list_transform(near, lambda x: x.found)))) AS n_found, list_min(list_transform(near, lambda x: x.first)) AS lo
    FROM (SELECT *, list_filter(ahead, lambda x: x.diag <= diag + reach) AS near FROM ah)),
n AS (SELECT *, CAST(phrase = 1 OR coalesce(diag - lag(diag) OVER o > {licenses.GAP}, true) AS INTEGER) AS new FROM m
    WHERE (phrase = 1 AND n_found = n_grams) OR (phrase = 0 AND n_found >= n_grams * CAST({licenses.COVERAGE} AS DOUBLE)) WINDOW o AS (PARTITION BY doc_id, tid ORDER BY diag)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS island FROM n),
s AS (SELECT doc_id, tid, label, phrase, max(n_found) / CAST(n_grams AS DOUBLE) AS coverage, min(lo) AS lo FROM k GROUP BY doc_id, tid, label, phrase, n_grams, island),
d AS (SELECT doc_id, count(*) FILTER (phrase = 1) AS n_base, min(lo) FILTER (phrase = 1) AS first_word, max(lo) FILTER (phrase = 1) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (phrase = 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    max(coverage) AS score, count(*) FILTER (phrase = 0) AS n_template_spans FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score,
    CAST(coalesce(n_template_spans, 0) AS BIGINT) AS n_template_spans FROM w LEFT JOIN d USING (doc_id)"""


def decontaminated() -> str:
    span = decontaminate.SPAN

    def seeds(source: str, key: str, place: str) -> str:
        masks = " UNION ALL ".join(
            f"SELECT {key}, {place}, {m} AS m, concat_ws(' ', {', '.join(f'ws[i + {j}]' for j, bit in enumerate(mask) if bit == '1')}) AS h FROM e"
            for m, mask in enumerate(decontaminate.MASKS))
        return f"WITH e AS (SELECT {key}, ws, unnest(range(1, len(ws) - {span} + 2)) AS i FROM {source}) SELECT * FROM (SELECT *, 0 AS z FROM ({masks.replace(place, f'i - 1 AS {place}')}))"

    return f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM documents),
q AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM benchmark),
sd AS ({seeds('w', 'doc_id', 'pos')}), sq AS ({seeds('q', 'item_id', 'ipos')}),
c AS (SELECT DISTINCT doc_id, item_id, pos - ipos AS d FROM sd JOIN sq USING (m, h)),
x AS (SELECT doc_id, item_id, d, greatest(d, 0) AS start, len(q.ws) AS n_item, w.ws[greatest(d, 0) + 1 : least(len(w.ws), d + len(q.ws))] AS a,
    q.ws[greatest(-d, 0) + 1 : least(len(q.ws), len(w.ws) - d)] AS b FROM c JOIN w USING (doc_id) JOIN q USING (item_id)),
y AS (SELECT *, len(a) AS n, least({decontaminate.WINDOW}, n_item) AS k, list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] = b[i] AS INTEGER)) AS eq FROM x),
z AS (SELECT *, list_max(list_transform(range(1, n - k + 2), lambda i: list_sum(eq[i : i + k - 1]))) AS best, list_sum(eq) AS n_match FROM y WHERE n >= k)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_overlap, CAST(n_match AS BIGINT) AS n_match, CAST(best AS BIGINT) AS best_window,
    n_match / CAST(n_item AS DOUBLE) AS similarity FROM z WHERE best >= ceil(k * CAST({decontaminate.SIMILARITY} AS DOUBLE))
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_match DESC, best DESC, start, n DESC) = 1"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


def prefix_trie() -> str:
    """Prefixes as lists of turns; subtree totals by joining every node to all prefixes of its smallest member."""
    return f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
p AS (SELECT s.conv_id, s.n, s.conv_id - s.conv_id % 100 AS base, {_crc32('CAST(s.conv_id AS VARCHAR)')} % 6 AS h FROM s),
q AS (SELECT p.*, least(h, coalesce(b.n, 0)) AS n_head, least(h, coalesce(b.n, 0)) + greatest(p.n - h, 0) AS n_turns FROM p LEFT JOIN s b ON b.conv_id = p.base),
r AS (SELECT q.conv_id, pos - h + n_head AS pos, role, text, n_turns FROM q JOIN t USING (conv_id) WHERE pos >= h
    UNION ALL SELECT q.conv_id, pos, role, text, n_turns FROM q JOIN t ON t.conv_id = q.base WHERE pos < h),
m AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, length(text) AS chars, pos + 1 = n_turns AS is_end FROM r
    UNION ALL SELECT conv_id, 0, [], 0, n_turns = 0 FROM q),
n AS MATERIALIZED (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM m GROUP BY prefix, depth),
k AS (SELECT m.conv_id, depth, prefix, n.conv_id AS node FROM n JOIN m USING (prefix, depth)),
u AS (SELECT n.prefix, n.depth, k.node AS parent FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth - 1),
c AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.conv_id AND c.depth = n.depth),
y AS (SELECT k.node, k.depth, sum(CAST(x.n_children = 0 AS BIGINT)) AS n_leaves, sum(x.saved) AS saved_tokens FROM x JOIN k ON k.conv_id = x.conv_id AND k.depth <= x.depth GROUP BY ALL)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.parent AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(y.n_leaves AS BIGINT) AS n_leaves,
    CAST(y.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN y ON y.node = x.conv_id AND y.depth = x.depth LEFT JOIN u ON u.prefix = x.prefix AND u.depth = x.depth"""


def structure_repair() -> str:
    """The dynamic program row by row over all conversations at once; a state is (cost, audit, repaired rows)."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = 10**12

    def plus(state: str, cost: str, audit: str, row: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {audit}, 'r': {state}.r || {row}}}"

    def least(*states: str) -> str:
        return f"list_min([{', '.join(states)}])"

    def insertion(state: str, role: str) -> str:
        return plus(state, "3", "'I'", f"chr(10) || '{role}:'")

    nothing = f"{{'c': CAST({far} AS BIGINT), 'a': '', 'r': ''}}"
    kept = "chr(10) || d.role || ':' || d.text"
    rerole = lambda state, role: plus(state, "3 + t", "'R'", f"chr(10) || '{role}:' || d.text")
    keep = lambda state, initial: f"CASE WHEN d.initial = '{initial}' THEN {plus(state, 't', chr(39) + 'K' + chr(39), kept)} ELSE {nothing} END"
    drop = lambda state: plus(state, "4", "'D'", "''")
    may = lambda e: f"CASE WHEN d.forced THEN {nothing} ELSE {e} END"
    return f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
e AS (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE kind <> 0),
f AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM e),
g AS (SELECT *, rtrim(text, {white}) AS bare, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS seen,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS prior FROM f),
d AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    bare = '' OR seen AS forced, CASE WHEN NOT (bare = '' OR seen) AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS t FROM g),
z AS (SELECT conv, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS b, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM (SELECT DISTINCT conv FROM o)
    UNION ALL SELECT conv, pos, {drop('b')}, {least(drop('s'), may(keep('b', 's')))},
        {least(drop('u2'), may(keep(least('b', 's', 'a2'), 'u')), may(rerole(least('b', 's', 'a2'), 'user')))},
        {least(drop('a2'), may(keep('u2', 'a')), may(rerole('u2', 'assistant')))}
    FROM (SELECT w.conv, d.pos, d.role, d.text, d.initial, d.forced, d.t, w.b, w.s, w.u2, {least('w.a', insertion('w.u2', 'assistant'))} AS a2, d
        FROM (SELECT *, {least('z.u', insertion('z.b', 'user'), insertion('z.s', 'user'), insertion('z.a', 'user'))} AS u2 FROM z) w JOIN d ON d.conv = w.conv AND d.pos = w.pos + 1)),
y AS (SELECT conv, {least('b', 'a', insertion(least('u', insertion('b', 'user'), insertion('s', 'user')), 'assistant'))} AS v FROM z QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1),
h AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, v.c AS cost, v.a AS audit, sha256(substr(v.r, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) i JOIN y USING (conv) LEFT JOIN h USING (conv)"""
