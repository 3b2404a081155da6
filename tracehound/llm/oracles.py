"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, pii

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"


def alnum(text: str) -> str:
    return rf"regexp_extract_all({lowered(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def plain(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


DECONTAM = f"""
WITH iw AS (SELECT item_id, {alnum("text")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, list_slice(w, s + 1, s + least(10, len(w))) AS win
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS s FROM iw WHERE len(w) > 0)
),
dw AS (SELECT doc_id, {alnum("text")} AS w FROM documents),
lens AS (SELECT DISTINCT len(win) AS k FROM wins),
pos AS (
  SELECT doc_id, s, k, list_slice(w, s + 1, s + k) AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(0, len(w) - k)) AS s FROM dw, lens WHERE len(w) >= k)
),
hits AS (SELECT p.doc_id, p.s, p.k, v.item_id FROM pos p JOIN wins v ON p.win = v.win),
n AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + k - 1)) AS word FROM hits) GROUP BY doc_id
),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _pii() -> str:
    """One CTE a kind: match texts by regexp_extract_all, places by the pieces between them."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0",
        "phone": f"len({digits}) BETWEEN 8 AND 15",
        "iban": "len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), "
        "lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, c: CASE WHEN c > 9 THEN (a * 100 + c) % 97 ELSE (a * 10 + c) % 97 END, 0) = 1",
        "ssn": "m[1:3] NOT IN ('000', '666') AND m[1:1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'",
    }
    parts = []
    for number, k in enumerate(pii.KINDS):
        near = " OR ".join(f"contains(before, {quoted(w)})" for w in k.context)
        parts.append(f"""
SELECT doc_id, {number} AS ord, '{k.name}' AS kind, st AS s, st + len(m) AS e FROM (
  SELECT doc_id, m, st, lower(substr(t, greatest(st - {pii.CONTEXT_CHARS} + 1, 1), least(st, {pii.CONTEXT_CHARS}))) AS before FROM (
    SELECT doc_id, t, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: len(p))), 0))::BIGINT AS st
    FROM (SELECT doc_id, t, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT doc_id, t, regexp_extract_all(t, {quoted(k.pattern)}) AS ms, regexp_split_to_array(t, {quoted(k.pattern)}) AS ps FROM d) WHERE len(ms) > 0)))
WHERE ({checks[k.name]}) AND round({k.base} + CASE WHEN {near} THEN {pii.CONTEXT_BONUS} ELSE 0.0 END, 6) >= {pii.THRESHOLD}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in pii.BASE_KINDS)
    base = ", ".join(quoted(k) for k in pii.BASE_KINDS)
    label = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
agg AS (
  SELECT doc_id, {counts}, string_agg({label}, ',' ORDER BY ord, s) FILTER (kind IN ({base})) AS b, string_agg({label}, ',' ORDER BY ord, s) AS a
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""


def _licenses() -> str:
    g = licenses.GRAM
    phrases = ", ".join(f"({quoted(label)}, {p.split()!r})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({i}, {quoted(label)}, {t.split()!r})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {alnum("text")} AS w FROM documents),
ph(label, p) AS (VALUES {phrases}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS bl FROM (
    SELECT doc_id, label, i FROM (SELECT doc_id, w, label, p, unnest(generate_series(0, len(w) - len(p))) AS i FROM d, ph WHERE len(w) >= len(p))
    WHERE w[i + 1:i + len(p)] = p) GROUP BY doc_id),
t(template, label, tw) AS (VALUES {templates}),
tg AS (SELECT template, label, len(tw) - {g - 1} AS n_grams, len(tw) AS t_len, tp, tw[tp + 1:tp + {g}] AS gram
       FROM (SELECT *, unnest(generate_series(0, len(tw) - {g})) AS tp FROM t)),
dg AS (SELECT doc_id, pos, w[pos + 1:pos + {g}] AS gram FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - {g})) AS pos FROM d WHERE len(w) >= {g})),
votes AS (SELECT doc_id, template, label, n_grams, t_len, pos - tp AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi
          FROM dg JOIN tg USING (gram) GROUP BY ALL),
opened AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {licenses.MERGE_DIAGONALS} THEN 0 ELSE 1 END AS opens FROM votes
           WINDOW x AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM opened),
spans AS (SELECT doc_id, label, least(1.0, sum(votes) / n_grams::DOUBLE) AS coverage, max(hi) + {g} - min(lo) AS words, t_len
          FROM numbered GROUP BY doc_id, template, label, n_grams, t_len, span),
method AS (SELECT doc_id, list(DISTINCT label) AS ml, max(coverage) AS coverage FROM spans
           WHERE coverage >= {licenses.MIN_COVERAGE} AND words <= t_len * {licenses.MAX_STRETCH} GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') AS labels,
       round(greatest(coalesce(coverage, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""


# base32 of a SHA-1: 5 hexadecimal digits are 4 characters.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
r AS (SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS d, CASE WHEN p.page_id > first THEN first END AS refers_to FROM p JOIN f ON p.h = f.h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{_BASE32}',
         ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""


def _mixing(docs: str = "documents") -> str:
    """Plain binary bisection, one CTE a step; the schedule by one running sum a source."""
    steps = 4 * mixing.ROUNDS
    ent = "ln(sum(pow(p, {m}))) - {m} * sum(pow(p, {m}) * ln(p)) / sum(pow(p, {m}))"
    spread = "max(pow(p, {m} - 1)) / min(pow(p, {m} - 1))"
    goal = f"{mixing.ENTROPY} * ln((SELECT count(*) FROM shares))"
    ctes = [f"h0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, (SELECT {ent.format(m='1.0::DOUBLE')} FROM shares) >= {goal} AS whole)",
            f"r0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, (SELECT {spread.format(m='0.0::DOUBLE')} FROM shares) <= {mixing.REPETITION} AS whole)"]
    for i in range(steps):
        for name, test, good in (("h", f"{ent.format(m='m')} >= {goal}", True), ("r", f"{spread.format(m='m')} <= {mixing.REPETITION}", False)):
            ctes.append(f"{name}{i + 1} AS (SELECT CASE WHEN ok = {str(good).lower()} THEN m ELSE lo END AS lo, CASE WHEN ok = {str(good).lower()} THEN hi ELSE m END AS hi, whole "
                        f"FROM (SELECT lo, hi, whole, m, {test} AS ok FROM (SELECT *, (lo + hi) / 2 AS m FROM {name}{i}), shares GROUP BY lo, hi, whole, m))")
    key = f"('0x' || substr(md5('{mixing.SEED}:' || {{n}} || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, source, greatest(len({plain("coalesce(text, '')")}), 1)::BIGINT AS tokens FROM {docs}),
c AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM c)::DOUBLE AS p FROM c),
{", ".join(ctes)},
a AS (SELECT greatest(CASE WHEN h.whole THEN 1.0 ELSE h.lo END, CASE WHEN r.whole THEN 0.0 ELSE r.hi END) AS a FROM h{steps} h, r{steps} r),
w AS (SELECT source, c.tokens AS total, pow(c.tokens / (SELECT sum(tokens) FROM c)::DOUBLE, a) / (SELECT sum(pow(p, a)) FROM shares, a) AS weight FROM c, a),
b AS (SELECT max(ceil(total / weight - 0.5))::BIGINT AS budget FROM w),
q AS (SELECT source, total, round(budget::DOUBLE * weight)::BIGINT AS quota FROM w, b),
f AS (SELECT *, quota // total AS full, quota % total AS rest FROM q),
x AS (SELECT doc_id, d.source, tokens, total, quota, "full", rest, unnest(generate_series(0, "full")) AS pass FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, {key.format(n="pass::VARCHAR")} AS key FROM x),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, source, tokens, pass, least(floor((pass + key / {float(mixing.KEY_SPACE)!r}::DOUBLE) * total / quota * blocks::DOUBLE), blocks - 1)::BIGINT AS block,
       {key.format(n="'slot' || pass::VARCHAR")} AS slot
FROM u, (SELECT greatest(1, ceil(budget / {mixing.BLOCK_TOKENS}.0))::BIGINT AS blocks FROM b)
WHERE pass < "full" OR upto <= rest
"""


SUBSTRING = f"""
WITH d AS (SELECT doc_id, {plain("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 50)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS word FROM k JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(word) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {plain(lowered("text"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS z FROM w),
e AS (SELECT doc_id, unnest(z) AS g, len(z) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x AS doc_id, y AS node FROM u UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.node = u.x),
c AS (SELECT doc_id, min(node) AS m FROM r GROUP BY doc_id)
SELECT s.doc_id, len(z)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)
"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {lowered(f"trim(line, {_BLANKS})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT doc_id, i, line, top IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: a bitwise fold, -1 stands for one shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {fold}), 4294967295::BIGINT)"


def _conversations() -> str:
    """Forward over the rows: for each state the cheapest edits so far, the ASCII-least of equals."""
    text = "coalesce({0}::VARCHAR, ' ')".format
    after = "(CASE {0} WHEN 2 THEN 3 ELSE 2 END)".format  # the state after a user or assistant turn
    inserted = "CASE {0} WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END".format
    more = f"unnest([{{'s': s, 'c': 0, 'l': '', 'o': ''}}, {{'s': {after('s')}, 'c': 2, 'l': 'I', 'o': {inserted(after('s'))}}}, " \
           f"{{'s': {after(after('s'))}, 'c': 4, 'l': 'II', 'o': {inserted(after('s'))} || {inserted(after(after('s')))}}}])"
    best = "conv, i, s, min(cost) AS cost, min_by(audit, printf('%09d', cost) || audit) AS audit, min_by(out, printf('%09d', cost) || audit) AS out"
    keep = "CASE WHEN ini = 's' AND s = 0 THEN 1 WHEN ini = 'u' AND s <> 2 THEN 2 WHEN ini = 'a' AND s = 2 THEN 3 END"
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, {text("conv_id")} AS conv, turn, {text("role")} AS role, {text("text")} AS text, {crc32(f"{text('conv_id')} || ':' || {text('turn')}")} % 20 AS how FROM conversations),
d AS (
  SELECT conv, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE how <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         substr(role, 1, 1) AS ini, right(rtrim(text, {_BLANKS}), 1) AS e FROM d),
f AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv ORDER BY i) AS prev FROM o),
r AS (
  SELECT {best} FROM (SELECT conv, i, m.s AS s, m.c AS cost, m.l AS audit, m.o AS out FROM (SELECT conv, 0::BIGINT AS i, {more} AS m FROM (SELECT DISTINCT conv, 0 AS s FROM f))) GROUP BY conv, i, s
  UNION ALL
  SELECT {best} FROM (
    SELECT conv, i, m.s AS s, cost + m.c AS cost, audit || m.l AS audit, out || m.o AS out FROM (
      SELECT conv, i, s, cost, audit, out, {more} AS m FROM (
        SELECT conv, i, e.s AS s, cost + e.c AS cost, audit || e.l AS audit, out || e.o AS out FROM (
          SELECT r.conv, f.i, cost, audit, out, unnest(
            [{{'s': s, 'c': 3, 'l': 'D', 'o': ''}}] ||
            CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE [{{'s': {after('s')}, 'c': 2 + (fault = 'truncated')::INTEGER, 'l': 'R', 'o': {inserted(after('s'))} || text}}] END ||
            CASE WHEN fault IN ('blank', 'duplicate') OR ({keep}) IS NULL THEN [] ELSE [{{'s': {keep}, 'c': (fault = 'truncated')::INTEGER, 'l': 'K', 'o': chr(10) || role || ':' || text}}] END) AS e
          FROM r JOIN f ON f.conv = r.conv AND f.i = r.i + 1))))
  GROUP BY conv, i, s),
n AS (
  SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
b AS (
  SELECT n.conv, min(cost) AS cost, min_by(audit, printf('%09d', cost) || audit) AS audit, min_by(out, printf('%09d', cost) || audit) AS out
  FROM r JOIN n ON n.conv = r.conv AND n.n = r.i WHERE s IN (0, 3) GROUP BY n.conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) LEFT JOIN n USING (conv) LEFT JOIN b USING (conv)
"""


def _merkle(levels: int = 7) -> str:
    """One CTE a level and tree, a node alone at its level is handed on as it is."""
    enc = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(enc(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    changed = f"CASE WHEN doc_id IS NOT NULL AND {crc32('coalesce(doc_id::VARCHAR, chr(48))')} % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END"
    ctes = [
        f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {row('text')} AS leaf, {row(f'({changed})')} AS claim FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS cnt FROM l)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            run = "PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN"
            ctes.append(
                f"{name}s{k} AS (SELECT tree, idx, cnt, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})")
            ctes.append(
                f"{name}{k + 1} AS (SELECT tree, idx // 8 AS idx, (max(cnt) + 7) // 8 AS cnt, CASE WHEN max(cnt) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h "
                f"FROM {name}{k} GROUP BY tree, idx // 8)")

    climb("a")
    ctes.append(f"b0 AS (SELECT '' AS tree, tree AS sub, row_number() OVER (ORDER BY tree) - 1 AS idx, h, count(*) OVER () AS cnt FROM a{levels})")
    climb("b")
    ctes.append(f"p0 AS (SELECT a0.doc_id, a0.leaf, a0.tree, a0.idx, b0.idx AS top, b0.h AS subroot, b{levels}.h AS root, claim AS f, '' AS proof FROM a0 JOIN b0 ON b0.sub = a0.tree, b{levels})")
    at = 0
    for name, tree, idx in (("a", "tree", "idx"), ("b", "''", "top")):
        for k in range(levels):
            ctes.append(
                f"p{at + 1} AS (SELECT p.* REPLACE (CASE WHEN s.cnt = 1 THEN f ELSE sha256(lft || f || rgt) END AS f, CASE WHEN s.cnt = 1 THEN proof ELSE proof || lft || rgt END AS proof) "
                f"FROM p{at} p JOIN {name}s{k} s ON s.tree = p.{tree} AND s.idx = p.{idx} // {8**k})".replace("p.''", "''"))
            at += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{at}"


CONVERSATIONS = _conversations()
MERKLE = _merkle()
PII = _pii()
MIXING = _mixing()
LICENSES = _licenses()
