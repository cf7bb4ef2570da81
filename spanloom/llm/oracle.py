"""DuckDB SQL for the queries that SQL can express over whole tables."""

from .chat import BEGIN, END, PART_TURNS
from .licenses import ANCHORS, KNOWN, LICENCE_RULES, NOTICES, known_pattern

ORACLE: dict[str, str] = {}

ORACLE["op1_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[pos : pos + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.pos, dw.n, bw.item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY rid),
which AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN which USING (rid)
"""

ORACLE["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line,
         list_sort(list_distinct(regexp_extract_all(translate(s[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
sets AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS k, doc_id, line, w, n
         FROM (SELECT w, len(w) AS n, min((doc_id, line)) AS p, p[1] AS doc_id, p[2] AS line FROM l WHERE len(w) > 0 GROUP BY w)),
later AS (SELECT k FROM sets x WHERE EXISTS (
  SELECT 1 FROM sets y WHERE y.k < x.k AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
    AND len(list_intersect(x.w, y.w)) * 180 >= (x.n + y.n) * 80)),
gone AS (SELECT l.doc_id, l.line FROM l JOIN sets s ON l.w = s.w WHERE (l.doc_id, l.line) <> (s.doc_id, s.line) OR s.k IN (SELECT k FROM later))
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(count(g.line) AS BIGINT) AS n_removed,
       coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS removed_lines
FROM documents d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, d.text
"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EITHER_CASE = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
#: Kind, pattern and least number of characters of the value (the last group of ``assign``).
_KINDS = (
    ("assign", _EITHER_CASE + r"""["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]+", 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    ("github_token", "gh[pousr]_[A-Za-z0-9]{36,}", 1),
    ("slack_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 1),
)


def _matches(rank: int, kind: str, pattern: str, least: int) -> str:
    quoted = pattern.replace("\\'", "\'").replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, CAST(list_sum(list_transform(w[1:i], lambda x: length(x))) - length(w[i]) + length(g[i]) AS BIGINT) AS s, CAST(list_sum(list_transform(w[1:i], lambda x: length(x))) AS BIGINT) AS e, v[i] AS v, {least} AS least
  FROM (SELECT rid, w, g, v, unnest(range(1, len(w) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '(?s)(.*?)({quoted})', 0) AS w, regexp_extract_all(t, '(?s)(.*?)({quoted})', 1) AS g, regexp_extract_all(t, '(?s)(.*?)({quoted})', {4 if kind == 'assign' else 2}) AS v FROM d WHERE regexp_matches(t, '{quoted}')))"""


ORACLE["op3_secret_scan"] = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))
    + """), f AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         sha256(coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
         string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) AS spans
  FROM m WHERE length(v) >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""
)

# RE2 has no look-around, so the marks are doubled: each sentence takes its own.
_SENTENCE, _NOTICE = known_pattern("(?: |\x02\x02)")
_BETWEEN = "(?:[^,]+,)*?"


def _fits(ids: tuple[str, ...], but: str | None) -> str:
    if len(ids) == 1:
        return f"contains(line, ',{ids[0]},')"
    rest = "^," + _BETWEEN + _BETWEEN.join(f"{k}," for k in ids[1:])
    return f"len(list_filter(string_split(line, ',{ids[0]},')[2:], lambda p: regexp_matches(',' || p, '{rest}')" + (f" AND NOT contains(',' || p, ',{but},')" if but else "") + ")) > 0"


_NAME = "|".join(NOTICES)
ORACLE["op2_licence_scan"] = (
    rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN regexp_matches(text, '(?i){'|'.join(ANCHORS)}') THEN translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(1) || chr(2), '--') ELSE '' END AS t FROM documents),
m AS (SELECT rid, doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '([:;])[ \t\n\x0B\f\r]+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g') AS t FROM d),
n AS (SELECT rid, doc_id, chr(1) || regexp_replace(t, '[\x00\x03-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') || chr(1) AS t FROM m),
c AS (SELECT rid, doc_id, regexp_replace(regexp_replace(t, ' ?\x02[ \x02]*', chr(2), 'g'), '[ \x02]?\x01[ \x01\x02]*', chr(1), 'g') AS t FROM n),
s AS (SELECT rid, doc_id, list_transform(regexp_extract_all(replace(replace(t, chr(1), chr(1) || chr(1)), chr(2), chr(2) || chr(2)), '[\x01\x02]((?:{_SENTENCE})[\x01\x02]|{_NOTICE})', 1),
        lambda x: rtrim(replace(replace(x, chr(2) || chr(2), ' '), chr(1), ''), ' ' || chr(2))) AS found FROM c),
i AS (SELECT rid, doc_id, list_transform(found, lambda x: coalesce({_list(KNOWN.values())}[nullif(list_position({_list(KNOWN)}, x), 0)], {_list(NOTICES.values())}[nullif(list_position({_list(NOTICES)}, regexp_extract(x, '({_NAME})$', 1)), 0)])) AS ids FROM s),
l AS (SELECT *, ',' || array_to_string(ids, ',') || ',' AS line FROM i)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(["""
    + ", ".join(f"CASE WHEN {_fits(ids, but)} THEN '{name}' END" for name, ids, but in LICENCE_RULES)
    + """], lambda x: x IS NOT NULL))), ',') AS licences, array_to_string(ids, ',') AS sentences, CAST(len(ids) AS BIGINT) AS n_sentences FROM l"""
)

ORACLE["op8_chat_perspectives"] = f"""
WITH t AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) / {PART_TURNS}.0) AS BIGINT) AS part
  FROM (SELECT conv_id, turn,
         replace(replace(coalesce(role, 'unknown'), '{BEGIN}', '<| im_start |>'), '{END}', '<| im_end |>') AS role,
         replace(replace(coalesce(text, ''), '{BEGIN}', '<| im_start |>'), '{END}', '<| im_end |>') AS text
  FROM conversations)),
p AS (SELECT * FROM (SELECT DISTINCT conv_id, role AS participant FROM t) a JOIN (SELECT DISTINCT conv_id AS c, part FROM t) b ON a.conv_id IS NOT DISTINCT FROM b.c),
j AS (SELECT p.conv_id, p.part, p.participant, t.turn, t.role, t.text, t.role = p.participant AS own,
        CASE WHEN t.role = p.participant THEN '{BEGIN}assistant' || chr(10) ELSE '{BEGIN}user name=' || t.role || chr(10) END AS head, t.text || '{END}' AS body
      FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.part = p.part),
k AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, participant ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - 1 AS stop FROM j)
SELECT conv_id, part, participant, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(concat_ws(':', CAST(stop - length(body) AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS spans, count(*) AS n_turns
FROM k GROUP BY conv_id, part, participant
"""

#: CRC-32 of ASCII text by a table that is made from its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"


def _crc(text: str, table: str = "crc.t") -> str:
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars"))) + " || {})"
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, claim
  FROM (SELECT doc_id, lang, {_LEAF.format(_field("text"))} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} END AS claim
        FROM documents, crc)),
up AS (SELECT lang, 0 AS lvl, i, leaf AS h, n FROM d
  UNION ALL SELECT lang, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lang, lvl, i // 8),
subs AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, i, h, n FROM subs UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY lvl, i // 8),
runs AS (SELECT false AS up2, lang, lvl, i // 8 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY lang, lvl, i // 8
  UNION ALL SELECT true, NULL, lvl, i // 8, list(h ORDER BY i) FROM top WHERE n > 1 GROUP BY lvl, i // 8),
walk AS (SELECT row_number() OVER () AS rid, doc_id, lang, leaf, coalesce(claim, leaf) AS f, '' AS proof, false AS up2, 0 AS lvl, i, n FROM d
  UNION ALL
  SELECT w.rid, w.doc_id, w.lang, w.leaf, CASE WHEN w.n > 1 THEN sha256(array_to_string(hs[:w.i % 8], '') || w.f || array_to_string(hs[w.i % 8 + 2:], '')) ELSE w.f END,
         CASE WHEN w.n > 1 THEN w.proof || array_to_string(hs[:w.i % 8], '') || array_to_string(hs[w.i % 8 + 2:], '') ELSE w.proof END,
         CASE WHEN w.n > 1 THEN w.up2 ELSE true END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.i // 8 ELSE s.i END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END
  FROM walk w LEFT JOIN runs r ON w.n > 1 AND r.up2 = w.up2 AND (w.up2 OR r.lang IS NOT DISTINCT FROM w.lang) AND r.lvl = w.lvl AND r.run = w.i // 8
              LEFT JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang
  WHERE w.n > 1 OR NOT w.up2)
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang, (SELECT h FROM top WHERE n = 1) t
WHERE w.up2 AND w.n = 1
"""


def _spoken(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), ' ')"


# The rest of a conversation from each state (0 nothing, 1 s, 2 u, 3 a put out last) is a pair of price and audit; a turn is
# put before it, then inserts before that.  Of a list of pairs the least is that of the least price and then audit.
def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


def _put(letter: str, price: str, rest: str) -> str:
    return f"{{'c': {rest}.c + {price}, 'e': '{letter}' || {rest}.e}}"


def _state(k: int) -> str:
    steps = {0: (("s", 2), ("u", 3)), 1: (("u", 3),), 2: (("a", 4),), 3: (("u", 3),)}[k]
    keeps = [f"CASE WHEN NOT x.g AND x.i = '{i}' THEN {_put('K', 'x.m', f'acc[{at}]')} END" for i, at in steps]
    reroles = [f"CASE WHEN NOT x.g THEN {_put('R', 'x.m + 2', f'acc[{at}]')} END" for i, at in steps if i != "s"]
    return _least(_put("D", "3", f"acc[{k + 1}]"), *keeps, *reroles)


# An insert leads from state 2 to 3 and from any other to 2; two in a row are never better than none but at the end.
_TURN = f"list_transform([[{', '.join(_state(k) for k in range(4))}]], lambda w: [{_least('w[1]', _put('I', '2', 'w[3]'))}, {_least('w[2]', _put('I', '2', 'w[3]'))}, {_least('w[3]', _put('I', '2', 'w[4]'))}, {_least('w[4]', _put('I', '2', 'w[3]'))}])[1]"
ORACLE["op13_conversation_repair"] = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
k AS (SELECT conv_id, turn, {_spoken("role")} AS role, {_spoken("text")} AS text, {_crc(f"({_spoken('conv_id')} || ':' || {_spoken('turn')})")} % 20 AS kind FROM conversations, crc),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
pl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS p, left(role, 1) AS i FROM dmg),
f AS (SELECT conv_id, turn, role, text, p, i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i NOT IN ('su', 'ua', 'au') AS wrong
  FROM pl),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (wrong) AS illegal, list({{'g': fault IN (1, 2), 'm': CASE WHEN fault = 3 THEN 1 ELSE 0 END, 'i': i, 'role': role, 'text': text}} ORDER BY p) AS t FROM f GROUP BY conv_id),
best AS (SELECT *, list_reduce(list_reverse(t), lambda acc, x: {_TURN}, [{{'c': 0, 'e': ''}}, {{'c': 4, 'e': 'II'}}, {{'c': 2, 'e': 'I'}}, {{'c': 0, 'e': ''}}])[1] AS r FROM c),
made AS (SELECT *, list_reduce(string_split(r.e, ''), lambda acc, e: CASE e
      WHEN 'D' THEN {{'n': acc.n + 1, 's': acc.s, 'o': acc.o}}
      WHEN 'I' THEN {{'n': acc.n, 's': CASE acc.s WHEN 'u' THEN 'a' ELSE 'u' END, 'o': list_append(acc.o, CASE acc.s WHEN 'u' THEN 'assistant:' ELSE 'user:' END)}}
      WHEN 'K' THEN {{'n': acc.n + 1, 's': t[acc.n].i, 'o': list_append(acc.o, t[acc.n].role || ':' || t[acc.n].text)}}
      WHEN 'R' THEN {{'n': acc.n + 1, 's': CASE acc.s WHEN 'u' THEN 'a' ELSE 'u' END, 'o': list_append(acc.o, CASE acc.s WHEN 'u' THEN 'assistant:' ELSE 'user:' END || t[acc.n].text)}}
      ELSE acc END, {{'n': CAST(1 AS BIGINT), 's': '', 'o': CAST([] AS VARCHAR[])}}) AS w FROM best)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(r.c, 0) AS BIGINT) AS cost, coalesce(r.e, '') AS audit, sha256(coalesce(array_to_string(w.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN made ON o.conv_id IS NOT DISTINCT FROM made.conv_id
"""
