"""DuckDB SQL for the queries that SQL can express.

The others rest on a trained model, on the search for disguises, or on bytes at every position of
a text; tests hold those against brute force, an exact round trip or held-out labels.
"""

from __future__ import annotations

from pageloom.llm import licenses
from pageloom.llm.queries import CONTROL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 175 * k >= 75 * (p.n + q.n)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.r) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.d = d.doc_id GROUP BY d.doc_id, n.n"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 12], ' ') AS s, least(len(ws), 13) AS size FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS s FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT dw.doc_id, dw.p, iw.size, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.size = iw.size),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

_ESC = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
step AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(12 + length({_ESC.format("role")}) + 1 + length({_ESC.format("text")}) + 11)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role IN ('assistant', 'tool') WHEN before = 'assistant' THEN role IN ('user', 'tool') WHEN before = 'tool' THEN role IN ('assistant', 'tool') ELSE false END AND (back > 1 OR role = 'assistant')) AS valid
FROM step GROUP BY conv_id"""


def _license_sql() -> str:
    """Sentences by word positions, rules by positions in the row of identifiers."""
    rows = ", ".join(f"('{v}', {len(v.split())}, '{v.split()[0]}', '{k}')" for v, k in licenses.SENTENCES.items())
    rules = ", ".join(f"({k}, '{rule}', '{license_}', {ids!r}::VARCHAR[])" for k, (rule, license_, ids) in enumerate(licenses.RULES))
    return rf"""
WITH catalogue(sentence, size, first, id) AS (VALUES {rows}), rules(k, rule, license, ids) AS (VALUES {rules}),
linked AS (SELECT doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '{licenses.LINK}', '\1', 'g'), '{licenses.SEE}', '. \1', 'g') AS x FROM documents),
pieces AS (SELECT doc_id, lower(array_to_string(list_transform(string_split(x, chr(10)), lambda l: CASE WHEN contains(lower(l), '{licenses.TAG}') THEN regexp_replace(l, '{licenses.OPERAND}', '{licenses.ANEW}', 'g') WHEN regexp_matches(lower(l), '{licenses.NOTICE}') THEN regexp_replace(l, '{licenses.CHOICE}', '{licenses.AGAIN}\1', 'g') ELSE l END), chr(10))) AS t, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ps FROM linked),
counted AS (SELECT doc_id, t, len(list_filter(ps, lambda x: regexp_matches(lower(x), '[a-z0-9]')))::BIGINT AS n_sentences FROM pieces),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(t, '[|~]', ' ', 'g'), '[.!?;:][\x20\x09-\x0D]+', ' | ', 'g'), '[a-z0-9]+|[|]|\n')) AS token, generate_subscripts(regexp_extract_all(regexp_replace(regexp_replace(t, '[|~]', ' ', 'g'), '[.!?;:][\x20\x09-\x0D]+', ' | ', 'g'), '[a-z0-9]+|[|]|\n'), 1) AS p FROM counted),
beside AS (SELECT doc_id, p, token, lag(token, 1, '|') OVER w AS before, lead(token, 1, '|') OVER w AS after FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
placed AS (SELECT *, token NOT IN ('|', chr(10)) AS is_word, sum((token = '|' OR (token = chr(10) AND before = chr(10)))::INT) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM beside),
words AS (SELECT doc_id, token, part, before IN ('|', chr(10)) AS opens, after IN ('|', chr(10)) AS closes, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM placed WHERE is_word),
texts AS (SELECT doc_id, list(token ORDER BY i) AS ws FROM words GROUP BY doc_id),
starts AS (SELECT w.doc_id, w.i, w.i + c.size - 1 AS j, w.part, c.id, c.size FROM words w JOIN catalogue c ON c.first = w.token JOIN texts t ON t.doc_id = w.doc_id WHERE w.opens AND (c.id NOT LIKE 'title.%' OR w.i = 1) AND array_to_string(t.ws[w.i:w.i + c.size - 1], ' ') = c.sentence),
fit AS (SELECT s.* FROM starts s JOIN words e ON e.doc_id = s.doc_id AND e.i = s.j AND e.closes AND e.part = s.part),
longest AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY size DESC) AS r FROM fit),
found AS (SELECT l.doc_id, l.i, l.id FROM longest l WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM longest o WHERE o.doc_id = l.doc_id AND o.r = 1 AND o.i < l.i AND o.j >= l.i)),
listed AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM found GROUP BY doc_id),
held AS (SELECT doc_id, k, rule, license, r.ids AS said, unnest(list_filter(range(1, len(l.ids) + 1), lambda i: l.ids[i:i + len(r.ids) - 1] = r.ids)) AS at FROM listed l CROSS JOIN rules r),
matched AS (SELECT DISTINCT doc_id, k, rule, license FROM held h WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.doc_id = h.doc_id AND len(o.said) > len(h.said) AND o.at <= h.at AND h.at + len(h.said) <= o.at + len(o.said))),
named AS (SELECT * FROM matched m WHERE rule NOT LIKE '%-title' OR NOT EXISTS (SELECT 1 FROM matched o WHERE o.doc_id = m.doc_id AND o.rule NOT LIKE '%-title'))
SELECT c.doc_id, c.n_sentences, coalesce(array_to_string(l.ids, ','), '') AS known, coalesce(string_agg(rule, ',' ORDER BY k), '') AS rules, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT license AS x FROM named m WHERE m.doc_id = c.doc_id)), '') AS licenses
FROM counted c LEFT JOIN listed l ON l.doc_id = c.doc_id LEFT JOIN named n ON n.doc_id = c.doc_id GROUP BY c.doc_id, c.n_sentences, l.ids"""


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def _repair_sql() -> str:
    """Damage by crc32, then the cheapest edits row by row: for each role before (z none yet, s, u, a) the least (cost, audit)."""
    pair = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 't': {x}.t || '{edit}'}}"
    far = "{'c': 1000000000000::BIGINT, 't': ''}"
    keep = lambda kind, x: f"CASE WHEN kind = '{kind}' THEN {pair(x, 'extra', 'K')} ELSE {far} END"
    reset = lambda x: f"CASE WHEN kind <> 'x' THEN {pair(x, 'extra + 2', 'R')} ELSE {far} END"
    grown = lambda source: f"""(SELECT key, pos, z, s, least(u1, {pair('a1', 2, 'I')}) AS u, a1 AS a FROM (SELECT *, least(a, {pair('u1', 2, 'I')}) AS a1 FROM (SELECT *, least(u, {pair('z', 2, 'I')}, {pair('s', 2, 'I')}, {pair('a', 2, 'I')}) AS u1 FROM {source})))"""
    return rf"""
WITH RECURSIVE crc(t) AS (SELECT {_crc_table()!r}::BIGINT[]),
said AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)), lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8)), 4294967295::BIGINT) % 20 AS fate FROM said, crc),
d AS (SELECT key, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos FROM d)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY key ORDER BY pos) AS before FROM o),
m AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial IN ('u', 'a', 's') THEN initial ELSE 'o' END AS kind, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM f),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY key),
run AS (
  SELECT key, pos, z, s, u, a FROM {grown(f"(SELECT DISTINCT key, 0::BIGINT AS pos, {{'c': 0::BIGINT, 't': ''}} AS z, {far} AS s, {far} AS u, {far} AS a FROM m)")}
  UNION ALL
  SELECT key, pos, z, s, u, a FROM {grown(f"(SELECT r.key, r.pos + 1 AS pos, {pair('z', 3, 'D')} AS z, least({pair('s', 3, 'D')}, {keep('s', 'z')}) AS s, least({pair('u', 3, 'D')}, {', '.join([keep('u', x) for x in 'zsa'] + [reset(x) for x in 'zsa'])}) AS u, least({pair('a', 3, 'D')}, {keep('a', 'u')}, {reset('u')}) AS a FROM run r JOIN m ON m.key = r.key AND m.pos = r.pos + 1)")}),
best AS (SELECT key, least(arg_max(z, pos), arg_max(a, pos)) AS b FROM run GROUP BY key),
edits AS (SELECT key, unnest(string_split(b.t, '')) AS edit, generate_subscripts(string_split(b.t, ''), 1) AS n FROM best WHERE b.t <> ''),
placed AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS nth FROM edits WINDOW w AS (PARTITION BY key ORDER BY n)),
kept AS (SELECT p.*, m.role, m.text, m.initial FROM placed p LEFT JOIN m ON m.key = p.key AND m.pos = p.pos WHERE edit <> 'D'),
opened AS (SELECT *, max((edit = 'K' AND nth = 1 AND initial = 's')::INT) OVER (PARTITION BY key) AS skip FROM kept),
lines AS (SELECT key, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - skip) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS sha FROM opened GROUP BY key),
ids AS (SELECT DISTINCT conv_id, key FROM said)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.t, '') AS audit, coalesce(l.sha, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.key = i.key LEFT JOIN best b ON b.key = i.key LEFT JOIN lines l ON l.key = i.key"""


_WINDOWS = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT row, doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
later AS (SELECT row, p FROM (SELECT row, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT row, unnest(range(p, p + 20)) AS place FROM later),
words AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
kept AS (SELECT words.row, count(*) AS n, string_agg(word, ' ' ORDER BY words.place) AS text FROM words ANTI JOIN gone ON gone.row = words.row AND gone.place = words.place GROUP BY words.row)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.row = w.row"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM benchmark),
asked AS (SELECT DISTINCT item, unnest(ts) AS term FROM i),
every AS (SELECT count(*) AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, every GROUP BY term),
scored AS (SELECT a.item, p.row, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(d.ts) * N) // L))))::BIGINT AS score FROM asked a JOIN postings p ON p.term = a.term JOIN weights w ON w.term = p.term JOIN d ON d.row = p.row, every GROUP BY a.item, p.row),
ranked AS (SELECT s.item, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, d.doc_id, s.row) AS rank FROM scored s JOIN d ON d.row = s.row WHERE s.score > 0)
SELECT i.item_id, r.rank::INTEGER AS rank, r.doc_id, r.score FROM ranked r JOIN i ON i.item = r.item WHERE r.rank <= 50"""


SQL: dict[str, str] = {
    "op2_jaccard_join": _JACCARD,
    "op3_decontamination": _CONTAMINATION,
    "op4_license_scan": _license_sql(),
    "op5_chat_formatting": _CHAT,
    "op11_conversation_repair": _repair_sql(),
    "op12_substring_dedup": _WINDOWS,
    "op13_lexical_search": _SEARCH,
}
