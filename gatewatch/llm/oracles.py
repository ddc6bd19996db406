"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality import BOILERPLATE
from .url_filter import ORACLE as URL_FILTER

_WORD = r"[^\x20\x09-\x0D]+"

LINE_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS x(k) GROUP BY r),
lines AS (SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
                 length(regexp_replace(line, '[^!-/:-@\[-`{{-~]+', '', 'g')) AS marks,
                 length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
                 length(regexp_replace(line, '[^|»›→>]+', '', 'g')) AS bars
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
per AS (SELECT r, count(*) - count(DISTINCT line) AS dup,
               coalesce(sum(n) FILTER (WHERE (n >= 5 AND marks > solid * 0.2) OR (bars >= 3 AND n - bars <= bars * 3)
                   OR (n <= 20 AND regexp_matches(line, '{BOILERPLATE}'))), 0) AS lost
        FROM lines WHERE n > 0 GROUP BY r),
facts AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_words
  FROM d LEFT JOIN covered c USING (r) LEFT JOIN per USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= n_words * 0.4 AS kept
FROM facts
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM grams)
          WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS "at" FROM again, range(0, 13) AS x(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS "at" FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY "at") AS rest, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, "at") GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MIXTURE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens,
         md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS "at" FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT count(*) AS n, CAST(max(tokens) AS DOUBLE) AS top, CAST(min(tokens) AS DOUBLE) AS bottom,
             list(tokens / (SELECT max(tokens) FROM s)) AS parts FROM s WHERE tokens > 0),
flat(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, mid, ln(list_sum(list_transform(parts, lambda p: pow(p, mid))))
                 - mid * list_sum(list_transform(parts, lambda p: pow(p, mid) * ln(p)))
                   / list_sum(list_transform(parts, lambda p: pow(p, mid))) >= 0.95 * ln(n) AS ok
        FROM (SELECT *, CASE WHEN step = 0 THEN 1 ELSE (low + high) / 2 END AS mid FROM flat) CROSS JOIN f)
  WHERE step <= 60),
wide AS (SELECT CASE WHEN n < 2 THEN 1 ELSE low END AS a, n, top, bottom FROM flat CROSS JOIN f WHERE step = 61),
fits(step, low, high) AS (
  SELECT 0, a, CAST(1 AS DOUBLE) FROM wide
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT step, low, high, mid, top / bottom * pow(bottom / top, mid) <= 2 * (1 + 1e-12) AS ok
        FROM (SELECT *, CASE WHEN step = 0 THEN low ELSE (low + high) / 2 END AS mid FROM fits) CROSS JOIN f)
  WHERE step <= 60),
e AS (SELECT CASE WHEN n < 2 THEN 1 ELSE high END AS a FROM fits CROSS JOIN f WHERE step = 61),
plan AS (
  SELECT source, docs, tokens, CASE WHEN tokens > 0 THEN greatest(tokens, CAST(floor(
           pow(tokens / top, a) / list_sum(list_transform(parts, lambda p: pow(p, a)))
           * (top * list_sum(list_transform(parts, lambda p: pow(p, a)))) * (1 + 1e-12) + 1e-6) AS BIGINT)) END AS quota
  FROM s CROSS JOIN f CROSS JOIN e),
epochs AS (SELECT source, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole,
                  CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest,
                  greatest(1, (docs + 999) // 1000) AS blocks FROM plan),
placed AS (SELECT d.*, whole, rest, CAST('0x' || substr("at", 1, 13) AS BIGINT) % blocks AS block
           FROM d JOIN epochs p ON d.source IS NOT DISTINCT FROM p.source),
given AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM placed),
spots AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '0', epoch, block)), 1, 13) AS BIGINT) AS position FROM given),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY position, block, "at", n_tokens
                                      ROWS UNBOUNDED PRECEDING) AS upto FROM spots)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, block, position FROM run
WHERE epoch < whole OR (rest > 0 AND upto <= rest)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top,
             list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('{_BASE32}', x // 32768 + 1, 1)
         || substr('{_BASE32}', x // 1024 % 32 + 1, 1) || substr('{_BASE32}', x // 32 % 32 + 1, 1)
         || substr('{_BASE32}', x % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM q
"""

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
judged AS (SELECT *, length(k) >= 10 AND min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM keys)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

#: Inserts and one edit of a turn: (from, to, symbol, cost, audit, inserted
#: turns, kept or renamed: the role, null to keep the turn's own).
_EDITS = """
states(s, nxt, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
walks AS (SELECT s AS a, s, 0 AS n, CAST([] AS VARCHAR[]) AS made FROM states
          UNION ALL SELECT s, nxt, 1, [role || ':'] FROM states
          UNION ALL SELECT x.s, y.nxt, 2, [x.role || ':', y.role || ':'] FROM states x JOIN states y ON x.nxt = y.s),
edits AS (
  SELECT a, w.s AS b, 'D' AS edit, CAST(NULL AS VARCHAR) AS initial, 3 * n + 4 AS cost, n, made, CAST(NULL AS VARCHAR) AS role
  FROM walks w
  UNION ALL SELECT a, nxt, 'R', NULL, 3 * n + 3, n, made, role FROM walks w JOIN states USING (s)
  UNION ALL SELECT a, k.t, 'K', k.i, 3 * n, n, made, NULL FROM walks w JOIN (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS k(s, i, t) USING (s))"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i:
      CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), 4294967295), 4294967295) % 20 AS what FROM c),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
turns AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1)
                  NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(k) AS n
  FROM turns GROUP BY conv_id),
{_EDITS},
path AS (
  SELECT conv_id, 0 AS k, 0 AS s, {{cost: 0, audit: '', made: CAST([] AS VARCHAR[])}} AS best FROM facts
  UNION ALL
  SELECT p.conv_id, p.k + 1, e.b, min({{
    cost: p.best.cost + e.cost + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END,
    audit: p.best.audit || repeat('I', e.n) || e.edit,
    made: list_concat(p.best.made, e.made, CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.role, t.role) || ':' || t.text] END)}})
  FROM path p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k + 1
  JOIN edits e ON e.a = p.s AND (e.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
    AND (e.initial IS NULL OR e.initial = substr(t.role, 1, 1))
  GROUP BY p.conv_id, p.k, e.b),
ended AS (
  SELECT f.conv_id, min({{cost: p.best.cost + 3 * w.n, audit: p.best.audit || repeat('I', w.n),
                          made: list_concat(p.best.made, w.made)}}) AS best
  FROM facts f JOIN path p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.k = f.n
  JOIN walks w ON w.a = p.s AND (w.s = 3 OR w.s = 0 AND w.n = 0) GROUP BY f.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""

ORACLES: dict[str, str] = {
    "op6_url_filter": URL_FILTER,
    "op7_line_quality": LINE_QUALITY,
    "op8_mixture": MIXTURE,
    "op9_warc": WARC,
    "op10_substrings": SUBSTRINGS,
    "op11_line_dedup": LINE_DEDUP,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
