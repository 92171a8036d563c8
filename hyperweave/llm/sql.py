"""DuckDB SQL of queries whose text is too long for their module."""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 steps AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 moves(s, r) AS (VALUES ('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')),
 checked AS (SELECT t.*, m.s IS NULL AS bad FROM steps t LEFT JOIN moves m ON m.s = before AND m.r = role)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars,
 sum(bad::BIGINT) = 0 AND bool_or(final AND role = 'assistant') AS valid, sum(bad::BIGINT)::BIGINT AS violations
FROM checked GROUP BY conv_id
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
 windows AS (
  SELECT DISTINCT item, size, array_to_string(ws[k:k + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS k FROM (SELECT *, least(13, len(ws)) AS size FROM items WHERE len(ws) > 0))),
 sizes AS (SELECT DISTINCT size FROM windows),
 grams AS (
  SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS win FROM (
   SELECT *, unnest(range(1, len(ws) - size + 2)) AS k FROM docs, sizes WHERE len(ws) >= size)),
 found AS (SELECT g.doc_id, g.k, g.size, w.item FROM grams g JOIN windows w ON w.size = g.size AND w.win = g.win),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
 said AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN said USING (doc_id)
"""
