"""DuckDB SQL with the same result as the conversation-repair query: row by row, the least (cost, audit) of each state."""

from checkloom.llm.conversations import INITIALS, NEXT, arcs
from checkloom.llm.crc_sql import hashed

_ARCS = ", ".join(f"('{i}', {f}, '{'K' if letter == 'S' else letter}', {q}, {r}, {cost})" for i in INITIALS for f in range(4) for letter, q, r, cost in arcs(i, f))


def _inserts() -> str:
    """Up to two inserts from each state; more lead back to where they began."""
    out = [(q, q, "", 0) for q in range(4)] + [(q, r, "I", 2) for q, r in NEXT.items()] + [(q, NEXT[r], "II", 4) for q, r in NEXT.items()]
    return ", ".join(f"({q}, {r}, '{letters}', {cost})" for q, r, letters, cost in out)


SQL = rf"""
WITH RECURSIVE src AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS f FROM conversations),
{hashed("SELECT DISTINCT f FROM src")},
hurt AS (SELECT conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role, CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src JOIN hashed ON hashed.f = src.f WHERE h % 20 <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, substr(role, 1, 1) AS own FROM hurt),
rows AS MATERIALIZED (SELECT conv_id, turn, i, role, text, own, CASE WHEN own IN ('s', 'u', 'a') THEN own ELSE '' END AS initial,
  CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
arc AS (SELECT * FROM (VALUES {_ARCS}) v(initial, fault, letter, q, r, cost)),
ins AS (SELECT * FROM (VALUES {_inserts()}) v(q, r, letters, cost)),
step AS (SELECT a.initial, a.fault, ins.q, a.r, ins.letters || a.letter AS letters, ins.cost + a.cost AS cost FROM ins JOIN arc a ON a.q = ins.r),
path AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': 0, 'audit': ''}} AS best FROM rows
  UNION ALL SELECT p.conv_id, p.i + 1, step.r, min({{'cost': p.best.cost + step.cost, 'audit': p.best.audit || step.letters}}) FROM path p JOIN rows ON rows.conv_id = p.conv_id AND rows.i = p.i + 1
  JOIN step ON step.initial = rows.initial AND step.fault = rows.fault AND step.q = p.q GROUP BY p.conv_id, p.i + 1, step.r),
ends AS (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id),
best AS (SELECT p.conv_id, min({{'cost': p.best.cost + ins.cost, 'audit': p.best.audit || ins.letters}}) AS best FROM path p JOIN ends ON ends.conv_id = p.conv_id AND p.i = n JOIN ins ON ins.q = p.q AND ins.r IN (0, 3) GROUP BY p.conv_id),
edit AS (SELECT conv_id, p, substr(best.audit, CAST(p AS BIGINT), 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, len(best.audit) + 1)) AS p FROM best)),
about AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS j FROM edit WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
named AS (SELECT about.*, rows.role, rows.text, max(CASE WHEN j = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY about.conv_id) AS s FROM about LEFT JOIN rows ON rows.conv_id = about.conv_id AND rows.i = about.i),
text AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM named WHERE letter <> 'D' GROUP BY conv_id),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM rows GROUP BY conv_id),
pair AS (SELECT conv_id, count(*) FILTER (own || coalesce(next, own) NOT IN ('su', 'ua', 'au') AND next IS NOT NULL) AS illegal FROM (SELECT conv_id, own, lead(own) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM rows) GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.best.cost, 0) AS BIGINT) AS cost, coalesce(best.best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat ON stat.conv_id = c.conv_id LEFT JOIN pair ON pair.conv_id = c.conv_id LEFT JOIN best ON best.conv_id = c.conv_id LEFT JOIN text ON text.conv_id = c.conv_id
"""
