"""DuckDB SQL with the same result as the importance-resampling query."""

from checkloom.llm.crc_sql import hashed
from checkloom.llm.importance import BUCKETS

SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT 'd' AS corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT corpus, doc_id, array_to_string(ws[i:i + k - 1], ' ') AS f FROM (SELECT corpus, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
post AS MATERIALIZED (SELECT corpus, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
{hashed("SELECT DISTINCT f FROM post")},
own AS MATERIALIZED (SELECT corpus, doc_id, h % {BUCKETS} AS b, sum(n) AS n FROM post JOIN hashed ON hashed.f = post.f GROUP BY ALL),
size AS (SELECT coalesce(sum(n) FILTER (corpus = 'd'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM own),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(sum(n) FILTER (corpus = 't'), 0) + 1 AS DOUBLE) * CAST(any_value(size.s) + {BUCKETS} AS DOUBLE)) / (CAST(coalesce(sum(n) FILTER (corpus = 'd'), 0) + 1 AS DOUBLE) * CAST(any_value(size.t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM own, size GROUP BY b),
weight AS (SELECT doc_id, sum(n * g) AS weight, sum(n) AS n FROM own JOIN gain ON gain.b = own.b WHERE corpus = 'd' GROUP BY doc_id),
score AS (SELECT w.doc_id, CAST(coalesce(weight.n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(ws) >= 20 AS can,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM w LEFT JOIN weight ON weight.doc_id = w.doc_id WHERE corpus = 'd'),
place AS (SELECT *, CASE WHEN can THEN row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (can) OVER () AS total FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * total // 100 THEN r END AS rank FROM place
"""
