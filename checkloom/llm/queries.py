"""The registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from checkloom.llm import bpe_codec, conversations, conversations_sql, embedding_dedup, html_extract, importance, importance_sql, line_dedup, ngram_join, packing, quality_rules, quality_sql, secrets, substring_dedup, toxicity, url_filter
from checkloom.llm.common import table


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_bpe_codec(spark, sf_dir):
    return bpe_codec.digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark, sf_dir):
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM twice, (SELECT unnest(range(35)) AS j)),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

LINE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op5_html_extraction": op5_html_extraction, "op6_toxicity": op6_toxicity, "op8_url_filter": op8_url_filter, "op4_embedding_dedup": op4_embedding_dedup, "op1_best_fit_packing": op1_best_fit_packing, "op10_bpe_codec": op10_bpe_codec, "op3_ngram_join": op3_ngram_join, "op2_substring_dedup": op2_substring_dedup, "op9_line_dedup": op9_line_dedup, "op7_quality_rules": op7_quality_rules, "op11_secret_scan": op11_secret_scan, "op12_conversation_repair": op12_conversation_repair, "op13_importance_resampling": op13_importance_resampling}
NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.m = l.x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, min(r.m) AS component_id, min(r.m) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id
"""

ORACLE_SQL = {"op3_ngram_join": NGRAM_SQL, "op4_embedding_dedup": EMBEDDING_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op9_line_dedup": LINE_SQL, "op7_quality_rules": quality_sql.SQL, "op12_conversation_repair": conversations_sql.SQL, "op13_importance_resampling": importance_sql.SQL}
