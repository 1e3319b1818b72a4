"""DuckDB SQL with the same result as the quality-rules query."""

from checkloom.llm.quality_rules import RULES, STOP_WORDS, WINDOW


def _verdict() -> str:
    tests = []
    for r in RULES:
        bad = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
        tests.append(f"NOT (n_words >= {r.from_words} AND ({' OR '.join(bad)}))")
    return " AND ".join(tests)


SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i, ws FROM w),
named AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM named) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
q AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^|]+', '', 'g')) AS BIGINT) AS n_bars,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([{', '.join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS n_stop
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
m AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_words > 0 THEN n_bars / n_words ELSE 0 END AS bar_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND {_verdict()} AS kept FROM m
"""
