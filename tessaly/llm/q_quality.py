"""op10: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.quality import HOST_FAIL_RATE, quality_verdicts


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}

ORACLE_SQL = {
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest(range(8)) AS k) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.r = w.r LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS m, count(*) AS k, sum(n) AS s, sum(n * n) AS q, sum(f * f / n) AS ff FROM h),
v AS (SELECT m, k, s, CASE WHEN s - q / s > 0 AND m * (1 - m) > 0
        THEN (ff - s * m * m - (k - 1) * m * (1 - m)) / ((s - q / s - (k - 1)) * m * (1 - m)) END AS rho FROM s),
p AS (SELECT m, CASE WHEN rho > 0 AND rho < 1 THEN (1 - rho) / rho ELSE s / k END AS w FROM v),
z AS (SELECT source, (f + m * w) / (n + w) > {HOST_FAIL_RATE} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(host_failed, false)) AS kept
FROM b LEFT JOIN z ON z.source = b.source
"""
}
