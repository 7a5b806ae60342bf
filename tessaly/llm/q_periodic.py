"""op13: periodic runs of words in every document, with loops planted by the checksum of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.periodic import looped, run_summaries


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_summaries(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=looped)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}

# The checksum bit by bit; pairs of equal words at every distance, their stretches as islands, of equal stretches the
# smallest distance.
ORACLE_SQL = {
    "op13_periodic_runs": r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT r, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda c, b: xor(c // 256, tab[CAST(xor(c % 256, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM d, tab WHERE doc_id IS NOT NULL),
g AS (SELECT d.r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n, coalesce(h.h % 10 = 0, false) AS edited, h.h // 10 AS g FROM d LEFT JOIN h ON h.r = d.r),
e AS (SELECT *, CASE WHEN edited AND n > 0 THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM e),
w AS MATERIALIZED (SELECT r, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word, n FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM s GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, q) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS line FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * length // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM d LEFT JOIN listed ON listed.r = d.r LEFT JOIN best ON best.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
}
