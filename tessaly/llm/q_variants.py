"""op11: spelling variants of the words of all documents, with letters lost by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.variants import spelling_variants


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

# The checksum byte by byte; near words by the places at which one code point is taken away.
ORACLE_SQL = {
    "op11_spelling_variants": r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
e AS MATERIALIZED (SELECT run, count(*) AS k, CASE WHEN doc_id IS NOT NULL THEN doc_id || ':' || run END AS line FROM d GROUP BY doc_id, run),
b AS (SELECT *, regexp_extract_all(hex(encode(line)), '..') AS bytes FROM e),
h AS (SELECT run, k, coalesce(xor(list_reduce(list_transform(bytes, lambda x: CAST(16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT)),
        lambda c, y: xor(c // 256, tab[CAST(xor(c % 256, y) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295), 1) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
x AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, c.word AS b, c.n AS m FROM x a JOIN x c ON a.rest = c.rest AND a.i = c.i AND a.word <> c.word
      UNION SELECT a.word, c.word, c.n FROM x a JOIN v c ON a.rest = c.word
      UNION SELECT c.word, a.word, a.n FROM x a JOIN v c ON a.rest = c.word),
g AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, max(m) AS m FROM p GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.m >= 2 * v.n THEN (SELECT min(p.b) FROM p WHERE p.a = v.word AND p.m = g.m) END AS form,
      CASE WHEN g.m >= 2 * v.n THEN g.m END AS form_n FROM v LEFT JOIN g ON g.word = v.word),
r(word, reached, depth) AS (SELECT word, word, 0 FROM v UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, l.root
FROM f JOIN (SELECT word, arg_max(reached, depth) AS root FROM r GROUP BY word) l ON l.word = f.word
"""
}
