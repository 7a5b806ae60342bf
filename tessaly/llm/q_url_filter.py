"""op2: verdicts on every url of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.url_filter import filter_urls

#: (rule, verdict) as the contract states them.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_filter": op2_url_filter}

ORACLE_SQL = {
    "op2_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS row_no
  FROM pages),
r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
s AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM r),
m AS (
  SELECT p.row_no, s.rule, s.verdict, row_number() OVER (PARTITION BY p.row_no ORDER BY length(s.rule) DESC, s.verdict, s.rule) AS k
  FROM p JOIN s ON (p.host = s.rhost OR ends_with(p.host, '.' || s.rhost)) AND starts_with(p.path, s.rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.row_no = p.row_no AND m.k = 1
"""
}
