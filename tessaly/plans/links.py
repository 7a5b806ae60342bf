"""URL allocation, comparisons, coverage and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators import links as L
from tessaly.plans.tables import table


def tier_quota(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("tier", (F.col("s_nationkey") % 3 + 1).cast("int")).withColumn("g", F.lit(1))
    return L.tier_quotas(s, ["g"], [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()], {1: 9, 2: 5, 3: 1}, 20, [2, 1, 3]).select("s_suppkey", "tier", "place")


def merged_urls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    urls = e.select(F.col("user_id").alias("key"), F.element_at(F.array(F.lit("registry"), F.lit("proven"), F.lit("fresh"), F.lit("field_proven")), (F.col("event_id") % 4 + 1).cast("int")).alias("origin"), F.col("event_id").alias("position"), "event_type")
    return L.merged_urls(urls, ["key"]).select("key", "origin", "event_type", "position")


def url_yield(spark: SparkSession, d: str) -> DataFrame:
    y = L.url_yield(table(spark, d, "events"), ["user_id", "event_type"], F.col("value") > 50, F.col("value") / 100)
    return y.select("user_id", "event_type", "attempts", "yielded", F.round("mean_confidence", 10).alias("mean_confidence"), F.round("best", 6).alias("best"), "any_yield")


def yield_score(spark: SparkSession, d: str) -> DataFrame:
    y = L.url_yield(table(spark, d, "events"), ["user_id", "event_type"], F.col("value") > 50, F.col("value") / 100)
    return L.yield_score(y, "user_id").select("user_id", F.round("score", 6).alias("score"))


def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return L.pair_coverage(li, "c_nationkey", "s_nationkey", 25)


def both_ways(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"), F.col("n_name").alias("source"))
    return L.both_ways(pairs, "a", "b")


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.round("c_acctbal", 2).alias("v"))
    new = c.where("c_custkey % 4 <> 0").select("c_custkey", F.round(F.col("c_acctbal") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0), 2).alias("v"))
    return L.compared(old, new, "c_custkey", "v").select("c_custkey", "old", "new", F.round("delta", 2).alias("delta"), "changed")


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    journal = p.where("p_partkey % 3 <> 0").select("p_name", "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("c"))
    disk = p.where("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_brand")).alias("c"))
    return L.reconciled(journal, disk, "p_partkey", "c")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("v"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.round("s_acctbal", 2).alias("v"))
    return L.upserted(c, new, ["c_custkey"])


def inserted_new(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("origin"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.concat(F.lit("event"), "event_id").alias("origin"), "event_id")
    return L.inserted_new(s.withColumn("event_id", F.lit(None).cast("long")), e, ["k"], [F.col("event_id").asc()]).select("k", "origin")


def kept_tier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("tier"), F.col("c_mktsegment").alias("category"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 2 + 1).alias("tier"), F.lit("new").alias("category"))
    return L.kept_tier_upsert(c, s, ["k"], "tier", "category")


def summary_dense(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("rank", F.col("p_size"))
    keys = table(spark, d, "part").select("p_brand").distinct().union(spark.range(1).select(F.lit("none").alias("p_brand")))
    out = L.dense_summary(p, keys, "p_brand", "rank", [10, 20, 50])
    return out.withColumn("best", F.when(F.col("best") < float("inf"), F.col("best")))


def residual_join(spark: SparkSession, d: str) -> DataFrame:
    """How many other customers each one's nation has: those of the nation less itself, without meeting any pair."""
    c = table(spark, d, "customer")
    n = c.groupBy("c_nationkey").agg((F.count(F.lit(1)) - 1).alias("n"))
    return c.join(n, "c_nationkey").where("n > 0").select(F.col("c_custkey").alias("k"), "n")


def archived_latest(spark: SparkSession, d: str) -> DataFrame:
    from tessaly.sources.files import latest_archived

    e = table(spark, d, "events").withColumn("storage_path", F.when(F.col("event_type") != "view", F.concat(F.lit("p/"), "event_id")))
    return latest_archived(e, ["user_id"], "ts", "event_id").select("user_id", "storage_path")


def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    from tessaly.sources.files import without_ids

    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return without_ids(table(spark, d, "customer").select("c_custkey", "c_name"), bad, "c_custkey")


QUERIES = {
    f.__name__: f
    for f in (tier_quota, merged_urls, url_yield, yield_score, pair_coverage, both_ways, version_diff, reconciled, upserted, inserted_new, kept_tier, summary_dense, residual_join, archived_latest, deleted_rows)
}

_YIELD = "y AS (SELECT user_id, event_type, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS yielded, avg(value / 100) FILTER (WHERE value > 50) AS mean_confidence, max(value / 100) AS best, bool_or(value > 50) AS any_yield FROM events GROUP BY ALL)"
ORACLE_SQL = {
    "tier_quota": """
WITH t AS (SELECT s_suppkey, CAST(s_nationkey % 3 + 1 AS INTEGER) AS tier, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier),
p AS (SELECT *, n > CASE tier WHEN 1 THEN 9 WHEN 2 THEN 5 ELSE 1 END AS later FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN later THEN CASE tier WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END ELSE tier END, n) AS place FROM p)
SELECT s_suppkey, tier, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20""",
    "merged_urls": """
WITH u AS (SELECT user_id AS key, event_id % 4 AS o, event_id AS position, event_type FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE o WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, CASE WHEN o = 1 THEN position ELSE -position END) AS k, min(position) OVER (PARTITION BY key) AS first FROM u)
SELECT key, ['registry', 'proven', 'fresh', 'field_proven'][o + 1] AS origin, event_type, first AS position FROM r WHERE k = 1""",
    "url_yield": f"WITH {_YIELD} SELECT user_id, event_type, attempts, yielded, round(mean_confidence, 10) AS mean_confidence, round(best, 6) AS best, any_yield FROM y",
    "yield_score": f"WITH {_YIELD} SELECT user_id, round(sum(yielded * coalesce(mean_confidence, 0.5)), 6) AS score FROM y GROUP BY 1",
    "pair_coverage": """
WITH p AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS x, greatest(c_nationkey, s_nationkey) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)
SELECT CAST(300 AS BIGINT) AS pairs, (SELECT count(*) FROM p) AS modelled, (SELECT count(DISTINCT e) FROM (SELECT x AS e FROM p UNION ALL SELECT y FROM p)) AS touched""",
    "both_ways": """
WITH p AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, n_name AS source FROM nation)
SELECT a, b, source, false AS reversed FROM p UNION ALL SELECT b, a, source, true FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)""",
    "version_diff": """
WITH o AS (SELECT c_custkey, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, round(c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END, 2) AS v FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.v AS old, n.v AS new, round(n.v - o.v, 2) AS delta, o.v IS DISTINCT FROM n.v AS changed FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "reconciled": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'UNAPPLIED' WHEN p_partkey % 4 = 0 THEN 'MISSING' WHEN p_partkey % 7 = 0 THEN 'NULL' WHEN p_partkey % 5 = 0 THEN 'DRIFT' ELSE 'OK' END AS verdict FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0""",
    "upserted": "SELECT c_custkey, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, round(s_acctbal, 2) FROM supplier",
    "inserted_new": "SELECT s_suppkey AS k, 'supplier' AS origin FROM supplier UNION ALL SELECT user_id, 'event' || min(event_id) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id",
    "kept_tier": """
SELECT coalesce(c_custkey, s_suppkey) AS k, least(c_custkey % 3, s_suppkey % 2 + 1) AS tier, coalesce(c_mktsegment, 'new') AS category FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
    "summary_dense": """
WITH p AS (SELECT * FROM part), k AS (SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'none')
SELECT k.p_brand, count(p.p_brand) AS total, CAST(min(p_size) AS DOUBLE) AS best, count(*) FILTER (WHERE p_size <= 10) AS within_10, count(*) FILTER (WHERE p_size <= 20) AS within_20, count(*) FILTER (WHERE p_size <= 50) AS within_50
FROM k LEFT JOIN p ON p.p_brand = k.p_brand GROUP BY 1""",
    "residual_join": "SELECT a.c_custkey AS k, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1",
    "archived_latest": "SELECT user_id, 'p/' || event_id AS storage_path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'view') WHERE k = 1",
    "deleted_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
}
