"""Gates and bookkeeping of the ingest pipeline on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators import gates as G
from tessaly.plans.tables import table


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def rubric_filter(spark: SparkSession, d: str) -> DataFrame:
    rubric = F.lit('{"categories":[{"value":"click","score":1},{"value":"view","score":2}]}')
    return _e(spark, d).where(G.rubric_holds(rubric, F.col("event_type"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def sane_values(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([("click", 10.0, 50.0), ("view", 0.0, 20.0)], "event_type string, low double, high double")
    return G.in_sane_range(_e(spark, d), ranges, "event_type", "value").groupBy("event_type", "sane").agg(F.count(F.lit(1)).alias("n"))


def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = G.review_reasons(F.col("value") / 100, F.lit(0.9), F.col("event_id") % 4 != 0, F.lit(10.0), F.lit(10.0) + (F.col("event_id") % 8))
    return _e(spark, d).groupBy(F.array_join(r, ";").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def auto_approval(spark: SparkSession, d: str) -> DataFrame:
    checked = F.when(F.col("event_id") % 5 == 0, "disagree").when(F.col("event_id") % 5 == 1, "agree")
    return _e(spark, d).groupBy(G.auto_approved(F.col("value") / 50, F.col("event_id") % 3 != 0, F.lit(0.85), checked).alias("approved")).agg(F.count(F.lit(1)).alias("n"))


def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x) for x in ("12", "not_found", "not_stated", "odd", "7")]), (F.col("event_id") % 5 + 1).cast("int"))
    p = G.published(F.when(F.col("event_id") % 31 == 0, "reject").otherwise("ok"), F.col("event_id") % 29 != 0, F.when(F.col("event_id") % 23 != 0, "s"), word, F.col("event_id") % 2 == 0, word != "odd", F.when(F.col("event_id") % 7 != 0, 1.0), F.col("value") < 90)
    return _e(spark, d).groupBy(p["status"].alias("status"), p["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def usable_scrapes(spark: SparkSession, d: str) -> DataFrame:
    s = _e(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 6 == 0, 404).otherwise(200).alias("status"), F.when(F.col("user_id") % 3 == 0, 2).otherwise(F.col("event_id") % 3 + 1).alias("tier"), F.when(F.col("event_id") % 7 == 0, " ").otherwise("x").alias("content"))
    return G.usable_scrapes(s, "user_id", "event_id").select("user_id", "event_id")


def citizenship_years(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", G.years_to_citizenship((k % 7) / 4, F.when(k % 5 != 0, k % 3 != 0), F.when(k % 11 != 0, (k % 9) / 4)).alias("years"), G.programme_age(2026, (1990 + k % 40)).cast("long").alias("age"))


def run_costs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cost = G.run_cost(k % 20, k % 40, k % 2 == 0, {"discovery": 0.5, "extraction": 0.75, "validation": 0.05}, 15.0, 12.0)
    return table(spark, d, "customer").select("c_custkey", F.round(cost["total"], 4).alias("total"), cost["verdict"].alias("verdict"))


def discovery_telemetry(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("program_id"), F.col("l_partkey").alias("url"), (F.col("l_suppkey") % 5).alias("country_iso"))
    registry = found.where("url % 3 = 0")
    archive = found.where("url % 4 = 0 AND program_id % 2 = 0")
    return G.discovery_telemetry(found, registry, archive)


def blocker_recheck(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("domain"))
    probes = _e(spark, d).select(F.col("user_id").alias("domain"), F.when(F.col("event_id") % 2 == 0, 200).otherwise(503).alias("status"), (F.col("value") * 16).alias("length"))
    cleared, kept = G.rechecked(blocked, probes)
    return cleared.withColumn("verdict", F.lit("cleared")).unionByName(kept.withColumn("verdict", F.lit("kept")))


def two_tier_source(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("program"), (F.col("o_orderkey") % 50).alias("url"))
    archive = o.where("url % 3 = 0").groupBy("program", "url").agg(F.lit("archive").alias("content"))
    cache = o.where("url % 2 = 0").groupBy("url").agg(F.lit("cache").alias("content"))
    return G.with_fallback(o, archive, ["program", "url"], cache, ["url"], "content").select("o_orderkey", "content")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select("c_custkey")
    hit, miss = G.cache_split(wanted, table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False)))


QUERIES = {f.__name__: f for f in (rubric_filter, sane_values, review_reasons, auto_approval, publish_gate, usable_scrapes, citizenship_years, run_costs, discovery_telemetry, blocker_recheck, two_tier_source, cache_misses)}
ORACLE_SQL = {
    "rubric_filter": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "sane_values": "SELECT event_type, CASE event_type WHEN 'click' THEN value BETWEEN 10 AND 50 WHEN 'view' THEN value BETWEEN 0 AND 20 ELSE true END AS sane, count(*) AS n FROM events GROUP BY ALL",
    "review_reasons": """
SELECT concat_ws(';', CASE WHEN value / 100 < 0.85 THEN 'extraction confidence' END, CASE WHEN event_id % 4 = 0 THEN 'cross-check disagreement' END, CASE WHEN event_id % 8 > 5 THEN 'score delta' END) AS reasons, count(*) AS n FROM events GROUP BY 1""",
    "auto_approval": "SELECT (value / 50 >= 0.85 AND event_id % 3 <> 0 AND event_id % 5 <> 0) AS approved, count(*) AS n FROM events GROUP BY 1",
    "publish_gate": """
WITH e AS (SELECT *, ['12', 'not_found', 'not_stated', 'odd', '7'][event_id % 5 + 1] AS w FROM events),
r AS (SELECT CASE WHEN event_id % 31 = 0 THEN 'gate verdict' WHEN event_id % 29 = 0 THEN 'metadata missing' WHEN event_id % 23 = 0 THEN 'no source sentence' WHEN w = 'not_found' THEN 'nothing found' WHEN event_id % 2 = 0 AND w = 'odd' THEN 'not in rubric'
  WHEN w = 'not_stated' THEN 'not stated' WHEN event_id % 7 = 0 THEN 'can''t be scored' WHEN value >= 90 THEN 'outside its range' END AS reason FROM e)
SELECT CASE WHEN reason IS NULL THEN 'approved' WHEN reason IN ('gate verdict', 'metadata missing') THEN 'error' WHEN reason = 'nothing found' THEN 'dropped' ELSE 'pending' END AS status, reason, count(*) AS n FROM r GROUP BY ALL""",
    "usable_scrapes": """
WITH s AS (SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE event_id % 3 + 1 END AS tier FROM events WHERE event_id % 6 <> 0 AND event_id % 7 <> 0),
a AS (SELECT *, bool_or(tier = 1) OVER (PARTITION BY user_id) AS top FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM a WHERE tier = 1 OR NOT top)
SELECT user_id, event_id FROM p WHERE n <= 5""",
    "citizenship_years": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 <> 0 THEN floor(((c_custkey % 7) / 4 + CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 9) / 4 END) * 2 + 0.5) / 2 END AS years,
  CASE WHEN 1990 + c_custkey % 40 <= 2026 THEN least(36 - c_custkey % 40, 20) END AS age FROM customer""",
    "run_costs": """
SELECT c_custkey, round(t, 4) AS total, CASE WHEN t > 15 THEN 'error' WHEN t > 12 THEN 'skip' WHEN t > 10 THEN 'warn' ELSE 'ok' END AS verdict
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + (c_custkey % 20) * 0.75::DOUBLE + (c_custkey % 40) * 0.05::DOUBLE AS t FROM customer)""",
    "discovery_telemetry": """
WITH f AS (SELECT l_suppkey AS p, l_partkey AS u, l_suppkey % 5 AS c FROM lineitem), a AS (SELECT DISTINCT c, u FROM f WHERE u % 4 = 0 AND p % 2 = 0),
n AS (SELECT p AS program_id, count(*) AS found, count(*) FILTER (WHERE f.u % 3 = 0) AS registered, count(a.u) AS archived FROM f LEFT JOIN a ON a.c = f.c AND a.u = f.u GROUP BY p)
SELECT *, found - archived AS new, round(100 * (found - archived) / found, 2) AS yield_pct FROM n""",
    "blocker_recheck": "SELECT s_suppkey AS domain, CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = s_suppkey AND event_id % 2 = 0 AND value * 16 >= 1500) THEN 'cleared' ELSE 'kept' END AS verdict FROM supplier",
    "two_tier_source": "SELECT o_orderkey, CASE WHEN o_orderkey % 50 % 3 = 0 THEN 'archive' WHEN o_orderkey % 50 % 2 = 0 THEN 'cache' END AS content FROM orders",
    "cache_misses": "SELECT c_custkey, c_custkey IN (SELECT s_suppkey FROM supplier) AS hit FROM customer",
}
