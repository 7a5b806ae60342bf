"""Changes, drift, reviews and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaly.functions.scores import change_severity
from tessaly.operators import feeds as O
from tessaly.operators import measures as M
from tessaly.plans.tables import table

AS_OF = "2024-01-31 00:00:00"


def drift_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return O.drifted(e, "user_id", "ts", "event_id", "event_type", F.lit("2024-01-23").cast("timestamp_ntz")).select("user_id", "event_id", "event_type", "previous")


def severity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 1000).cast("double"))
    s = o.select("o_orderkey", change_severity(F.lag("score").over(w), F.col("score"), F.col("o_orderstatus") != "P").alias("s"))
    return s.select("o_orderkey", "s.severity", "s.delta", "s.reason")


def changes_feed(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("o_orderpriority").startswith("1"), "breaking").when(F.col("o_orderpriority").startswith("2"), "material").when(F.col("o_orderpriority").startswith("3"), "minor").otherwise("url_broken")
    c = table(spark, d, "orders").withColumn("severity", level)
    return O.feed(c, (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 1000), "o_orderdate", "o_orderkey", "severity").select("o_orderkey", "severity")


def dedupe_30d(spark: SparkSession, d: str) -> DataFrame:
    return O.without_recent(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 30).select("event_id")


def _recipients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("all", None, None), ("buyers", ["purchase"], None), ("odd", ["click", "view"], ["1", "3"])], "recipient string, severities array<string>, countries array<string>")


def digest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("country", (F.col("user_id") % 5).cast("string"))
    return O.digest(e, _recipients(spark), "ts", "2024-01-30 00:00:00", "event_type", "country").select("recipient", "event_id")


def digest_body(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("country", (F.col("user_id") % 5).cast("string"))
    rows = O.digest(e, _recipients(spark), "ts", "2024-01-30 00:00:00", "event_type", "country", 2)
    return O.digest_body(rows, "recipient", F.concat("event_type", F.lit(" "), "event_id"), [F.col("event_type").asc(), F.col("ts").desc(), F.col("event_id").asc()])


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select(
        "doc_id",
        F.when(i % 3 == 0, "pending").when(i % 3 == 1, "in_review").otherwise("approved").alias("status"),
        F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, F.lit("n/a")).otherwise(((i % 100) / 100).cast("string")).alias("extraction"),
        ((i * 7 % 100) / 100).cast("string").alias("validation"),
        F.when(i % 5 == 0, "false").when(i % 5 == 1, F.lit(None)).otherwise("true").alias("valid"),
        F.when(i % 4 == 0, "r1").alias("assigned"),
        (F.col("quality") == 0).alias("signal"),
    )


def review_tabs(spark: SparkSession, d: str) -> DataFrame:
    tabs = O.review_tabs(*[F.col(c) for c in ("status", "extraction", "validation", "valid", "assigned")], "r1", F.col("signal"))
    return _reviews(spark, d).agg(*[F.count_if(p).alias(f"n_{name}") for name, p in tabs.items()])


def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    click = F.col("event_type") == "click"
    late = F.col("ts") < F.expr(f"timestamp_ntz'{AS_OF}' - INTERVAL 3 DAYS")
    return e.agg(F.count_if(click).alias("pending"), F.count_if(click & late).alias("beyond_sla"), F.round(M.mean_age_hours(e, "ts", AS_OF, click), 4).alias("age_hours"), M.mean_age_hours(e, "ts", AS_OF, F.lit(False)).alias("none"))


def sla_tier(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return e.groupBy(O.sla_tier(F.col("ts"), now).alias("tier"), O.priority(F.col("value") / 100, F.lit(0.65)).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def relative_age(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", O.relative_age(F.col("ts"), F.lit("2024-01-30 23:59:59").cast("timestamp_ntz")).alias("age"))


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "view", "edit").otherwise("unapprove")
    decisions = e.select(F.col("user_id").alias("id"), "ts", "event_id", kind.alias("decision"), F.when(kind == "edit", F.concat(F.lit("v"), "event_id")).alias("edited_raw"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("pending").alias("status"), F.lit("raw").alias("value_raw"))
    return O.decided(rows, decisions, "id", "ts", "event_id")


def change_audit(spark: SparkSession, d: str) -> DataFrame:
    """Changes by audit bucket."""
    o = table(spark, d, "orders")
    level, key = F.when(F.col("o_orderpriority").startswith("1"), "url_broken").when(F.col("o_orderpriority").startswith("2"), "imd_refresh").otherwise("minor"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.substring("o_orderstatus", 1, 1), F.lit(".1")))
    bucket = F.when(level == "url_broken", "provenance").when((level == "imd_refresh") | key.startswith("F"), "countries").when(key.isNull(), "methodology").otherwise("data")
    return o.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (drift_diff, severity, changes_feed, dedupe_30d, digest, digest_body, review_tabs, queue_stats, sla_tier, relative_age, review_decisions, change_audit)}

_RECIPIENTS = "r(recipient, severities, countries) AS (VALUES ('all', NULL, NULL), ('buyers', ['purchase'], NULL), ('odd', ['click', 'view'], ['1', '3']))"
_WANTED = "(severities IS NULL OR list_contains(severities, event_type)) AND (countries IS NULL OR list_contains(countries, CAST(user_id % 5 AS VARCHAR)))"
ORACLE_SQL = {
    "drift_diff": """
WITH w AS (SELECT *, lag(event_type) OVER o AS previous, lead(event_id) OVER o AS nxt FROM events WHERE ts >= TIMESTAMP '2024-01-23' WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, previous FROM w WHERE nxt IS NULL AND previous IS NOT NULL AND previous <> event_type""",
    "severity": """
WITH s AS (SELECT o_orderkey, o_orderstatus <> 'P' AS c, floor(o_totalprice / 1000) - lag(floor(o_totalprice / 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS x FROM orders)
SELECT o_orderkey, CASE WHEN NOT c OR x IS NULL THEN 'minor' WHEN abs(x) > 5 THEN 'breaking' WHEN abs(x) >= 1 THEN 'material' ELSE 'minor' END AS severity, CASE WHEN c THEN x END AS delta,
  CASE WHEN NOT c THEN 'no scoring field changed' WHEN x IS NULL THEN 'no score on both sides' ELSE 'score moved by ' || printf('%.2f', x) END AS reason FROM s""",
    "changes_feed": """
SELECT o_orderkey, severity FROM (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'breaking' WHEN '2' THEN 'material' WHEN '3' THEN 'minor' ELSE 'url_broken' END AS severity
  FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) WHERE severity <> 'url_broken'""",
    "dedupe_30d": """
WITH RECURSIVE e AS (SELECT user_id, event_type, {'t': ts, 'i': event_id} AS x FROM events),
r AS (SELECT user_id, event_type, min(x) AS x FROM e GROUP BY ALL UNION ALL
      SELECT r.user_id, r.event_type, min(e.x) FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.x.t >= r.x.t + INTERVAL 30 DAY GROUP BY ALL)
SELECT x.i AS event_id FROM r""",
    "digest": f"WITH {_RECIPIENTS} SELECT recipient, event_id FROM events, r WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30' AND {_WANTED}",
    "digest_body": f"WITH {_RECIPIENTS} SELECT recipient, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_type, ts DESC, event_id) AS body FROM events, r WHERE ts BETWEEN TIMESTAMP '2024-01-29 22:00:00' AND TIMESTAMP '2024-01-30' AND {_WANTED} GROUP BY recipient",
    "review_tabs": """
WITH l AS (SELECT doc_id, ['pending', 'in_review', 'approved'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE (doc_id % 100) / 100 END AS x, (doc_id * 7 % 100) / 100 AS v,
  doc_id % 5 = 0 AS bad, doc_id % 4 = 0 AS mine, quality = 0 AS signal FROM labels)
SELECT count(*) AS n_all, count(*) FILTER (WHERE mine) AS n_my_queue, count(*) FILTER (WHERE status = 'pending') AS n_pending,
  count(*) FILTER (WHERE status = 'pending' AND x >= 0.85 AND v >= 0.85 AND NOT bad) AS n_high_confidence, count(*) FILTER (WHERE status = 'pending' AND least(coalesce(x, 0), coalesce(v, 0)) < 0.7) AS n_flagged,
  count(*) FILTER (WHERE status = 'in_review') AS n_in_review, count(*) FILTER (WHERE signal) AS n_quality_signals FROM l""",
    "queue_stats": f"""
SELECT count(*) FILTER (WHERE event_type = 'click') AS pending, count(*) FILTER (WHERE event_type = 'click' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY) AS beyond_sla,
  round(avg(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) FILTER (WHERE event_type = 'click') / 3.6e9, 4) AS age_hours, CAST(NULL AS DOUBLE) AS none FROM events""",
    "sla_tier": f"""
SELECT CASE WHEN x >= 14 THEN 'red' WHEN x >= 7 THEN 'orange' ELSE 'green' END AS tier, CASE WHEN least(value / 100, 0.65) < 0.5 THEN 1 WHEN least(value / 100, 0.65) < 0.6 THEN 2 ELSE 3 END AS priority, count(*) AS n
FROM (SELECT value, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 8.64e10) AS x FROM events) GROUP BY ALL""",
    "relative_age": """
SELECT event_id, CASE WHEN m < 60 THEN CAST(round(m) AS INT) || 'm' WHEN m < 2880 THEN CAST(round(m / 60) AS INT) || 'h' ELSE CAST(round(m / 1440) AS INT) || 'd' END AS age
FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-30 23:59:59') - epoch_us(ts)) / 6e7 AS m FROM events)""",
    "review_decisions": """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT c_custkey AS id, CASE WHEN event_type IN ('purchase', 'view') THEN 'approved' WHEN event_type = 'click' THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN event_type = 'view' THEN 'v' || event_id ELSE 'raw' END AS value_raw FROM customer LEFT JOIN l ON user_id = c_custkey""",
    "change_audit": """
SELECT CASE WHEN p = '1' THEN 'provenance' WHEN p = '2' OR (k AND o_orderstatus = 'F') THEN 'countries' WHEN NOT k THEN 'methodology' ELSE 'data' END AS bucket, count(*) AS n
FROM (SELECT substr(o_orderpriority, 1, 1) AS p, o_orderkey % 3 <> 0 AS k, o_orderstatus FROM orders) GROUP BY 1""",
}
