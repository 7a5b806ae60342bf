"""Rollups and comparisons over the driver tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators import rollups as R
from tessaly.plans.tables import table


def pattern_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return R.without_patterns(table(spark, d, "part"), "p_type", ["PROMO%", "%TIN"]).select("p_partkey")


def purge_reasons(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    found = R.purge_candidates(o, F.col("o_totalprice") > 50000, F.col("o_orderstatus") == "F", "day", F.lit("1998-06-01").cast("timestamp"), F.col("o_orderkey") % 7 == 0)
    return found.select("o_orderkey", "reason")


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("issues", F.filter(F.array(F.when(F.col("value") > 90, "high"), F.when(F.col("value") > 95, "extreme")), lambda x: x.isNotNull()))
    return R.issue_rollup(e, "user_id", "event_type", "issues")


def purge_lists(spark: SparkSession, d: str) -> DataFrame:
    found = R.purge_preview(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey")
    return found.select("o_custkey", "n", "first", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def url_fields(spark: SparkSession, d: str) -> DataFrame:
    found = R.grouped_lists(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], {"lines": "l_linenumber", "status": "l_linestatus"})
    return found.select("l_suppkey", "l_returnflag", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("lines", "status")])


def stale_prompts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 20).alias("made"))
    return R.stale_rollup(R.newer_than(o, c, "o_custkey", "made", "o_totalprice"), "o_custkey", "o_orderkey", "o_orderstatus")


def mismatches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.nullif(F.col("c_nationkey").cast("long"), F.lit(3).cast("long")).alias("v"))
    return R.differing(o, c, ["k"], "v").select("o_orderkey")


def scored_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), "o_orderstatus", "o_totalprice")
    return R.scored_rollup(c, o, "k", "status", R.is_populated(F.when(F.col("o_orderstatus") == "P", "").otherwise("x"), F.when(F.col("o_totalprice") > 200000, 1)))


def kinds(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("min_max", "z_score", "categorical", "boolean", "boolean_with_annotation", "country_substitute_regional")])
    return R.kind_counts(table(spark, d, "part").select(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("fn")), "fn")


def pillar_contributions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("score"))
    p = p.withColumn("weight", F.when(F.col("l_returnflag") == "A", 0.5).otherwise(0.25))
    return R.contributions(p, "l_suppkey", "score", "weight").select("l_suppkey", "l_returnflag", "contribution", "total")


def in_tier(spark: SparkSession, d: str) -> DataFrame:
    origin = F.element_at(F.array(*[F.lit(x) for x in ("fresh", "proven", "registry", "field_proven")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").withColumns({"tier": (F.col("event_id") % 3 + 1).cast("int"), "origin": origin, "gained": F.when(F.col("value") > 20, F.floor("value").cast("double"))})
    return R.in_tier_order(e, ["user_id"], "tier", "origin", "gained", "event_id").select("event_id", "place")


def country_counts(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    left = c.select(F.col("c_nationkey").alias("k"), "c_acctbal")
    right = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("k"), "o_custkey")
    return R.distinct_aggregates(left, right, "k", F.max("c_acctbal"), F.col("o_custkey"))


def seed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    live = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return R.seed_diff(seed, live, ["k"], "v")


def backfill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("v"))
    return R.backfilled(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v")), ["k"], "v")


def map_override(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    both = R.overridden(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.col("s_nationkey").cast("int"), F.lit("c"), F.lit(3)))
    m = s.select("s_suppkey", both.alias("m"))
    return m.select("s_suppkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in "abc"])


def compare_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return R.candidates(c, F.col("c_custkey") == 1, F.col("c_acctbal") > 0, [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_custkey", "c_acctbal")


QUERIES = {
    f.__name__: f
    for f in (pattern_exclusion, purge_reasons, issue_counts, purge_lists, url_fields, stale_prompts, mismatches, scored_counts, kinds, pillar_contributions, in_tier, country_counts, seed_verdicts, backfill, map_override, compare_candidates)
}
ORACLE_SQL = {
    "pattern_exclusion": "SELECT p_partkey FROM part WHERE p_type IS NULL OR p_type NOT LIKE 'PROMO%' AND p_type NOT LIKE '%TIN'",
    "purge_reasons": """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 AND o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-05-25' THEN 'empty' WHEN o_orderkey % 7 = 0 THEN 'provenance' END AS reason FROM orders) WHERE reason IS NOT NULL""",
    "issue_counts": "SELECT user_id, event_type, count(*) AS n, CAST(count(*) FILTER (WHERE value > 90) + count(*) FILTER (WHERE value > 95) AS BIGINT) AS issues FROM events GROUP BY ALL",
    "purge_lists": "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey",
    "url_fields": "SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS status FROM lineitem GROUP BY ALL",
    "stale_prompts": "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS least_id, min(o_orderstatus) AS least_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal * 20 > o_totalprice GROUP BY 1",
    "mismatches": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE nullif(o_custkey % 5, 0) IS DISTINCT FROM nullif(c_nationkey, 3)",
    "scored_counts": """SELECT c_custkey AS k, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS approved, count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS pending,
  count(o_orderkey) FILTER (WHERE o_orderstatus <> 'P' OR o_totalprice > 200000) AS populated FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "kinds": "SELECT CASE WHEN p_partkey % 6 < 2 THEN 'numeric' WHEN p_partkey % 6 = 2 THEN 'categorical' WHEN p_partkey % 6 < 5 THEN 'boolean' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "pillar_contributions": """WITH q AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS score FROM lineitem GROUP BY l_suppkey, l_returnflag),
p AS (SELECT l_suppkey, l_returnflag, score * CASE WHEN l_returnflag = 'A' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS contribution FROM q)
SELECT *, sum(contribution) OVER (PARTITION BY l_suppkey) AS total FROM p""",
    "in_tier": """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id % 4 = 3 DESC, event_id % 4 = 2 DESC, event_id % 4 = 1 DESC, CASE WHEN value > 20 THEN floor(value) ELSE 0 END DESC, event_id) AS INTEGER) AS place FROM events""",
    "country_counts": "SELECT c_nationkey AS k, max(c_acctbal) AS newest, count(DISTINCT o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "seed_verdicts": """SELECT s_suppkey AS k, s_nationkey AS v, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN s_nationkey = c_nationkey THEN 'unchanged' ELSE 'update' END AS verdict
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 3 > 0""",
    "backfill": "SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal > 0 THEN c_nationkey END, s_nationkey) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "map_override": "SELECT s_suppkey, 1 AS a, CAST(s_nationkey AS INTEGER) AS b, 3 AS c FROM supplier",
    "compare_candidates": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> 1 AND c_acctbal > 0",
}
