"""Scores, calibration, cohort aggregates and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import scores as S
from tessaly.operators import hierarchy as H
from tessaly.operators import measures as M
from tessaly.operators import rows as R
from tessaly.plans.tables import table

INDICATORS = [H.Indicator("a1", "A", "A.1", 0.6), H.Indicator("a2", "A", "A.1", 0.4), H.Indicator("a3", "A", "A.2", 1.0), H.Indicator("b1", "B", "B.1", 1.0), H.Indicator("b4", "B", "B.4", 1.0), H.Indicator("c1", "C", "C.1", 0.5), H.Indicator("c2", "C", "C.2", 0.5)]



def minmax_score(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_partkey", F.round(S.min_max(F.col("l_quantity"), F.lit(2.0), F.lit(8.0), F.lit(S.LOWER)), 6).alias("score"))


def zscore_score(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.round(S.z_score(F.col("s_acctbal"), F.lit(4500.0), F.lit(3000.0), F.lit(S.HIGHER)), 6).alias("score"))


def categorical_score(spark: SparkSession, d: str) -> DataFrame:
    rubric = F.create_map(F.lit("R"), F.lit(0.0), F.lit("A"), F.lit(60.0))
    li = table(spark, d, "lineitem")
    scored = li.select("l_returnflag", S.categorical(F.col("l_returnflag"), rubric).alias("score"), S.error_of(F.lit("categorical"), F.lit(None).cast("double"), F.col("l_returnflag"), F.lit(None), F.lit(None), F.lit(None), rubric).alias("error"))
    return scored.groupBy("l_returnflag", "score", "error").agg(F.count(F.lit(1)).alias("n"))


def boolean_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.boolean(F.col("c_acctbal") > 0, F.lit(S.LOWER)).alias("score"))


def annotated_boolean_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    noted = F.when(F.get_json_object("props", "$.k").try_cast("int") % 2 == 0, F.lit('{"required":true,"note":"x"}')).otherwise(F.lit('{"required":false}'))
    return e.select("event_id", S.annotated_boolean(noted, F.lit("required"), F.lit(S.HIGHER)).alias("score"))


def raw_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" %"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(S.number_of(raw), 2).alias("number"), S.truth_of(F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("maybe")).alias("truth"), S.no_limit(F.when(F.col("o_orderkey") % 2 == 0, " NO_Cap").otherwise("12")).alias("unlimited"))


def geometric_mean(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), (F.max("l_discount") * 100).alias("x"), F.when(F.col("l_suppkey") % 20 == 1, F.min("l_tax")).otherwise(F.max("l_tax")).alias("t"))
    return li.select("l_suppkey", F.round(H.geometric_mean([(F.col("q"), 0.5), (F.col("x"), 0.3), (F.col("t"), 0.2)]), 6).alias("score"))


def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.when(F.col("l_suppkey") % 3 != 0, F.avg("l_discount") * 100).alias("x"))
    return li.select("l_suppkey", F.round(H.weighted_mean([(F.col("q"), 0.5), (F.col("x"), 0.2)]), 6).alias("score"))


def missing_penalty(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("present"), F.count(F.lit(1)).alias("total"), F.avg("l_quantity").alias("q"))
    return s.select("l_suppkey", F.round(F.when(F.col("present") == F.col("total"), F.col("q")).otherwise(F.col("q") * F.sqrt(F.col("present") / F.col("total"))), 6).alias("score"), F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.col("present") / F.col("total")), 6).alias("coverage"))


def _cohort(spark: SparkSession, d: str, profile: H.Profile) -> DataFrame:
    """Suppliers scored on seven indicators; a2, b1 and c2 are missing for some."""
    li = table(spark, d, "lineitem")
    k = F.col("l_suppkey")
    wide = li.groupBy("l_suppkey").agg(
        (F.avg("l_quantity") * 2).alias("a1"), F.when(k % 3 != 0, F.avg("l_discount") * 1000).alias("a2"), (F.avg("l_tax") * 1000).alias("a3"), F.when(k % 4 != 0, F.avg((F.col("l_returnflag") == "R").cast("int")) * 100).alias("b1"),
        (F.max("l_discount") * 100).alias("b4"), (F.avg((F.col("l_linestatus") == "O").cast("int")) * 100).alias("c1"), F.when(k % 5 != 0, F.max("l_tax") * 100).alias("c2"),
    )
    values = wide.unpivot("l_suppkey", ["a1", "a2", "a3", "b1", "b4", "c1", "c2"], "key", "score").withColumnRenamed("l_suppkey", "entity")
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), S.min_max(F.col("s_acctbal"), F.lit(-1000.0), F.lit(10000.0), F.lit(S.HIGHER)).alias("cme"))
    return H.score_cohort(values, entities, INDICATORS, profile)


def _flat(df: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return df.select(
        "entity", r(F.col("sub_scores")["A.1"]).alias("a_1"), r(F.col("pillar_scores")["A"]).alias("pillar_a"), r(F.col("pillar_scores")["B"]).alias("pillar_b"), r(F.col("pillar_scores")["C"]).alias("pillar_c"), r(F.col("coverage")["A"]).alias("coverage_a"), r("paq").alias("paq"), r("composite").alias("composite"), "flagged"
    )


def composite(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_cohort(spark, d, H.REFERENCE))


def composite_geometric(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    return _cohort(spark, d, replace(H.REFERENCE, geometric=True)).select("entity", F.round("paq", 6).alias("paq"))


def whatif_rerank(spark: SparkSession, d: str) -> DataFrame:
    weights = H.rebalanced(H.REFERENCE.pillars, "A", 0.5)
    return H.what_if(_cohort(spark, d, H.REFERENCE).withColumn("name", F.col("entity")), weights).select("entity", F.round("composite", 6).alias("composite"), "rank")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return M.calibrated(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_suppkey", 5)


def cohort_minmax(spark: SparkSession, d: str) -> DataFrame:
    return M.cohort_min_max(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "score").select("s_suppkey", "score")


def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    return M.medians(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("median", 6).alias("median"))


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("s", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    h = M.histogram(o, "o_orderpriority", "s")
    return h.select("o_orderpriority", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def cohort_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    one = o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.countDistinct("o_custkey").alias("n_programmes"), F.max("o_orderdate").alias("last_seen"))
    share = M.nested_average(o, "o_custkey", F.col("o_orderstatus") == "F").select(F.round("mean_share", 6).alias("mean_share"))
    return one.crossJoin(F.broadcast(share))  # one row each


def spearman(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a = R.rank_positions(s.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", "a").select("s_suppkey", "a")
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    b = R.rank_positions(li, "q", "l_suppkey", "b").select("l_suppkey", "b")
    return M.spearman(a.join(b, F.col("s_suppkey") == F.col("l_suppkey")), "a", "b").select("n", F.round("rho", 4).alias("rho"))


def pearson(spark: SparkSession, d: str) -> DataFrame:
    return M.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("r", 6).alias("r"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), ((F.col("s_acctbal") + 1000) / 110).alias("cme"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg((F.avg("l_quantity") * 2).alias("p_A"), (F.avg("l_discount") * 1000).alias("p_B"), (F.avg("l_tax") * 1200).alias("p_C"))
    return s.join(li, "entity").select("entity", *[F.round(c, 6).alias(c) for c in ("cme", "p_A", "p_B", "p_C")])


def split_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d).withColumn("paq", F.col("p_A"))
    return M.split_sensitivity(base, [0.1, 0.2, 0.4, 0.5, 0.6]).select("split", "n", F.round("rho", 6).alias("rho"), "shift")


def dropout_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return M.dropout_sensitivity(_base(spark, d), {"A": 0.5, "B": 0.25, "C": 0.25}).select("pillar", "n", F.round("rho", 6).alias("rho"), "shift")


def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    return M.monte_carlo(_base(spark, d).withColumn("paq", F.col("p_A")), 50).select("trial", "n", F.round("rho", 6).alias("rho"), "shift")


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("score", (F.col("c_acctbal") + 1000) / 110)
    band = F.when(F.col("score") >= 70, 1).when(F.col("score") >= 60, 2).when(F.col("score") >= 50, 3).when(F.col("score") >= 40, 4).otherwise(5)
    bucket = F.when(F.col("score") < 20, 0).when(F.col("score") < 40, 1).when(F.col("score") < 60, 2).when(F.col("score") < 80, 3).otherwise(4)
    return c.groupBy(band.alias("band"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.8, 4.0), ("default", 1.0, 5.0)], "model string, tokens_in double, tokens_out double")
    usage = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    return M.token_costs(usage, prices, ["tokens_in", "tokens_out"]).select("model", F.round("cost", 6).alias("cost"))


def event_weights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "purchase", "major").when(F.col("event_type") == "click", "moderate").otherwise("minor")
    return e.groupBy("user_id").agg(M.event_weight(level).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        minmax_score, zscore_score, categorical_score, boolean_score, annotated_boolean_score, raw_values, geometric_mean, weighted_mean, missing_penalty, composite, composite_geometric, whatif_rerank, calibration,
        cohort_minmax, median_by_group, value_histogram, cohort_stats, spearman, pearson, split_sensitivity, dropout_sensitivity, monte_carlo, score_bands, token_costs, event_weights,
    )
}

_COHORT = """
w AS (SELECT l_suppkey AS k, avg(l_quantity) * 2 AS a1, CASE WHEN l_suppkey % 3 <> 0 THEN avg(l_discount) * 1000 END AS a2, avg(l_tax) * 1000 AS a3,
  CASE WHEN l_suppkey % 4 <> 0 THEN avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100 END AS b1, max(l_discount) * 100 AS b4,
  avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) * 100 AS c1, CASE WHEN l_suppkey % 5 <> 0 THEN max(l_tax) * 100 END AS c2 FROM lineitem GROUP BY l_suppkey),
e AS (SELECT s_suppkey AS entity, greatest(0, least(100, 100 * (s_acctbal + 1000) / 11000)) AS cme, w.* FROM supplier LEFT JOIN w ON k = s_suppkey),
s AS (SELECT entity, cme,
  CASE WHEN a1 IS NULL AND a2 IS NULL THEN 0 WHEN a2 IS NULL THEN a1 * sqrt(0.5) WHEN a1 IS NULL THEN a2 * sqrt(0.5) ELSE a1 * 0.6 + a2 * 0.4 END AS s1, coalesce(a3, 0) AS s2, coalesce(b1, 0) AS s3, coalesce(c1, 0) AS s5, coalesce(c2, 0) AS s6,
  ((a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT) / 3 AS ca, ((b1 IS NOT NULL)::INT + (b4 IS NOT NULL)::INT) / 2 AS cb, ((c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT) / 2 AS cc FROM e),
p AS (SELECT *, s1 * (0.4 / 0.75) + s2 * (0.35 / 0.75) AS pa, s3 AS pb, s5 * (0.45 / 0.8) + s6 * (0.35 / 0.8) AS pc FROM s),
q AS (SELECT *, (pa * 0.28 + pb * 0.15 + pc * 0.2) / 0.63 AS paq FROM p)"""
_BASE = """
b AS (SELECT entity, cme, p_A, p_B, p_C FROM (SELECT s_suppkey AS entity, round((s_acctbal + 1000) / 110, 6) AS cme FROM supplier)
  JOIN (SELECT l_suppkey, round(avg(l_quantity) * 2, 6) AS p_A, round(avg(l_discount) * 1000, 6) AS p_B, round(avg(l_tax) * 1200, 6) AS p_C FROM lineitem GROUP BY 1) ON l_suppkey = entity)"""
_RHO = "1 - 6 * sum(power(base_rank - new_rank, 2)) / (count(*) * (power(count(*), 2) - 1))"
_SHIFT = "CAST(sum((base_rank <> new_rank)::INT + (base_rank > 10)::INT) FILTER (WHERE new_rank <= 10) AS BIGINT)"

ORACLE_SQL = {
    "minmax_score": "SELECT l_orderkey, l_partkey, round(greatest(0, least(100, 100 * (1 - (l_quantity - 2) / 6))), 6) AS score FROM lineitem",
    "zscore_score": """
WITH z AS (SELECT s_suppkey, (s_acctbal - 4500) / 3000 AS z FROM supplier), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
u AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t)
SELECT s_suppkey, round(greatest(0, least(100, 100 * CASE WHEN z >= 0 THEN 1 - tail ELSE tail END)), 6) AS score FROM u""",
    "categorical_score": "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 0.0::DOUBLE WHEN 'A' THEN 60.0::DOUBLE END AS score, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN 'value not in rubric' END AS error, count(*) AS n FROM lineitem GROUP BY ALL",
    "boolean_score": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM customer",
    "annotated_boolean_score": "SELECT event_id, CASE WHEN CAST(props ->> '$.k' AS INT) % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events",
    "raw_values": "SELECT o_orderkey, round(o_totalprice, 2) AS number, CASE WHEN o_orderstatus = 'F' THEN true END AS truth, o_orderkey % 2 = 0 AS unlimited FROM orders",
    "geometric_mean": """
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS q, max(l_discount) * 100 AS x, CASE WHEN l_suppkey % 20 = 1 THEN min(l_tax) ELSE max(l_tax) END AS t FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(CASE WHEN q <= 0 OR x <= 0 OR t <= 0 THEN 0 ELSE exp(0.5 * ln(nullif(greatest(q, 0), 0)) + 0.3 * ln(nullif(greatest(x, 0), 0)) + 0.2 * ln(nullif(greatest(t, 0), 0))) END, 6) AS score FROM g""",
    "weighted_mean": "SELECT l_suppkey, round(CASE WHEN l_suppkey % 3 <> 0 THEN avg(l_quantity) * 0.5 / 0.7 + avg(l_discount) * 100 * 0.2 / 0.7 ELSE avg(l_quantity) END, 6) AS score FROM lineitem GROUP BY l_suppkey",
    "missing_penalty": "SELECT l_suppkey, round(CASE WHEN present = total THEN q ELSE q * sqrt(present / total) END, 6) AS score, round(present / total, 6) AS coverage FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS present, count(*) AS total, avg(l_quantity) AS q FROM lineitem GROUP BY 1)",
    "composite": f"WITH {_COHORT} SELECT entity, round(s1, 6) AS a_1, round(pa, 6) AS pillar_a, round(pb, 6) AS pillar_b, round(pc, 6) AS pillar_c, round(ca, 6) AS coverage_a, round(paq, 6) AS paq, round(0.3 * cme + 0.7 * paq, 6) AS composite, true AS flagged FROM q",
    "composite_geometric": f"WITH {_COHORT} SELECT entity, round(CASE WHEN least(pa, pb, pc) <= 0 THEN 0 ELSE exp((0.28 * ln(greatest(pa, 1e-300)) + 0.15 * ln(greatest(pb, 1e-300)) + 0.2 * ln(greatest(pc, 1e-300))) / 0.63) END, 6) AS paq FROM q",
    "whatif_rerank": f"""
WITH {_COHORT}, x AS (SELECT entity, 0.3 * cme + 0.7 * (0.5 * pa + 0.15 * 0.5 / 0.72 * pb + 0.2 * 0.5 / 0.72 * pc) AS composite FROM q)
SELECT entity, round(composite, 6) AS composite, row_number() OVER (ORDER BY composite DESC, entity) AS rank FROM x""",
    "calibration": """
SELECT l_returnflag, count(*) AS n, floor(quantile_cont(l_quantity, 0.1) * 100 + 0.5) / 100 AS low, floor(quantile_cont(l_quantity, 0.9) * 100 + 0.5) / 100 AS high,
  floor(avg(l_quantity) * 100 + 0.5) / 100 AS mean, floor(stddev_samp(l_quantity) * 100 + 0.5) / 100 AS stddev FROM lineitem GROUP BY 1""",
    "cohort_minmax": "SELECT s_suppkey, floor(100 * (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) * 100 + 0.5) / 100 AS score FROM supplier",
    "median_by_group": "SELECT c_mktsegment, round(median(c_acctbal), 6) AS median FROM customer GROUP BY 1",
    "value_histogram": "SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1",
    "cohort_stats": """
SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(DISTINCT o_custkey) AS n_programmes, max(o_orderdate) AS last_seen,
  (SELECT round(avg(s), 6) FROM (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s FROM orders GROUP BY o_custkey)) AS mean_share FROM orders""",
    "spearman": """
WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS a FROM supplier),
b AS (SELECT l_suppkey, row_number() OVER (ORDER BY q DESC, l_suppkey) AS b FROM (SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1))
SELECT count(*) AS n, round(1 - 6 * sum(power(a - b, 2)) / (count(*) * (power(count(*), 2) - 1)), 4) AS rho FROM a JOIN b ON s_suppkey = l_suppkey""",
    "pearson": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "split_sensitivity": f"""
WITH {_BASE}, x AS (SELECT entity, s AS split, 0.3 * cme + 0.7 * p_A AS o, s * cme + (1 - s) * p_A AS v FROM b, (SELECT unnest([0.1::DOUBLE, 0.2, 0.4, 0.5, 0.6]) AS s)),
r AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY o DESC, entity) AS base_rank, row_number() OVER (PARTITION BY split ORDER BY v DESC, entity) AS new_rank FROM x)
SELECT split, count(*) AS n, round({_RHO}, 6) AS rho, {_SHIFT} AS shift FROM r GROUP BY split""",
    "dropout_sensitivity": f"""
WITH {_BASE}, y AS (SELECT entity, 0.3 * cme + 0.7 * (p_A * 0.5 + p_B * 0.25 + p_C * 0.25) AS o, [0.3 * cme + 0.7 * (p_B * 0.5 + p_C * 0.5), 0.3 * cme + 0.7 * (p_A * (0.5 / 0.75) + p_C * (0.25 / 0.75)), 0.3 * cme + 0.7 * (p_A * (0.5 / 0.75) + p_B * (0.25 / 0.75))] AS vs FROM b),
x AS (SELECT entity, ['A', 'B', 'C'][i] AS pillar, o, vs[i] AS v FROM y, (SELECT unnest([1, 2, 3]) AS i)),
r AS (SELECT pillar, row_number() OVER (PARTITION BY pillar ORDER BY o DESC, entity) AS base_rank, row_number() OVER (PARTITION BY pillar ORDER BY v DESC, entity) AS new_rank FROM x)
SELECT pillar, count(*) AS n, round({_RHO}, 6) AS rho, {_SHIFT} AS shift FROM r GROUP BY pillar""",
    "monte_carlo": f"""
WITH {_BASE}, t AS (SELECT t, 0.3 - 0.06 + 2 * 0.06 * ((1103515245 * (t + 1) + 12345) % 2147483648) / 2147483648.0::DOUBLE AS w FROM range(1, 51) r(t)),
x AS (SELECT entity, t AS trial, round(0.3 * cme + 0.7 * p_A, 9) AS o, round(w * cme + (1 - w) * p_A, 9) AS v FROM b, t),
r AS (SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY o DESC, entity) AS base_rank, row_number() OVER (PARTITION BY trial ORDER BY v DESC, entity) AS new_rank FROM x)
SELECT CAST(trial AS INTEGER) AS trial, count(*) AS n, round({_RHO}, 6) AS rho, {_SHIFT} AS shift FROM r GROUP BY trial""",
    "score_bands": """
SELECT CASE WHEN s >= 70 THEN 1 WHEN s >= 60 THEN 2 WHEN s >= 50 THEN 3 WHEN s >= 40 THEN 4 ELSE 5 END AS band, CASE WHEN s < 20 THEN 0 WHEN s < 40 THEN 1 WHEN s < 60 THEN 2 WHEN s < 80 THEN 3 ELSE 4 END AS bucket, count(*) AS n
FROM (SELECT (c_acctbal + 1000) / 110 AS s FROM customer) GROUP BY ALL""",
    "token_costs": """
SELECT event_type AS model, round(sum(((event_id % 1000) * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 0.8 ELSE 1.0 END + (event_id % 77) * CASE event_type WHEN 'click' THEN 15.0 WHEN 'view' THEN 4.0 ELSE 5.0 END) / 1e6), 6) AS cost FROM events GROUP BY 1""",
    "event_weights": "SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM events GROUP BY 1",
}
