"""Raw values to composites, responses and review input over the driver tables, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import responses as T
from tessaly.functions import scores as S
from tessaly.operators import hierarchy as H
from tessaly.operators import measures as M
from tessaly.operators import rescore as C
from tessaly.operators import sensitivity as V
from tessaly.plans.tables import table
from tessaly.sources.stored import shared_folder

INDICATORS = [H.Indicator(p.lower() + "1", p, f"{p}.1", 1.0) for p in "ABCDE"]
FACTORS = (0.9, 0.95, 1.05, 1.1)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' values of five fields, one for each function but z_score; the first field is written twice."""
    k = F.col("s_suppkey")
    value = lambda key, raw, place=1: F.struct(F.lit(key).alias("key"), raw.cast("string").alias("raw"), F.lit(place).alias("place"))
    flag = F.when(k % 5 == 0, "true").otherwise("false")
    rows = [
        value("a1", F.lit("0")),
        value("a1", F.when(F.col("s_acctbal") > 0, F.concat(F.lit("$"), F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string"))).otherwise("no_limit"), 2),
        value("b1", F.when(k % 3 == 0, "x").when(k % 3 == 1, "y").otherwise('{"notApplicable": true}')),
        value("c1", F.when(k % 2 == 0, '{"substituted": true, "region": "south", "value": "paid"}').otherwise("automatic")),
        value("d1", F.when(k % 4 < 2, "Yes").otherwise("no")),
        value("e1", F.concat(F.lit('{"e1": '), flag, F.lit(', "note": "n"}'))),
    ]
    s = table(spark, d, "supplier").select(k.alias("entity"), F.explode(F.array(*rows)).alias("v"))
    status = F.when((F.col("entity") % 7 == 0) & (F.col("v.key") == "d1"), "pending").otherwise("approved")
    return s.select("entity", "v.*", status.alias("status"))


UP, DOWN = "higher_is_better", "lower_is_better"
FIELDS = [
    V.Field("a1", "A", "A.1", 1.0, "min_max", UP, low=1000.0, high=8000.0), V.Field("b1", "B", "B.1", 1.0, "categorical", UP, rubric=(("x", 20.0), ("y", 80.0))),
    V.Field("c1", "C", "C.1", 1.0, "country_substitute_regional"), V.Field("d1", "D", "D.1", 1.0, "boolean", DOWN), V.Field("e1", "E", "E.1", 1.0, "boolean_with_annotation"),
]


def _substitutes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c1", "north", "automatic", 100.0), ("c1", "south", "paid", 40.0)], "key string, region string, value string, score double")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") * 4.0).alias("cme"))


def raw_to_composite(spark: SparkSession, d: str) -> DataFrame:
    scores = H.indicator_scores(_raw(spark, d), V.definitions(spark, FIELDS), _substitutes(spark))
    scored = H.score_cohort(scores, _entities(spark, d), INDICATORS)
    return scored.select("entity", *[F.round(F.col("pillar_scores")[p], 6).alias(f"p_{p.lower()}") for p in "ABCDE"], F.round("paq", 6).alias("paq"), F.round("composite", 6).alias("composite"), "flagged")


def normalisation_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    runs = V.sensitivity_runs(_raw(spark, d), _entities(spark, d), FIELDS, _substitutes(spark), [V.Perturbation("normalization", str(f), factor=f) for f in FACTORS], digits=6)
    return runs.select(F.col("label").cast("double").alias("factor"), "n", F.round("rho", 6).alias("rho"), "shift")


#: Fields that share sub-factors, one for each function, both directions.
MORE = [
    V.Field("a1", "A", "A.1", 0.6, "min_max", UP, low=1000.0, high=8000.0), V.Field("a2", "A", "A.1", 0.4, "z_score", UP, mean=25.0, stddev=4.0), V.Field("a3", "A", "A.2", 0.7, "min_max", DOWN, low=5.0, high=20.0),
    V.Field("a4", "A", "A.2", 0.3, "boolean", UP), V.Field("b1", "B", "B.1", 0.5, "categorical", UP, rubric=(("x", 20.0), ("y", 80.0))), V.Field("b2", "B", "B.1", 0.5, "z_score", DOWN, mean=1.0, stddev=0.5),
    V.Field("c1", "C", "C.2", 1.0, "country_substitute_regional"), V.Field("d1", "D", "D.1", 0.8, "boolean", DOWN), V.Field("d2", "D", "D.1", 0.2, "min_max", UP, low=10.0, high=60.0), V.Field("e1", "E", "E.1", 1.0, "boolean_with_annotation"),
]


def _more(spark: SparkSession, d: str) -> DataFrame:
    """Raw values of MORE from suppliers and their lines; a2, b2 and d2 are missing for some."""
    k = F.col("l_suppkey")
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 3).alias("q"), F.round(F.stddev_samp("l_quantity"), 3).alias("s"), F.round(F.avg("l_tax") * 25, 3).alias("t"), F.round(F.avg("l_extendedprice") / 1000, 3).alias("m"))
    value = lambda key, raw: F.struct(F.lit(key).alias("key"), raw.cast("string").alias("raw"), F.lit(1).alias("place"))
    rows = [
        value("a2", F.when(k % 3 != 0, F.col("q"))), value("a3", F.col("s")), value("a4", F.when(k % 6 < 4, "yes").otherwise("no")),
        value("b2", F.when(k % 7 == 1, "no_cap").when(k % 4 != 0, F.col("t").cast("string"))), value("d2", F.when(k % 5 != 0, F.col("m"))),
    ]
    more = li.select(k.alias("entity"), F.explode(F.array(*rows)).alias("v")).select("entity", "v.*", F.lit("approved").alias("status"))
    return _raw(spark, d).unionByName(more)


def engine_cohort(spark: SparkSession, d: str) -> DataFrame:
    scores = H.indicator_scores(_more(spark, d), V.definitions(spark, MORE), _substitutes(spark))
    scored = H.score_cohort(scores, _entities(spark, d), [H.Indicator(f.key, f.pillar, f.sub_factor, f.weight) for f in MORE])
    return scored.select("entity", *[F.round(F.col("pillar_scores")[p], 6).alias(f"p_{p.lower()}") for p in "ABCDE"], F.round(F.col("coverage")["A"], 6).alias("coverage_a"), F.round("paq", 6).alias("paq"), F.round("composite", 6).alias("composite"), "flagged")


def sensitivity_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = V.sensitivity_runs(_more(spark, d), _entities(spark, d), MORE, _substitutes(spark), V.standard_perturbations(list("ABCDE")), digits=6)
    return runs.select("analysis", "label", "n", F.round("rho", 4).alias("rho"), "shift")


def score_correlation(spark: SparkSession, d: str) -> DataFrame:
    scores = H.indicator_scores(_more(spark, d), V.definitions(spark, MORE), _substitutes(spark))
    scored = H.score_cohort(scores, _entities(spark, d), [H.Indicator(f.key, f.pillar, f.sub_factor, f.weight) for f in MORE])
    return V.score_correlation(scored).select("n", F.round("r", 6).alias("r"), "flagged")


def scoring_errors(spark: SparkSession, d: str) -> DataFrame:
    """What can't be scored, by field and reason: values outside the rubric, unknown regions, unreadable flags."""
    bad = _raw(spark, d).withColumn("raw", F.when((F.col("key") == "b1") & (F.col("entity") % 9 == 0), "z").when((F.col("key") == "c1") & (F.col("entity") % 8 == 0), '{"region": "east"}').when((F.col("key") == "d1") & (F.col("entity") % 11 == 0), "perhaps").otherwise(F.col("raw")))
    scores = H.indicator_scores(bad, V.definitions(spark, FIELDS), _substitutes(spark))
    return scores.where("error IS NOT NULL").groupBy("key", "error").agg(F.count(F.lit(1)).alias("n"))


def _failing(spark: SparkSession, d: str) -> DataFrame:
    """_more with each field written once, and a value outside its rubric for every ninth supplier."""
    rows = _more(spark, d).where("NOT (key = 'a1' AND place = 1)")
    return rows.withColumn("raw", F.when((F.col("key") == "b1") & (F.col("entity") % 9 == 0), "z").otherwise(F.col("raw")))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("string").alias("country"))


def calibrated_fields(spark: SparkSession, d: str) -> DataFrame:
    numbers = _failing(spark, d).select(F.col("entity").alias("programme"), "key", S.number_of(F.col("raw")).alias("number"), "status")
    found = M.calibrated_fields(numbers, V.definitions(spark, MORE), _members(spark, d).withColumnRenamed("entity", "programme"), [str(n) for n in range(20)])
    return found.select("key", "fn", "n", F.round("raw_min", 4).alias("raw_min"), F.round("raw_max", 4).alias("raw_max"), "low", "high", "mean", "stddev", "n_programmes", "n_observations", "meets_threshold")


def _rescore(spark: SparkSession, d: str, path: str, run: str, countries: list[str] | None = None) -> DataFrame:
    return C.calibrate_and_rescore(_failing(spark, d), MORE, _substitutes(spark), _members(spark, d), _entities(spark, d), path, run, countries)


def calibrate_and_rescore(spark: SparkSession, d: str) -> DataFrame:
    """The status of a run over all countries, of its rerun, and of one over a country that isn't there."""
    path = f"{shared_folder(spark)}/rescored-{uuid.uuid4().hex}"
    runs = {"whole": (None, "w1"), "again": (None, "w1"), "none": (["x"], "w2")}
    rows = [_rescore(spark, d, path, run, countries).withColumn("run", F.lit(name)) for name, (countries, run) in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def rescored_cohort(spark: SparkSession, d: str) -> DataFrame:
    """What two runs under one name have left: scores under calibrated parameters, without the failing programmes."""
    path = f"{shared_folder(spark)}/rescored-{uuid.uuid4().hex}"
    for _ in range(2):
        _rescore(spark, d, path, "w1")
    return spark.read.parquet(f"{path}/scores").select("entity", F.round("paq", 5).alias("paq"), F.round("composite", 5).alias("composite"))


def _refresh(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances by nation as the new index; every third nation has none yet, every fourth is unchanged."""
    sums = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.round(F.avg("c_acctbal"), 2).alias("appeal"), F.count(F.lit(1)).alias("rank"))
    k = F.col("country")
    cohort = sums.where(k % 6 != 5).select(k, F.when(k % 3 == 0, None).when(k % 4 == 0, F.col("appeal")).otherwise(F.round(F.col("appeal") + 1, 2)).alias("appeal"))
    return C.index_refresh(sums, cohort)


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    return _refresh(spark, d)


def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.refresh_summary(_refresh(spark, d).withColumn("country", F.col("country").cast("string")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("programme")))


def bare_domains(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url")).otherwise(F.regexp_replace("url", "^[^:]*://", "")).alias("url"))
    return p.select("page_id", T.bare_domain(F.col("url")).alias("domain"))


def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.relative_date(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-03 00:00:00").cast("timestamp")).alias("ago"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", T.filled(F.lit("Of {name} in {country}: {name}"), {"name": F.col("s_name"), "country": F.col("s_nationkey").cast("string")}).alias("prompt"))


def coverage_chips(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("a"), F.count(F.lit(1)).alias("b"))
    return li.select("l_suppkey", T.coverage_chip(F.col("a"), F.col("b")).alias("c")).select("l_suppkey", "c.*")


def weight_splits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    record = F.concat(F.lit('{"cme": '), F.when(k % 3 == 0, "0.4").when(k % 3 == 1, '"0.25"').otherwise('"none"'), F.lit(', "paq": 0.6}'))
    return table(spark, d, "supplier").select("s_suppkey", T.weight_split(record).alias("w")).select("s_suppkey", "w.*")


def derived_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    fn = F.when(k % 4 == 0, "min_max").when(k % 4 == 1, "boolean").when(k % 4 == 2, "categorical").otherwise("boolean_with_annotation")
    raw = F.when(k % 5 == 0, "not_applicable").when(k % 4 == 0, F.col("o_custkey").cast("string")).when(k % 4 == 1, F.when(F.col("o_orderstatus") == "F", " Permitted").when(F.col("o_orderstatus") == "O", "no").otherwise("maybe")).when(k % 4 == 2, F.concat(F.lit(" "), "o_orderpriority")).when(k % 8 == 3, '{"a": 1}').otherwise("[1]")
    return table(spark, d, "orders").select("o_orderkey", T.derived_value(raw, fn).alias("v")).select("o_orderkey", "v.*")


def quote_places(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    quote = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("of  "), "c_mktsegment")).otherwise("absent (quote)")
    return c.select("c_custkey", T.quote_place(F.concat("c_name", F.lit("  is of\n"), "c_mktsegment"), quote).cast("int").alias("place"))


def response_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"valueRaw": '), F.when(k % 5 == 0, "7").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))), F.lit(', "sourceSentence": "'), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.lit('", "characterOffsets": '),
        F.when(k % 13 == 0, "[1, 2]").when(k % 17 == 0, "null").otherwise(F.concat(F.lit('{"start": '), (k % 4).cast("string"), F.lit(', "end": '), (k % 2).cast("string"), F.lit("}"))), F.lit(', "extractionConfidence": '), F.when(k % 7 == 0, "1.5").when(k % 19 == 0, "0").otherwise("0.5"), F.lit("}"),
    )
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.response_errors(F.when(k % 11 == 0, "[]").when(k % 23 == 0, '"text"').otherwise(text)), ";").alias("errors"))


def reviewer_changes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    uuid = F.concat(F.lpad(F.hex(k), 8, "0"), F.lit("-0000-4000-8000-00000000000A"))
    who = F.when(k % 3 == 0, "").when(k % 3 == 1, uuid).otherwise("someone")
    c = T.reviewer_change(F.when(k % 5 == 0, "x").otherwise(uuid), who, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.error", "c.assigned_to", F.col("c.assigned_at").isNotNull().alias("stamped"))


_LIST = (raw_to_composite, normalisation_sensitivity, engine_cohort, sensitivity_runs, score_correlation, scoring_errors, calibrated_fields, calibrate_and_rescore, rescored_cohort, index_refresh, refresh_summary, bare_domains, relative_dates, prompts, coverage_chips, weight_splits, derived_values, quote_places, response_checks, reviewer_changes)
QUERIES = {f.__name__: f for f in _LIST}

_P = """SELECT s_suppkey AS entity, f, CASE WHEN s_acctbal > 0 THEN greatest(0, least(100, 100 * (round(s_acctbal, 2) - 1000 * f) / (7000 * f))) ELSE 100 END AS pa,
  CASE s_suppkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 80 ELSE 0 END AS pb, CASE WHEN s_suppkey % 2 = 0 THEN 40 ELSE 100 END AS pc,
  CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 4 < 2 THEN 0 ELSE 100 END AS pd, CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 0 END AS pe, s_nationkey * 4.0 AS cme FROM supplier, (SELECT unnest([1.0::DOUBLE, 0.9, 0.95, 1.05, 1.1]) AS f)"""
def _z(x: str, mean: str, stddev: str) -> str:
    """100 times the normal distribution function at (x - mean) / stddev, by the same approximation."""
    z = f"(({x} - {mean}) / ({stddev}))"
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"greatest(0, least(100, 100 * CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END))"


def _mean2(a: str, wa: float, b: str, wb: float) -> str:
    """The penalised mean of two scores of a sub-factor that may be null."""
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 WHEN {b} IS NULL THEN {a} * sqrt(0.5) WHEN {a} IS NULL THEN {b} * sqrt(0.5) ELSE {wa} * {a} + {wb} * {b} END"


def _runs(a1=("1000", "8000"), a2=("25", "4"), a3=("5", "20"), b2=("1", "0.5"), d2=("10", "60"), more: str = "") -> str:
    """The engine over all perturbations; parameters of the ranged fields as SQL, which more (a relation) may give."""
    low_high = lambda x, p: f"(({x}) - {p[0]} * f) / (({p[1]} - {p[0]}) * f)"
    return f"""
m AS (SELECT l_suppkey AS k, round(avg(l_quantity), 3) AS q, round(stddev_samp(l_quantity), 3) AS s, round(avg(l_tax) * 25, 3) AS t, round(avg(l_extendedprice) / 1000, 3) AS m FROM lineitem GROUP BY 1),
x(analysis, label, wc, wp, f, g, gone) AS (
  SELECT 'baseline', 'baseline', 0.3::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE, false, '' UNION ALL
  SELECT 'cme_paq_split', (100 * s)::INT || '/' || (100 - 100 * s)::INT, s, 1 - s, 1.0, false, '' FROM (SELECT unnest([0.2::DOUBLE, 0.25, 0.35, 0.4, 0.5]) AS s) UNION ALL
  SELECT 'normalization', CAST(f AS VARCHAR), 0.3, 0.7, f, false, '' FROM (SELECT unnest([0.9::DOUBLE, 0.95, 1.05, 1.1]) AS f) UNION ALL
  SELECT 'aggregation', 'geometric', 0.3, 0.7, 1.0, true, '' UNION ALL
  SELECT 'indicator_dropout', p, 0.3, 0.7, 1.0, false, p FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p) UNION ALL
  SELECT 'weight_monte_carlo', CAST(t AS VARCHAR), w, 1 - w, 1.0, false, '' FROM (SELECT t, 0.3 - 0.06 + 2 * 0.06 * ((1103515245 * (t + 1) + 12345) % 2147483648) / 2147483648.0::DOUBLE AS w FROM range(1, 51) r(t))),
v AS (SELECT s_suppkey AS entity, x.*, s_nationkey * 4.0 AS cme,
  CASE WHEN s_acctbal > 0 THEN greatest(0, least(100, 100 * {low_high("round(s_acctbal, 2)", a1)})) ELSE 100 END AS a1,
  CASE WHEN s_suppkey % 3 <> 0 THEN {_z("q", a2[0] + " * f", a2[1] + " * f")} END AS a2, greatest(0, least(100, 100 * (1 - {low_high("s", a3)}))) AS a3,
  CASE WHEN s_suppkey % 6 < 4 THEN 100 ELSE 0 END AS a4, CASE s_suppkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 80 END AS b1,
  CASE WHEN s_suppkey % 7 = 1 THEN 0 WHEN s_suppkey % 4 <> 0 THEN {_z("-t", "-" + b2[0] + " * f", b2[1] + " * f")} END AS b2,
  CASE WHEN s_suppkey % 2 = 0 THEN 40 ELSE 100 END AS c1, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 4 < 2 THEN 0 ELSE 100 END AS d1,
  CASE WHEN s_suppkey % 5 <> 0 THEN greatest(0, least(100, 100 * {low_high("m", d2)})) END AS d2, CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 0 END AS e1
  FROM supplier JOIN m ON k = s_suppkey, x{more}),
u AS (SELECT *, ((0.6 * a1 + 0.4 * coalesce(a2, 0)) * CASE WHEN a2 IS NULL THEN sqrt(0.5) / 0.6 ELSE 1 END * 0.4 + (0.7 * a3 + 0.3 * a4) * 0.35) / 0.75 AS pa,
  {_mean2("b1", 0.5, "b2", 0.5)} AS pb, c1 * 1.0 AS pc, {_mean2("d1", 0.8, "d2", 0.2)} AS pd, e1 * 1.0 AS pe FROM v),
w AS (SELECT *, [pa, pb, pc, pd, pe] AS ps, list_transform(['A', 'B', 'C', 'D', 'E'], lambda p: CASE WHEN p = gone THEN 0 ELSE 1 END) AS there FROM u),
n AS (SELECT *, 0.28 * there[1] + 0.15 * there[2] + 0.2 * there[3] + 0.22 * there[4] + 0.15 * there[5] AS tot FROM w),
c AS (SELECT *, CASE WHEN NOT g THEN (0.28 * pa * there[1] + 0.15 * pb * there[2] + 0.2 * pc * there[3] + 0.22 * pd * there[4] + 0.15 * pe * there[5]) / tot
  WHEN least(pa, pb, pc, pd, pe) <= 0 THEN 0 ELSE exp(0.28 * ln(greatest(pa, 1e-300)) + 0.15 * ln(greatest(pb, 1e-300)) + 0.2 * ln(greatest(pc, 1e-300)) + 0.22 * ln(greatest(pd, 1e-300)) + 0.15 * ln(greatest(pe, 1e-300))) END AS paq FROM n)"""


_RUNS = _runs()

_Q = "SELECT *, 0.28 * pa + 0.15 * pb + 0.2 * pc + 0.22 * pd + 0.15 * pe AS paq FROM p"

#: Approved numbers of the ranged fields, of the suppliers of some nations.
_NUMBERS = """
mm AS (SELECT l_suppkey AS k, round(avg(l_quantity), 3) AS q, round(stddev_samp(l_quantity), 3) AS s, round(avg(l_tax) * 25, 3) AS t, round(avg(l_extendedprice) / 1000, 3) AS m FROM lineitem GROUP BY 1),
ob AS (SELECT s_suppkey AS p, s_nationkey AS c, 'a1' AS key, 'min_max' AS fn, round(s_acctbal, 2) AS x FROM supplier WHERE s_acctbal > 0 UNION ALL
  SELECT k, s_nationkey, key, fn, x FROM supplier JOIN mm ON k = s_suppkey, LATERAL (SELECT unnest(['a2', 'a3', 'b2', 'd2']) AS key, unnest(['z_score', 'min_max', 'z_score', 'min_max']) AS fn,
    unnest([CASE WHEN k % 3 <> 0 THEN q END, s, CASE WHEN k % 7 <> 1 AND k % 4 <> 0 THEN t END, CASE WHEN k % 5 <> 0 THEN m END]) AS x) WHERE x IS NOT NULL)"""
_HALF = "floor({0} * 100 + 0.5) / 100"
_PR = "pr AS (SELECT " + ", ".join(
    [f"{_HALF.format(f'quantile_cont(x, {q}) FILTER (WHERE key = ' + chr(39) + k + chr(39) + ')')} AS {k}{n}" for k in ("a1", "a3", "d2") for q, n in ((0.1, "l"), (0.9, "h"))]
    + [f"{_HALF.format(f'{g}(x) FILTER (WHERE key = ' + chr(39) + k + chr(39) + ')')} AS {k}{n}" for k in ("a2", "b2") for g, n in (("avg", "m"), ("stddev_samp", "s"))]
) + " FROM ob)"

ORACLE_SQL = {
    "calibrated_fields": f"""
WITH {_NUMBERS}, o AS (SELECT * FROM ob WHERE c < 20), n AS (SELECT count(DISTINCT p) AS np, count(*) AS no FROM o)
SELECT key, fn, count(*) AS n, round(min(x), 4) AS raw_min, round(max(x), 4) AS raw_max, CASE WHEN fn = 'min_max' THEN {_HALF.format("quantile_cont(x, 0.1)")} END AS low, CASE WHEN fn = 'min_max' THEN {_HALF.format("quantile_cont(x, 0.9)")} END AS high,
  CASE WHEN fn = 'z_score' THEN {_HALF.format("avg(x)")} END AS mean, CASE WHEN fn = 'z_score' THEN {_HALF.format("stddev_samp(x)")} END AS stddev, any_value(np) AS n_programmes, any_value(no) AS n_observations, any_value(np) >= 5 AS meets_threshold FROM o, n GROUP BY key, fn""",
    "calibrate_and_rescore": f"""
WITH {_NUMBERS}, n AS (SELECT count(DISTINCT p) AS np, count(*) AS no FROM ob), c AS (SELECT count(*) FILTER (WHERE s_suppkey % 9 <> 0) AS good, count(*) FILTER (WHERE s_suppkey % 9 = 0) AS bad FROM supplier)
SELECT run, 'ok' AS status, np AS n_programs, no AS n_observations, true AS persisted, good AS rescored, bad AS rescore_failures, CAST(NULL AS VARCHAR) AS reason FROM n, c, (SELECT unnest(['whole', 'again']) AS run) UNION ALL
SELECT 'none', 'skipped', 0, 0, false, 0, 0, 'below_threshold_5'""",
    "rescored_cohort": f"WITH {_NUMBERS}, {_PR}, {_runs(('a1l', 'a1h'), ('a2m', 'a2s'), ('a3l', 'a3h'), ('b2m', 'b2s'), ('d2l', 'd2h'), ', pr')} SELECT entity, round(paq, 5) AS paq, round(0.3 * cme + 0.7 * paq, 5) AS composite FROM c WHERE analysis = 'baseline' AND entity % 9 <> 0",
    "index_refresh": """
WITH s AS (SELECT c_nationkey AS country, round(avg(c_acctbal), 2) AS appeal, count(*) AS rank FROM customer GROUP BY 1),
j AS (SELECT country, rank, CASE WHEN country % 3 = 0 THEN NULL WHEN country % 4 = 0 THEN appeal ELSE round(appeal + 1, 2) END AS previous, appeal, floor(100 * (appeal - min(appeal) OVER ()) / (max(appeal) OVER () - min(appeal) OVER ()) * 100 + 0.5) / 100 AS cme FROM s WHERE country % 6 <> 5)
SELECT * FROM j WHERE appeal IS DISTINCT FROM previous""",
    "refresh_summary": """
WITH s AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey % 6 <> 5 AND (c_nationkey % 3 = 0 OR c_nationkey % 4 <> 0))
SELECT count(*) AS n_changes, string_agg(CAST(k AS VARCHAR), ', ' ORDER BY CAST(k AS VARCHAR)) AS countries, (SELECT min(s_suppkey) FROM supplier) AS programme FROM s""",
    "raw_to_composite": f"""
WITH p AS ({_P}), q AS ({_Q}) SELECT entity, round(pa, 6)::DOUBLE AS p_a, pb::DOUBLE AS p_b, pc::DOUBLE AS p_c, pd::DOUBLE AS p_d, pe::DOUBLE AS p_e, round(paq, 6) AS paq, round(0.3 * cme + 0.7 * paq, 6) AS composite,
  entity % 3 = 2 OR entity % 7 = 0 AS flagged FROM q WHERE f = 1""",
    "normalisation_sensitivity": f"""
WITH p AS ({_P}), q AS ({_Q}), c AS (SELECT entity, f, round(0.3 * cme + 0.7 * paq, 6) AS v FROM q), r AS (SELECT entity, f, row_number() OVER (PARTITION BY f ORDER BY v DESC, entity) AS k FROM c)
SELECT n.f AS factor, count(*) AS n, round(1 - 6 * sum(power(o.k - n.k, 2)) / (count(*) * (power(count(*), 2) - 1)), 6) AS rho, CAST(sum((o.k <> n.k)::INT + (o.k > 10)::INT) FILTER (WHERE n.k <= 10) AS BIGINT) AS shift
FROM r n JOIN r o ON o.entity = n.entity AND o.f = 1 WHERE n.f <> 1 GROUP BY n.f""",
    "engine_cohort": f"""
WITH {_RUNS} SELECT entity, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round(pc, 6)::DOUBLE AS p_c, round(pd, 6) AS p_d, round(pe, 6)::DOUBLE AS p_e, CASE WHEN a2 IS NULL THEN 0.75 ELSE 1 END::DOUBLE AS coverage_a, round(paq, 6) AS paq, round(0.3 * cme + 0.7 * paq, 6) AS composite,
  b1 IS NULL OR b2 IS NULL OR d1 IS NULL OR d2 IS NULL AS flagged FROM c WHERE analysis = 'baseline'""",
    "sensitivity_runs": f"""
WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY analysis, label ORDER BY round(wc * cme + wp * paq, 6) DESC, entity) AS k FROM c)
SELECT n.analysis, n.label, count(*) AS n, round(1 - 6 * sum(power(o.k - n.k, 2)) / (count(*) * (power(count(*), 2) - 1)), 4) AS rho, CAST(sum((o.k <> n.k)::INT + (o.k > 10)::INT) FILTER (WHERE n.k <= 10) AS BIGINT) AS shift
FROM r n JOIN r o ON o.entity = n.entity AND o.analysis = 'baseline' WHERE n.analysis <> 'baseline' GROUP BY n.analysis, n.label""",
    "score_correlation": f"WITH {_RUNS} SELECT count(*) AS n, round(corr(paq, cme), 6) AS r, abs(corr(paq, cme)) > 0.8 AS flagged FROM c WHERE analysis = 'baseline'",
    "scoring_errors": """
SELECT key, error, count(*) AS n FROM (
  SELECT 'b1' AS key, 'value not in rubric' AS error FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL
  SELECT 'c1', 'unreadable value' FROM supplier WHERE s_suppkey % 8 = 0 UNION ALL
  SELECT 'd1', 'unreadable value' FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 7 <> 0) GROUP BY ALL""",
    "bare_domains": r"SELECT page_id, lower(regexp_extract(url, '^(?:[^:]*://)?([^/?#:]*)', 1)) AS domain FROM pages",
    "relative_dates": """
WITH o AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-03') AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 30 THEN n || ' days ago' WHEN n < 365 THEN floor(n / 30 + 0.5)::INT || ' months ago' ELSE floor(n / 365 + 0.5)::INT || ' years ago' END AS ago FROM o""",
    "prompts": "SELECT s_suppkey, 'Of ' || s_name || ' in ' || s_nationkey || ': ' || s_name AS prompt FROM supplier",
    "coverage_chips": "SELECT l_suppkey, floor(100.0 * a / b + 0.5)::INT || '%' AS percent, a || '/' || b AS fraction, a / b < 0.7 AS low FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS a, count(*) AS b FROM lineitem GROUP BY 1)",
    "weight_splits": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.25 ELSE 0.3 END::DOUBLE AS cme, CASE s_suppkey % 3 WHEN 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS paq FROM supplier",
    "derived_values": """
SELECT o_orderkey, CASE WHEN a AND k = 0 THEN o_custkey END::DOUBLE AS number, CASE WHEN a AND k = 1 THEN CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END END AS truth,
  CASE WHEN a AND k = 2 THEN o_orderpriority END AS text, CASE WHEN a AND o_orderkey % 8 = 3 THEN '{"a": 1}' END AS record, a AS applies FROM (SELECT *, o_orderkey % 4 AS k, o_orderkey % 5 <> 0 AS a FROM orders)""",
    "quote_places": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN length(c_name) + 8 WHEN 1 THEN length(c_name) + 5 ELSE -1 END::INT AS place FROM customer",
    "response_checks": """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AND o_orderkey % 19 <> 0 OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) AS found, o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS plain FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'valueRaw:text;sourceSentence:text;characterOffsets:object;extractionConfidence:share' WHEN k % 23 = 0 THEN 'response:object' ELSE
  concat_ws(';', CASE WHEN k % 5 = 0 THEN 'valueRaw:text' END, CASE WHEN k % 17 = 0 AND k % 13 <> 0 THEN 'characterOffsets:object' END, CASE WHEN k % 13 = 0 THEN 'characterOffsets.start:count;characterOffsets.end:count' END,
  CASE WHEN k % 7 = 0 THEN 'extractionConfidence:share' END, CASE WHEN found AND k % 3 = 0 THEN 'sourceSentence:bound' END, CASE WHEN found AND plain AND k % 4 = 0 THEN 'characterOffsets:bound' END,
  CASE WHEN found AND plain AND k % 4 >= 2 THEN 'characterOffsets:order' END) END AS errors FROM o""",
    "reviewer_changes": """
WITH c AS (SELECT c_custkey, printf('%08X', c_custkey) || '-0000-4000-8000-00000000000A' AS u FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'invalid row' WHEN c_custkey % 3 = 2 THEN 'invalid reviewer' END AS error, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 1 THEN u END AS assigned_to, c_custkey % 5 <> 0 AND c_custkey % 3 = 1 AS stamped FROM c""",
}
