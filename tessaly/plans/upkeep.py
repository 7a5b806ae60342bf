"""Small jobs around the index: caches, seeds, sources, formats and rows picked by rule, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import text as T
from tessaly.operators import gates as G
from tessaly.operators import links as L
from tessaly.operators import measures as M
from tessaly.operators import rows as R
from tessaly.plans.tables import table
from tessaly.sources import files
from tessaly.sources.stored import shared_folder

AS_OF = "2024-01-20 12:00:00"


def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def bad_scrapes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a scrape cache: what is to be deleted, and why."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(k % 13 == 0, F.concat(F.lit("Page not found. "), "text")).otherwise(F.col("text")).alias("content"), F.when(k % 17 == 0, 503).otherwise(200).alias("status"))
    return G.bad_scrapes(docs, "content", "status").select("doc_id", "reason")


def purged_cache(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the cache, by status."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content"), F.when(k % 17 == 0, 503).otherwise(200).alias("status"))
    left = files.without_ids(docs, G.bad_scrapes(docs, "content", "status"), "doc_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def treaty_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Lines as treaties between the nations of customer and supplier; the first line of a pair says whether it is active."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = li.where("c_nationkey <> s_nationkey").select("c_nationkey", "s_nationkey", (F.col("l_returnflag") != "R").alias("active"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    members = table(spark, d, "nation").where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("member"))
    return L.treaty_coverage(pairs, "c_nationkey", "s_nationkey", "active", "place", members)


def enriched_rubrics(spark: SparkSession, d: str) -> DataFrame:
    """Brands as fields, their types as categories, scored by the length of the type."""
    p = table(spark, d, "part")
    definitions = p.groupBy(F.col("p_brand").alias("key")).agg(F.sort_array(F.collect_set("p_type")).alias("categories"))
    scores = p.select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"), F.length("p_type").alias("score")).distinct()
    found = G.enriched_rubrics(definitions, scores)
    return found.select("key", F.array_join(F.transform("scored", lambda x: F.concat_ws("=", x["value"], x["score"].cast("string"))), ";").alias("scored"))


def keyword_pick(spark: SparkSession, d: str) -> DataFrame:
    """The customer of each nation whose name holds the nation's keyword, else the first by name; of several the first."""
    c = table(spark, d, "customer").withColumn("keyword", F.lpad((F.col("c_nationkey") * 3 % 50).cast("string"), 2, "0"))
    held = F.contains(F.lower("c_name"), "keyword")
    return R.first_per_key(c, ["c_nationkey"], [held.desc(), F.col("c_name").asc(), F.col("c_custkey").asc()]).select("c_nationkey", "c_custkey")


def quality_signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    record = F.when(k % 7 == 0, "[1]").when(k % 7 == 1, None).otherwise(F.concat(F.lit('{"crossCheckResult": "'), F.when(k % 2 == 0, "disagree").otherwise("agree"), F.lit('", "deriveLlmMismatch": '), F.when(k % 3 == 0, '"model said x"').when(k % 3 == 1, '""').otherwise("7"), F.lit(', "crossCheckUrl": '), F.when(k % 5 == 0, '"https://t"').otherwise("null"), F.lit("}")))
    return table(spark, d, "events").select("event_id", G.quality_signals(record).alias("q")).select("event_id", "q.*")


def json_projections(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of a JSON text as integer, double and boolean; what doesn't fit is null."""
    k = F.col("event_id")
    record = F.concat(F.lit('{"tier": '), F.when(k % 3 == 0, '"2"').when(k % 3 == 1, "1").otherwise('"x"'), F.lit(', "confidence": "'), (k % 100 / 100).cast("string"), F.lit('", "isValid": '), F.when(k % 4 == 0, "false").when(k % 4 == 1, '"maybe"').otherwise("true"), F.lit("}"))
    at = lambda key: F.get_json_object(record, f"$.{key}")
    return table(spark, d, "events").select("event_id", at("tier").try_cast("int").alias("tier"), at("confidence").try_cast("double").alias("confidence"), at("isValid").try_cast("boolean").alias("is_valid"))


def active_keys(spark: SparkSession, d: str) -> DataFrame:
    """Values of the active fields only: the sizes of some brands' parts stand for the active keys."""
    p = table(spark, d, "part")
    active = p.where("p_brand IN ('Brand#11', 'Brand#23')").select("p_size").distinct()
    return p.join(active, "p_size", "left_semi").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The version published last, unpublished ones after all others, the larger tag of equal ones."""
    o = table(spark, d, "orders").select(F.concat(F.lit("v"), "o_custkey").alias("tag"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"))
    return o.orderBy(F.col("published_at").desc_nulls_last(), F.col("tag").desc()).limit(1)


def latest_three(spark: SparkSession, d: str) -> DataFrame:
    """The three newest approved changes."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").asc()).limit(3).select("o_orderkey")


def formats(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    day = F.when(k % 4 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")))
    return s.select("s_suppkey", T.score_text(F.when(k % 3 != 0, F.round("s_acctbal", 1))).alias("score"), T.rank_text(F.when(k % 5 != 0, k)).alias("rank"), T.day_text(day).alias("day"))


def scoped_contents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as programmes of their nation; lines of some are contents, others take what their nation has."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("programme"), F.col("s_nationkey").alias("country"))
    li = table(spark, d, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("programme"), (F.col("l_partkey") % 40).alias("url")).join(s, "programme")
    return G.scoped_contents(s, li)


def usd_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in dollars by a table of rates; a currency without a rate gives null."""
    rates = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, "USD").otherwise("XXX").alias("code"), F.when(F.col("n_nationkey") % 7 != 0, 1 + F.col("n_nationkey") / 4).alias("rate"))
    c = table(spark, d, "customer").join(F.broadcast(rates), "c_nationkey")
    return c.select("c_custkey", F.round(T.to_usd(F.col("c_acctbal"), F.col("code"), F.col("rate")), 4).alias("usd"))


def capped_confidences(spark: SparkSession, d: str) -> DataFrame:
    c = G.capped(F.col("value") / 100, 0.6)
    return table(spark, d, "events").select("event_id", F.round(c["confidence"], 6).alias("confidence"), c["was_capped"].alias("was_capped"))


def derive_mismatches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    model = F.when(k % 4 == 0, None).when(k % 4 == 1, "derived-knowledge").otherwise("model-a")
    note = G.derive_mismatch((k % 3).cast("string"), model, F.when(k % 5 != 0, (k % 2).cast("string")))
    return table(spark, d, "events").select("event_id", note.alias("note"))


def unexpired_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return files.unexpired(e, "expires_at", _now()).select("event_id")


def registry_urls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sources of customers, those in a certain segment as active programmes."""
    sources = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("program_id"), (F.col("o_orderkey") % 3 + 1).alias("tier"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_seen_at"))
    programs = table(spark, d, "customer").select(F.col("c_custkey").alias("program_id"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("closed").alias("status"))
    return G.registry_urls(sources, programs, F.lit("1998-08-02 00:00:00").cast("timestamp_ntz")).select("o_orderkey")


def calibrated_or_default(spark: SparkSession, d: str) -> DataFrame:
    """Parameters calibrated on the lines, and the default ones where too few suppliers are asked for."""
    default = spark.createDataFrame([(f, 1.0, 2.0) for f in "ANR"], "l_returnflag string, low double, high double")
    found = lambda least: M.calibrated(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_suppkey", least).select("l_returnflag", "low", "high")
    return M.or_default(found(5), default).withColumn("least", F.lit(5)).unionByName(M.or_default(found(1000000000), default).withColumn("least", F.lit(0)))


def dynamic_caps(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", L.dynamic_cap(F.col("n") * 3).alias("cap"))


def request_filters(spark: SparkSession, d: str) -> DataFrame:
    """A request's text parameters as a filter and an order over suppliers."""
    params = {"nation": "1, 3,,5,7", "min": "-20", "max": "60", "sort": "nonsense", "dir": "up"}
    filters, sort, down = R.filters_from_params(params, {"nation": "nation"})
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"), F.round((F.col("s_acctbal") + 1000) / 110, 4).alias("composite"))
    return R.page(R.ordered(s.where(filters.column()), sort, down, "s_name"), 15)[0].select("s_suppkey", "composite")


def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Customers through CSV: written with quotes and line ends in values, read under other headers, invalid rows left out."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit('say "'), "c_name", F.lit('", or\nnot')).alias("Long-Name"), F.when(k % 10 == 0, "xx").otherwise(F.substring(F.upper(F.translate("c_mktsegment", " ", "")), 1, 3)).alias(" ISO3 "), F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("score"), k.cast("string").alias("id"),
    )
    files.write_csv(rows, path)
    read = files.read_csv(spark, path, {"name": ["title", "long_name"], "iso": ["iso", "iso3"], "score": ["score"], "id": ["id"], "gone": ["gone"]})
    return files.valid_rows(read, "iso", ["score"]).select(F.col("id").cast("long").alias("id"), "name", "iso", F.round("score", 2).alias("score"), "gone")


def public_rows_by_view(spark: SparkSession, d: str) -> DataFrame:
    """Approved values and changes as the public reads them."""
    o = table(spark, d, "orders")
    files.public_views(spark, o.withColumn("status", F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending")), o.withColumn("summary_human_approved", F.col("o_orderstatus") == "P"))
    both = "SELECT 'value' AS kind, o_orderpriority FROM public_field_values UNION ALL SELECT 'change', o_orderpriority FROM public_policy_changes"
    return spark.sql(both).groupBy("kind", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_LIST = (
    bad_scrapes, purged_cache, treaty_coverage, enriched_rubrics, keyword_pick, quality_signals, json_projections, active_keys, latest_version, latest_three, formats, scoped_contents, usd_amounts, capped_confidences,
    derive_mismatches, unexpired_rows, registry_urls, calibrated_or_default, dynamic_caps, request_filters, csv_source, public_rows_by_view,
)
QUERIES = {f.__name__: f for f in _LIST}

_VISIBLE = r"length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[[^\]]*\]\([^)]*\)', '', 'g'), '[#*`_>|-]+', ' ', 'g'), '\s+', ' ', 'g')))"
_SOFT = r"regexp_matches(substr({0}, 1, 2048), '(?is)\b404\b.*\bnot found\b') OR regexp_matches(substr({0}, 1, 2048), '(?i)\bpage (not|cannot be) found\b|\bcan''t find (the )?page\b|\bthis page (doesn''t|does not) exist\b')"


def _bad(text: str) -> str:
    return f"CASE WHEN doc_id % 17 = 0 THEN 'http_error' WHEN {_SOFT.format(text)} THEN 'soft_404' WHEN {_VISIBLE.format(text)} < 1500 THEN 'short_content' END"


ORACLE_SQL = {
    "bad_scrapes": f"SELECT doc_id, reason FROM (SELECT doc_id, {_bad('t')} AS reason FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 13 = 0 THEN 'Page not found. ' || text ELSE text END, '') AS t FROM documents)) WHERE reason IS NOT NULL",
    "purged_cache": f"SELECT source, count(*) AS n FROM (SELECT source, {_bad('t')} AS reason FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)) WHERE reason IS NULL GROUP BY source",
    "treaty_coverage": """
WITH m AS (SELECT n_nationkey AS m FROM nation WHERE n_nationkey % 4 <> 3),
p AS (SELECT c_nationkey AS a, s_nationkey AS b, l_returnflag <> 'R' AS active, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
k AS (SELECT least(a, b) AS x, greatest(a, b) AS y, arg_min(active, n) AS active FROM p WHERE a IN (SELECT m FROM m) AND b IN (SELECT m FROM m) GROUP BY 1, 2),
s AS (SELECT count(*) AS members FROM m), c AS (SELECT count(*) AS modelled, count(*) FILTER (WHERE active) AS active FROM k), t AS (SELECT count(*) AS touched FROM m WHERE m IN (SELECT a FROM p) OR m IN (SELECT b FROM p))
SELECT members, members * (members - 1) // 2 AS pairs, modelled, active, touched, members * (members - 1) // 2 - modelled AS unmodelled FROM s, c, t""",
    "enriched_rubrics": "SELECT p_brand AS key, string_agg(p_type || '=' || length(p_type), ';' ORDER BY p_type) AS scored FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1",
    "keyword_pick": "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY contains(lower(c_name), lpad(CAST(c_nationkey * 3 % 50 AS VARCHAR), 2, '0')) DESC, c_name, c_custkey) AS k FROM customer) WHERE k = 1",
    "quality_signals": "SELECT event_id, o AND event_id % 2 = 0 AS disagrees, o AND event_id % 3 = 0 AS mismatch, CASE WHEN o AND event_id % 3 = 0 THEN 'model said x' END AS note, CASE WHEN o AND event_id % 5 = 0 THEN 'https://t' END AS url FROM (SELECT event_id, event_id % 7 > 1 AS o FROM events)",
    "json_projections": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS tier, (event_id % 100 / 100)::DOUBLE AS confidence, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_valid FROM events",
    "active_keys": "SELECT p_size, count(*) AS n FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')) GROUP BY 1",
    "latest_version": "SELECT 'v' || o_custkey AS tag, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at FROM orders ORDER BY published_at DESC NULLS LAST, tag DESC LIMIT 1",
    "latest_three": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 3",
    "formats": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN printf('%.2f', round(s_acctbal, 1)) ELSE '—' END AS score, CASE WHEN s_suppkey % 5 <> 0 THEN '#' || s_suppkey ELSE '—' END AS rank, CASE WHEN s_suppkey % 4 <> 0 THEN '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') ELSE '—' END AS day FROM supplier",
    "scoped_contents": """
WITH l AS (SELECT DISTINCT l_suppkey AS p, s_nationkey AS c, l_partkey % 40 AS url FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 3 <> 0)
SELECT p AS programme, url FROM l UNION ALL SELECT DISTINCT s_suppkey, url FROM supplier JOIN l ON c = s_nationkey WHERE s_suppkey NOT IN (SELECT p FROM l)""",
    "usd_amounts": "SELECT c_custkey, round(CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal WHEN c_nationkey % 7 <> 0 THEN c_acctbal / (1 + c_nationkey / 4) END, 4) AS usd FROM customer",
    "capped_confidences": "SELECT event_id, round(least(value / 100, 0.6), 6) AS confidence, value / 100 > 0.6 AS was_capped FROM events",
    "derive_mismatches": "SELECT event_id, CASE WHEN event_id % 4 > 1 AND CASE WHEN event_id % 5 <> 0 THEN event_id % 2 END IS DISTINCT FROM event_id % 3 THEN 'model said ' || coalesce(CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2 AS VARCHAR) END, 'nothing') END AS note FROM events",
    "unexpired_rows": f"SELECT event_id FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '{AS_OF}'",
    "registry_urls": "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderkey % 3 < 2 AND CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1998-08-02' - INTERVAL 90 DAYS",
    "calibrated_or_default": """
SELECT l_returnflag, floor(quantile_cont(l_quantity, 0.1) * 100 + 0.5) / 100 AS low, floor(quantile_cont(l_quantity, 0.9) * 100 + 0.5) / 100 AS high, true AS calibrated, 5 AS least FROM lineitem GROUP BY 1
UNION ALL SELECT unnest(['A', 'N', 'R']), 1.0, 2.0, false, 0""",
    "dynamic_caps": "SELECT o_custkey, CASE WHEN 3 * count(*) < 30 THEN 20 WHEN 3 * count(*) < 42 THEN 15 ELSE 12 END AS cap FROM orders GROUP BY 1",
    "request_filters": "SELECT s_suppkey, composite FROM (SELECT *, round((s_acctbal + 1000) / 110, 4) AS composite FROM supplier) WHERE s_nationkey IN (1, 3, 5, 7) AND composite BETWEEN 0 AND 60 ORDER BY composite DESC, s_name LIMIT 15",
    "csv_source": """
SELECT c_custkey AS id, 'say "' || c_name || '", or not' AS name, substr(upper(replace(c_mktsegment, ' ', '')), 1, 3) AS iso, round(c_acctbal, 2) AS score, CAST(NULL AS VARCHAR) AS gone FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 > 1""",
    "public_rows_by_view": "SELECT CASE o_orderstatus WHEN 'F' THEN 'value' ELSE 'change' END AS kind, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL",
}
