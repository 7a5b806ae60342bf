"""Rankings pages, series, selections and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators import rows
from tessaly.plans.tables import table


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """Customers as programmes: latest order as score, finished orders as populated fields, filters, order, page."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    latest = rows.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_totalprice", "o_orderdate")
    done = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_done"))
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    where = rows.Filters(lists={"c_mktsegment": ["BUILDING", "MACHINERY"], "r_name": []}, ranges={"o_totalprice": (1000, None)}, present=["o_totalprice"])
    joined = (
        table(spark, d, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(latest, F.col("c_custkey") == latest["o_custkey"], "left")
        .drop("o_custkey")
        .join(done, F.col("c_custkey") == done["o_custkey"], "left")
        .where(where.column())
        .select("c_custkey", "c_name", "n_name", "r_name", F.round("o_totalprice", 2).alias("latest_price"), "o_orderdate", F.coalesce("n_done", F.lit(0)).alias("n_done"))
    )
    return rows.page(rows.ordered(joined, "latest_price", True, "c_name", scored="latest_price"))[0]


def rankings_total(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").where(rows.Filters(lists={"c_mktsegment": ["BUILDING"]}, ranges={"c_acctbal": (0, 5000)}).column())
    return rows.page(df)[1]


def rankings_page2(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("composite"))
    return rows.page(rows.ordered(df, "composite", False, "s_name"), 10, 20)[0]


def score_history_12(spark: SparkSession, d: str) -> DataFrame:
    cents = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    series = rows.latest_series(cents, "o_custkey", "o_orderdate", "o_orderkey", "cents", 12)
    return series.select("o_custkey", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


def country_index(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    best = rows.first_per_key(customer, ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_name").asc(), F.col("c_custkey").asc()]).select("c_nationkey", F.col("c_name").alias("best_name"))
    stats = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("c_acctbal"), 2).alias("best"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.bool_or(F.col("c_acctbal") < 0).alias("any_negative"))
    both = best.join(stats, "c_nationkey")
    return table(spark, d, "nation").join(both, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), "best_name", "best", "mean", F.coalesce("any_negative", F.lit(False)).alias("any_negative"))


def leaders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.round(F.max("c_acctbal"), 2).alias("best"))


def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return rows.top_per_key(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], 5).select("p_brand", "place", "p_partkey")


def scored_rank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("score", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")))
    return rows.rank_positions(s.where("score IS NOT NULL"), "score", "s_suppkey").select("s_suppkey", "rank").join(s.select("s_suppkey"), "s_suppkey", "right")


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.select("c_custkey").join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'P'").select("o_custkey").intersect(o.where("o_totalprice > 300000").select("o_custkey"))


def set_union_sorted(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))
    return keys.distinct().orderBy("k")


def facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


def concatenated(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    both = c.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(s.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))
    return both.groupBy("nation", "kind").agg(F.count(F.lit(1)).alias("n"))


def anti_join_unscored(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def semi_join_members(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    """All definitions (nations) with the values of one programme (a segment): its filter is on the right side only."""
    one = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
    n = one.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return table(spark, d, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", "k")


def zero_counts(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.left_with_zero(table(spark, d, "customer").select("c_custkey"), right, "c_custkey", "n")


def early_exit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") / 100).alias("conf"))
    return rows.until_confident(e, "user_id", "at", "conf", 0.9).select("event_id", "user_id")


def latest_winner(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rows.superseded(e, "user_id", "ts", "event_id").select("event_id", "user_id", "superseded_by", "is_published")


def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return rows.first_per_key(li, ["l_orderkey"], [F.col("l_discount").desc(), *[F.col(c).asc() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]]).select("l_orderkey", "l_linenumber", "l_partkey")


def public_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Programmes by country and name, then countries by name."""
    entry = lambda df, part, group, name, url: df.select(F.lit(part).alias("part"), group.alias("group"), name.alias("name"), url.alias("url"))
    a = entry(table(spark, d, "supplier"), 1, F.col("s_nationkey"), F.col("s_name"), F.concat(F.lit("/programmes/"), "s_suppkey"))
    b = entry(table(spark, d, "nation"), 2, F.lit(0), F.col("n_name"), F.concat(F.lit("/countries/"), F.lower("n_name")))
    return rows.ranked(a.unionByName(b), [F.col(c).asc() for c in ("part", "group", "name")], "place").select("place", "url")


def nation_tree(spark: SparkSession, d: str) -> DataFrame:
    from tessaly.operators.nested import tree

    j = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    t = tree(j, ["r_name"], ["n_name"], ["s_suppkey"])
    text = F.array_join(F.transform("children", lambda n: F.concat(n["n_name"], F.lit(":"), F.array_join(F.transform(n["children"], lambda s: s["s_suppkey"].cast("string")), "+"))), ";")
    return t.select("r_name", text.alias("children"))


QUERIES = {
    f.__name__: f
    for f in (
        rankings, rankings_total, rankings_page2, score_history_12, country_index, leaders, top_n_per_group, scored_rank, set_difference, set_intersection, set_union_sorted, facets, concatenated, anti_join_unscored,
        semi_join_members, dense_grid, zero_counts, early_exit, latest_winner, argmax_first, public_rows, sitemap, nation_tree,
    )
}

ORACLE_SQL = {
    "rankings": """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM o) WHERE k = 1),
n AS (SELECT o_custkey, count(*) AS n_done FROM o WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, c_name, n_name, r_name, round(l.o_totalprice, 2) AS latest_price, l.o_orderdate, coalesce(n_done, 0) AS n_done
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND l.o_totalprice >= 1000
ORDER BY latest_price DESC NULLS LAST, c_name LIMIT 100""",
    "rankings_total": "SELECT count(*) AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000",
    "rankings_page2": "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS composite FROM supplier ORDER BY composite ASC NULLS LAST, s_name LIMIT 10 OFFSET 20",
    "score_history_12": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, string_agg(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS series FROM r WHERE k <= 12 GROUP BY o_custkey""",
    "country_index": """
WITH b AS (SELECT c_nationkey, c_name AS best_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_name, c_custkey) AS k FROM customer) WHERE k = 1),
s AS (SELECT c_nationkey, count(*) AS n, round(max(c_acctbal), 2) AS best, round(avg(c_acctbal), 6) AS mean, bool_or(c_acctbal < 0) AS any_negative FROM customer GROUP BY c_nationkey)
SELECT n_name, coalesce(n, 0) AS n, best_name, best, mean, coalesce(any_negative, false) AS any_negative FROM nation LEFT JOIN b ON b.c_nationkey = n_nationkey LEFT JOIN s ON s.c_nationkey = n_nationkey""",
    "leaders": "SELECT c_nationkey, round(max(c_acctbal), 2) AS best FROM customer GROUP BY c_nationkey",
    "top_n_per_group": "SELECT p_brand, CAST(place AS INTEGER) AS place, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5",
    "scored_rank": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN row_number() OVER (PARTITION BY s_suppkey % 5 <> 0 ORDER BY s_acctbal DESC, s_suppkey) END AS rank FROM supplier",
    "set_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_intersection": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "set_union_sorted": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k",
    "facets": "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1",
    "concatenated": "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL",
    "anti_join_unscored": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)",
    "semi_join_members": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)",
    "dense_grid": "SELECT n_nationkey, n_name, k FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey",
    "zero_counts": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer",
    "early_exit": """
SELECT event_id, user_id FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR best < 0.9""",
    "latest_winner": """
SELECT event_id, user_id, lead(event_id) OVER w AS superseded_by, lead(event_id) OVER w IS NULL AS is_published FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "argmax_first": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1",
    "public_rows": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "sitemap": "SELECT row_number() OVER (ORDER BY p, g, n) AS place, url FROM (SELECT 1 AS p, s_nationkey AS g, s_name AS n, '/programmes/' || s_suppkey AS url FROM supplier UNION ALL SELECT 2, 0, n_name, '/countries/' || lower(n_name) FROM nation)",
    "nation_tree": """
WITH n AS (SELECT r_name, n_name, string_agg(CAST(s_suppkey AS VARCHAR), '+' ORDER BY s_suppkey) AS s FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name, string_agg(n_name || ':' || s, ';' ORDER BY n_name) AS children FROM n GROUP BY 1""",
}
