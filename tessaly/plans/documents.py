"""Search and programme documents over the driver tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import scores
from tessaly.operators import documents as D
from tessaly.operators import search as S
from tessaly.plans.tables import table


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"), F.col("text").alias("body"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the benchmark as queries: two words with control characters and stop words, the whole text (cut at 200
    characters), a word that no text has, punctuation only, the first word."""
    i, words = F.col("item_id"), F.split("text", " ")
    text = F.when(i % 5 == 0, F.concat(F.lit("\t the\x00 "), words[0], F.lit("\x07of\x1f"), words[1], F.lit(" \n"))).when(i % 5 == 1, F.col("text")).when(i % 5 == 2, F.concat(words[0], F.lit(" zzqxz"))).when(i % 5 == 3, " ...!! - ").otherwise(F.upper(words[0]))
    return table(spark, d, "benchmark").select("item_id", text.alias("query"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    queries = _queries(spark, d)
    index = S.inverted_index(_titled(spark, d), "doc_id", "title", "body", S.query_terms(queries, "query"))
    return S.search(index, queries, "doc_id", "item_id", "query")


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of every query with its rank."""
    hits = _hits(spark, d)
    return hits.select("item_id", "doc_id", F.round("rank", 6).alias("rank"))


def search_first_hits(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of each query."""
    hits = _hits(spark, d)
    return S.placed_hits(hits.withColumn("rank", F.round("rank", 6)), "doc_id", "item_id").where("place <= 3").select("item_id", "place", "doc_id")


def search_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the queries: sanitised, and their distinct lexemes."""
    q = _queries(spark, d).select("item_id", S.sanitised(F.col("query")).alias("text"))
    return q.select("item_id", "text", F.array_join(F.array_sort(F.array_distinct(S.lexemes(F.col("text")))), " ").alias("lexemes"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as programmes, nations as countries and versions, parts' sizes as definitions, orders as scores, history
    and changes, lines as values and sources. Customers without orders lack most parts."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    countries = n.join(F.broadcast(regions), "n_regionkey").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("country_name"), "region")
    k = F.col("c_custkey")
    programmes = c.select(
        k.alias("programme"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_acctbal") < 0, "closed").otherwise("open").alias("status"), F.when(k % 3 != 0, F.concat(F.lit("About "), "c_name")).alias("description"),
        (1990 + k % 30).cast("int").alias("launch_year"), F.when(F.col("c_acctbal") < 0, 2020).alias("closure_year"), F.col("c_nationkey").alias("country"), F.when(k % 2 == 0, "long").alias("long_summary"), F.lit(None).cast("timestamp").alias("long_summary_at"), F.lit(None).cast("string").alias("long_summary_by"),
    )
    price = scores.rounded(F.col("o_totalprice") / 5000, 3)
    pillars = F.create_map(*[x for i, p in enumerate("ABCDE") for x in (F.lit(p), F.when((F.col("o_orderkey") % 10 != 1) | F.lit(p != "C"), price + i))])
    base = o.select(
        F.col("o_custkey").alias("programme"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("scored_at"), price.alias("composite"), (price / 2).alias("cme"), (price * 2).alias("paq"), pillars.alias("pillar_scores"), (F.col("o_orderstatus") == "P").alias("flagged"),
        F.col("o_orderkey").alias("version"), F.lit(False).alias("placeholder"),
    )
    versions = spark.range(0, 1).select(F.lit(-1).cast("long").alias("version"), F.lit("none").alias("tag"))
    fields = table(spark, d, "part").groupBy(F.col("p_size").alias("field")).agg(F.count(F.lit(1)).alias("n_parts"))
    definitions = fields.select("field", F.concat(F.lit("f"), "field").alias("key"), F.concat(F.lit("Field "), "field").alias("label"), F.element_at(F.array(*map(F.lit, "ABCDEX")), (F.col("field") % 6 + 1).cast("int")).alias("pillar"), (F.col("field") % 4).alias("sub_factor"), F.lit(0.5).alias("weight"))
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    values = li.groupBy(F.col("o_custkey").alias("programme"), F.col("p_size").alias("field")).agg(F.max("l_quantity").cast("int").cast("string").alias("value_raw"), F.max("l_quantity").alias("score"), F.min(F.when(F.col("l_returnflag") == "R", "approved").otherwise("pending")).alias("status"))
    sources = o.select(F.col("o_custkey").alias("programme"), F.col("o_orderkey").alias("source"), F.concat(F.lit("https://s"), F.col("o_orderkey") % 7).alias("url"), (F.col("o_orderkey") % 3 + 1).alias("tier"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 2 == 0).alias("is_primary"))
    severity = F.element_at(F.array(*map(F.lit, ("minor", "material", "breaking", "url_broken", "odd"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    changes = o.select(F.col("o_custkey").alias("programme"), F.col("o_orderkey").alias("change"), (F.col("o_orderkey") % 60).alias("field"), F.col("o_orderdate").alias("detected_at"), severity.alias("severity"), (F.col("o_orderstatus") != "O").alias("approved"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("summary"), price.alias("paq_delta"))
    return D.programme_documents(programmes, countries, base, definitions, values, sources, changes, base.select("programme", "scored_at", "composite", "cme", "paq", "version"), versions)


def programme_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document by what is in it, its arrays in their order as text."""
    doc = _documents(spark, d)
    line = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    text = lambda *xs: F.concat_ws(",", *[F.coalesce(x.cast("string"), F.lit("-")) for x in xs])
    return doc.select(
        "programme", F.col("header.country_name").alias("country_name"), F.col("header.region").alias("region"), F.col("header.description").alias("description"), F.col("score.composite").alias("composite"), F.col("score.flagged").alias("flagged"), F.round(F.col("score.pillar_scores")["E"], 3).alias("pillar_e"),
        F.col("long_summary.body").alias("long_summary"), line("field_values", lambda x: text(x["pillar"], x["sub_factor"], x["key"], x["value_raw"], x["status"])), line("sources", lambda x: text(x["tier"], x["is_primary"], x["url"], x["source"])),
        line("policy_changes", lambda x: text(x["change"], x["severity"], x["field_key"], x["summary"])), line("score_history", lambda x: x["composite"].cast("decimal(12,3)").cast("string")), F.col("cohort.scored_count").alias("scored_count"), F.round(F.col("cohort.medians")["B"], 6).alias("median_b"),
    )


def programme_json(spark: SparkSession, d: str) -> DataFrame:
    """The documents as JSON text, read back by path."""
    j = D.as_json(_documents(spark, d))
    # one parse for all paths; get_json_object reads the whole text for each
    kept = "header struct<name: string>, score struct<composite: double>, sources array<struct<url: string>>, policy_changes array<struct<change: bigint>>, field_values array<struct<key: string>>"
    j = j.select("programme", F.from_json("document", kept).alias("x"))
    first = lambda c: F.get(F.col(f"x.{c}"), F.lit(0))
    return j.select("programme", F.col("x.header.name").alias("name"), F.col("x.score.composite").alias("composite"), first("sources")["url"].alias("first_source"), first("policy_changes")["change"].alias("last_change"), first("field_values")["key"].alias("first_field"))


QUERIES = {f.__name__: f for f in (search_terms, search_first_hits, search_inputs, programme_documents, programme_json)}

_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"
_HITS = rf"""
i AS (SELECT item_id, string_split(text, ' ') AS w, text FROM benchmark),
q AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN chr(9) || ' the' || chr(1) || ' ' || w[1] || chr(7) || 'of' || chr(31) || w[2] || ' ' || chr(10) WHEN 1 THEN text WHEN 2 THEN w[1] || ' zzqxz' WHEN 3 THEN ' ...!! - ' ELSE upper(w[1]) END AS t FROM i),
s AS (SELECT item_id, trim(regexp_replace(regexp_replace(t, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM q),
u AS (SELECT item_id, CASE WHEN regexp_matches(t, '[A-Za-z0-9]') THEN substring(t, 1, 200) ELSE '' END AS t FROM s),
l AS (SELECT item_id, t, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), lambda x: NOT list_contains({_STOP}, x)) AS ls FROM u)"""
_FOUND = rf"""
p AS (SELECT doc_id, term, count(*) FILTER (WHERE b = 0) AS nt, count(*) FILTER (WHERE b = 1) AS nb FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(regexp_extract(text, '^([^.\n]*)', 1)), '[\p{{L}}\p{{N}}]+')) AS term, 0 AS b FROM documents UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), 1 FROM documents) GROUP BY ALL),
t AS (SELECT item_id, unnest(list_distinct(ls)) AS term, len(list_distinct(ls)) AS n FROM l),
h AS (SELECT item_id, doc_id, round(1.0 * sum(nt) + 0.4 * sum(nb), 6)::DOUBLE AS rank FROM t JOIN p ON p.term = t.term GROUP BY item_id, doc_id, n HAVING count(*) = n)"""
_O = "SELECT o_custkey AS programme, o_orderkey AS k, o_orderdate AS day, o_orderstatus AS s, round(o_totalprice / 5000, 3) AS price, o_orderpriority AS pri FROM orders"
ORACLE_SQL = {
    "search_terms": f"WITH {_HITS}, {_FOUND} SELECT item_id, doc_id, rank FROM h",
    "search_first_hits": f"WITH {_HITS}, {_FOUND} SELECT item_id, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, doc_id) AS place FROM h) WHERE place <= 3",
    "search_inputs": f"WITH {_HITS} SELECT item_id, t AS text, array_to_string(list_sort(list_distinct(ls)), ' ') AS lexemes FROM l",
    "programme_documents": rf"""
WITH o AS ({_O}), latest AS (SELECT *, k % 10 <> 1 AS whole FROM (SELECT *, row_number() OVER (PARTITION BY programme ORDER BY day DESC, k DESC) AS r FROM o) WHERE r = 1),
f AS (SELECT DISTINCT p_size AS field FROM part),
g AS (SELECT c_custkey AS programme, field, substr('ABCDEX', field % 6 + 1, 1) AS pillar, field % 4 AS sub, 'f' || field AS key FROM customer, f WHERE field % 6 < 5),
v AS (SELECT o_custkey AS programme, p_size AS field, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS raw, min(CASE WHEN l_returnflag = 'R' THEN 'approved' ELSE 'pending' END) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
fv AS (SELECT g.programme, string_agg(concat_ws(',', pillar, sub, key, coalesce(raw, '-'), coalesce(status, 'draft')), ';' ORDER BY pillar, sub, key) AS t FROM g LEFT JOIN v ON v.programme = g.programme AND v.field = g.field GROUP BY 1),
so AS (SELECT programme, string_agg(concat_ws(',', k % 3 + 1, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, 'https://s' || k % 7, k), ';' ORDER BY k % 3, k % 2, k % 7, k) AS t FROM o GROUP BY 1),
pc AS (SELECT programme, string_agg(concat_ws(',', k, ['minor', 'material', 'breaking', 'url_broken'][k % 5 + 1], 'f' || k % 60, CASE WHEN k % 3 <> 0 THEN pri ELSE '' END), ';' ORDER BY day DESC, k) AS t FROM o WHERE s <> 'O' AND k % 5 < 4 AND k % 60 IN (SELECT field FROM f) GROUP BY 1),
hi AS (SELECT programme, string_agg(CAST(CAST(price AS DECIMAL(12, 3)) AS VARCHAR), ';' ORDER BY r DESC) AS t FROM (SELECT *, row_number() OVER (PARTITION BY programme ORDER BY day DESC, k DESC) AS r FROM o) WHERE r <= 36 GROUP BY 1),
co AS (SELECT count(*) AS n, median(price + 1) AS m FROM latest WHERE whole)
SELECT c_custkey AS programme, n_name AS country_name, r_name AS region, CASE WHEN c_custkey % 3 <> 0 THEN 'About ' || c_name END AS description, l.price AS composite, l.s = 'P' AS flagged, CASE WHEN l.whole THEN round(l.price + 4, 3) END AS pillar_e,
  CASE WHEN c_custkey % 2 = 0 THEN 'long' END AS long_summary, coalesce(fv.t, '') AS field_values, coalesce(so.t, '') AS sources, coalesce(pc.t, '') AS policy_changes, coalesce(hi.t, '') AS score_history, co.n AS scored_count, round(co.m, 6) AS median_b
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN latest l ON l.programme = c_custkey LEFT JOIN fv ON fv.programme = c_custkey LEFT JOIN so ON so.programme = c_custkey
  LEFT JOIN pc ON pc.programme = c_custkey LEFT JOIN hi ON hi.programme = c_custkey, co""",
    "programme_json": f"""
WITH o AS ({_O}), f AS (SELECT DISTINCT p_size AS field FROM part),
so AS (SELECT programme, arg_min('https://s' || k % 7, (k % 3) * 1000 + (k % 2) * 100 + k % 7) AS url FROM o GROUP BY 1),
pc AS (SELECT programme, k FROM (SELECT *, row_number() OVER (PARTITION BY programme ORDER BY day DESC, k) AS r FROM o WHERE s <> 'O' AND k % 5 < 4 AND k % 60 IN (SELECT field FROM f)) WHERE r = 1),
l AS (SELECT programme, price FROM (SELECT *, row_number() OVER (PARTITION BY programme ORDER BY day DESC, k DESC) AS r FROM o) WHERE r = 1),
d AS (SELECT min(('ABCDE'[field % 6 + 1]) || (field % 4) || ' f' || field) AS x FROM f WHERE field % 6 < 5)
SELECT c_custkey AS programme, c_name AS name, l.price AS composite, so.url AS first_source, pc.k AS last_change, substr(d.x, 4) AS first_field FROM customer LEFT JOIN l ON l.programme = c_custkey LEFT JOIN so ON so.programme = c_custkey LEFT JOIN pc ON pc.programme = c_custkey, d""",
}
