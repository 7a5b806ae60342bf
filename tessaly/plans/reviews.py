"""Provenance checks, review rewrites, re-run modes, derived fields and page texts over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators import derive as D
from tessaly.operators import nested as N
from tessaly.operators import pages as P
from tessaly.operators import reviews as R
from tessaly.plans.tables import table


def _record(keys: list[str], k: Column, special: dict[str, Column]) -> Column:
    """A JSON object with every key but the one that k picks; special: JSON texts of some values."""
    parts = [F.when(k % (len(keys) + 4) != i, F.concat(F.lit(f'"{key}": '), special.get(key, F.lit('"v"')))) for i, key in enumerate(keys)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def provenance_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records of orders that lack one key or have odd offsets and tiers; every seventh is approved without reviewer."""
    k = F.col("o_orderkey")
    offsets = F.when(k % 5 == 0, '{"start": 1, "end": "2"}').when(k % 5 == 1, "[1, 2]").when(k % 5 == 2, "null").otherwise(F.concat(F.lit('{"start": 0, "end": '), k.cast("string"), F.lit("}")))
    tier = F.when(k % 3 == 0, "null").when(k % 3 == 1, '"one"').otherwise("2")
    record = F.when(k % 29 == 0, "[]").otherwise(_record(N.PROVENANCE_KEYS, k, {"characterOffsets": offsets, "sourceTier": tier}))
    status = F.when(k % 7 == 0, "approved").otherwise("pending_review")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(N.provenance_issues(record, status), ";").alias("issues"))


def shown_provenance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    offsets = F.when(k % 5 == 0, "[1]").when(k % 5 == 1, '{"start": 1}').when(k % 5 == 2, "null").otherwise("[0, 7]")
    record = F.when(k % 29 == 0, "7").otherwise(_record(N.SHOWN_KEYS, k, {"charOffsets": offsets, "sourceTier": F.lit("null")}))
    status = F.when(k % 7 == 0, "approved").otherwise("draft")
    return table(spark, d, "orders").select("o_orderkey", N.shown_provenance(record, status).alias("p")).select("o_orderkey", "p.ok", F.array_join("p.missing", ";").alias("missing"))


def extraction_modes(spark: SparkSession, d: str) -> DataFrame:
    """What each mode extracts again: suppliers as programmes, brands as fields, their parts' lines as values and attempts."""
    programmes = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("programme"))
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("least"))
    definitions = brands.select("key", F.when(F.col("least") % 4 != 0, F.col("least") % 3).alias("prompt"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    note = F.when(F.col("l_partkey") % 5 == 0, '{"normalizationError": "bad"}').when(F.col("l_partkey") % 5 == 1, '{"normalizationError": null}').otherwise("{}")
    values = li.where("l_partkey % 2 = 0").select(F.col("l_suppkey").alias("programme"), F.col("p_brand").alias("key"), F.when(F.col("l_returnflag") == "R", "pending_review").otherwise("approved").alias("status"), note.alias("provenance"))
    attempts = li.select(F.col("l_suppkey").alias("programme"), F.col("p_brand").alias("key"), (F.col("l_linestatus") == "F").alias("published"), F.when(F.col("l_partkey") % 6 != 0, F.col("l_partkey") % 3).alias("prompt"))
    out = None
    for mode in R.MODES:
        found = R.fields_to_extract(mode, programmes, definitions, values, attempts, ["Brand#11", "Brand#55", "none"]).select(F.lit(mode).alias("mode"), "programme", "key")
        out = found if out is None else out.unionByName(found)
    return out


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as values, events as decisions on them."""
    k = F.col("o_orderkey")
    key = F.when(k % 2 == 0, "n").otherwise("c")
    o = table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("entity"), key.alias("key"), F.when(k % 2 == 0, "5").otherwise("x").alias("value_raw"), F.when(F.col("o_orderstatus") == "O", "pending_review").otherwise("approved").alias("status"),
        F.lit(50.0).alias("score"), F.when(k % 3 != 0, '{"a":"b"}').alias("provenance"),
    )
    e, i = table(spark, d, "events"), F.col("event_id")
    kinds = F.element_at(F.array(*map(F.lit, ("approve", "reject", "edit", "unapprove"))), (i % 4 + 1).cast("int"))
    edited = F.when(i % 5 == 0, " 8 ").when(i % 5 == 1, "y").when(i % 5 == 2, "  ")
    decisions = e.select((i % 15000 * 4 + 1 + i % 2).alias("id"), kinds.alias("decision"), edited.alias("edited"), F.when(i % 3 == 0, " wrong ").alias("reason"), F.col("ts").alias("at"), i.alias("seq"))
    return o, decisions


def review_transitions(spark: SparkSession, d: str) -> DataFrame:
    schema = "key string, fn string, direction string, low double, high double, mean double, stddev double, rubric map<string,double>"
    definitions = spark.createDataFrame([("n", "min_max", "higher_is_better", 0.0, 10.0, None, None, None), ("c", "categorical", "higher_is_better", None, None, None, None, {"x": 20.0, "y": 80.0})], schema)
    substitutes = spark.createDataFrame([], "key string, region string, value string, score double")
    return R.transitions(*_reviewed(spark, d), definitions, substitutes)


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    o, decisions = _reviewed(spark, d)
    queue = o.where("id % 3 <> 0").select("id", F.lit("flag").alias("reason"), F.lit(1).alias("priority"), "status")
    return R.queue_after(queue, decisions.join(o.select("id"), "id", "left_semi"))


def bulk_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Both bulk approvals over orders: numbers approved, and what is left pending in the values and in the queue."""
    k = F.col("o_orderkey")
    sure = F.concat(F.lit('{"extractionConfidence": '), (k % 100 / 100).cast("string"), F.lit(', "validationConfidence": "0.9", "isValid": '), F.when(k % 5 == 0, "false").otherwise("true"), F.lit("}"))
    o = table(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, "n").otherwise("c").alias("key"), F.col("o_orderstatus").alias("value_raw"), F.when(F.col("o_orderpriority") < "3", "pending_review").otherwise("approved").alias("status"), sure.alias("provenance"))
    rubric = '{"categories": [{"value": "F", "score": 1}, {"value": "P", "score": 2}]}'
    definitions = spark.createDataFrame([("n", "min_max", None), ("c", "categorical", rubric)], "key string, fn string, rubric string")
    out = None
    for confident in (False, True):
        values, queue, n = R.bulk_approved(o, o.select("id", "status"), definitions, F.lit("2024-01-31 00:00:00").cast("timestamp"), confident)
        left = values.agg(F.count_if(F.col("status") == "pending_review").alias("pending"), F.count("reviewed_at").alias("stamped")).crossJoin(queue.agg(F.count_if(F.col("status") == "pending_review").alias("queued")))  # one row each
        row = n.crossJoin(left).withColumn("confident", F.lit(confident))
        out = row if out is None else out.unionByName(row)
    return out


def _policies(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    own = lambda *columns: n.select(k.alias("country"), *columns, F.concat(F.lit("https://p/"), k).alias("source_url"), (F.lit(2000) + k).alias("source_year"))
    note = F.concat(F.lit("of "), "n_name").alias("notes")
    return {
        "timeline": own(F.when(k % 4 != 0, k / 2).alias("years"), note).where("country % 7 <> 0"),
        "presence": own(F.when(k % 3 != 0, k % 2 == 0).alias("pr_required"), F.when(k % 5 != 0, k * 3).alias("pr_days"), F.col("n_name").alias("pr_notes"), F.when(k % 3 == 1, k % 2 == 1).alias("stay_required"), F.lit(None).cast("long").alias("stay_days"), F.lit(None).cast("string").alias("stay_notes")),
        "citizenship": own(F.when(k % 5 != 0, k % 2 == 0).alias("permitted"), note),
        "civic": own(F.when(k % 4 != 1, F.when(k % 2 == 0, "light").otherwise("heavy")).alias("burden"), note),
        "residency": own(F.when(k % 6 != 0, k * 10 + 3).alias("days"), note),
        "basis": own(F.when(k % 9 != 0, "worldwide").alias("basis"), note).where("country < 20"),
    }


def known_fields(spark: SparkSession, d: str) -> DataFrame:
    programmes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("programme"), F.col("s_nationkey").alias("country"))
    found = D.known_fields(programmes, _policies(spark, d))
    return found.select("programme", "key", "value_raw", "number", "sentence", "source_url", "source_year", "content_hash", "model", "confidence")


def volatility_fields(spark: SparkSession, d: str) -> DataFrame:
    histories = table(spark, d, "customer").select(F.col("c_custkey").alias("programme"), F.lit(2015).alias("first_year"), F.lit(2025).alias("last_year"), F.lit("https://h").alias("source_url"))
    level = F.when(F.col("o_orderstatus") == "F", "major").when(F.col("o_orderstatus") == "O", "moderate").otherwise("minor")
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("programme"), F.year("o_orderdate").alias("year"), level.alias("severity"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("seq"))
    return D.volatility_fields(histories, events).select("programme", "value_raw", "number", "sentence", "content_hash")


def main_texts(spark: SparkSession, d: str) -> DataFrame:
    """The readable main text of every page; no SQL parses HTML, so tests hold it against written pages."""
    return P.main_texts(table(spark, d, "pages"), "page_id", "html").select("page_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (provenance_checks, shown_provenance, extraction_modes, review_transitions, review_queue, bulk_approvals, known_fields, volatility_fields, main_texts)}


def _lacking(keys: list[str]) -> str:
    """The key that a record lacks, a null column among the keys told apart before."""
    return "CASE k % " + str(len(keys) + 4) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(keys)) + " END"


_AT = {x: i for i, x in enumerate(N.PROVENANCE_KEYS)}
_SHOWN_AT = {x: i for i, x in enumerate(N.SHOWN_KEYS)}
_DECIDED = """
dd AS (SELECT event_id % 15000 * 4 + 1 + event_id % 2 AS id, ['approve', 'reject', 'edit', 'unapprove'][event_id % 4 + 1] AS d, trim(CASE event_id % 5 WHEN 0 THEN ' 8 ' WHEN 1 THEN 'y' WHEN 2 THEN '  ' END) AS ed, CASE WHEN event_id % 3 = 0 THEN 'wrong' END AS re, ts, event_id FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS r FROM dd) WHERE r = 1)"""
_FIELD = "SELECT programme, '{key}' AS key, {value} AS value_raw, CAST({number} AS DOUBLE) AS number, {notes} AS sentence, {told} AS told, k FROM s WHERE {there}"
ORACLE_SQL = {
    "provenance_checks": f"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 17 AS w, {_lacking(N.PROVENANCE_KEYS).replace('k %', 'o_orderkey %')} AS gone FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 29 = 0 THEN 'not_an_object' ELSE concat_ws(';', CASE WHEN k % 5 = 2 AND w < {_AT['characterOffsets']} THEN gone || ';characterOffsets' WHEN k % 5 = 2 AND gone IS NOT NULL AND w > {_AT['characterOffsets']} THEN 'characterOffsets;' || gone WHEN k % 5 = 2 THEN 'characterOffsets' ELSE gone END,
  CASE WHEN k % 7 = 0 THEN 'reviewedBy;reviewedAt;reviewDecision' END, CASE WHEN k % 5 < 2 AND w <> {_AT['characterOffsets']} THEN 'shape:characterOffsets' END, CASE WHEN k % 3 = 1 AND w <> {_AT['sourceTier']} THEN 'shape:sourceTier' END) END AS issues FROM o""",
    "shown_provenance": f"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 17 AS w, {_lacking(N.SHOWN_KEYS).replace('k %', 'o_orderkey %')} AS gone FROM orders),
m AS (SELECT k, CASE WHEN k % 29 = 0 THEN '{";".join(N.SHOWN_KEYS)}' ELSE concat_ws(';', CASE WHEN k % 5 = 2 AND w < {_SHOWN_AT['charOffsets']} THEN gone || ';charOffsets' WHEN k % 5 = 2 AND gone IS NOT NULL AND w > {_SHOWN_AT['charOffsets']} THEN 'charOffsets;' || gone WHEN k % 5 = 2 THEN 'charOffsets' ELSE gone END,
  CASE WHEN k % 7 = 0 THEN 'reviewer;reviewedAt;reviewerNotes' END, CASE WHEN k % 5 < 2 AND w <> {_SHOWN_AT['charOffsets']} THEN 'charOffsets' END) END AS missing FROM o)
SELECT k AS o_orderkey, missing = '' AS ok, missing FROM m""",
    "extraction_modes": """
WITH p AS (SELECT s_suppkey AS programme FROM supplier WHERE s_nationkey < 20), d AS (SELECT p_brand AS key, CASE WHEN min(p_partkey) % 4 <> 0 THEN min(p_partkey) % 3 END AS prompt FROM part GROUP BY 1),
l AS (SELECT l_suppkey AS programme, p_brand AS key, l_partkey AS k, l_returnflag AS f, l_linestatus AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT programme FROM p))
SELECT 'narrow' AS mode, programme, key FROM p, d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.programme = p.programme AND l.key = d.key AND k % 2 = 0) UNION ALL
SELECT DISTINCT 'gate-failed', programme, key FROM l WHERE k % 2 = 0 AND f = 'R' AND k % 5 = 0 UNION ALL
SELECT DISTINCT 'rubric-changed', programme, l.key FROM l JOIN d ON d.key = l.key WHERE s = 'F' AND prompt IS NOT NULL AND CASE WHEN k % 6 <> 0 THEN k % 3 END IS DISTINCT FROM prompt UNION ALL
SELECT 'field', programme, key FROM p, d WHERE key IN ('Brand#11', 'Brand#55', 'none')""",
    "review_transitions": f"""
WITH {_DECIDED}, v AS (SELECT o_orderkey AS id, o_custkey AS entity, CASE WHEN o_orderkey % 2 = 0 THEN 'n' ELSE 'c' END AS key, CASE WHEN o_orderkey % 2 = 0 THEN '5' ELSE 'x' END AS raw, CASE WHEN o_orderstatus = 'O' THEN 'pending_review' ELSE 'approved' END AS st,
  CASE WHEN o_orderkey % 3 <> 0 THEN '{{"a":"b"}}' END AS pr FROM orders),
j AS (SELECT v.*, d, ed, re, ts, d IN ('approve', 'edit') AND length(ed) > 0 AS anew FROM v LEFT JOIN (SELECT * FROM l WHERE d <> 'edit' OR length(ed) > 0) l ON l.id = v.id)
SELECT id, entity, key, CASE WHEN anew THEN ed ELSE raw END AS value_raw, CASE WHEN d IN ('approve', 'edit') THEN 'approved' WHEN d = 'reject' THEN 'rejected' WHEN d = 'unapprove' THEN 'pending_review' ELSE st END AS status,
  CASE WHEN anew THEN CASE WHEN key = 'n' AND ed = '8' THEN 80 WHEN key = 'c' AND ed = 'y' THEN 80 END ELSE 50 END::DOUBLE AS score,
  CASE WHEN d = 'reject' AND re IS NOT NULL THEN CASE WHEN pr IS NULL THEN '{{"rejectReason":"wrong"}}' ELSE '{{"a":"b","rejectReason":"wrong"}}' END ELSE pr END AS provenance, CASE WHEN d <> 'unapprove' THEN ts END AS reviewed_at FROM j""",
    "review_queue": f"""
WITH {_DECIDED}, v AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending_review' ELSE 'approved' END AS st FROM orders), x AS (SELECT * FROM l WHERE d <> 'edit')
SELECT v.id, 'flag' AS reason, 1 AS priority, CASE d WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'unapprove' THEN 'pending_review' ELSE st END AS status, CASE WHEN d IN ('approve', 'reject') THEN ts END AS resolved_at FROM v LEFT JOIN x ON x.id = v.id WHERE v.id % 3 <> 0
UNION ALL SELECT v.id, 'Re-pended via /review', 50, 'pending_review', NULL FROM v JOIN x ON x.id = v.id WHERE d = 'unapprove' AND v.id % 3 = 0""",
    "bulk_approvals": """
WITH o AS (SELECT o_orderpriority < '3' AS pending, o_orderkey % 2 = 0 OR o_orderstatus IN ('F', 'P') AS fits, o_orderkey % 100 >= 85 AND o_orderkey % 5 <> 0 AS sure FROM orders)
SELECT confident, count(*) FILTER (WHERE pending AND fits AND (sure OR NOT confident)) AS approved, count(*) FILTER (WHERE pending AND NOT (fits AND (sure OR NOT confident))) AS pending, count(*) FILTER (WHERE pending AND fits AND (sure OR NOT confident)) AS stamped,
  count(*) FILTER (WHERE pending AND NOT (fits AND (sure OR NOT confident))) AS queued FROM o, (SELECT unnest([false, true]) AS confident) GROUP BY confident""",
    "known_fields": f"""
WITH s AS (SELECT s_suppkey AS programme, n_nationkey AS k, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
f AS ({" UNION ALL ".join(_FIELD.format(**x) for x in (
    dict(key="D.1.2", value="CASE WHEN k % 2 = 0 THEN CAST(k // 2 AS VARCHAR) ELSE (k // 2) || '.5' END", number="k / 2", notes="'of ' || name", told="CASE WHEN k % 2 = 0 THEN CAST(k // 2 AS VARCHAR) ELSE (k // 2) || '.5' END", there="k % 4 <> 0 AND k % 7 <> 0"),
    dict(key="D.1.3", value="'{\"required\":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',\"daysPerYear\":' || CASE WHEN k % 5 <> 0 THEN CAST(k * 3 AS VARCHAR) ELSE 'null' END || ',\"notes\":\"' || name || '\"}'", number="0", notes="name", told="CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ':' || CASE WHEN k % 5 <> 0 THEN CAST(k * 3 AS VARCHAR) ELSE 'null' END", there="k % 3 <> 0"),
    dict(key="D.1.4", value="'{\"required\":' || CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END || ',\"daysPerYear\":null,\"notes\":null}'", number="0", notes="CAST(NULL AS VARCHAR)", told="CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END || ':null'", there="k % 3 = 1"),
    dict(key="D.2.3", value="CASE WHEN k % 2 = 0 THEN 'permitted' ELSE 'not_permitted' END", number="0", notes="'of ' || name", told="CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", there="k % 5 <> 0"),
    dict(key="D.2.4", value="CASE WHEN k % 2 = 0 THEN 'light' ELSE 'heavy' END", number="0", notes="'of ' || name", told="CASE WHEN k % 2 = 0 THEN 'light' ELSE 'heavy' END", there="k % 4 <> 1"),
    dict(key="D.3.1", value="CAST(k * 10 + 3 AS VARCHAR)", number="k * 10 + 3", notes="'of ' || name", told="CAST(k * 10 + 3 AS VARCHAR)", there="k % 6 <> 0"),
    dict(key="D.3.3", value="'worldwide'", number="0", notes="'of ' || name", told="'worldwide'", there="k % 9 <> 0 AND k < 20"),
))})
SELECT programme, key, value_raw, number, sentence, 'https://p/' || k AS source_url, 2000 + k AS source_year, sha256('derived-knowledge:' || key || ':' || programme || ':' || k || ':' || told) AS content_hash, 'derived-knowledge' AS model, 0.7::DOUBLE AS confidence FROM f""",
    "volatility_fields": """
WITH o AS (SELECT o_custkey AS p, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS w, year(o_orderdate) || ' (' || CASE o_orderstatus WHEN 'F' THEN 'major' WHEN 'O' THEN 'moderate' ELSE 'minor' END || '): ' || o_orderpriority AS t, o_orderkey AS k FROM orders),
g AS (SELECT p, CAST(sum(w) AS BIGINT) AS s, count(*) AS n, arg_min(t, k) AS t FROM o GROUP BY p)
SELECT c_custkey AS programme, CAST(coalesce(s, 0) AS VARCHAR) AS value_raw, coalesce(s, 0)::DOUBLE AS number, coalesce(t, 'No material changes recorded in window 2015-2025.') AS sentence, sha256('derived-knowledge:E.1.1:' || c_custkey || ':' || coalesce(s, 0) || ':' || coalesce(n, 0)) AS content_hash FROM customer LEFT JOIN g ON p = c_custkey""",
}
