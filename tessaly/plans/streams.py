"""Structured Streaming jobs drained over the events table, with their batch twins as oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.plans.tables import table
from tessaly.sources.stored import shared_folder
from tessaly.streaming import expiring, ingest, jobs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.source(spark, f"{d}/events.parquet")


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.deduplicated(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"))


def stream_drift(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.changes_of_value(_events(spark, d), "user_id", "ts", "event_id", "event_type"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts; the last day stays open behind the watermark and isn't emitted."""
    return jobs.drain(jobs.window_counts(_events(spark, d), "ts", "event_type", "1 day", "1 hour")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _observations(e: DataFrame) -> DataFrame:
    return e.select(
        F.concat(F.lit("d"), F.col("user_id")).alias("domain"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.concat(F.lit("/"), F.col("event_id") % 3).alias("url"), F.when(F.col("value") > 97, "").otherwise(F.floor("value").cast("string")).alias("content_hash"),
        (F.col("event_type") == "view").alias("thin"), (F.col("event_type") == "click").alias("challenge"),
    )


def stream_blocker(spark: SparkSession, d: str) -> DataFrame:
    """Hashes are forgotten after two days."""
    return jobs.drain(expiring.blocked_domains(_observations(_events(spark, d)), hours=48))


def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a cache of 24 hours for each user and kind of event misses."""
    return jobs.drain(expiring.cache_fetches(_events(spark, d), ["user_id", "event_type"], "ts", "event_id", expiring.SCRAPE_HOURS)).select("event_id")


def stream_discovery_cache(spark: SparkSession, d: str) -> DataFrame:
    """The same with the seven days of discovered URLs, for each user."""
    return jobs.drain(expiring.cache_fetches(_events(spark, d), ["user_id"], "ts", "event_id", expiring.DISCOVERY_HOURS)).select("event_id")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Insert-ignore by user and kind, the stream run twice over the same rows: the second run adds nothing."""
    path = f"{shared_folder(spark)}/signals-{uuid.uuid4().hex}"
    rows = lambda: _events(spark, d).select("user_id", "event_type", "ts", "event_id")
    for _ in range(2):
        ingest.ingest(rows(), path, ["user_id", "event_type"], [F.col("ts").asc(), F.col("event_id").asc()])
    found = ingest.batches(spark, path, "user_id long, event_type string, ts timestamp_ntz, event_id long")
    return found.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))


def archive_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed rows, written by two batches over the same texts and one of them again; read back with their
    checksums: one row for each content."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    schema = "digest string, source string, text string, doc_id long"
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "source", "text", "doc_id")
    for batch in (1, 2, 1):
        ingest.write_batch(docs, path, batch, ["digest"], [F.col("doc_id").asc()], schema)
    found = ingest.verified(ingest.written_rows(spark, path, ["digest"], schema), "text", "digest")
    return found.select("digest", "doc_id", "intact")


def history_rerun(spark: SparkSession, d: str) -> DataFrame:
    """A history of two runs, the second of which was run twice."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    scores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("programme"), F.round("s_acctbal", 2).alias("composite"))
    for run in ("first", "second", "second"):
        ingest.write_run(scores, path, run)
    return spark.read.parquet(path).groupBy("programme").agg(F.count(F.lit(1)).alias("n"), F.max("composite").alias("composite"))


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_drift, stream_windows, stream_blocker, stream_cache, stream_discovery_cache, stream_ingest, archive_rerun, history_rerun)}
_CACHE = """
WITH RECURSIVE e AS (SELECT {0} AS k, event_id, ts, row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id) AS n FROM events),
x AS (SELECT a.k, a.n, (SELECT min(b.n) FROM e b WHERE b.k = a.k AND b.ts >= a.ts + INTERVAL {1} HOURS) AS m FROM e a),
c(k, n) AS (SELECT DISTINCT k, CAST(1 AS BIGINT) FROM e UNION ALL SELECT x.k, x.m FROM c JOIN x ON x.k = c.k AND x.n = c.n WHERE x.m IS NOT NULL)
SELECT event_id FROM c JOIN e ON e.k = c.k AND e.n = c.n"""
ORACLE_SQL = {
    "stream_cache": _CACHE.format("user_id || ' ' || event_type", 24),
    "stream_discovery_cache": _CACHE.format("user_id", 168),
    "stream_ingest": "SELECT user_id, event_type, CAST(1 AS BIGINT) AS n, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "archive_rerun": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, true AS intact FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "history_rerun": "SELECT s_suppkey AS programme, CAST(2 AS BIGINT) AS n, round(s_acctbal, 2) AS composite FROM supplier",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_drift": "SELECT user_id, ts AS at, previous, event_type AS current FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NOT NULL AND previous <> event_type",
    "stream_blocker": """
WITH o AS (SELECT 'd' || user_id AS domain, event_id AS seq, ts, event_id % 3 AS url, CASE WHEN value > 97 THEN NULL ELSE floor(value) END AS h, event_type = 'view' AS thin, event_type = 'click' AS challenge FROM events),
c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY domain, h ORDER BY ts, seq) <= INTERVAL 48 HOURS THEN 2 ELSE 1 END AS hn FROM o),
r AS (SELECT domain, seq, ts, max(CASE WHEN h IS NULL THEN 0 ELSE hn END) OVER w AS hashes, sum(thin::INT) OVER w AS thins, sum(challenge::INT) OVER w AS challenges, min(url) OVER w <> max(url) OVER w AS paths FROM c WINDOW w AS (PARTITION BY domain ORDER BY ts, seq)),
s AS (SELECT *, CASE WHEN NOT paths THEN NULL WHEN hashes > 1 THEN 'hash_equality' WHEN thins > 1 THEN 'thin_fanout' WHEN challenges > 1 THEN 'challenge_fanout' END AS signal FROM r)
SELECT domain, signal, seq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS k FROM s WHERE signal IS NOT NULL) WHERE k = 1""",
}
