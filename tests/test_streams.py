"""State that expires across triggers, and sinks that a rerun doesn't change."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tessaly.streaming import expiring, ingest, jobs

DAY = dt.datetime(2024, 1, 1)


def staged(spark, folder, batches, schema):
    """A file a batch, in the order of their times of change, so each is a trigger of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return jobs.source(spark, str(folder / "*.parquet"), files_a_trigger=1)


def test_cache_forgets_after_its_time(spark, tmp_path):
    at = lambda hours: DAY + dt.timedelta(hours=hours)
    batches = [[("k", at(0), 1), ("k", at(5), 2), ("m", at(1), 3), ("k", None, 9)], [("k", at(23), 4), ("k", at(24), 5), ("m", at(30), 6)], [("z", at(200), 7)], [("k", at(201), 8), ("k", at(202), 10)]]
    stream = staged(spark, tmp_path / "in", batches, "k string, at timestamp_ntz, id int")
    got = {r["id"] for r in jobs.drain(expiring.cache_fetches(stream, ["k"], "at", "id", 24)).collect()}
    assert got == {1, 3, 5, 6, 7, 8}


def test_blocked_domains_forget_hashes(spark, tmp_path):
    at = lambda hours: DAY + dt.timedelta(hours=hours)
    row = lambda domain, seq, hours, url, h, thin=False, wall=False: (domain, seq, at(hours), url, h, thin, wall)
    batches = [
        [row("same", 1, 0, "/a", "h"), row("late", 2, 0, "/a", "h"), row("thin", 3, 0, "/a", "i", True), row("one", 4, 0, "/a", "h"), row("blank", 5, 0, "/a", "")],
        [row("same", 6, 5, "/b", "h"), row("thin", 7, 5, "/b", "j", True), row("one", 8, 5, "/a", "h"), row("wall", 9, 5, "/a", "a", False, True), row("wall", 10, 5, "/b", "b", False, True), row("blank", 11, 5, "/b", "")],
        [row("late", 12, 100, "/b", "h"), row("same", 13, 100, "/c", "h")],
    ]
    stream = staged(spark, tmp_path / "in", batches, "domain string, seq long, at timestamp_ntz, url string, content_hash string, thin boolean, challenge boolean")
    got = {r["domain"]: (r["signal"], r["seq"]) for r in jobs.drain(expiring.blocked_domains(stream, hours=24)).collect()}
    assert got == {"same": ("hash_equality", 6), "thin": ("thin_fanout", 7), "wall": ("challenge_fanout", 10)}


def test_ingest_is_idempotent(spark, tmp_path):
    schema = "url string, at int"
    stream = lambda: staged(spark, tmp_path / "in", [], schema)
    staged(spark, tmp_path / "in", [[("u", 2), ("v", 1)], [("u", 1), ("w", 5)]], schema)
    path = str(tmp_path / "out")
    for _ in range(2):
        ingest.ingest(stream(), path, ["url"], [F.col("at").asc()])
    got = sorted(tuple(r) for r in ingest.written_rows(spark, path, ["url"], schema).select("url", "at").collect())
    assert got == [("u", 2), ("v", 1), ("w", 5)] and ingest.batches(spark, path, schema).count() == 3
    # a batch that is run again replaces its own rows only
    again = spark.createDataFrame([("u", 2), ("v", 1)], schema)
    ingest.write_batch(again, path, 0, ["url"], [F.col("at").asc()], schema)
    assert ingest.batches(spark, path, schema).count() == 3
    # two batches at the same time may both bring a row; readers see one
    again.write.mode("overwrite").parquet(f"{path}/batch=7")
    assert ingest.written_rows(spark, path, ["url"], schema).count() == 3


def test_checksums_are_read_back(spark):
    df = spark.createDataFrame([("a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("b", "x")], "t string, h string")
    assert [r["intact"] for r in ingest.verified(df, "t", "h").orderBy("t").collect()] == [True, False]


def test_state_travels_with_rows(spark, tmp_path):
    """Python that asks the JVM for each piece of a key's state takes many times as long for many keys."""
    rows = [("d", 1, DAY, "/a", "h", False, False)]
    stream = staged(spark, tmp_path / "in", [rows], "domain string, seq long, at timestamp_ntz, url string, content_hash string, thin boolean, challenge boolean")
    for out in (expiring.blocked_domains(stream), expiring.cache_fetches(stream, ["domain"], "at", "seq", 24)):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" not in plan and "WithState" in plan


def test_cache_state_is_dealt_to_groups(spark, tmp_path):
    """A call of Python and a row of state for each key take many times as long as the key's rows."""
    schema, n = "k long, at timestamp_ntz, id long", 5000
    folder = tmp_path / "in"
    spark.range(n).selectExpr("id AS k", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id % 60) AS at", "id").union(spark.createDataFrame([(3, DAY + dt.timedelta(hours=23), n), (3, DAY + dt.timedelta(hours=25), n + 1)], schema)).write.parquet(str(folder))
    out = expiring.cache_fetches(jobs.source(spark, str(folder / "*.parquet"), files_a_trigger=100), ["k"], "at", "id", 24)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] <= 2048
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {*range(n), n + 1}


def test_cache_keeps_keys_apart_and_numbers_whole(spark, tmp_path):
    """All in one group: null, empty and zero keys, and numbers that a double doesn't hold."""
    big, at = 2**53, lambda hours: DAY + dt.timedelta(hours=hours)
    batches = [[(None, "a", at(0), big + 1), ("a", None, at(0), big + 3), ("null", "a", at(0), 1), ("", "a", at(0), 2), ('","', "a", at(0), None), ("t", "t", at(1), big + 3), ("t", "t", at(1), big + 1), ("t", "t", at(2), None)], [(None, "a", at(23), 4), ("a", None, at(24), 5), ("t", "t", at(25), 6)]]
    stream = staged(spark, tmp_path / "in", batches, "k string, j string, at timestamp_ntz, id long")
    got = [r["id"] for r in jobs.drain(expiring.cache_fetches(stream, ["k", "j"], "at", "id", 24, groups=1)).collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 5, 6, big + 1, big + 1, big + 3] and len(got) == 8
    rows = [(big + 1, 0.0, at(0), 1), (big, 0.0, at(0), 2), (big, -0.0, at(1), 3), (None, 0.0, at(0), 4), (None, None, at(0), 5), (big, float("nan"), at(2), 6)]
    stream = staged(spark, tmp_path / "numbers", [rows], "k long, x double, at timestamp_ntz, id int")
    out = expiring.cache_fetches(stream, ["k", "x"], "at", "id", 24, groups=1)
    assert {(r["k"], r["id"]) for r in jobs.drain(out).collect()} == {(big + 1, 1), (big, 2), (None, 4), (None, 5), (big, 6)}
