"""Row selection, URL allocation, text rules, sources, streams and the entry point."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from tessaly.functions import text as T
from tessaly.operators import feeds, links, nested, rows
from tessaly.sources import files
from tessaly.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_filters_from_params():
    f, sort, down = rows.filters_from_params({"country": "AUS, SGP,", "min": "-5", "max": "abc", "sort": "nope", "dir": "asc"}, {"country": "iso"})
    assert f.lists == {"iso": ["AUS", "SGP"]} and f.ranges == {"composite": (0, None)} and sort == "composite" and not down


def test_unscored_are_last_both_ways(spark):
    df = spark.createDataFrame([("b", None), ("a", 1.0), ("c", 2.0)], "name string, composite double")
    order = lambda sort, down: [r["name"] for r in rows.ordered(df, sort, down, "name").collect()]
    assert order("composite", True) == ["c", "a", "b"] and order("composite", False) == ["a", "c", "b"] and order("name", False) == ["a", "c", "b"]


def test_early_exit_keeps_the_confident_row(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([0.5, 0.95, 0.2])] + [("m", 0, 0.1)], "key string, i int, c double")
    assert sorted((r["key"], r["i"]) for r in rows.until_confident(df, "key", "i", "c", 0.9).collect()) == [("k", 0), ("k", 1), ("m", 0)]


def test_merged_urls_precedence(spark):
    data = [("u", "proven", 1, "p"), ("u", "registry", 2, "r"), ("v", "registry", 3, "r"), ("v", "fresh", 4, "f"), ("w", "fresh", 5, "f"), ("w", "field_proven", 6, "fp"), ("x", "proven", 7, "p")]
    got = {r["key"]: (r["tag"], r["position"]) for r in links.merged_urls(spark.createDataFrame(data, "key string, origin string, position int, tag string"), ["key"]).collect()}
    assert got == {"u": ("r", 1), "v": ("f", 3), "w": ("fp", 5), "x": ("p", 7)}


def test_quotas_backfill(spark):
    df = spark.createDataFrame([(1, t, n) for t, k in ((1, 1), (2, 6), (3, 4)) for n in range(k)], "g int, tier int, n int")
    got = links.tier_quotas(df, ["g"], [F.col("n").asc()], {1: 3, 2: 2, 3: 1}, 8, [2, 1, 3]).collect()
    assert [(r["tier"], r["n"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 0), (2, 0), (2, 1), (3, 0), (2, 2), (2, 3), (2, 4), (2, 5)]
    assert [one(spark, links.dynamic_cap(F.lit(n))) for n in (29, 30, 41, 42)] == [20, 15, 15, 12]


def test_both_directions_prefer_the_given(spark):
    got = {(r["a"], r["b"]): r["s"] for r in links.both_ways(spark.createDataFrame([("x", "y", "d"), ("y", "x", "e"), ("x", "z", "f")], "a string, b string, s string"), "a", "b").collect()}
    assert got == {("x", "y"): "d", ("y", "x"): "e", ("x", "z"): "f", ("z", "x"): "f"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.com:443/a/?utm_source=x&b=1&gclid=2#f", "https://ex.com/a?b=1#f"), ("http://ex.com", "http://ex.com/"), ("http://ex.com/", "http://ex.com/"),
        ("http://ex.com:8080/p/?fbclid=1", "http://ex.com:8080/p"), (" not a url ", "not a url"), ("http://ex.com/a?gclidx=1", "http://ex.com/a?gclidx=1"),
    ],
)
def test_normal_url(spark, url, want):
    assert one(spark, T.normal_url(F.lit(url))) == want


def test_text_rules(spark):
    assert one(spark, T.hash_tag(F.lit("abc"))) == f"RV-{440920332 % 2**24:06X}" and one(spark, T.hash_tag(F.lit(""))) == "RV-000000"
    assert one(spark, T.news_severity(F.lit("they terminate it"))) == "unknown" and one(spark, T.news_severity(F.lit("Repeal and launch"))) == "breaking"
    assert one(spark, T.keywords(F.lit("The Minimum wage (per year) / wage – level"))) == ["minimum", "wage", "year", "level"]
    assert one(spark, T.scrape_status(F.lit("x" * 1499), F.lit(200))) == "short_content" and one(spark, T.scrape_status(F.lit("x" * 1500), F.lit(200))) == "ok" and one(spark, T.scrape_status(F.lit("Error 404: page Not Found"), F.lit(200))) == "soft_404"
    assert one(spark, T.gap_class(F.array(F.lit("fee")), F.lit("x" * 30000 + " fee"), F.lit(True))) == "TRUNCATION" and one(spark, T.gap_class(F.array(F.lit("fee")), F.lit("coffee"), F.lit(False))) == "ABSENT"
    assert one(spark, T.currency(F.lit("US$ 5"), F.lit("AUS"))) == ("USD", "5") and one(spark, T.currency(F.lit("$5"), F.lit("AUS"))) == ("AUD", "5") and one(spark, T.currency(F.lit("$5"), F.lit("FRA"))) is None
    assert one(spark, feeds.bulk_candidate(F.lit("0.9"), F.lit("0.85"), F.lit(None).cast("string"))) and not one(spark, feeds.bulk_candidate(F.lit("0.9"), F.lit(None).cast("string"), F.lit("true")))
    assert not one(spark, feeds.bulk_candidate(F.lit("0.9"), F.lit("0.9"), F.lit("false")))


def test_content_windows(spark):
    near = "z" * 1500 + " needle " + "z" * 2000 + " needle " + "z" * 9000
    texts = [
        ("a" * 20000 + " needle " + "b" * 20000, ["needle"]), ("short", ["x"]), ("c" * 9000, []), (None, ["x"]), ("x" * 9000 + " needles " + "y" * 9000, ["needle"]), (near, ["needle"]),
        ("e" * 4000 + " two words " + "e" * 6000, ["two words"]), ("f" * 4000 + " c++ " + "f" * 6000, ["c++"]), ("g" * 9000, None),
    ]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)], "id int, t string, w array<string>")
    got = {r["id"]: r for r in nested.content_windows(df, "id", "t", "w", 6300).collect()}
    first = got[0]["window"]
    assert "needle" in first and first.startswith("a" * 2000) and first.endswith("b" * 800) and len(first) <= 6300
    assert got[1]["window"] == "short" and got[1]["chunks"] is None and got[2]["window"] == "c" * 6300 and got[3]["window"] == "" and got[8]["window"] == "g" * 6300
    # whole words only; neighbours cost no more than they add and have no gap
    assert "needles" not in got[4]["window"] and got[5]["window"].startswith(near[:3800])
    assert " two words " in got[6]["window"] and " c++ " in got[7]["window"]


def test_provenance_and_flatten(spark):
    record = '{"sourceTier": null, "sourceUrl": "u", "contentHash": null}'
    got = one(spark, nested.provenance_issues(F.lit(record), F.lit("approved")))
    assert "sourceTier" not in got and "sourceUrl" not in got and "contentHash" in got and got[-3:] == nested.APPROVED_KEYS
    assert one(spark, nested.provenance_issues(F.lit("[]"), F.lit("approved"))) == ["not_an_object"] == one(spark, nested.provenance_issues(F.lit(None).cast("string"), F.lit("x")))
    texts = [(1, '{"a":{"b":2,"e":{"f":{"g":true}}},"c":[1, {"x":2}],"d":null,"h":{},"i":"t","j":1.50}'), (2, "broken"), (3, None), (4, "[1]"), (5, "7")]
    flat = nested.flattened(spark.createDataFrame(texts, "id int, j string"), "id", "j")
    want = {(1, "a.b", "2"), (1, "a.e.f.g", "true"), (1, "c", '[1,{"x":2}]'), (1, "d", None), (1, "i", "t"), (1, "j", "1.5"), (4, "", "[1]"), (5, "", "7")}
    assert {tuple(r) for r in flat.collect()} == want and flat.count() == len(want)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', "AUS", "1.5"), ("two\nlines", "NaN", "2"), ("x", "SGP", "nan")], "`Long-Name` string, iso string, n string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), {"name": ["title", "long_name"], "iso": ["iso"], "n": ["n"], "gone": ["gone"]})
    assert {r["name"] for r in back.collect()} == {'say "hi", ok', "two lines", "x"} and back.where("gone IS NOT NULL").count() == 0
    assert [r["iso"] for r in files.valid_rows(back, "iso", ["n"]).collect()] == ["AUS"]


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, links.inserted_new(old, new, ["k"], [F.col("v").asc()]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert (2, "b") not in set(map(tuple, links.upserted(old, new, ["k"]).collect()))


def test_dedupe_looks_at_written_rows_only(spark):
    rows = [("k", f"2024-01-{1 + d:02d}" if d < 31 else f"2024-02-{d - 30:02d}", d, "x") for d in (0, 20, 45, 50)] + [("m", "2024-01-01", 1, "y"), ("m", "2024-01-31", 2, "z")]
    df = spark.createDataFrame(rows, "k string, at string, id int, more string").withColumn("at", F.to_timestamp("at"))
    assert {(r["k"], r["id"]) for r in feeds.without_recent(df, ["k"], "at", "id", 30).collect()} == {("k", 0), ("k", 45), ("m", 1), ("m", 2)}


def test_last_of_an_origin_counts(spark):
    data = [("a", "registry", 1, "r1"), ("a", "registry", 2, "r2"), ("b", "proven", 3, "p1"), ("b", "proven", 4, "p2"), ("c", "fresh", 5, "f1"), ("c", "fresh", 6, "f2")]
    got = {r["key"]: (r["tag"], r["position"]) for r in links.merged_urls(spark.createDataFrame(data, "key string, origin string, position int, tag string"), ["key"]).collect()}
    assert got == {"a": ("r2", 1), "b": ("p1", 3), "c": ("f2", 5)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    parts = str(tmp_path / "events.parquet")
    events.repartition(6, "user_id").sortWithinPartitions("ts").write.parquet(parts)
    stream = jobs.source(spark, "/root/testdata/sf0.001/events.parquet")
    once = jobs.drain(jobs.deduplicated(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days"))
    assert once.count() == events.select("user_id", "event_type").distinct().count()


def test_entry_and_the_guard(spark, monkeypatch):
    sys.path.insert(0, ".")
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    named = entry.queries()
    assert set(entry.oracle_sql()) <= set(named)
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert "rankings" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]


def test_queries_are_listed_without_a_session():
    import subprocess

    listed = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True)
    assert listed.returncode == 0, listed.stderr


def test_archive_reruns_add_nothing(spark, tmp_path):
    df = spark.createDataFrame([("AUS", "2024-01-01 10:00:00", "h1"), ("AUS", "2024-01-01 11:00:00", "h1"), ("SGP", "2024-01-02 10:00:00", "h2")], "iso string, at string, hash string").withColumn("at", F.to_timestamp("at"))
    path = str(tmp_path / "archive")
    files.write_archive(df, path, "iso", F.col("at"), "hash")
    files.write_archive(df, path, "iso", F.col("at"), "hash", spark.read.parquet(path))
    assert sorted(r["hash"] for r in spark.read.parquet(path).collect()) == ["h1", "h2"]


def test_upsert_takes_one_row_of_a_key(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "k int, v string")
    assert sorted(tuple(r) for r in links.upserted(old, new, ["k"], [F.col("v").desc()]).collect()) == [(1, "c"), (2, "d")]


def test_dedupe_against_a_loop(spark):
    import random

    r = random.Random(4)
    data = [(r.choice(["k", "m", None]), r.randrange(0, 2000), i) for i in range(400)] + [("k", None, 999)]
    df = spark.createDataFrame(data, "k string, day int, id int").withColumn("at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)"))
    want, last = set(), {}
    for k, day, i in sorted((x for x in data if x[1] is not None), key=lambda x: (str(x[0]), x[1], x[2])):
        if k not in last or day >= last[k] + 30:
            want.add((k, i))
            last[k] = day
    assert {(x["k"], x["id"]) for x in feeds.without_recent(df, ["k"], "at", "id", 30).collect()} == want
    assert feeds.without_recent(df.limit(0), ["k"], "at", "id", 30).count() == 0
