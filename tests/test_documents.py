"""Search, documents, page texts, provenance for pages, reviews and re-run modes."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessaly.functions import text as T
from tessaly.operators import derive as V
from tessaly.operators import documents as D
from tessaly.operators import gates as G
from tessaly.operators import links as L
from tessaly.operators import nested as N
from tessaly.operators import pages as P
from tessaly.operators import reviews as R
from tessaly.operators import search as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sanitised_queries(spark):
    assert one(spark, S.sanitised(F.lit("  a\x00b\t\n c\x7f "))) == "a b c" and one(spark, S.sanitised(F.lit(" ..!é "))) == ""
    assert one(spark, S.sanitised(F.lit("x" * 300))) == "x" * 200 and one(spark, S.sanitised(F.lit(None).cast("string"))) == ""
    assert one(spark, S.lexemes(F.lit("The Visa, of AUSTRALIA-482 and the visa"))) == ["visa", "australia", "482", "visa"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Skilled visa", "A visa for nurses"), (2, "Nurses", "visa visa visa"), (3, None, "the skilled"), (4, "x", None)], "id int, title string, body string")
    index = S.inverted_index(docs, "id", "title", "body")
    queries = spark.createDataFrame([("two", "VISA\x00 of nurses"), ("one", "skilled"), ("none", "the of"), ("gone", "visa zebra"), ("null", None), ("twice", "visa visa")], "q string, text string")
    got = {(r["q"], r["id"]): round(r["rank"], 6) for r in S.search(index, queries, "id", "q", "text").collect()}
    assert got == {("two", 1): 1.8, ("two", 2): 2.2, ("one", 1): 1.0, ("one", 3): 0.4, ("twice", 1): 1.4, ("twice", 2): 1.2}
    kept = S.search(index, queries, "id", "q", "text", S.document_counts(index))
    placed = {(r["q"], r["place"]): r["id"] for r in S.placed_hits(kept, "id", "q").collect()}
    assert placed[("two", 1)] == 2 and placed[("one", 1)] == 1 and len(placed) == 6
    assert S.search(index.limit(0), queries, "id", "q", "text").count() == 0


def test_search_index_of_asked_terms(spark):
    """An index for known queries keeps the postings of their terms alone, whole; before, it could only hold all terms."""
    docs = spark.createDataFrame([(1, "Skilled visa", "A visa for nurses"), (2, "Nurses", "visa visa visa"), (3, None, "the skilled")], "id int, title string, body string")
    queries = spark.createDataFrame([("a", "VISA of nurses"), ("b", "visa zebra"), ("c", None)], "q string, text string")
    index = S.inverted_index(docs, "id", "title", "body", S.query_terms(queries, "text"))
    assert sorted(map(tuple, index.collect())) == [("nurses", 1, 0, 1), ("nurses", 2, 1, 0), ("visa", 1, 1, 1), ("visa", 2, 0, 3)]
    hits = lambda i: sorted(map(tuple, S.search(i, queries, "id", "q", "text").collect()))
    assert hits(index) == hits(S.inverted_index(docs, "id", "title", "body")) != []


def test_programme_documents(spark):
    programmes = spark.createDataFrame([(1, "P", "c", "open", None, 2000, None, "AUS", "long", None, None), (2, "Q", "c", "open", None, None, None, "XXX", None, None, None)], "programme int, name string, category string, status string, description string, launch_year int, closure_year int, country string, long_summary string, long_summary_at timestamp, long_summary_by string")
    countries = spark.createDataFrame([("AUS", "Australia", "Oceania")], "country string, country_name string, region string")
    whole, part = {p: 10.0 for p in "ABCDE"}, {p: 1.0 for p in "ABCD"}
    scores = spark.createDataFrame([(1, "2024-01-02", 50.0, 40.0, 60.0, whole, None, False, 7), (1, "2024-01-01", 1.0, 1.0, 1.0, part, True, False, 7)], "programme int, scored_at string, composite double, cme double, paq double, pillar_scores map<string,double>, flagged boolean, placeholder boolean, version int")
    definitions = spark.createDataFrame([(10, "b", "B", "B", "B.1", 1.0), (11, "a", "A", "A", "A.1", 1.0), (12, "x", "X", "X", "X.1", 1.0)], "field int, key string, label string, pillar string, sub_factor string, weight double")
    values = spark.createDataFrame([(1, 10, "v", 5.0, "approved")], "programme int, field int, value_raw string, score double, status string")
    sources = spark.createDataFrame([(1, 1, "u2", 1, "c", False), (1, 2, "u3", 1, "c", True), (1, 3, "u1", 1, "c", False), (1, 4, "u0", 2, "c", True)], "programme int, source int, url string, tier int, category string, is_primary boolean")
    changes = spark.createDataFrame([(1, 1, 10, "2024-01-01", "minor", True, None, 1.0), (1, 2, 10, "2024-01-03", "breaking", True, "s", None), (1, 3, 10, "2024-01-04", "odd", True, "s", 1.0), (1, 4, 10, "2024-01-05", "minor", False, "s", 1.0), (1, 5, 99, "2024-01-06", "minor", True, "s", 1.0)], "programme int, change int, field int, detected_at string, severity string, approved boolean, summary string, paq_delta double")
    history = spark.createDataFrame([(1, f"2023-{m:02d}-{d:02d}", float(m * 100 + d), 1.0, 1.0, 7) for m in (1, 2) for d in range(1, 21)], "programme int, scored_at string, composite double, cme double, paq double, version int")
    versions = spark.createDataFrame([(7, "v7")], "version int, tag string")
    docs = D.programme_documents(programmes, countries, scores, definitions, values, sources, changes, history, versions)
    got = {r["programme"]: r for r in docs.collect()}
    p, q = got[1], got[2]
    assert p["header"]["country_name"] == "Australia" and q["header"]["country_name"] is None and p["long_summary"]["body"] == "long"
    assert p["score"]["composite"] == 50.0 and p["score"]["flagged"] is False and p["score"]["version"] == "v7" and q["score"] is None
    assert [(x["key"], x["value_raw"], x["status"]) for x in p["field_values"]] == [("a", None, "draft"), ("b", "v", "approved")] and [x["status"] for x in q["field_values"]] == ["draft", "draft"]
    assert [x["url"] for x in p["sources"]] == ["u3", "u1", "u2", "u0"] and q["sources"] == []
    assert [(x["change"], x["summary"], x["field_key"]) for x in p["policy_changes"]] == [(2, "s", "b"), (1, "", "b")]
    assert len(p["score_history"]) == 36 and p["score_history"][0]["composite"] == 105.0 and p["score_history"][-1]["composite"] == 220.0
    assert p["cohort"]["scored_count"] == 1 and p["cohort"]["medians"] == whole
    text = {r["programme"]: json.loads(r["document"]) for r in D.as_json(docs).collect()}
    assert text[2]["score"] is None and text[1]["sources"][0]["url"] == "u3"


def test_main_text():
    page = "<html><body><nav>menu</nav><p>out</p><main> <h1>A &amp; b</h1><script>x()</script><p>one<!-- no -->two<br>three</p><footer>f</footer><noscript>n</noscript></main><article>later</article></body></html>"
    assert P.readable(page) == "A & b\none\ntwo\nthree" and P.readable(page, main_only=False) == "A & b\none\ntwo\nthree\nf"
    assert P.readable("<article>first</article><article>second</article>") == "first"
    assert P.readable('<div id=content>by id</div><div class="big content">by class</div>') == "by class" and P.readable('<p>x</p><div id="content">by id</div>') == "by id"
    assert P.readable("<head><title>t</title></head><body>in</body>") == "in" and P.readable("plain <b>text") == "plain\ntext"
    assert P.readable("<nav><main>gone</main></nav><p>stays") == "stays" and P.readable(None) == "" and P.readable("<main></div>open") == "open"
    assert P.readable("<div>" * 20000 + "deep") == "deep" and P.readable("</p>" * 20000 + "x") == "x"


def test_shown_provenance(spark):
    whole = {k: "v" for k in N.SHOWN_KEYS} | {"charOffsets": [1, 2], "sourceTier": None}
    read = lambda record, status="draft": one(spark, N.shown_provenance(F.lit(record).cast("string"), F.lit(status)))
    assert tuple(read(json.dumps(whole))) == (True, []) and read(json.dumps(whole), "approved")["missing"] == N.SHOWN_REVIEW_KEYS
    assert read(json.dumps(whole | {"charOffsets": [1]}))["missing"] == ["charOffsets"] and read(json.dumps(whole | {"charOffsets": None}))["missing"] == ["charOffsets"]
    assert read(None)["missing"] == N.SHOWN_KEYS and read("[]")["missing"] == N.SHOWN_KEYS and read("nonsense")["ok"] is False


def test_modes(spark):
    programmes = spark.createDataFrame([(1,), (2,)], "programme int")
    definitions = spark.createDataFrame([("a", 5), ("b", None), ("c", 7)], "key string, prompt int")
    values = spark.createDataFrame([(1, "a", "pending_review", '{"normalizationError": "x"}'), (1, "b", "pending_review", '{"normalizationError": null}'), (2, "a", "approved", '{"normalizationError": "x"}'), (3, "a", "pending_review", '{"normalizationError": "x"}')], "programme int, key string, status string, provenance string")
    attempts = spark.createDataFrame([(1, "a", True, 4), (1, "a", True, 3), (1, "c", False, 1), (2, "c", True, None), (2, "a", True, 5), (2, "b", True, 1)], "programme int, key string, published boolean, prompt int")
    get = lambda mode, keys=None: {tuple(r) for r in R.fields_to_extract(mode, programmes, definitions, values, attempts, keys).collect()}
    assert get("narrow") == {(1, "c"), (2, "b"), (2, "c")} and get("gate-failed") == {(1, "a")}
    assert get("rubric-changed") == {(1, "a"), (2, "c")} and get("field", ["c", "z"]) == {(1, "c"), (2, "c")} and get("field") == set()


def test_rubrics_must_be_whole(spark):
    definitions = spark.createDataFrame([("a", ["y", "x"]), ("b", None), ("c", ["x"])], "key string, categories array<string>")
    scores = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("c", "x", 3)], "key string, value string, score int")
    got = {r["key"]: r["scored"] and [tuple(x) for x in r["scored"]] for r in G.enriched_rubrics(definitions, scores).collect()}
    assert got == {"a": [("y", 2), ("x", 1)], "b": None, "c": [("x", 3)]}
    with pytest.raises(PySparkException, match="no score for a: y"):
        G.enriched_rubrics(definitions, scores.where("value <> 'y'")).collect()


def test_treaty_coverage(spark):
    rows = [("A", "B", False, 2), ("B", "A", True, 1), ("A", "C", True, 3), ("A", "X", True, 4), ("X", "D", True, 5), ("E", "E", True, 6)]
    members = spark.createDataFrame([(m,) for m in "ABCDEF"], "member string")
    got = L.treaty_coverage(spark.createDataFrame(rows, "a string, b string, active boolean, place int"), "a", "b", "active", "place", members).first()
    assert (got["members"], got["pairs"], got["touched"]) == (6, 15, 5)
    assert got["modelled"] + got["unmodelled"] == 15 and got["active"] == got["modelled"]


def test_quality_signals_and_formats(spark):
    read = lambda text: tuple(one(spark, G.quality_signals(F.lit(text).cast("string"))))
    assert read('{"crossCheckResult":"disagree","deriveLlmMismatch":"","crossCheckUrl":"u"}') == (True, False, None, "u")
    assert read('{"deriveLlmMismatch":"m"}') == (False, True, "m", None) and read("x") == read(None) == read("[]") == (False, False, None, None)
    assert one(spark, T.score_text(F.lit(None).cast("double"))) == one(spark, T.rank_text(F.lit(None).cast("int"))) == one(spark, T.day_text(F.lit(""))) == T.NONE_TEXT
    assert one(spark, T.score_text(F.lit(1.5))) == "1.50" and one(spark, T.rank_text(F.lit(3))) == "#3" and one(spark, T.day_text(F.lit("2024-01-02T03"))) == "2024-01-02"


def test_known_fields_without_policies(spark):
    programmes = spark.createDataFrame([(1, "AUS"), (2, "XXX"), (3, None)], "programme int, country string")
    one_policy = {"citizenship": spark.createDataFrame([("AUS", False, "n", "u", 2001)], "country string, permitted boolean, notes string, source_url string, source_year int")}
    rules = [r for r in V.standard_rules() if r.policy == "citizenship"]
    got = V.known_fields(programmes, one_policy, rules).collect()
    assert [(r["programme"], r["key"], r["value_raw"], r["confidence"]) for r in got] == [(1, "D.2.3", "not_permitted", 0.7)]
    histories = spark.createDataFrame([(1, 2015, 2025, "u"), (2, 2015, 2025, "u")], "programme int, first_year int, last_year int, source_url string")
    events = spark.createDataFrame([(1, 2020, "minor", "b", 2), (1, 2019, "major", "a", 1)], "programme int, year int, severity string, description string, seq int")
    got = {r["programme"]: r for r in V.volatility_fields(histories, events).collect()}
    assert got[1]["value_raw"] == "4" and got[1]["sentence"] == "2019 (major): a" and got[2]["value_raw"] == "0" and got[2]["sentence"].endswith("2015-2025.")


def test_provenance_records_are_parsed_once(spark):
    for column in (N.provenance_issues(F.col("r"), F.col("s")), N.shown_provenance(F.col("r"), F.col("s"))):
        plan = spark.createDataFrame([("{}", "approved")], "r string, s string").select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("parse_json(") == 1 and plan.count("from_json(") == 1


def test_terms_as_patterns(spark):
    """A term with a dot: any one character stands for it; the words of a phrase are set apart, so it isn't met."""
    count = lambda text, *terms: one(spark, N.pattern_matches(F.lit(text), F.array(*map(F.lit, terms))))
    assert count("on one. on", "on.") == 2 and count("on one. on", "on") == 2 and count("on.on", "on", "í") == 2 and count("aíb", "í") == 1 and count("a b", "a b") == 0
    text = "x" * 2500 + " one " + "y" * 4895
    windows = [N.content_windows(spark.createDataFrame([(1, text, ["on."])], "id int, text string, terms array<string>"), "id", "text", "terms", 6000, *by).first()["chunks"] for by in ((), (N.pattern_matches,))]
    assert windows == [[0, 3], [0, 1, 3]]


def test_latest_decisions(spark):
    """Ties in time go to the larger seq, a null time comes before all others; decisions are matched by time before any sort."""
    rows = [(1, "approve", 5, 1), (1, "reject", 5, 2), (1, "edit", 4, 9), (2, "edit", None, 1), (2, "approve", None, 3), (3, "reject", None, 8), (3, "edit", 1, 1)]
    found = R.latest_decisions(spark.createDataFrame(rows, "id int, decision string, at int, seq int"))
    assert sorted((r["id"], r["decision"]) for r in found.collect()) == [(1, "reject"), (2, "approve"), (3, "edit")]


def test_field_values_without_a_grid(spark):
    """A programme's values are gathered by the fields' numbers: every field once or once for each of its values, nulls of
    the order last. Before, every programme was joined with all fields, a row for each."""
    programmes = spark.createDataFrame([(1,), (2,)], "programme int")
    fields = spark.createDataFrame([(10, "b", "L", "B", None, 1.0), (11, "b", "L", "B", 2, 1.0), (12, None, "L", "A", 1, 1.0), (13, "z", "L", "A", 1, 1.0), (None, "n", "L", "C", 1, 1.0)], "field int, key string, label string, pillar string, sub_factor int, weight double")
    values = spark.createDataFrame([(1, 11, "v", 5.0, "approved"), (1, 10, "w", None, None), (1, 10, "x", 1.0, "pending"), (1, 99, "u", 1.0, "approved"), (3, 11, "o", 1.0, "approved")], "programme int, field int, value_raw string, score double, status string")
    found = D._field_values(programmes, fields, values)
    got = {r["programme"]: [(x["field"], x["key"], x["value_raw"], x["status"]) for x in r["field_values"]] for r in found.collect()}
    bare = [(13, "z", None, "draft"), (12, None, None, "draft"), (11, "b", None, "draft"), (10, "b", None, "draft"), (None, "n", None, "draft")]
    assert got == {1: [*bare[:2], (11, "b", "v", "approved"), (10, "b", "w", "draft"), (10, "b", "x", "pending"), bare[-1]], 2: bare}
    assert {r["programme"]: r["field_values"] for r in D._field_values(programmes, fields.limit(0), values).collect()} == {1: [], 2: []}


def test_programme_json_is_parsed_once(spark):
    plan = queries()["programme_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") + plan.count("from_json") == 1
