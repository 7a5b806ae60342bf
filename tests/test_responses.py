from pyspark.sql import functions as F

from tessaly.functions import responses as T
from tessaly.operators import hierarchy as H


def _values(spark, column, rows, schema):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_quote_places(spark):
    rows = [("a  b c", "b c"), ("a   B\nC", "b c"), ("  x", "X"), ("abc", "z"), ("abc", "  "), ("f(x) ok", "F(X)"), (None, "a")]
    assert _values(spark, T.quote_place(F.col("c"), F.col("q")), rows, "c string, q string") == [3, 2, 0, -1, -1, 0, None]


def test_small_readers(spark):
    assert _values(spark, T.bare_domain(F.col("c")), [(" HTTPS://A.b/x ",), ("A.b/x",), ("",), (None,)], "c string") == ["a.b", "a.b", None, None]
    assert _values(spark, T.number_record(F.col("c")), [('{"a": 1, "b": "2.5", "c": "x", "d": "Infinity"}',), (None,)], "c string") == [{"a": 1.0, "b": 2.5}, None]
    splits = _values(spark, T.weight_split(F.col("c")), [('{"cme": 0.4, "paq": 0.6}',), ('{"cme": 0.4}',), (None,)], "c string")
    assert [tuple(x) for x in splits] == [(0.4, 0.6), (0.3, 0.7), (0.3, 0.7)]
    chips = _values(spark, T.coverage_chip(F.col("a"), F.col("b")), [(7, 10), (0, 0), (1, 8)], "a long, b long")
    assert [tuple(x) for x in chips] == [("70%", "7/10", False), ("0%", "0/0", True), ("13%", "1/8", True)]


def test_response_errors(spark):
    rows = [
        ('{"valueRaw": "", "sourceSentence": "", "characterOffsets": {"start": 0, "end": 0}, "extractionConfidence": 0}',),
        ('{"valueRaw": "v", "sourceSentence": "s", "characterOffsets": null, "extractionConfidence": "1"}',),
        ("{broken",),
        (None,),
        ("[]",),
        ('{"valueRaw": "v", "sourceSentence": " ", "characterOffsets": [1], "extractionConfidence": 0.5}',),
        ('{"valueRaw": "v", "sourceSentence": "s", "characterOffsets": {"start": 5, "end": 2}, "extractionConfidence": 1}',),
        ('{"valueRaw": "v", "sourceSentence": "s", "characterOffsets": {"start": 0, "end": 0}, "extractionConfidence": 1}',),
    ]
    found = _values(spark, T.response_errors(F.col("c")), rows, "c string")
    assert found[:4] == [[], ["characterOffsets:object", "extractionConfidence:share"], ["response:object"], ["response:object"]]
    assert found[4] == ["valueRaw:text", "sourceSentence:text", "characterOffsets:object", "extractionConfidence:share"]
    assert found[5] == ["characterOffsets.start:count", "characterOffsets.end:count", "sourceSentence:bound"]
    assert found[6:] == [["characterOffsets:order"], ["characterOffsets:bound"]]


def test_indicator_scores(spark):
    fields = [("n", "min_max", "higher_is_better", 0.0, 10.0, None, None, None), ("r", "country_substitute_regional", "higher_is_better", None, None, None, None, None)]
    definitions = spark.createDataFrame(fields, "key string, fn string, direction string, low double, high double, mean double, stddev double, rubric map<string,double>")
    substitutes = spark.createDataFrame([("r", "south", "paid", 40.0), ("r", "north", "paid", 90.0)], "key string, region string, value string, score double")
    rows = [
        (1, "n", "5", "approved", 1), (2, "n", "none", "approved", 1), (3, "n", '{"notApplicable": true}', "approved", 1), (4, "n", "5", "pending", 1), (5, "n", None, "approved", 1),
        (6, "r", '{"region": "south"}', "approved", 1), (7, "r", "paid", "approved", 1), (8, "r", '{"region": "east"}', "approved", 1), (9, "r", "free", "approved", 1),
    ]
    values = spark.createDataFrame(rows, "entity int, key string, raw string, status string, place int")
    found = {r.entity: r.score for r in H.indicator_scores(values, definitions, substitutes).collect()}
    assert found == {1: 50.0, 2: 100.0, 6: 40.0, 7: 90.0, 8: None, 9: None}
