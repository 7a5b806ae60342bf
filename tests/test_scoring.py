"""Hand-computed scores, the hierarchy's fixtures and the traps of the scoring rules."""

import math

import pytest
from pyspark.sql import functions as F

from tessaly.functions import scores as S
from tessaly.operators import hierarchy as H
from tessaly.operators import measures as M

KEYS = [(f"{p}.{s}.{i}", p, f"{p}.{s}", w) for p in "ABCDE" for s, n, w in ((1, 2, 0.5), (2, 1, 1.0), (3, 1, 1.0)) for i in range(n)]
FULL = [H.Indicator(*k) for k in KEYS]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cohort(spark, missing=(), indicators=FULL, profile=H.REFERENCE, cme=75.0):
    values = spark.createDataFrame([("e", i.key, 70.0) for i in indicators if i.key not in missing] or [("none", "x", 0.0)], "entity string, key string, score double")
    entities = spark.createDataFrame([("e", cme)], "entity string, cme double")
    return H.score_cohort(values, entities, indicators, profile).first()


def test_full_coverage(spark):
    r = cohort(spark)
    assert r["sub_scores"]["A.1"] == pytest.approx(70) and r["paq"] == pytest.approx(70) and r["composite"] == pytest.approx(71.5) and not r["flagged"]


def test_one_missing_is_penalised(spark):
    r = cohort(spark, {"A.1.0"})
    assert r["sub_scores"]["A.1"] == pytest.approx(49.497475) and r["pillar_scores"]["A"] == pytest.approx(61.798990)
    assert r["paq"] == pytest.approx(67.703717) and r["composite"] == pytest.approx(69.892602) and r["coverage"]["A"] == 0.75 and not r["flagged"]


def test_low_coverage_is_flagged(spark):
    many = [H.Indicator(f"A.1.{i}", "A", "A.1", 0.2) for i in range(5)] + [i for i in FULL if not i.key.startswith("A.1")]
    r = cohort(spark, {f"A.1.{i}" for i in range(4)}, many)
    assert r["sub_scores"]["A.1"] == pytest.approx(31.304952) and r["pillar_scores"]["A"] == pytest.approx(54.521981) and r["paq"] == pytest.approx(65.666155)
    assert r["composite"] == pytest.approx(68.466308) and r["flagged"] and r["coverage"]["A"] == pytest.approx(3 / 7)


def test_coverage_of_exactly_the_limit_is_not_flagged(spark):
    ten = [H.Indicator(f"A.1.{i}", "A", "A.1", 0.1) for i in range(10)]
    assert not cohort(spark, {f"A.1.{i}" for i in range(3)}, ten + [i for i in FULL if i.pillar != "A"])["flagged"]


def test_sub_factor_without_weight_counts_for_coverage_only(spark):
    extra = FULL + [H.Indicator("B.4.0", "B", "B.4", 1.0)]
    r = cohort(spark, {"B.4.0"}, extra)
    assert r["pillar_scores"]["B"] == pytest.approx(70) and r["coverage"]["B"] == 0.8
    from dataclasses import replace

    wider = replace(H.REFERENCE, sub_factors=H.REFERENCE.sub_factors | {"B": {"B.1": 0.3, "B.2": 0.2, "B.3": 0.3, "B.4": 0.2}})
    assert cohort(spark, {"B.4.0"}, extra, wider)["pillar_scores"]["B"] == pytest.approx(56)


def test_missing_cme_is_zero_and_geometric_zero_wins(spark):
    assert cohort(spark, cme=None)["composite"] == pytest.approx(49)
    assert one(spark, H.geometric_mean([(F.lit(0.0), 0.1), (F.lit(50.0), 0.9)])) == 0
    assert one(spark, H.geometric_mean([(F.lit(0.0), 0.0), (F.lit(50.0), 0.9)])) == pytest.approx(50)
    assert one(spark, H.geometric_mean([(F.lit(4.0), 0.5), (F.lit(9.0), 0.5)])) == pytest.approx(6)
    assert one(spark, H.weighted_mean([(F.lit(None).cast("double"), 1.0)])) == 0


def test_scores(spark):
    assert one(spark, S.phi(F.lit(1.96))) == pytest.approx(0.975002, abs=1e-6) and one(spark, S.phi(F.lit(-1.96))) == pytest.approx(0.024998, abs=1e-6)
    assert one(spark, S.min_max(F.lit(3.0), F.lit(2.0), F.lit(6.0), F.lit(S.LOWER))) == 75 and one(spark, S.min_max(F.lit(30.0), F.lit(2.0), F.lit(6.0), F.lit(S.HIGHER))) == 100
    assert one(spark, S.min_max(F.lit(3.0), F.lit(2.0), F.lit(2.0), F.lit(S.HIGHER))) is None
    none = F.lit(None).cast("double")
    assert one(spark, S.error_of(F.lit("min_max"), F.lit(1.0), F.lit("x"), F.lit(2.0), F.lit(2.0), none, F.create_map(F.lit("a"), F.lit(1.0)))) == "degenerate range"
    got = S.indicator_score(F.lit("min_max"), F.lit(S.LOWER), none, F.lit("x"), F.lit(True), F.lit(True), none, none, none, none, F.create_map(F.lit("a"), F.lit(1.0)))
    assert one(spark, got) == 0


@pytest.mark.parametrize(("raw", "want"), [("12", 12), ("$1,234.5", 1234.5), (" 45 %", 45), ("12abc", 12), ("abc", None), ("", None), ("-3.5e2x", -350), ("1 000 ", 1000)])
def test_raw_numbers(spark, raw, want):
    assert one(spark, S.number_of(F.lit(raw))) == want


def test_raw_words(spark):
    assert [one(spark, S.truth_of(F.lit(x))) for x in (" YES ", "0", "maybe")] == [True, False, None] and one(spark, S.no_limit(F.lit(" No_Limit "))) and not one(spark, S.no_limit(F.lit("99")))


@pytest.mark.parametrize(("delta", "want"), [(5.0, "material"), (5.01, "breaking"), (-6.0, "breaking"), (1.0, "material"), (0.99, "minor")])
def test_severity_edges(spark, delta, want):
    assert one(spark, S.change_severity(F.lit(50.0), F.lit(50.0 + delta), F.lit(True)))["severity"] == want
    assert one(spark, S.change_severity(F.lit(None).cast("double"), F.lit(9.0), F.lit(True)))["severity"] == "minor" and one(spark, S.change_severity(F.lit(0.0), F.lit(9.0), F.lit(False)))["severity"] == "minor"


def test_calibration_and_ranks(spark):
    df = spark.createDataFrame([("k", 1.0, "a"), ("k", 2.0, "b"), ("k", 3.0, "c"), ("one", 5.0, "a"), ("k", None, "d")], "key string, v double, e string")
    got = {r["key"]: r for r in M.calibrated(df, "key", "v").collect()}
    assert (got["k"]["low"], got["k"]["high"], got["k"]["mean"], got["k"]["stddev"]) == (1.2, 2.8, 2.0, 1.0) and got["one"]["stddev"] == 0
    assert M.calibrated(df, "key", "v", "e", 4).count() == 0 and M.calibrated(df, "key", "v", "e", 3).count() == 2
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "a int, b int")
    assert M.spearman(ranks, "a", "b").first()["rho"] == pytest.approx(0.5) and M.spearman(ranks.limit(1), "a", "b").first()["rho"] == 1
    assert M.top_shift(ranks, "a", "b", 2).first()["shift"] == 2
    assert one(spark, S.half_up(F.lit(-1.005), 0)) == -1 and one(spark, S.half_up(F.lit(-1.5), 0)) == -1


def test_rebalanced():
    w = H.rebalanced({"A": 0.5, "B": 0.25, "C": 0.25}, "A", 0.8)
    assert w["B"] == pytest.approx(0.1) and math.isclose(sum(w.values()), 1)
    assert H.rebalanced({"A": 1.0, "B": 0.0, "C": 0.0}, "A", 2)["B"] == 0 and H.rebalanced({"A": 1.0, "B": 0.0, "C": 0.0}, "A", 0.5)["B"] == pytest.approx(0.25)


def test_rounded_as_on_doubles(spark):
    """250250 / 100 / 5000 is 0.5005 as text, and its thousandfold lies below the half; an exact half goes away from 0."""
    assert one(spark, S.rounded(F.lit(2502.5) / 5000, 3)) == 0.5 and one(spark, F.round(F.lit(2502.5) / 5000, 3)) == 0.501
    assert one(spark, S.rounded(F.lit(25.5625), 3)) == 25.563 and one(spark, S.rounded(F.lit(-25.5625), 3)) == -25.563
    assert one(spark, S.rounded(F.lit(None).cast("double"), 3)) is None
