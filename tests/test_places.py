"""Distributed ranks, running sums, quantiles and sensitivity against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaly.operators import measures as M
from tessaly.operators import places as P
from tessaly.operators import sensitivity as V


def rows(n=600):
    """A hot key with two thirds of the rows, a null key, many ties, null values."""
    r = random.Random(3)
    return [(i, r.choice(["hot"] * 6 + ["a", None, "b"]), r.choice([None, *range(15)])) for i in range(n)]


def test_ranks(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(7)
    order = lambda x: (-(x[2] if x[2] is not None else -1), x[0])
    got = {r["id"]: r["rank"] for r in P.ranked(df, [F.col("v").desc_nulls_last(), F.col("id").asc()]).collect()}
    assert got == {x[0]: i + 1 for i, x in enumerate(sorted(data, key=order))}
    within = {r["id"]: r["place"] for r in P.ranked(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], "place", ["k"]).collect()}
    for k in ("hot", "a", "b", None):
        own = sorted((x for x in data if x[1] == k), key=order)
        assert [within[x[0]] for x in own] == list(range(1, len(own) + 1))
    assert P.ranked(df.limit(0), [F.col("id").asc()]).count() == 0


def test_running_sums(spark):
    data = [(i, k, v or 0) for i, k, v in rows()]
    df = spark.createDataFrame(data, "id int, k string, v int")
    got = {r["id"]: r["before"] for r in P.running_before(df, ["k"], [F.col("id").asc()], "v", "before").collect()}
    total = {}
    for i, k, v in data:
        assert got[i] == total.get(k, 0)
        total[k] = total.get(k, 0) + v


def test_quantiles(spark):
    r = random.Random(8)
    data = [(k, r.choice([None, r.uniform(-5, 5), 1.0])) for k in ["hot"] * 700 + ["one"] + [None] * 20 for _ in range(1)] + [("one", 2.5), ("empty", None)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"p10": 0.1, "half": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    got = {x["k"]: x for x in P.quantiles(df, ["k"], "v", shares).collect()}
    for k in ("hot", None):
        own = [v for a, v in data if a == k and v is not None]
        assert got[k]["n"] == len(own)
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(own, share))
    assert "empty" not in got
    whole = P.quantiles(df, [], "v", {"half": 0.5}).first()
    assert whole["half"] == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_calibrated_fields(spark):
    values = [(p, "m", float(p), "approved") for p in range(1, 6)] + [(p, "z", 2.0 * p, "approved") for p in range(1, 6)] + [(6, "m", 99.0, "pending"), (1, "m", None, "approved"), (1, "b", 1.0, "approved"), (9, "m", 50.0, "approved")]
    values = spark.createDataFrame(values, "programme int, key string, number double, status string")
    definitions = spark.createDataFrame([("m", "min_max"), ("z", "z_score"), ("b", "boolean")], "key string, fn string")
    programmes = spark.createDataFrame([(p, "AUS" if p < 9 else "SGP") for p in range(1, 10)], "programme int, country string")
    got = {r["key"]: r for r in M.calibrated_fields(values, definitions, programmes, ["AUS"]).collect()}
    assert set(got) == {"m", "z"} and (got["m"]["low"], got["m"]["high"], got["m"]["mean"]) == (1.4, 4.6, None)
    assert (got["z"]["mean"], got["z"]["stddev"], got["z"]["low"]) == (6.0, 3.16, None) and got["z"]["n_programmes"] == 5 and got["z"]["n_observations"] == 10 and got["z"]["meets_threshold"]
    assert not M.calibrated_fields(values.where("programme < 5"), definitions, programmes).first()["meets_threshold"]


def test_sensitivity_of_one_field_cohort(spark):
    fields = [V.Field("a", "A", "A.1", 1.0, "min_max", low=0.0, high=10.0), V.Field("b", "B", "B.1", 1.0, "z_score", mean=5.0, stddev=2.0)]
    values = spark.createDataFrame([(e, k, str(x), "approved", 1) for e, a, b in ((1, 9, 1), (2, 5, 5), (3, 1, 9)) for k, x in (("a", a), ("b", b))] + [(4, "a", "5", "pending", 1)], "entity int, key string, raw string, status string, place int")
    entities = spark.createDataFrame([(1, 0.0), (2, 50.0), (3, 100.0), (4, 1.0)], "entity int, cme double")
    substitutes = spark.createDataFrame([], "key string, region string, value string, score double")
    runs = [V.BASELINE, V.Perturbation("split", "cme", cme=1.0, paq=0.0), V.Perturbation("drop", "A", dropped="A"), V.Perturbation("drop", "B", dropped="B", cme=0.0, paq=1.0), V.Perturbation("mean", "geometric", geometric=True)]
    got = {(r["analysis"], r["label"]): r for r in V.sensitivity_runs(values, entities, fields, substitutes, runs).collect()}
    assert got[("baseline", "baseline")]["rho"] == 1.0 and got[("baseline", "baseline")]["shift"] == 0 and {r["n"] for r in got.values()} == {3}
    # the baseline's order is 1, 2, 3 or its reverse; cme alone gives 3, 2, 1, and field a alone 1, 2, 3
    assert {got[("split", "cme")]["rho"], got[("drop", "B")]["rho"]} == {1.0, -1.0}


def test_standard_perturbations():
    runs = V.standard_perturbations(list("ABCDE"))
    assert len(runs) == 5 + 4 + 1 + 5 + 50 and len({(p.analysis, p.label) for p in runs}) == 65
    assert all(0.24 <= p.cme <= 0.36 and p.cme + p.paq == pytest.approx(1) for p in runs if p.analysis == "weight_monte_carlo")


def test_sensitivity_deals_a_small_cohort(spark, monkeypatch):
    """A cohort in one file is dealt by the rows that it explodes into; before, one task scored them all."""
    values = spark.createDataFrame([(i, "a", str(i % 17), 1, "approved") for i in range(60)], "entity int, key string, raw string, place int, status string").coalesce(1)
    entities = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "entity int, cme double").coalesce(1)
    fields = [V.Field("a", "A", "A.1", 1.0, "min_max", low=0.0, high=16.0)]
    substitutes = spark.createDataFrame([], "key string, region string, value string, score double")
    runs = [V.Perturbation("split", str(k), cme=k / 10, paq=1 - k / 10) for k in range(1, 9)]
    whole = sorted(map(tuple, V.sensitivity_runs(values, entities, fields, substitutes, runs).collect()))
    tasks, stored = {}, V.stored
    monkeypatch.setattr(V, "stored", lambda df, name: tasks.setdefault(name, df.rdd.getNumPartitions()) and stored(df, name))
    monkeypatch.setattr(V, "TASK_ROWS", 60, raising=False)
    assert sorted(map(tuple, V.sensitivity_runs(values, entities, fields, substitutes, runs).collect())) == whole and len(whole) == 8
    assert tasks["perturbed"] == 8
    assert V.sensitivity_runs(values.limit(0), entities, fields, substitutes, runs).count() == 0
