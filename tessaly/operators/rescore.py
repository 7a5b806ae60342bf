"""Periodic jobs over a whole cohort: calibrate and rescore, and the refresh of a country index with its list of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.functions.scores import number_of
from tessaly.operators import hierarchy as H
from tessaly.operators.measures import CALIBRATION_PROGRAMMES, calibrated_fields, cohort_min_max
from tessaly.operators.sensitivity import Field, definitions
from tessaly.sources.stored import stored
from tessaly.streaming.ingest import write_run

STATUS = "status string, n_programs long, n_observations long, persisted boolean, rescored long, rescore_failures long, reason string"


def with_calibration(fields: list[Field], params: DataFrame) -> DataFrame:
    """The fields' definitions, those that have calibrated parameters with these."""
    base = definitions(params.sparkSession, fields)
    new = params.select("key", *[F.col(c).alias(f"_{c}") for c in ("low", "high", "mean", "stddev")])
    found = base.join(F.broadcast(new), "key", "left")  # a row for each field
    both = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    return found.select("key", "fn", "direction", *map(both, ("low", "high", "mean", "stddev")), "rubric")


def calibrate_and_rescore(values: DataFrame, fields: list[Field], substitutes: DataFrame, programmes: DataFrame, entities: DataFrame, path: str, run: str, countries: list[str] | None = None, profile: H.Profile = H.REFERENCE) -> DataFrame:
    """One row STATUS: calibrates the fields' parameters on the approved numeric values (entity, key, raw, status, place),
    and scores every programme (programmes: entity, country; entities: entity, cme) anew under them.

    With less than CALIBRATION_PROGRAMMES programmes nothing is written and the status is skipped. Parameters go to
    path/params and scores to path/scores, each in the run's own partition, so a rerun replaces its own rows only. A
    programme with a value that can't be scored is a failure and keeps its old scores.
    """
    spark = values.sparkSession
    numbers = values.select(F.col("entity").alias("programme"), "key", number_of(F.col("raw")).alias("number"), "status")
    params = stored(calibrated_fields(numbers, definitions(spark, fields), programmes.select(F.col("entity").alias("programme"), "country"), countries), "params")
    seen = params.agg(F.coalesce(F.max("n_programmes"), F.lit(0)), F.coalesce(F.max("n_observations"), F.lit(0))).first()
    if seen[0] < CALIBRATION_PROGRAMMES:
        return spark.createDataFrame([("skipped", seen[0], seen[1], False, 0, 0, f"below_threshold_{CALIBRATION_PROGRAMMES}")], STATUS)
    write_run(params, f"{path}/params", run)
    scores = stored(H.indicator_scores(values, with_calibration(fields, params), substitutes), "indicator-scores")
    failed = scores.where("error IS NOT NULL").select("entity").distinct()
    known = entities.join(values.where("status = 'approved'").select("entity").distinct(), "entity", "left_semi")
    scored = H.score_cohort(scores, known.join(failed, "entity", "left_anti"), [H.Indicator(f.key, f.pillar, f.sub_factor, f.weight) for f in fields], profile)
    write_run(scored, f"{path}/scores", run)
    rescored = spark.read.parquet(f"{path}/scores/run={run}").count()
    return spark.createDataFrame([("ok", seen[0], seen[1], True, rescored, known.join(failed, "entity", "left_semi").count(), None)], STATUS)


def index_refresh(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """country, rank, previous, appeal, cme for the countries whose appeal changes: rows (country, rank, appeal) of the
    cohort (country, appeal, null for none yet), normalised over the rows of cohort countries to 0..100."""
    some = rows.join(cohort.select("country", F.col("appeal").alias("previous")), "country")
    return cohort_min_max(some, "appeal", "cme").where(~F.col("appeal").eqNullSafe(F.col("previous"))).select("country", "rank", "previous", "appeal", "cme")


def refresh_summary(changes: DataFrame, programmes: DataFrame) -> DataFrame:
    """One row, or none without changes: the first programme by id, the number of changes and the countries in order. It
    stands for the whole refresh, so any programme would do; the smallest id makes it the same each time."""
    told = changes.agg(F.count(F.lit(1)).alias("n_changes"), F.array_join(F.array_sort(F.collect_list("country")), ", ").alias("countries"))
    return told.where("n_changes > 0").crossJoin(programmes.select("programme").orderBy("programme").limit(1))  # one row each
