"""Sensitivity of a ranking as one job: rows of engine parameters meet one pivoted cohort.

An entity's raw values are read once: a number, whether it stands for 'no limit', or the score that its field's function
gives without parameters. Each entity's row explodes into the perturbations, whose weights, range factor, aggregation and
dropped pillar are columns, and the engine's arithmetic runs over them in the same row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions import scores as S
from tessaly.operators import hierarchy as H
from tessaly.operators.measures import drawn_weight, rank_statistics
from tessaly.operators.places import ranked
from tessaly.sources.stored import stored

#: The shares of cme, the factors on calibrated ranges and the number of draws of a standard run.
SPLITS = (0.2, 0.25, 0.35, 0.4, 0.5)
FACTORS = (0.9, 0.95, 1.05, 1.1)
TRIALS = 50
#: Rows of entities under perturbations that one task scores.
TASK_ROWS = 20_000


@dataclass(frozen=True)
class Field:
    """An indicator with its function and parameters."""

    key: str
    pillar: str
    sub_factor: str
    weight: float
    fn: str
    direction: str = S.HIGHER
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    stddev: float | None = None
    rubric: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Perturbation:
    """Parameters of the engine that differ from the standard ones."""

    analysis: str
    label: str
    cme: float = 0.3
    paq: float = 0.7
    factor: float = 1.0
    geometric: bool = False
    dropped: str | None = None


BASELINE = Perturbation("baseline", "baseline")


def standard_perturbations(pillars: list[str], trials: int = TRIALS, seed: int = 1) -> list[Perturbation]:
    """Splits, range factors, geometric aggregation, dropped pillars and drawn weights."""
    out = [Perturbation("cme_paq_split", f"{100 * s:g}/{100 * (1 - s):g}", cme=s, paq=1 - s) for s in SPLITS]
    out += [Perturbation("normalization", f"{f:g}", factor=f) for f in FACTORS]
    out += [Perturbation("aggregation", "geometric", geometric=True)]
    out += [Perturbation("indicator_dropout", p, dropped=p) for p in pillars]
    for t in range(1, trials + 1):
        w = drawn_weight(t, seed)
        out.append(Perturbation("weight_monte_carlo", str(t), cme=w, paq=1 - w))
    return out


def definitions(spark, fields: list[Field]) -> DataFrame:
    """The fields as the table that hierarchy.indicator_scores reads."""
    rows = [(f.key, f.fn, f.direction, f.low, f.high, f.mean, f.stddev, dict(f.rubric) or None) for f in fields]
    return spark.createDataFrame(rows, "key string, fn string, direction string, low double, high double, mean double, stddev double, rubric map<string,double>")


def read_cohort(values: DataFrame, fields: list[Field], substitutes: DataFrame, entity: str = "entity") -> DataFrame:
    """entity and v0, v1, ...: for each field a struct (number, unlimited, score) of the entity's value, null without."""
    read = H.readings(values, definitions(values.sparkSession, fields), substitutes, entity)
    part = F.struct(F.when(F.col("fn").isin("min_max", "z_score"), F.col("number")).alias("number"), "unlimited", "score")
    return read.groupBy(entity).agg(*[F.max_by(part, F.when(F.col("key") == f.key, F.col("place"))).alias(f"v{n}") for n, f in enumerate(fields)])


def field_score(part: Column, field: Field, factor: Column) -> Column:
    """The score of a read value when the field's parameters are scaled by factor; null where there is none."""
    direction = F.lit(field.direction)
    scaled = {k: F.lit(getattr(field, k)).cast("double") * factor for k in ("low", "high", "mean", "stddev")}
    if field.fn == "min_max":
        score = S.min_max(part["number"], scaled["low"], scaled["high"], direction)
    elif field.fn == "z_score":
        score = S.z_score(part["number"], scaled["mean"], scaled["stddev"], direction)
    else:
        return part["score"]
    return F.when(part["unlimited"], 0.0 if field.direction == S.LOWER else 100.0).otherwise(score)


def _scored(rows: DataFrame, fields: list[Field], profile: H.Profile, entity: str, keep: list[str]) -> DataFrame:
    """The engine over rows with the columns of a Perturbation in p."""
    p = F.col("p")
    some = rows.select(entity, "cme", *keep, "p", *[field_score(F.col(f"v{n}"), f, p["factor"]).alias(f"v{n}") for n, f in enumerate(fields)])
    value = {f.key: F.col(f"v{n}") for n, f in enumerate(fields)}
    indicators = [H.Indicator(f.key, f.pillar, f.sub_factor, f.weight) for f in fields]
    return H.aggregated(some, value, indicators, profile, entity, [*keep, "p"], cme=p["cme"], paq=p["paq"], geometric=p["geometric"], dropped=p["dropped"])


def sensitivity_runs(values: DataFrame, entities: DataFrame, fields: list[Field], substitutes: DataFrame, perturbations: list[Perturbation], profile: H.Profile = H.REFERENCE, entity: str = "entity", digits: int = 9) -> DataFrame:
    """analysis, label, n, rho and shift for each perturbation: its ranking of the entities against the baseline's.

    values and substitutes as in hierarchy.indicator_scores, entities (entity, cme). Entities without any approved value
    take no part. Ties in composites, rounded to digits, go to the smaller entity.
    """
    cohort = entities.select(entity, F.coalesce("cme", F.lit(0.0)).alias("cme")).join(read_cohort(values, fields, substitutes, entity), entity)
    cohort = stored(cohort, "cohort")  # read for the baseline's ranks, then for all perturbations

    def literal(x: Perturbation) -> Column:
        parts = {"analysis": x.analysis, "label": x.label, "cme": float(x.cme), "paq": float(x.paq), "factor": float(x.factor), "geometric": x.geometric}
        return F.struct(*[F.lit(v).alias(k) for k, v in parts.items()], F.lit(x.dropped).cast("string").alias("dropped"))

    composite = F.round("composite", digits)
    order = [F.col("_c").desc(), F.col(entity).asc()]
    plain = _scored(cohort.withColumn("p", literal(BASELINE)), fields, profile, entity, [])
    # written before it is ranked, as dealing rows by range looks at them twice
    base = ranked(stored(plain.select(entity, composite.alias("_c")), "baseline"), order, "base_rank").select(entity, "base_rank")
    # a cohort is small and lies in few files, what it explodes into isn't: dealt by the rows that it makes
    dealt = cohort.join(base, entity).repartition(-(-cohort.count() * len(perturbations) // TASK_ROWS) or 1)
    many = dealt.withColumn("p", F.explode(F.array(*map(literal, perturbations))))
    new = _scored(many, fields, profile, entity, ["base_rank"]).select(entity, "base_rank", F.col("p.analysis").alias("analysis"), F.col("p.label").alias("label"), composite.alias("_c"))
    return rank_statistics(ranked(stored(new, "perturbed"), order, "new_rank", ["analysis", "label"]), "base_rank", "new_rank", ["analysis", "label"])


def score_correlation(scored: DataFrame) -> DataFrame:
    """n, r and flagged (|r| > 0.8): Pearson's r of paq and cme over a cohort; 0 where either doesn't vary, null for less
    than two rows."""
    r = F.when(F.count(F.lit(1)) >= 2, F.coalesce(F.nanvl(F.corr("paq", "cme"), F.lit(0.0)), F.lit(0.0)))
    return scored.agg(F.count(F.lit(1)).alias("n"), r.alias("r")).withColumn("flagged", F.coalesce(F.abs("r") > 0.8, F.lit(False)))
