"""Composite indicators: values up a weighted hierarchy with penalties for missing data.

The hierarchy is configuration (some dozens of indicators), so each entity's indicators become columns by one
grouping, and all that follows is arithmetic in the same row: one shuffle for the whole cohort, and sums in the order
of the definitions, which keeps them bit by bit reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.operators.places import ranked

DISCLOSURE = 0.7


@dataclass(frozen=True)
class Indicator:
    key: str
    pillar: str
    sub_factor: str
    weight: float


@dataclass(frozen=True)
class Profile:
    """Weights of one methodology. Sub-factors without a weight are covered but not aggregated."""

    sub_factors: dict[str, dict[str, float]]
    pillars: dict[str, float]
    cme: float = 0.3
    paq: float = 0.7
    geometric: bool = False
    disclosure: float = DISCLOSURE


# The reference profile's weights.
REFERENCE = Profile(
    sub_factors={
        "A": {"A.1": 0.4, "A.2": 0.35, "A.3": 0.25},
        "B": {"B.1": 0.4, "B.2": 0.35, "B.3": 0.25},
        "C": {"C.1": 0.45, "C.2": 0.35, "C.3": 0.2},
        "D": {"D.1": 0.5, "D.2": 0.35, "D.3": 0.15},
        "E": {"E.1": 0.5, "E.2": 0.3, "E.3": 0.2},
    },
    pillars={"A": 0.28, "B": 0.15, "C": 0.2, "D": 0.22, "E": 0.15},
)


def total(columns: list[Column]) -> Column:
    """The sum from left to right; 0 for none."""
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """The mean of the present parts under weights made to sum to 1 over them; 0 where none is present."""
    present = total([F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts])
    return F.when(present > 0, total([F.coalesce(x, F.lit(0.0)) * F.when(x.isNotNull(), w / present).otherwise(0.0) for x, w in parts])).otherwise(0.0)


def geometric_mean(parts: list[tuple[Column, float]]) -> Column:
    """exp of the weighted mean of logarithms; 0 where a weighted part isn't above 0 or none is present."""
    used = [(x, w) for x, w in parts if w]
    present = total([F.when(x.isNotNull(), w).otherwise(0.0) for x, w in used])
    zero = reduce(lambda a, b: a | b, [F.coalesce(x <= 0, F.lit(False)) for x, _ in used], F.lit(False))
    logs = total([F.coalesce(F.ln(F.when(x > 0, x)), F.lit(0.0)) * (w / F.nullif(present, F.lit(0.0))) for x, w in used])
    return F.when(zero | (present <= 0), 0.0).otherwise(F.exp(logs))


def penalised(score: Column, present: Column, of: int) -> Column:
    return F.when(present == of, score).otherwise(score * F.sqrt(present / float(of)))


def score_cohort(values: DataFrame, entities: DataFrame, indicators: list[Indicator], profile: Profile = REFERENCE, entity: str = "entity") -> DataFrame:
    """entity, sub_scores, pillar_scores and coverage (maps), paq, cme, composite, flagged for every entity.

    values (entity, key, score): indicator scores, null or absent where missing; of repeated keys the one with the
    largest value in a column place counts, which comes last, or without that column the largest score. entities
    (entity, cme): a null cme is 0.
    """
    place = F.col("place") if "place" in values.columns else F.col("score")
    keys = [i.key for i in indicators]
    wide = values.where(F.col("key").isin(keys)).groupBy(entity).agg(*[F.max_by("score", F.when(F.col("key") == k, place)).alias(f"v{n}") for n, k in enumerate(keys)])
    rows = entities.select(entity, F.coalesce("cme", F.lit(0.0)).alias("cme")).join(wide, entity, "left")
    value = {k: F.col(f"v{n}") for n, k in enumerate(keys)}
    return aggregated(rows, value, indicators, profile, entity)


def aggregated(
    rows: DataFrame, value: dict[str, Column], indicators: list[Indicator], profile: Profile = REFERENCE, entity: str = "entity", keep: list[str] | None = None,
    cme: Column | float | None = None, paq: Column | float | None = None, geometric: Column | None = None, dropped: Column | None = None,
) -> DataFrame:
    """What score_cohort gives, and the columns keep, for rows (entity, cme and more) with each indicator's score as a
    Column over them. The weights of cme and paq, whether pillars meet in a geometric mean, and a pillar whose
    indicators are left out may be columns, too; without, they are the profile's."""
    subs: dict[str, dict[str, list[Indicator]]] = {}
    for i in indicators:
        subs.setdefault(i.pillar, {}).setdefault(i.sub_factor, []).append(i)
    columns, coverage, pillar_score = {}, {}, {}
    for pillar in profile.pillars:
        own = subs.get(pillar, {})
        for name, of in own.items():
            present = total([value[i.key].isNotNull().cast("int") for i in of])
            columns[name] = F.when(present > 0, penalised(weighted_mean([(value[i.key], i.weight) for i in of]), present, len(of))).otherwise(0.0)
        every = [i for of in own.values() for i in of]
        coverage[pillar] = total([value[i.key].isNotNull().cast("int") for i in every]) / float(len(every)) if every else F.lit(0.0)
    hidden = keep or []
    rows = rows.select(entity, "cme", *hidden, *[c.alias(f"s{n}") for n, c in enumerate(columns.values())], *[c.alias(f"c_{p}") for p, c in coverage.items()])
    sub = {name: F.col(f"s{n}") for n, name in enumerate(columns)}
    for pillar, weights in profile.sub_factors.items():
        there = {s: w for s, w in weights.items() if s in sub}
        scale = sum(there.values())
        pillar_score[pillar] = total([sub[s] * (w / scale) for s, w in there.items()]) if scale else F.lit(0.0)
    rows = rows.select("*", *[c.alias(f"p_{p}") for p, c in pillar_score.items()])
    there = lambda p: F.col(f"p_{p}") if dropped is None else F.when(~F.col(f"p_{p}").isNull() & ~dropped.eqNullSafe(F.lit(p)), F.col(f"p_{p}"))
    scoped = [(there(p), w) for p, w in profile.pillars.items() if any(s in sub for s in profile.sub_factors.get(p, {}))]
    if geometric is None:
        mean = geometric_mean(scoped) if profile.geometric else weighted_mean(scoped)
    else:
        mean = F.when(geometric, geometric_mean(scoped)).otherwise(weighted_mean(scoped))
    flagged = reduce(lambda a, b: a | b, [F.col(f"c_{p}") < profile.disclosure for p in coverage], F.lit(False))
    as_map = lambda pairs: F.create_map(*[x for k, c in pairs for x in (F.lit(k), c)])
    weight = profile.cme if cme is None else cme, profile.paq if paq is None else paq
    return rows.withColumn("_paq", mean).select(
        entity,
        *hidden,
        as_map(sub.items()).alias("sub_scores"),
        as_map((p, F.col(f"p_{p}")) for p in pillar_score).alias("pillar_scores"),
        as_map((p, F.col(f"c_{p}")) for p in coverage).alias("coverage"),
        F.col("_paq").alias("paq"),
        "cme",
        (weight[0] * F.col("cme") + weight[1] * F.col("_paq")).alias("composite"),
        flagged.alias("flagged"),
    )


def what_if(rows: DataFrame, pillars: dict[str, float], cme: float = 0.3, paq: float = 0.7, name: str = "name") -> DataFrame:
    """rows (pillar_scores, cme, name) with new weights: paq, composite and rank of those that have a composite."""
    re_paq = total([F.try_element_at("pillar_scores", F.lit(p)) * w for p, w in pillars.items()])
    scored = rows.withColumn("paq", re_paq).withColumn("composite", cme * F.col("cme") + paq * F.col("paq"))
    placed = ranked(scored, [F.col("composite").desc_nulls_last(), F.col(name).asc()])
    return placed.withColumn("rank", F.when(F.col("composite").isNotNull(), F.col("rank")))


def rebalanced(weights: dict[str, float], changed: str, value: float) -> dict[str, float]:
    """The other weights scaled so that all sum to 1 after one is set (clamped to 0..1); equal shares where all others are 0."""
    value = min(1.0, max(0.0, value))
    others = [k for k in weights if k != changed]
    rest = sum(weights[k] for k in others)
    out = {k: (weights[k] / rest if rest > 0 else 1 / len(others)) * (1 - value) for k in others} | {changed: value}
    if others:
        out[others[-1]] += 1 - sum(out.values())
    return {k: out[k] for k in weights}


def readings(values: DataFrame, definitions: DataFrame, substitutes: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, key, fn, place, number, unlimited, score, error: raw values (entity, key, raw, status, place) through their
    fields' functions.

    definitions (key, fn, direction, low, high, mean, stddev, rubric) and substitutes (key, region, value, score) are
    configuration and broadcast. Rows that aren't approved, have no value or say {"notApplicable": true} take no part. A
    regional value names its region, or else is one of the substitutes' values (of equal ones the first region's). What
    can't be scored is null, with an error that says why: one bad row doesn't stop a cohort.
    """
    from tessaly.functions import scores as S

    by_region = substitutes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("region", "score"))).alias("by_region"))
    first = substitutes.groupBy("key", "value").agg(F.min_by("score", "region").alias("score"))
    by_value = first.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "score"))).alias("by_value"))
    rows = values.where((F.col("status") == "approved") & F.col("raw").isNotNull()).join(F.broadcast(definitions), "key")
    rows = rows.join(F.broadcast(by_region), "key", "left").join(F.broadcast(by_value), "key", "left")
    rows = rows.withColumn("fields", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", "map<string,string>")))
    field = lambda k: F.try_element_at("fields", k)
    region = field(F.lit("region"))
    regional = F.when(region.isNotNull(), F.try_element_at("by_region", region)).otherwise(F.try_element_at("by_value", F.trim("raw")))
    annotated = F.when(field(F.col("key")) == "true", True).when(field(F.col("key")) == "false", False)
    c = F.col
    number, unlimited = S.number_of(c("raw")), S.no_limit(c("raw"))
    score = S.indicator_score(c("fn"), c("direction"), number, F.trim("raw"), S.truth_of(c("raw")), unlimited, c("low"), c("high"), c("mean"), c("stddev"), c("rubric"), annotated, regional)
    why = S.error_of(c("fn"), number, F.trim("raw"), c("low"), c("high"), c("stddev"), c("rubric"))
    applies = F.coalesce(field(F.lit("notApplicable")) != "true", F.lit(True))
    rows = rows.where(applies).select(entity, "key", "fn", "place", number.alias("number"), unlimited.alias("unlimited"), score.alias("score"), why.alias("_why"))
    return rows.withColumn("error", F.when(F.col("score").isNull(), F.coalesce("_why", F.lit("unreadable value")))).drop("_why")


def indicator_scores(values: DataFrame, definitions: DataFrame, substitutes: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, key, score, place, error of readings; score_cohort takes a null score as missing."""
    return readings(values, definitions, substitutes, entity).select(entity, "key", "score", "place", "error")
