"""Calibration, medians, histograms, rank statistics and cohort counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions.scores import half_up
from tessaly.operators.places import quantiles, ranked
from tessaly.sources.stored import stored


def calibrated(df: DataFrame, key: str, value: str, entity: str | None = None, least_entities: int = 0) -> DataFrame:
    """For each key: n, low and high (interpolated 10th and 90th percentiles), mean, stddev (0 for one row), rounded to
    two digits. With an entity column, only if the whole frame has least_entities of them. Non-numeric values are null
    and are skipped."""
    some = df.where(F.col(value).isNotNull())
    ends = quantiles(some, [key], value, {"low": 0.1, "high": 0.9}).select(F.col(key).alias("_key"), "low", "high")
    moments = some.groupBy(key).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(value)).alias("mean"), half_up(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("stddev"))
    out = moments.join(ends, F.col(key).eqNullSafe(F.col("_key"))).select(key, "n", half_up(F.col("low")).alias("low"), half_up(F.col("high")).alias("high"), "mean", "stddev")
    if entity:
        seen = some.agg(F.countDistinct(entity).alias("_entities"))
        out = out.join(F.broadcast(seen), F.col("_entities") >= least_entities).drop("_entities")  # seen: one row
    return out


#: Below so many programmes a calibration isn't used.
CALIBRATION_PROGRAMMES = 5


def calibrated_fields(values: DataFrame, definitions: DataFrame, programmes: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """key, fn, n, raw_min, raw_max, low, high (of min_max fields), mean, stddev (of z_score fields) from the approved
    numeric values (programme, key, number, status) of the programmes (programme, country), of some countries or all.
    Every row also says n_programmes, n_observations (of all fields) and meets_threshold."""
    fields = definitions.where(F.col("fn").isin("min_max", "z_score")).select("key", "fn")  # configuration
    some = values.where((F.col("status") == "approved") & F.col("number").isNotNull()).join(F.broadcast(fields), "key").join(programmes.select("programme", "country"), "programme")
    if countries:
        some = some.where(F.col("country").isin(countries))
    some = stored(some.select("programme", "key", "fn", F.col("number").cast("double").alias("number")), "observations")
    ends = quantiles(some.where("fn = 'min_max'"), ["key"], "number", {"low": 0.1, "high": 0.9}).select("key", half_up(F.col("low")).alias("low"), half_up(F.col("high")).alias("high"))
    raw = some.groupBy("key", "fn").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("raw_min"), F.max("number").alias("raw_max"), F.avg("number").alias("_m"), F.coalesce(F.stddev_samp("number"), F.lit(0.0)).alias("_s"))
    seen = some.agg(F.countDistinct("programme").alias("n_programmes"), F.count(F.lit(1)).alias("n_observations"))
    of_z = lambda c: half_up(F.when(F.col("fn") == "z_score", F.col(c)))
    out = raw.join(ends, "key", "left").crossJoin(F.broadcast(seen))  # seen: one row
    return out.select("key", "fn", "n", "raw_min", "raw_max", "low", "high", of_z("_m").alias("mean"), of_z("_s").alias("stddev"), "n_programmes", "n_observations", (F.col("n_programmes") >= CALIBRATION_PROGRAMMES).alias("meets_threshold"))


def or_default(found: DataFrame, default: DataFrame) -> DataFrame:
    """The calibrated parameters, or the default ones as a whole where there are none; with calibrated as a flag."""
    chosen = found.withColumn("calibrated", F.lit(True))
    return default.withColumn("calibrated", F.lit(False)) if found.isEmpty() else chosen


def cohort_min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max over the whole frame on 0..100, 100 where all are equal. The two ends are one broadcast row, so the
    frame isn't gathered in one task as a global window would."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    return df.crossJoin(F.broadcast(ends)).withColumn(out, half_up(F.when(width == 0, 100.0).otherwise(100 * (F.col(value) - F.col("_low")) / F.nullif(width, F.lit(0.0))))).drop("_low", "_high")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    return quantiles(df, [key], value, {"median": 0.5}).select(key, "median")


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and counts, a map from the trimmed value to its number; blank values don't count."""
    trimmed = F.trim(F.col(value))
    n = df.where(F.length(trimmed) > 0).groupBy(key, trimmed.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("counts"))


def nested_average(df: DataFrame, key: str, hit: Column) -> DataFrame:
    """The mean over keys of each key's share of hits."""
    shares = df.groupBy(key).agg((F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"))
    return shares.agg(F.avg("share").alias("mean_share"), F.count(F.lit(1)).alias("n_keys"))


def _rho(a: str, b: str) -> Column:
    """1 - 6 sum d^2 / (n (n^2 - 1)); 1 for less than two rows."""
    d = F.col(a).cast("double") - F.col(b)
    n = F.count(F.lit(1)).cast("double")
    return F.when(n < 2, 1.0).otherwise(1 - 6 * F.sum(d * d) / F.nullif(n * (n * n - 1), F.lit(0.0)))


def _shift(base: str, perturbed: str, n: int) -> Column:
    """Over the perturbed top n: 1 for each changed rank, and 1 more for each that wasn't in the base top n."""
    moved = (F.col(base) != F.col(perturbed)).cast("int") + (F.col(base) > n).cast("int")
    return F.coalesce(F.sum(F.when(F.col(perturbed) <= n, moved)), F.lit(0)).cast("long")


def spearman(df: DataFrame, rank_a: str, rank_b: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), _rho(rank_a, rank_b).alias("rho"))


def top_shift(df: DataFrame, base: str, perturbed: str, n: int = 10, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(_shift(base, perturbed, n).alias("shift"))


def rank_statistics(df: DataFrame, base: str, perturbed: str, by: list[str], top: int = 10) -> DataFrame:
    """by, n, rho and shift, by one grouping."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _rho(base, perturbed).alias("rho"), _shift(base, perturbed, top).alias("shift"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """0 where either side doesn't vary."""
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias("r"))


def split_sensitivity(base: DataFrame, splits: list[float], entity: str = "entity") -> DataFrame:
    """split, n, rho and shift of the ranking when cme weighs split instead of 0.3."""
    new = F.array(*[F.struct(F.lit(float(s)).alias("split"), (float(s) * F.col("cme") + (1 - float(s)) * F.col("paq")).alias("new")) for s in splits])
    return perturbed(base, 0.3 * F.col("cme") + 0.7 * F.col("paq"), new, "split", entity)


def drawn_weight(trial, seed: int = 1, spread: float = 0.06):
    """The cme weight of a trial (a number or a Column): 0.3 +- spread, by a linear congruential rule."""
    return 0.3 - spread + 2 * spread * ((1103515245 * (trial + seed) + 12345) % 2147483648) / 2147483648.0


def monte_carlo(base: DataFrame, trials: int = 50, spread: float = 0.06, seed: int = 1, entity: str = "entity") -> DataFrame:
    """trial, n, rho and shift for cme weights drawn uniformly from 0.3 +- spread."""
    weights = [(t, drawn_weight(t, seed, spread)) for t in range(1, trials + 1)]
    new = F.array(*[F.struct(F.lit(t).alias("trial"), (w * F.col("cme") + (1 - w) * F.col("paq")).alias("new")) for t, w in weights])
    return perturbed(base, 0.3 * F.col("cme") + 0.7 * F.col("paq"), new, "trial", entity)


def dropout_sensitivity(base: DataFrame, pillars: dict[str, float], entity: str = "entity") -> DataFrame:
    """pillar, n, rho and shift of the ranking when a pillar is left out of paq. base: entity, cme, p_<pillar> columns."""
    paq = lambda names: sum((F.col(f"p_{p}") * (pillars[p] / sum(pillars[q] for q in names)) for p in names), F.lit(0.0))
    new = F.array(*[F.struct(F.lit(p).alias("pillar"), (0.3 * F.col("cme") + 0.7 * paq([q for q in pillars if q != p])).alias("new")) for p in pillars])
    return perturbed(base, 0.3 * F.col("cme") + 0.7 * paq(list(pillars)), new, "pillar", entity)


def perturbed(base: DataFrame, composite: Column, new: Column, by: str, entity: str, digits: int = 9) -> DataFrame:
    """by, n, rho and shift: for each element (by, new) of the array new the ranking by it against that by composite.
    Composites are rounded to so many digits first: sums that only differ in their last bits tie. The base ranks go with
    the row before it explodes, so the many rows are ordered once and never joined."""
    rows = base.select(entity, F.round(composite, digits).alias("_base"), new.alias("_new"))
    old = ranked(rows, [F.col("_base").desc(), F.col(entity).asc()], "_rank")
    many = old.select(entity, F.col("_rank").alias("base_rank"), F.explode("_new").alias("_x"))
    many = many.select(entity, "base_rank", F.col(f"_x.{by}").alias(by), F.round("_x.new", digits).alias("_v"))
    return rank_statistics(ranked(many, [F.col("_v").desc(), F.col(entity).asc()], "new_rank", [by]), "base_rank", "new_rank", [by])


def classified_counts(df: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    """A column with the count of each label; the labels are given, so no pass looks for them."""
    return df.groupBy(by).agg(*[F.count_if(F.col(label) == x).alias(x.lower()) for x in labels], F.count(F.lit(1)).alias("total"))


def mean_age_hours(df: DataFrame, time: str, as_of: str, where: Column | None = None) -> Column:
    """An aggregate: the mean age in hours, null where nothing matches."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 3.6e9
    return F.avg(age if where is None else F.when(where, age))


def event_weight(severity: Column) -> Column:
    """An aggregate: the sum of severity weights of a key's events, major 3, moderate 2, minor 1; 0 for others."""
    return F.sum(F.when(severity == "major", 3).when(severity == "moderate", 2).when(severity == "minor", 1).otherwise(0))


def token_costs(usage: DataFrame, prices: DataFrame, kinds: list[str], model: str = "model", by: list[str] | None = None, fallback: str = "default") -> DataFrame:
    """Cost of token usage by model and further keys: tokens of each kind times the model's price per million; models
    without prices take the fallback row. prices (a configuration table) is broadcast."""
    price = prices.select(F.col(model).alias("_m"), *[F.col(k).alias(f"_{k}") for k in kinds])
    base = prices.where(F.col(model) == fallback).select(*[F.col(k).alias(f"_f_{k}") for k in kinds])
    rows = usage.join(F.broadcast(price), F.col(model) == F.col("_m"), "left").crossJoin(F.broadcast(base))
    cost = sum((F.col(k) * F.coalesce(f"_{k}", f"_f_{k}") / 1e6 for k in kinds), F.lit(0.0))
    return rows.groupBy(*(by or []), model).agg(F.sum(cost).alias("cost"))
