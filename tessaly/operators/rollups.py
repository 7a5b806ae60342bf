"""Bookkeeping rollups and comparisons of two tables: issues, previews, stale prompts, seeds, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORIGINS = ["field_proven", "registry", "proven", "fresh"]


def without_patterns(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose column is like none of the patterns; null is like none."""
    like = F.lit(False)
    for p in patterns:
        like = like | F.coalesce(F.col(column).like(p), F.lit(False))
    return df.where(~like)


def purge_candidates(values: DataFrame, filled: Column, approved: Column, time: str, as_of: Column, broken: Column, days: int = 7) -> DataFrame:
    """Values to purge with the reason: empty, not approved and older than days; else with a broken provenance."""
    empty = ~filled & ~approved & (F.col(time) < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return values.withColumn("reason", F.when(empty, "empty").when(broken, "provenance")).where(F.col("reason").isNotNull())


def issue_rollup(rows: DataFrame, key: str, status: str, issues: str) -> DataFrame:
    """For each key and status: rows, and issues (an array column) in all."""
    return rows.groupBy(key, status).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.size(issues), F.lit(0))).cast("long").alias("issues"))


def purge_preview(rows: DataFrame, key: list[str], row_id: str, time: str) -> DataFrame:
    """For each key: how many rows, the first time, and the ids in order. All ids are what is asked for, so a key's rows
    meet in one row of the result."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.sort_array(F.collect_list(row_id)).alias("ids"))


def grouped_lists(rows: DataFrame, key: list[str], lists: dict[str, str]) -> DataFrame:
    """For each key the distinct values of some columns as sorted lists, which meet in one row of the result; repeated
    values are dropped before they are shuffled."""
    return rows.groupBy(*key).agg(*[F.sort_array(F.collect_set(c)).alias(name) for name, c in lists.items()])


def newer_than(values: DataFrame, prompts: DataFrame, key: str, made: str, read: str) -> DataFrame:
    """values joined to the prompts of their key that were made after the value was read."""
    return values.join(prompts, key).where(F.col(made) > F.col(read))


def stale_rollup(stale: DataFrame, key: str, row_id: str, name: str) -> DataFrame:
    return stale.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("least_id"), F.min(name).alias("least_name"))


def differing(left: DataFrame, right: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows of left whose column differs from that of right for the same key; null differs from a value, not from null."""
    other = right.select(*key, F.col(column).alias("_other"))
    return left.join(other, key).where(~F.col(column).eqNullSafe(F.col("_other"))).drop("_other")


def scored_rollup(scored: DataFrame, values: DataFrame, key: str, status: str, filled: Column) -> DataFrame:
    """For each scored key, also those without values: how many values are approved, pending and filled."""
    n = values.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("approved", "pending")], F.count_if(filled).alias("populated"))
    names = ("approved", "pending", "populated")
    return scored.select(key).distinct().join(n, key, "left").select(key, *[F.coalesce(x, F.lit(0)).alias(x) for x in names])


def is_populated(raw: Column, normalised: Column) -> Column:
    """A raw text that isn't empty, or any normalised value."""
    return F.coalesce(raw != "", F.lit(False)) | normalised.isNotNull()


def kind_counts(rows: DataFrame, fn: str) -> DataFrame:
    kind = F.when(F.col(fn).isin("min_max", "z_score"), "numeric").when(F.col(fn) == "categorical", "categorical").when(F.col(fn).isin("boolean", "boolean_with_annotation"), "boolean").otherwise("other")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def contributions(scores: DataFrame, entity: str, score: str, weight: str) -> DataFrame:
    """Each pillar's score times its weight beside the sum of an entity."""
    total = scores.groupBy(entity).agg(F.sum(F.col(score) * F.col(weight)).alias("total"))
    return scores.withColumn("contribution", F.col(score) * F.col(weight)).join(total, entity)


def in_tier_order(urls: DataFrame, group: list[str], tier: str, origin: str, gained: str, position: str) -> DataFrame:
    """urls with their place in the tier: by origin, then by what they gave before, largest first, then as they came."""
    order = [F.array_position(F.array(*[F.lit(x) for x in ORIGINS]), F.col(origin)), F.coalesce(F.col(gained), F.lit(0.0)).desc(), F.col(position)]
    return urls.withColumn("place", F.row_number().over(Window.partitionBy(*group, tier).orderBy(*order)))


def distinct_aggregates(left: DataFrame, right: DataFrame, key: str, newest: Column, counted: Column) -> DataFrame:
    """For each key of left the newest of left and how many distinct of right, from two groupings instead of a join that
    multiplies rows."""
    return left.groupBy(key).agg(newest.alias("newest")).join(right.groupBy(key).agg(F.count_distinct(counted).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def seed_diff(seed: DataFrame, live: DataFrame, key: list[str], column: str) -> DataFrame:
    """For each seed row whether the live table has it unchanged, has another value, or lacks it."""
    there = live.select(*key, F.col(column).alias("_live"), F.lit(True).alias("_there"))
    verdict = F.when(F.col("_there").isNull(), "missing").when(F.col(column).eqNullSafe(F.col("_live")), "unchanged").otherwise("update")
    return seed.join(there, key, "left").withColumn("verdict", verdict).drop("_live", "_there")


def backfilled(existing: DataFrame, seed: DataFrame, key: list[str], column: str, forced: bool = False) -> DataFrame:
    """existing with the seed's value of a natural key where it has none, or everywhere that the seed has one if forced."""
    found = existing.join(seed.groupBy(*key).agg(F.max(column).alias("_seed")), key, "left")
    both = ("_seed", column) if forced else (column, "_seed")
    return found.withColumn(column, F.coalesce(*both)).drop("_seed")


def overridden(first: Column, second: Column) -> Column:
    """A map with the entries of both; those of the second win."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.coalesce(F.map_contains_key(second, k), F.lit(False))), second)


def candidates(scored: DataFrame, own: Column, complete: Column, order: list[Column]) -> DataFrame:
    """All other rows with complete scores, in order."""
    return scored.where(~own & complete).orderBy(*order)
