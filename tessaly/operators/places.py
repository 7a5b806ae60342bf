"""Ranks, running sums and exact quantiles of whole tables, without a window over one group.

Rows are dealt by range of (keys, order), so each task holds one stretch of the total order, and sorted. A task's rows
are numbered where they lie; a small table, with a row for each task and each key that it holds, says how many rows of
the key, or what sum, lie in the tasks before. A key with a third of all rows spans a third of the tasks.

Rows that are equal in all of keys and order take places next to each other in any order; give a total order for
repeatable ranks. Null keys are a key of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.sources.stored import broadcast_if_small, stored


def _laid_out(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with _task and _at (from 0), its row's place in the task, written."""
    every = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    rows = df.repartitionByRange(*every).sortWithinPartitions(*every).withColumn("_id", F.monotonically_increasing_id())
    # the id is made of the task's number and, in its lower 33 bits, the place
    return stored(rows.withColumn("_task", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(2**33 - 1)).drop("_id"), "laid-out")


def _with_offsets(rows: DataFrame, keys: list[str], amount: Column, out: str) -> DataFrame:
    """rows with _first, the place of their key's first row in the task, and out: the key's amounts in the tasks before."""
    parts = rows.groupBy("_task", *keys).agg(F.min("_at").alias("_first"), F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(parts.withColumn(out, F.coalesce(F.sum("_sum").over(before), F.lit(0).cast(parts.schema["_sum"].dataType))).drop("_sum"), "offsets")
    side = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in ("_task", *keys)], "_first", out)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], F.col("_task") == F.col("_o__task"))
    return rows.join(broadcast_if_small(side), same).drop(*[f"_o_{c}" for c in ("_task", *keys)])


def ranked(df: DataFrame, order: list[Column], place: str = "rank", within: list[str] | None = None) -> DataFrame:
    """df with the place (from 1) of each row in order, within each of the given keys."""
    keys = within or []
    rows = _with_offsets(_laid_out(df, keys, order), keys, F.lit(1).cast("long"), "_before")
    return rows.withColumn(place, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_task", "_at", "_first", "_before")


def running_before(df: DataFrame, keys: list[str], order: list[Column], amount: str, out: str) -> DataFrame:
    """df with the sum of amount over the rows of the same keys that come before in order; 0 for a key's first row."""
    rows = _with_offsets(_laid_out(df, keys, order), keys, F.col(amount), "_before")
    inside = Window.partitionBy("_task", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(rows.schema["_before"].dataType)
    return rows.withColumn(out, F.col("_before") + F.coalesce(F.sum(amount).over(inside), zero)).drop("_task", "_at", "_first", "_before")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a column for each share (0..1): the value at place share * (n - 1), linear between two places. Values
    are counted first, nulls aside; counts add up along the order of values, so no task holds all values of a key."""
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    sizes = stored(counts.groupBy(*keys).agg(F.sum("_n").alias("n")), "sizes")
    rows = running_before(counts, keys, [F.col("_v").asc()], "_n", "_less")
    side = sizes.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], F.lit(True))
    rows = rows.join(broadcast_if_small(side), same) if keys else rows.crossJoin(F.broadcast(side))  # without keys: one row
    at = {name: (F.col("n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    held = lambda place: F.max(F.when((F.col("_less") <= place) & (place < F.col("_less") + F.col("_n")), F.col("_v")))
    ends = [x for name, place in at.items() for x in (held(F.floor(place)).alias(f"_{name}_low"), held(F.ceil(place)).alias(f"_{name}_high"))]
    found = rows.groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    between = lambda name, place: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (place - F.floor(place))
    return found.select(*keys, "n", *[between(name, place).alias(name) for name, place in at.items()])
