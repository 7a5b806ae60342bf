"""URL allocation, version comparison, pair coverage, upserts and other joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Origins from weakest to strongest payload.
ORIGIN_STRENGTH = ["registry", "proven", "fresh", "field_proven"]


def _index(column: str, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def merged_urls(urls: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: registry, then proven if absent, then fresh and field-proven over both; of one origin the
    last row counts, of proven ones the first; the first place stays. urls (key..., origin, position, payload columns)."""
    payload = F.struct(*[F.col(c) for c in urls.columns if c not in key and c != "position"])
    # proven only counts where no registry row is there, so it ranks below it
    strength = F.when(F.col("origin") == "proven", 0).otherwise(_index("origin", ORIGIN_STRENGTH))
    best = urls.groupBy(*key).agg(F.max_by(payload, F.struct(strength, F.when(F.col("origin") == "proven", -F.col("position")).otherwise(F.col("position")))).alias("_p"), F.min("position").alias("position"))
    return best.select(*key, "_p.*", "position")


def tier_quotas(urls: DataFrame, group: list[str], order: list[Column], quotas: dict[int, int], cap: int, backfill: list[int], tier: str = "tier") -> DataFrame:
    """Up to quotas rows of each tier in order, then the left over ones of the tiers in backfill order, cap in all. The
    order must be total. At most cap rows of a tier reach the task that places a group."""
    in_tier = F.row_number().over(Window.partitionBy(*group, tier).orderBy(*order))
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(tier)), F.lit(0))
    later = F.array_position(F.array(*[F.lit(t) for t in backfill]), F.col(tier))
    # what comes after cap rows of its own tier can't be among the first cap; Spark drops it before it shuffles
    rows = urls.withColumn("_n", in_tier).where(F.col("_n") <= cap)
    phase = F.struct((F.col("_n") > quota).cast("int").alias("phase"), F.when(F.col("_n") > quota, later).otherwise(F.col(tier).cast("bigint")).alias("at"), F.col("_n").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*[F.col(g) for g in group]).orderBy(phase))).where(F.col("place") <= cap).drop("_n")


def dynamic_cap(populated: Column) -> Column:
    return F.when(populated < 30, 20).when(populated < 42, 15).otherwise(12)


def url_yield(df: DataFrame, keys: list[str], published: Column, confidence: Column) -> DataFrame:
    """Attempts, yields, mean confidence of the yields and the best one, and whether any yielded."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(published).alias("yielded"), F.avg(F.when(published, confidence)).alias("mean_confidence"), F.max(confidence).alias("best"), F.bool_or(published).alias("any_yield")
    )


def yield_score(yields: DataFrame, url: str) -> DataFrame:
    return yields.groupBy(url).agg(F.sum(F.greatest(F.col("yielded"), F.lit(0)) * F.coalesce("mean_confidence", F.lit(0.5))).alias("score"))


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair in both directions; a pair that is given in a direction wins over the reverse of the other."""
    direct = pairs.withColumn("reversed", F.lit(False))
    back = pairs.select(*[F.col({a: b, b: a}.get(c, c)).alias(c) for c in pairs.columns]).withColumn("reversed", F.lit(True))
    rest = [c for c in direct.columns if c not in (a, b)]
    best = direct.unionByName(back).groupBy(a, b).agg(F.min_by(F.struct(*rest), "reversed").alias("_r"))
    return best.select(a, b, "_r.*")


def pair_coverage(pairs: DataFrame, a: str, b: str, members: int) -> DataFrame:
    """Unordered pairs of members, how many are there, and the members that they touch."""
    there = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    ends = there.agg(F.count(F.lit(1)).alias("modelled"))
    touched = there.select(F.explode(F.array("x", "y")).alias("e")).agg(F.countDistinct("e").alias("touched"))
    return ends.crossJoin(F.broadcast(touched)).select(F.lit(members * (members - 1) // 2).cast("long").alias("pairs"), "modelled", "touched")  # one row each


def treaty_coverage(pairs: DataFrame, a: str, b: str, active: str, place: str, members: DataFrame) -> DataFrame:
    """One row: members, pairs (unordered, of members), modelled and active ones, members touched, pairs not modelled.
    pairs may name a pair in both directions and more than once: its first row by place says whether it is active. Of a
    member with itself only the touch counts. members (member): distinct; each side is joined once."""
    side = lambda c, name: members.select(F.col("member").alias(c), F.lit(True).alias(name))
    inside = pairs.join(side(a, "_a"), a, "left").join(side(b, "_b"), b, "left")
    known = inside.where("_a AND _b").groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.min_by(active, place).alias("active"))
    counts = known.agg(F.count(F.lit(1)).alias("modelled"), F.count_if("active").alias("active"))
    touched = inside.select(F.explode(F.array(F.when(F.col("_a"), F.col(a)), F.when(F.col("_b"), F.col(b)))).alias("e")).agg(F.countDistinct("e").alias("touched"))
    size = members.agg(F.count(F.lit(1)).alias("members"))
    whole = F.floor(F.col("members") * (F.col("members") - 1) / 2)
    return size.crossJoin(counts).crossJoin(touched).select("members", whole.alias("pairs"), "modelled", "active", "touched", (whole - F.col("modelled")).alias("unmodelled"))  # one row each


def compared(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of both versions with old and new value, the numeric delta, and whether it changed."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    return both.select(key, "old", "new", (F.col("new").try_cast("double") - F.col("old").try_cast("double")).alias("delta"), (~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))


def reconciled(journal: DataFrame, disk: DataFrame, name: str, checksum: str) -> DataFrame:
    """OK, DRIFT, MISSING (only in the journal), UNAPPLIED (only on disk) or NULL (no checksum in the journal)."""
    j = journal.select(name, F.col(checksum).alias("_j"), F.lit(True).alias("_in_j"))
    d = disk.select(name, F.col(checksum).alias("_d"), F.lit(True).alias("_in_d"))
    verdict = F.when(F.col("_in_j").isNull(), "UNAPPLIED").when(F.col("_in_d").isNull(), "MISSING").when(F.col("_j").isNull(), "NULL").when(F.col("_j") == F.col("_d"), "OK").otherwise("DRIFT")
    return j.join(d, name, "full_outer").select(name, verdict.alias("verdict"))


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """existing with the incoming rows in place of those of the same key; of several for a key the first in order, or
    without an order any one."""
    from tessaly.operators.rows import first_per_key

    incoming = first_per_key(incoming, key, order) if order else incoming.dropDuplicates(key)
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def inserted_new(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """existing and the first incoming row of each key that it doesn't have."""
    from tessaly.operators.rows import first_per_key

    return existing.unionByName(first_per_key(incoming.join(existing.select(*key).distinct(), key, "left_anti"), key, order))


def kept_tier_upsert(existing: DataFrame, incoming: DataFrame, key: list[str], tier: str, category: str) -> DataFrame:
    """The smaller tier and the category that was there first win."""
    left = existing.select(*key, F.col(tier).alias("_t"), F.col(category).alias("_c"))
    both = left.join(incoming.select(*key, tier, category), key, "full_outer")
    return both.select(*key, F.least("_t", tier).alias(tier), F.coalesce("_c", category).alias(category))


def dense_summary(items: DataFrame, keys: DataFrame, key: str, rank: str, bounds: list[int]) -> DataFrame:
    """For every key: its number of items, the best rank (infinity for none) and how many are within each bound."""
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.min(rank).cast("double").alias("best"), *[F.count_if(F.col(rank) <= b).alias(f"within_{b}") for b in bounds])
    return keys.select(key).join(n, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("best", F.lit(float("inf"))).alias("best"), *[F.coalesce(f"within_{b}", F.lit(0)).alias(f"within_{b}") for b in bounds])
