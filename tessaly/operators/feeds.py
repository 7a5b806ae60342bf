"""Change feeds, drift, review queues and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.operators.places import ranked, running_before
from tessaly.sources.stored import stored

FEED_SEVERITIES = ["minor", "material", "breaking"]


def drifted(df: DataFrame, key: str, time: str, tie: str, value: str, since: Column) -> DataFrame:
    """The newest row of each key since a time whose value differs from the one before it in that span."""
    w = Window.partitionBy(key).orderBy(time, tie)
    newest = F.lead(tie).over(w).isNull()
    return (
        df.where(F.col(time) >= since)
        .withColumn("previous", F.lag(value).over(w))
        .withColumn("_newest", newest)
        .where(F.col("_newest") & F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))
        .drop("_newest")
    )


def without_recent(df: DataFrame, keys: list[str], time: str, tie: str, days: int) -> DataFrame:
    """The rows that are written if a row is left out while a written one of the same keys is younger than days. What is
    left out counts for nothing later, so a row is written at most once in days. Rows without a time aren't written.

    The rows of a key are numbered by time; after each of them the next that could be written is the first at least days
    later, found by counting the rows before that time. The written ones are those that these pointers reach from a key's
    first row. Pointers double their length in each round, so a chain of n rows takes about log2(n) joins, and no task
    holds a whole key.
    """
    dated = df.where(F.col(time).isNotNull())
    order = [F.col(time).asc(), F.col(tie).asc()]
    rows = stored(ranked(dated, order, "_place", keys), "placed")
    point = lambda at, kind: rows.select(*keys, at.alias("_t"), F.lit(kind).alias("_kind"), F.col(tie).alias("_tie"), "_place", F.lit(kind).cast("long").alias("_one"))
    # at one time the question comes before the rows, so it counts those before only
    both = point(F.col(time) + F.expr(f"INTERVAL {days} DAYS"), 0).union(point(F.col(time), 1))
    before = running_before(both, keys, [F.col("_t").asc(), F.col("_kind").asc(), F.col("_tie").asc()], "_one", "_earlier")
    sizes = rows.groupBy(*keys).agg(F.max("_place").alias("_size"))
    nexts = before.where("_kind = 0").select(*keys, F.col("_place").alias("_from"), (F.col("_earlier") + 1).alias("_to"))
    jumps = stored(_same_keys(nexts, sizes, keys).where("_to <= _size").select(*keys, "_from", "_to"), "jumps")
    written = rows.where("_place = 1").select(*keys, "_place")
    while not jumps.isEmpty():
        there = _same_keys(written, jumps, keys, F.col("_place") == F.col("_from")).select(*keys, F.col("_to").alias("_place"))
        written = stored(written.union(there), "written")
        on = jumps.select(*keys, F.col("_from").alias("_via"), F.col("_to").alias("_end"))
        jumps = stored(_same_keys(jumps, on, keys, F.col("_to") == F.col("_via")).select(*keys, "_from", F.col("_end").alias("_to")), "jumps")
    return _same_keys(rows, written.withColumnRenamed("_place", "_written"), keys, F.col("_place") == F.col("_written"), "left_semi").select(*df.columns)


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """left joined with right where all keys, nulls too, and more are equal; right's keys go."""
    side = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True) if more is None else more
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(side, same, how)
    return joined if how == "left_semi" else joined.drop(*[f"_right_{k}" for k in keys])


def feed(changes: DataFrame, where: Column, time: str, tie: str, severity: str, limit: int = 200) -> DataFrame:
    """The newest changes that pass, then only known severities: the guard comes after the limit, so less than limit
    rows can come back."""
    return changes.where(where).orderBy(F.col(time).desc(), F.col(tie).desc()).limit(limit).where(F.col(severity).isin(FEED_SEVERITIES))


def digest(events: DataFrame, recipients: DataFrame, time: str, as_of: str, severity: str, country: str, hours: int = 24) -> DataFrame:
    """recipient and event for the last hours; a recipient's null filter lets all pass. recipients (recipient,
    severities, countries) is a configuration table and is broadcast."""
    recent = events.where((F.col(time) >= F.expr(f"timestamp_ntz'{as_of}' - INTERVAL {hours} HOURS")) & (F.col(time) <= F.expr(f"timestamp_ntz'{as_of}'")))
    wanted = (F.col("severities").isNull() | F.array_contains("severities", F.col(severity))) & (F.col("countries").isNull() | F.array_contains("countries", F.col(country)))
    return recent.join(F.broadcast(recipients), wanted).drop("severities", "countries")


def digest_body(rows: DataFrame, recipient: str, line: Column, order: list[Column]) -> DataFrame:
    """One text for each recipient, its lines in order."""
    w = Window.partitionBy(recipient).orderBy(*order)
    numbered = rows.select(recipient, line.alias("line"), F.row_number().over(w).alias("n"))
    return numbered.groupBy(recipient).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))


def bulk_candidate(extraction: Column, validation: Column, valid: Column, least: float = 0.85) -> Column:
    """Both confidences (text or number) high enough and not called invalid; a null confidence fails, a null or
    textual validity doesn't."""
    return F.coalesce((extraction.try_cast("double") >= least) & (validation.try_cast("double") >= least), F.lit(False)) & ~valid.eqNullSafe(F.lit("false"))


def review_tabs(status: Column, extraction: Column, validation: Column, valid: Column, assigned: Column, reviewer: str, signal: Column) -> dict[str, Column]:
    """The predicate of each tab of the review page; a row may be in several."""
    low = F.least(F.coalesce(extraction.try_cast("double"), F.lit(0.0)), F.coalesce(validation.try_cast("double"), F.lit(0.0)))
    pending = status == "pending"
    return {
        "all": F.lit(True),
        "my_queue": F.coalesce(assigned == reviewer, F.lit(False)),
        "pending": pending,
        "high_confidence": pending & bulk_candidate(extraction, validation, valid),
        "flagged": pending & (low < 0.7),
        "in_review": status == "in_review",
        "quality_signals": F.coalesce(signal, F.lit(False)),
    }


def priority(extraction: Column, validation: Column) -> Column:
    low = F.least(extraction, validation)
    return F.when(low < 0.5, 1).when(low < 0.6, 2).when(low < 0.7, 3).otherwise(4)


def sla_tier(time: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 8.64e10)
    return F.when(days >= 14, "red").when(days >= 7, "orange").otherwise("green")


def relative_age(time: Column, as_of: Column) -> Column:
    """Minutes below 60, hours below 48, else days."""
    minutes = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 6e7
    return F.when(minutes < 60, F.concat(F.round(minutes).cast("int"), F.lit("m"))).when(minutes < 48 * 60, F.concat(F.round(minutes / 60).cast("int"), F.lit("h"))).otherwise(
        F.concat(F.round(minutes / 1440).cast("int"), F.lit("d"))
    )


def decided(rows: DataFrame, decisions: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """rows with the status that their latest decision leaves: approve, reject, edit (approved with a new raw value)
    and unapprove (pending again); without a decision the status stays."""
    from tessaly.operators.rows import first_per_key

    last = first_per_key(decisions, [key], [F.col(time).desc(), F.col(tie).desc()]).select(F.col(key).alias("_k"), F.col("decision").alias("_d"), F.col("edited_raw").alias("_raw"))
    status = F.when(F.col("_d").isin("approve", "edit"), "approved").when(F.col("_d") == "reject", "rejected").when(F.col("_d") == "unapprove", "pending").otherwise(F.col("status"))
    joined = rows.join(last, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("status", status).withColumn("value_raw", F.when(F.col("_d").isin("approve", "edit"), F.coalesce("_raw", "value_raw")).otherwise(F.col("value_raw"))).drop("_k", "_d", "_raw")
