"""Review decisions as rewrites of values and queue, and the fields that a re-run extracts again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.operators import hierarchy as H
from tessaly.operators.feeds import bulk_candidate
from tessaly.operators.gates import rubric_holds
from tessaly.operators.rows import first_per_key

MODES = ("narrow", "gate-failed", "rubric-changed", "field")
#: What a queue row says that a withdrawn approval makes, and its priority.
REPENDED, REPENDED_PRIORITY = "Re-pended via /review", 50


def _record(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision (at, then seq) of each id. The latest times are found by hashing, and only rows of these are
    sorted, so a task holds a time for each id rather than all decisions on some ids."""
    newest = decisions.groupBy("id").agg(F.max("at").alias("_newest"))
    same = decisions["id"].eqNullSafe(newest["id"]) & decisions["at"].eqNullSafe(newest["_newest"])
    rows = decisions.join(newest, same, "left_semi")
    return first_per_key(rows, ["id"], [F.col("at").desc(), F.col("seq").desc()])


def transitions(values: DataFrame, decisions: DataFrame, definitions: DataFrame, substitutes: DataFrame) -> DataFrame:
    """values (id, entity, key, value_raw, status, score, provenance) after the latest decision (id, decision, edited,
    reason, at, seq) of each.

    approve keeps the value, or takes a non-blank edited one; edit needs one (else nothing happens); reject adds a
    non-blank reason to the provenance as rejectReason; unapprove makes it pending_review again. A value taken anew is
    scored by its definition, null where it can't be. reviewed_at is the decision's time, null after unapprove.
    """
    last = latest_decisions(decisions).select("id", "decision", F.trim("edited").alias("_edited"), F.trim("reason").alias("_reason"), "at")
    last = last.where((F.col("decision") != "edit") | (F.length("_edited") > 0))
    rows = values.join(last, "id", "left")
    anew = F.col("decision").isin("approve", "edit") & (F.length("_edited") > 0)
    taken = rows.where(anew).select(F.col("id").alias("entity"), "key", F.col("_edited").alias("raw"), F.lit("approved").alias("status"), F.lit(1).alias("place"))
    rescored = H.indicator_scores(taken, definitions, substitutes).select(F.col("entity").alias("id"), F.col("score").alias("_score"))
    status = F.when(F.col("decision").isin("approve", "edit"), "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "unapprove", "pending_review").otherwise(F.col("status"))
    told = (F.col("decision") == "reject") & (F.length("_reason") > 0)
    fields = F.from_json(F.coalesce("provenance", F.lit("{}")), "map<string,string>")
    merged = F.to_json(F.map_concat(F.map_filter(fields, lambda k, v: k != "rejectReason"), F.create_map(F.lit("rejectReason"), F.col("_reason"))))
    return rows.join(rescored, "id", "left").select(
        "id", "entity", "key", F.when(F.coalesce(anew, F.lit(False)), F.col("_edited")).otherwise(F.col("value_raw")).alias("value_raw"), status.alias("status"),
        F.when(F.coalesce(anew, F.lit(False)), F.col("_score")).otherwise(F.col("score")).alias("score"), F.when(F.coalesce(told, F.lit(False)), merged).otherwise(F.col("provenance")).alias("provenance"),
        F.when(F.coalesce(F.col("decision") != "unapprove", F.lit(False)), F.col("at")).alias("reviewed_at"),
    )


def queue_after(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue (id, reason, priority, status) after the latest decision of each value: approved or rejected and resolved,
    pending_review again after unapprove; a withdrawn value that has no row gets one. An edit leaves the queue."""
    last = latest_decisions(decisions).where("decision <> 'edit'").select("id", "decision", "at")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "unapprove", "pending_review")
    old = queue.join(last, "id", "left").select("id", "reason", "priority", F.coalesce(status, "status").alias("status"), F.when(F.col("decision").isin("approve", "reject"), F.col("at")).alias("resolved_at"))
    gone = last.where("decision = 'unapprove'").join(queue.select("id"), "id", "left_anti")
    return old.unionByName(gone.select("id", F.lit(REPENDED).alias("reason"), F.lit(REPENDED_PRIORITY).alias("priority"), F.lit("pending_review").alias("status"), F.lit(None).cast(old.schema["resolved_at"].dataType).alias("resolved_at")))


def bulk_approved(values: DataFrame, queue: DataFrame, definitions: DataFrame, at: Column, confident_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """values (id, key, value_raw, status, provenance), queue (id, status) with all pending values approved at a time, and
    one row approved, their number. A categorical value must stand in its rubric (definitions: key, fn, rubric, a JSON
    text with categories); confident_only asks for both confidences of the provenance and that it isn't invalid."""
    rows = values.join(F.broadcast(definitions.select("key", "fn", F.col("rubric").alias("_rubric"))), "key")
    chosen = (F.col("status") == "pending_review") & ((F.col("fn") != "categorical") | F.coalesce(rubric_holds(F.col("_rubric"), F.col("value_raw")), F.lit(False)))
    if confident_only:
        p = F.col("provenance")
        chosen &= bulk_candidate(_record(p, "extractionConfidence"), _record(p, "validationConfidence"), _record(p, "isValid"))
    ids = rows.where(chosen).select("id")
    mark = ids.select("id", F.lit(True).alias("_chosen"))
    done = values.join(mark, "id", "left").withColumn("status", F.when(F.col("_chosen"), "approved").otherwise(F.col("status"))).withColumn("reviewed_at", F.when(F.col("_chosen"), at)).drop("_chosen")
    left = queue.join(mark, "id", "left").withColumn("status", F.when(F.col("_chosen"), "approved").otherwise(F.col("status"))).withColumn("resolved_at", F.when(F.col("_chosen"), at)).drop("_chosen")
    return done, left, ids.agg(F.count(F.lit(1)).alias("approved"))


def fields_to_extract(mode: str, programmes: DataFrame, definitions: DataFrame, values: DataFrame, attempts: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """programme, key of what a run in a mode extracts again; a programme without any has no row and no work.

    narrow: definitions (key, prompt) without a value (programme, key, status, provenance); gate-failed: pending values
    whose provenance has a normalizationError; rubric-changed: published attempts (programme, key, published, prompt)
    whose prompt isn't the definition's current one; field: the explicit keys that are defined.
    """
    if mode == "narrow":
        grid = programmes.select("programme").join(F.broadcast(definitions.select("key")))  # definitions are configuration
        return grid.join(values.select("programme", "key").distinct(), ["programme", "key"], "left_anti")
    if mode == "gate-failed":
        failed = _record(F.col("provenance"), "normalizationError").isNotNull()
        return values.where((F.col("status") == "pending_review") & failed).join(programmes.select("programme"), "programme", "left_semi").select("programme", "key").distinct()
    if mode == "rubric-changed":
        current = F.broadcast(definitions.where("prompt IS NOT NULL").select("key", F.col("prompt").alias("_current")))
        stale = attempts.where("published").join(current, "key").where(~F.col("prompt").eqNullSafe(F.col("_current")))
        return stale.join(programmes.select("programme"), "programme", "left_semi").select("programme", "key").distinct()
    if mode == "field":
        return programmes.select("programme").join(F.broadcast(definitions.where(F.col("key").isin(explicit or [])).select("key")))
    raise ValueError(f"unknown mode {mode}")
