"""Rules of the ingest pipeline: gates, derivations, planning and bookkeeping, each over whole tables.

What calls a model or a website in an ingest run comes in as a table of responses here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rubric_holds(rubric_json: Column, value: Column) -> Column:
    """Whether a rubric of the form {"categories": [{"value": ...}]} holds a value."""
    categories = F.from_json(rubric_json, "struct<categories:array<struct<value:string>>>")["categories"]
    return F.coalesce(F.exists(categories, lambda c: c["value"] == value), F.lit(False))


def in_sane_range(values: DataFrame, ranges: DataFrame, key: str = "key", number: str = "number") -> DataFrame:
    """values with sane: inside the inclusive range of its key, or no range known. ranges is a configuration table."""
    r = ranges.select(F.col(key).alias("_key"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    return values.join(F.broadcast(r), F.col(key) == F.col("_key"), "left").withColumn("sane", F.coalesce(F.col(number).between(F.col("_low"), F.col("_high")), F.col("_key").isNull())).drop("_key", "_low", "_high")


def review_reasons(extraction: Column, validation: Column, agrees: Column, before: Column, after: Column, least: float = 0.85, most_delta: float = 5.0) -> Column:
    """The reasons that apply, in order; a score that moved by exactly most_delta isn't one."""
    return F.array_compact(
        F.array(
            F.when(extraction < least, "extraction confidence"),
            F.when(validation < least, "validation confidence"),
            F.when(~agrees, "cross-check disagreement"),
            F.when(F.abs(after - before) > most_delta, "score delta"),
        )
    )


def auto_approved(extraction: Column, valid: Column, validation: Column, checked: Column, least: float = 0.85) -> Column:
    """High confidences, valid, and not vetoed by a disagreeing cross-check; a missing check doesn't veto."""
    passes = (extraction >= least) & valid & (validation >= least)
    return F.coalesce(passes, F.lit(False)) & (F.coalesce(checked, F.lit("not_checked")) != "disagree")


def capped(confidence: Column, cap: float) -> Column:
    """struct(confidence, was_capped)."""
    return F.struct(F.least(confidence, F.lit(cap)).alias("confidence"), (confidence > cap).alias("was_capped"))


def published(verdict: Column, has_meta: Column, sentence: Column, value: Column, categorical: Column, in_rubric: Column, score: Column, sane: Column) -> Column:
    """struct(status, reason): the first rule that applies decides. Out-of-rubric values come before 'not stated'."""
    word = F.lower(F.trim(value))
    rules = [
        (verdict.isin("reject", "re-extract"), "error", "gate verdict"),
        (~has_meta, "error", "metadata missing"),
        (F.coalesce(F.trim(sentence), F.lit("")) == "", "pending", "no source sentence"),
        (word.isin("not_addressed", "not_found"), "dropped", "nothing found"),
        (categorical & ~in_rubric, "pending", "not in rubric"),
        (word == "not_stated", "pending", "not stated"),
        (score.isNull(), "pending", "can't be scored"),
        (~sane, "pending", "outside its range"),
    ]
    out = F.struct(F.lit("approved").alias("status"), F.lit(None).cast("string").alias("reason"))
    for when, status, reason in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def usable_scrapes(scrapes: DataFrame, program: str, order: str, most: int = 5) -> DataFrame:
    """For each programme the first tier-1 scrapes with a good status and text; without one, the first of any tier."""
    from pyspark.sql import Window

    good = scrapes.where((F.col("status") >= 200) & (F.col("status") < 400) & (F.trim("content") != ""))
    whole = Window.partitionBy(program)
    picked = good.withColumn("_any", F.max((F.col("tier") == 1).cast("int")).over(whole)).where((F.col("tier") == 1) | (F.col("_any") == 0))
    return picked.withColumn("_n", F.row_number().over(Window.partitionBy(program).orderBy(order))).where(F.col("_n") <= most).drop("_any", "_n")


def registry_urls(sources: DataFrame, programs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Sources of active programmes in tiers 1 and 2 that were seen less than days before as_of."""
    active = programs.where("status = 'active'").select("program_id")
    return sources.where(F.col("tier").isin(1, 2) & (F.col("last_seen_at") > as_of - F.expr(f"INTERVAL {days} DAYS"))).join(active, "program_id", "left_semi")


def with_fallback(left: DataFrame, first: DataFrame, first_keys: list[str], second: DataFrame, second_keys: list[str], payload: str) -> DataFrame:
    """left with the payload of the first table, else of the second; of several rows for a key the largest payload."""
    one = first.groupBy(*first_keys).agg(F.max(payload).alias("_one"))
    two = second.groupBy(*second_keys).agg(F.max(payload).alias("_two"))
    return left.join(one, first_keys, "left").join(two, second_keys, "left").withColumn(payload, F.coalesce("_one", "_two")).drop("_one", "_two")


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows that the cache holds, and the others."""
    keys = cache.select(key).distinct()
    return wanted.join(keys, key, "left_semi"), wanted.join(keys, key, "left_anti")


def years_to_citizenship(years_to_pr: Column, pathway: Column, years_as_pr: Column) -> Column:
    """Both spans summed, in half years; null where a part is missing or there is no pathway."""
    return F.when(F.coalesce(pathway, F.lit(True)), F.floor((years_to_pr + years_as_pr) * 2 + 0.5) / 2)


def programme_age(year: int, launched: Column, most: int = 20) -> Column:
    """Whole years, at most most; null for a launch in the future."""
    return F.when(launched <= year, F.least(F.lit(year) - launched, F.lit(most)))


def derive_mismatch(derived: Column, model: Column, model_value: Column) -> Column:
    """A note where a language model's earlier value differs from the derived one."""
    return F.when(model.isNotNull() & ~model.startswith("derived") & ~model_value.eqNullSafe(derived), F.concat(F.lit("model said "), F.coalesce(model_value, F.lit("nothing"))))


def run_cost(urls: Column, fields: Column, discovers: Column, price: dict[str, float], global_cap: float, program_cap: float) -> Column:
    """struct(total, verdict) of a linear cost model: error above the global cap, skip above the programme's, warn above
    10. price: discovery, extraction, validation."""
    total = F.when(discovers, price["discovery"]).otherwise(0.0) + urls * price["extraction"] + fields * price["validation"]
    verdict = F.when(total > global_cap, "error").when(total > program_cap, "skip").when(total > 10, "warn").otherwise("ok")
    return F.struct(total.alias("total"), verdict.alias("verdict"))


def discovery_telemetry(found: DataFrame, registry: DataFrame, archive: DataFrame, program: str = "program_id", country: str = "country_iso", url: str = "url") -> DataFrame:
    """For each programme: urls found, in its registry, archived in its country, new, and the share of new ones."""
    in_registry = registry.select(program, url).distinct().withColumn("_r", F.lit(1))
    archived = archive.select(country, url).distinct().withColumn("_a", F.lit(1))
    rows = found.join(in_registry, [program, url], "left").join(archived, [country, url], "left")
    n = rows.groupBy(program).agg(F.count(F.lit(1)).alias("found"), F.count("_r").alias("registered"), F.count("_a").alias("archived"))
    return n.withColumn("new", F.col("found") - F.col("archived")).withColumn("yield_pct", F.round(100 * F.col("new") / F.col("found"), 2))


def rechecked(blocked: DataFrame, probes: DataFrame, domain: str = "domain", least: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Blocked domains that are cleared (status 200 and enough text) and those that stay."""
    clear = probes.where((F.col("status") == 200) & (F.col("length") >= least)).select(domain).distinct()
    return blocked.join(clear, domain, "left_semi"), blocked.join(clear, domain, "left_anti")


def bad_scrapes(cache: DataFrame, content: str, status: str) -> DataFrame:
    """Rows of a scrape cache to delete, with the reason: an error status, a soft 404, or too little visible text. A null
    content is an empty one."""
    from tessaly.functions.text import scrape_status

    return cache.withColumn("reason", scrape_status(F.coalesce(F.col(content), F.lit("")), F.col(status))).where("reason <> 'ok'")


def enriched_rubrics(definitions: DataFrame, scores: DataFrame) -> DataFrame:
    """definitions (key, categories: an array of values, null for none) with scored, their array of (value, score) in
    order. scores (key, value, score) is configuration. A category without a score stops the job, as a seed must be whole."""
    rows = definitions.where(F.size("categories") > 0).select("key", F.posexplode("categories").alias("place", "value"))
    found = rows.join(F.broadcast(scores.select("key", "value", "score")), ["key", "value"], "left")
    sure = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no score for "), "key", F.lit(": "), "value"))).otherwise(F.col("score"))
    arrays = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", sure.alias("score")))), lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"))).alias("scored"))
    return definitions.join(arrays, "key", "left")


def scoped_contents(programmes: DataFrame, contents: DataFrame) -> DataFrame:
    """programme, url: the contents (programme, country, url) of each programme (programme, country), or all of its
    country's where it has none of its own."""
    own = contents.select("programme", "url").distinct()
    without = programmes.join(own.select("programme").distinct(), "programme", "left_anti")
    wide = without.join(contents.select("country", "url").distinct(), "country").select("programme", "url")
    return programmes.select("programme").join(own, "programme").unionByName(wide)


def quality_signals(provenance: Column) -> Column:
    """struct(disagrees, mismatch, note, url) of a provenance record; without a JSON object all false and null."""
    record = F.try_parse_json(provenance)
    schema = lambda k: F.schema_of_variant(F.try_variant_get(record, f"$.{k}", "variant"))
    text = lambda k: F.when(schema(k) == "STRING", F.nullif(F.try_variant_get(record, f"$.{k}", "string"), F.lit("")))
    note = text("deriveLlmMismatch")
    return F.struct(F.coalesce(text("crossCheckResult") == "disagree", F.lit(False)).alias("disagrees"), note.isNotNull().alias("mismatch"), note.alias("note"), text("crossCheckUrl").alias("url"))
