"""A whole programme as one nested document, for all programmes at once.

Every part is nested by programme on its own, with its rows in their order, and the parts are joined once by the
programme's id. What holds for the whole cohort (medians, counts) is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.operators.places import quantiles
from tessaly.operators.rows import first_per_key, top_per_key

PILLARS = ("A", "B", "C", "D", "E")
SEVERITIES = ("minor", "material", "breaking", "url_broken")
HISTORY_POINTS = 36


def nested(df: DataFrame, key: str, out: str, order: list[tuple[str, bool]], columns: list[str]) -> DataFrame:
    """key and out, the array of a key's rows as structs of columns, ordered by (column, descending) of numbers, dates,
    booleans or texts; the rows of a key are gathered in one row of the result, which is what is asked for."""
    rows = df.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias(out))
    signs = [(c, -1 if down else 1) for c, down in order]

    def compare(a: Column, b: Column) -> Column:
        by = F.lit(0)
        for c, sign in reversed(signs):
            by = F.when(a[c].eqNullSafe(b[c]), by).when(a[c].isNull(), 1).when(b[c].isNull(), -1).when(a[c] < b[c], -sign).otherwise(sign)
        return by

    return rows.withColumn(out, F.array_sort(out, compare))


def pillar_scores(scores: Column) -> Column:
    """A map of pillars to scores where all five are there and finite, else null."""
    sound = lambda p: F.coalesce(F.abs(F.try_element_at(scores, F.lit(p))) < float("inf"), F.lit(False))
    every = sound(PILLARS[0])
    for p in PILLARS[1:]:
        every &= sound(p)
    return F.when(every, F.create_map(*[x for p in PILLARS for x in (F.lit(p), F.try_element_at(scores, F.lit(p)))]))


def median_pillar_scores(scored: DataFrame) -> DataFrame:
    """One row: scored_count and medians, a map from the pillar, of programmes whose pillar_scores are whole."""
    whole = scored.where(F.col("pillar_scores").isNotNull()).select(F.explode("pillar_scores").alias("pillar", "score"))
    found = quantiles(whole, ["pillar"], "score", {"median": 0.5})
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("scored_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pillar", "median")))).alias("medians"))


def _field_values(programmes: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """programme and field_values: a row for every field, in the order of pillar, sub-factor and key (nulls last), with the
    programme's values of it. The order is the same for all programmes, so the fields are numbered once, as one row, and
    a programme gathers its values by number and adds the fields that it lacks; no row is made for each of these."""
    order = [x for c in ("pillar", "sub_factor", "key") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    listed = fields.agg(F.array_sort(F.collect_list(F.struct(*order, "field", "label", "weight"))).alias("fields"))
    places = listed.select(F.posexplode("fields").alias("place", "of")).select("place", "of.field")
    some = values.join(F.broadcast(places), "field").groupBy("programme").agg(F.collect_list(F.struct("place", "value_raw", "score", "status")).alias("given"))
    kind = some.schema["given"].dataType
    empty = F.array().cast(kind)
    found = programmes.select("programme").distinct().join(some, "programme", "left").withColumn("given", F.coalesce("given", empty)).crossJoin(F.broadcast(listed))  # listed: one row
    numbers = F.when(F.size("fields") > 0, F.sequence(F.lit(0), F.size("fields") - 1)).otherwise(F.array().cast("array<int>"))
    lacking = F.transform(F.array_except(numbers, F.col("given.place")), lambda n: F.struct(n.alias("place"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.elementType.fields[1:]]))
    found = found.withColumn("given", F.array_sort(F.concat("given", lacking)))

    def filled(x: Column) -> Column:
        of = F.get("fields", x["place"])
        return F.struct(*[of[c].alias(c) for c in ("field", "key", "label", "pillar", "sub_factor", "weight")], x["value_raw"].alias("value_raw"), x["score"].alias("score"), F.coalesce(x["status"], F.lit("draft")).alias("status"))

    return found.select("programme", F.transform("given", filled).alias("field_values"))


def programme_documents(
    programmes: DataFrame, countries: DataFrame, scores: DataFrame, definitions: DataFrame, values: DataFrame, sources: DataFrame, changes: DataFrame, history: DataFrame, versions: DataFrame
) -> DataFrame:
    """programme and header, score, long_summary, field_values, sources, policy_changes, score_history, cohort.

    - header: programmes (programme, name, category, status, description, launch_year, closure_year, country, long_summary,
      long_summary_at, long_summary_by) with the name and region of countries (country, country_name, region).
    - score: the newest of scores (programme, scored_at, composite, cme, paq, pillar_scores, flagged, placeholder, version),
      with its version's tag (versions: version, tag); null without one.
    - field_values: a row for every one of definitions (field, key, label, pillar, sub_factor, weight) of the five pillars,
      with the value of values (programme, field, value_raw, score, status), by pillar, sub-factor and key; status draft
      without one.
    - sources (programme, source, url, tier, category, is_primary): by tier, primary ones first, then url.
    - policy_changes: approved ones of changes (programme, change, field, detected_at, severity, approved, summary,
      paq_delta) of a known severity whose field is known, newest first; a null summary is empty.
    - score_history: the newest HISTORY_POINTS of history (programme, scored_at, composite, cme, paq, version), oldest first.
    - cohort: how many programmes have all pillar scores, and the medians of these by pillar.

    Parts that a programme lacks are empty arrays. definitions, countries and versions are configuration and broadcast.
    """
    tags = F.broadcast(versions.select("version", "tag"))
    newest = first_per_key(scores, ["programme"], [F.col("scored_at").desc_nulls_last(), F.col("version").desc()]).join(tags, "version", "left")
    newest = newest.withColumn("pillar_scores", pillar_scores(F.col("pillar_scores")))
    cohort = median_pillar_scores(newest)
    score = newest.select("programme", F.struct("composite", "cme", "paq", "pillar_scores", F.coalesce("flagged", F.lit(False)).alias("flagged"), "placeholder", "scored_at", F.col("tag").alias("version")).alias("score"))

    fields = definitions.where(F.col("pillar").isin(*PILLARS))
    known = F.broadcast(definitions.select("field", F.col("key").alias("field_key"), F.col("label").alias("field_label")))
    field_values = _field_values(programmes, fields, values)

    some = changes.where("approved").join(known, "field").where(F.col("severity").isin(*SEVERITIES)).withColumn("summary", F.coalesce("summary", F.lit("")))
    points = top_per_key(history, ["programme"], [F.col("scored_at").desc(), F.col("version").desc()], HISTORY_POINTS).join(tags, "version", "left")
    parts = [
        field_values,
        nested(sources, "programme", "sources", [("tier", False), ("is_primary", True), ("url", False), ("source", False)], ["source", "url", "tier", "category", "is_primary"]),
        nested(some, "programme", "policy_changes", [("detected_at", True), ("change", False)], ["change", "detected_at", "severity", "field_key", "field_label", "summary", "paq_delta"]),
        nested(points, "programme", "score_history", [("place", True)], ["place", "scored_at", "composite", "cme", "paq", "tag"]),
    ]
    out = programmes.join(F.broadcast(countries), "country", "left").join(score, "programme", "left")
    for part in parts:
        out = out.join(part, "programme", "left")
    plain = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    header = F.struct("programme", "name", "category", "status", "description", "launch_year", "closure_year", "country", "country_name", "region").alias("header")
    summary = F.struct(F.col("long_summary").alias("body"), F.col("long_summary_at").alias("updated_at"), F.col("long_summary_by").alias("reviewer")).alias("long_summary")
    arrays = [plain(df, df.columns[1]) for df in parts]
    return out.select("programme", header, "score", summary, *arrays).crossJoin(F.broadcast(cohort.select(F.struct("scored_count", "medians").alias("cohort"))))  # cohort: one row


def as_json(documents: DataFrame, key: str = "programme") -> DataFrame:
    """key and the document as JSON text, absent values as null."""
    return documents.select(key, F.to_json(F.struct(*[F.col(c) for c in documents.columns]), {"ignoreNullFields": "false"}).alias("document"))
