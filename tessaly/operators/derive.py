"""Fields whose values follow from what is known of a country or a programme's history, not from extraction.

Policies are configuration (a row a country) and broadcast; a programme's fields are made in its own row and exploded.
Where a country has no policy, or its value is null (contested, no pathway, another mechanism), the field isn't derived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a derived row names as its model, and its confidence.
MODEL, CONFIDENCE = "derived-knowledge", 0.7
#: What an event of a severity counts for.
SEVERITY_WEIGHTS = {"major": 3, "moderate": 2, "minor": 1}


@dataclass(frozen=True)
class Rule:
    """A field that a policy gives: which policy, the value as text (null: not derived), its number (0 for texts), the
    sentence, and the parts of the value that its checksum covers."""

    key: str
    policy: str
    value: Column
    number: Column
    sentence: Column
    parts: tuple[Column, ...]


def standard_rules() -> list[Rule]:
    """The seven fields by country. Policies: timeline (years, notes), presence (pr_required, pr_days, pr_notes,
    stay_required, stay_days, stay_notes), citizenship (permitted, notes), civic (burden, notes), residency (days, notes),
    basis (basis, notes); each with source_url and source_year. A column c of policy p is p_c."""
    c, zero = F.col, F.lit(0.0)
    whole = lambda x: c(x).cast("long").cast("string")
    number_text = lambda x: F.when(c(x) == F.floor(c(x)), whole(x)).otherwise(c(x).cast("string"))
    kept = {"ignoreNullFields": "false"}

    def presence(key: str, at: str) -> Rule:
        required, days, notes = (c(f"presence_{at}_{x}") for x in ("required", "days", "notes"))
        record = F.to_json(F.struct(required.alias("required"), days.alias("daysPerYear"), notes.alias("notes")), kept)
        return Rule(key, "presence", F.when(required.isNotNull(), record), zero, notes, (required.cast("string"), F.coalesce(days.cast("string"), F.lit("null"))))

    permitted = F.when(c("citizenship_permitted"), "permitted").when(~c("citizenship_permitted"), "not_permitted")
    return [
        Rule("D.1.2", "timeline", number_text("timeline_years"), c("timeline_years").cast("double"), c("timeline_notes"), (number_text("timeline_years"),)),
        presence("D.1.3", "pr"),
        presence("D.1.4", "stay"),
        Rule("D.2.3", "citizenship", permitted, zero, c("citizenship_notes"), (c("citizenship_permitted").cast("string"),)),
        Rule("D.2.4", "civic", c("civic_burden"), zero, c("civic_notes"), (c("civic_burden"),)),
        Rule("D.3.1", "residency", whole("residency_days"), c("residency_days").cast("double"), c("residency_notes"), (whole("residency_days"),)),
        Rule("D.3.3", "basis", c("basis_basis"), zero, c("basis_notes"), (c("basis_basis"),)),
    ]


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(MODEL), *parts), 256)


def known_fields(programmes: DataFrame, policies: dict[str, DataFrame], rules: list[Rule] | None = None) -> DataFrame:
    """programme, key, value_raw, number, sentence, source_url, source_year, content_hash, model, confidence for each
    programme (programme, country) and rule whose policy (country and its columns) gives a value."""
    rows = programmes.select("programme", "country")
    for name, policy in policies.items():
        own = policy.select("country", *[F.col(x).alias(f"{name}_{x}") for x in policy.columns if x != "country"])
        rows = rows.join(F.broadcast(own), "country", "left")
    programme = F.col("programme").cast("string")

    def made(r: Rule) -> Column:
        digest = _hash(F.lit(r.key), programme, F.col("country").cast("string"), *r.parts)
        fields = {"key": F.lit(r.key), "value_raw": r.value, "number": r.number, "sentence": r.sentence, "source_url": F.col(f"{r.policy}_source_url"), "source_year": F.col(f"{r.policy}_source_year"), "content_hash": digest}
        return F.struct(*[x.alias(n) for n, x in fields.items()])

    every = F.explode(F.array(*map(made, rules or standard_rules()))).alias("d")
    return rows.select("programme", every).select("programme", "d.*").where("value_raw IS NOT NULL").withColumns({"model": F.lit(MODEL), "confidence": F.lit(CONFIDENCE)})


def volatility_fields(histories: DataFrame, events: DataFrame) -> DataFrame:
    """E.1.1 of each programme with a history (programme, first_year, last_year, source_url): the sum of its events'
    weights (programme, year, severity, description, seq), 0 without events; the first event by seq is the sentence. The
    events of a programme are summed where they lie and never gathered."""
    weight = F.lit(0)
    for name, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    told = F.concat(F.col("year").cast("string"), F.lit(" ("), "severity", F.lit("): "), "description")
    found = events.groupBy("programme").agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min_by(told, "seq").alias("_told"))
    rows = histories.join(found, "programme", "left")
    total, n = F.coalesce("_sum", F.lit(0)), F.coalesce("_n", F.lit(0))
    none = F.concat(F.lit("No material changes recorded in window "), F.col("first_year").cast("string"), F.lit("-"), F.col("last_year").cast("string"), F.lit("."))
    digest = _hash(F.lit("E.1.1"), F.col("programme").cast("string"), total.cast("string"), n.cast("string"))
    return rows.select(
        "programme", F.lit("E.1.1").alias("key"), total.cast("string").alias("value_raw"), total.cast("double").alias("number"), F.coalesce("_told", none).alias("sentence"), "source_url", F.col("last_year").alias("source_year"),
        digest.alias("content_hash"), F.lit(MODEL).alias("model"), F.lit(CONFIDENCE).alias("confidence"),
    )
