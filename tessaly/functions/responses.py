"""Model responses and review input: validation, location of quotes, derived values, small readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def bare_domain(text: Column) -> Column:
    """The host of a URL, or of a text without a scheme what stands before its first slash, lower-cased; else null."""
    plain = F.trim(text)
    host = F.lower(F.try_parse_url(plain, F.lit("HOST")))
    return F.when(plain == "", None).when(plain.contains("://"), host).otherwise(F.lower(F.split_part(plain, F.lit("/"), F.lit(1))))


def relative_date(time: Column, as_of: Column) -> Column:
    """How long ago in words; a dash for null."""
    nearest = lambda x: F.floor(x + 0.5)
    days = nearest((F.unix_micros(as_of) - F.unix_micros(time)) / 8.64e10)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    far = F.when(days < 30, ago(days, "days")).when(days < 365, ago(nearest(days / 30), "months")).otherwise(ago(nearest(days / 365), "years"))
    return F.when(days.isNull(), "—").when(days < 1, "today").when(days == 1, "yesterday").otherwise(far)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def coverage_chip(populated: Column, total: Column) -> Column:
    """struct(percent, fraction, low): low under 70 percent."""
    ratio = F.coalesce(populated / F.nullif(total, F.lit(0)), F.lit(0.0))
    percent = F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))
    return F.struct(percent.alias("percent"), F.concat_ws("/", populated.cast("string"), total.cast("string")).alias("fraction"), (ratio < 0.7).alias("low"))


def number_record(record: Column) -> Column:
    """The numbers, or texts of finite numbers, of a JSON object."""
    found = F.transform_values(F.from_json(record, "map<string,string>"), lambda k, v: v.try_cast("double"))
    return F.map_filter(found, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def weight_split(record: Column, cme: float = 0.3, paq: float = 0.7) -> Column:
    """struct(cme, paq) of a JSON object; the default where either isn't a finite number."""
    found = number_record(record)
    pair = [F.try_element_at(found, F.lit(k)) for k in ("cme", "paq")]
    sound = F.coalesce(pair[0].isNotNull() & pair[1].isNotNull(), F.lit(False))
    return F.struct(F.when(sound, pair[0]).otherwise(cme).alias("cme"), F.when(sound, pair[1]).otherwise(paq).alias("paq"))


def derived_value(raw: Column, fn: Column) -> Column:
    """struct(number, truth, text, record, applies) of a derived raw value under its field's function; all null where the
    value doesn't fit."""
    from tessaly.functions.scores import number_of

    applies = raw != "not_applicable"
    word = F.lower(F.trim(raw))
    truth = F.when(word.isin("permitted", "true", "yes"), True).when(word.isin("not_permitted", "false", "no"), False)
    record = F.when(F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull(), raw)
    of = lambda names, x: F.when(applies & fn.isin(names), x)
    return F.struct(
        of(["min_max", "z_score"], number_of(raw)).alias("number"),
        of(["boolean"], truth).alias("truth"),
        of(["categorical", "country_substitute_regional"], F.trim(raw)).alias("text"),
        of(["boolean_with_annotation"], record).alias("record"),
        applies.alias("applies"),
    )


def quote_place(content: Column, quote: Column) -> Column:
    """Where a quote starts in the content (from 0), else -1: as it is, or else in any case and with any white space. A
    place in a run of white space before it is the run's second character."""
    exact = F.instr(content, quote)
    plain = F.trim(F.regexp_replace(quote, r"\s+", " "))
    body = F.replace(F.regexp_replace(plain, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(" "), F.lit(r"\s+"))
    loose = F.regexp_instr(content, F.concat(F.lit(r"(?iu)(?:^\s+|(?<=\s)\s+)?"), body))
    return F.when(exact > 0, exact - 1).when(plain == "", -1).otherwise(loose - 1)


#: Fields of an extraction response and what they must be: a text, an object, a count (0 or more) or a share (0 to 1).
RESPONSE_FIELDS = (("valueRaw", "text"), ("sourceSentence", "text"), ("characterOffsets", "object"), ("characterOffsets.start", "count"), ("characterOffsets.end", "count"), ("extractionConfidence", "share"))


def response_errors(response: Column) -> Column:
    """What is wrong with an extraction response (JSON), as field:rule codes in the order of RESPONSE_FIELDS; empty for a
    sound one. A value that was found (not blank, confidence above 0) must be bound: to a sentence that isn't blank, to
    offsets that aren't both 0, and the end not before the start. An array counts as an object, here and as offsets;
    anything else has the one code response:object. Offsets inside what isn't an object aren't looked at."""
    doc = F.try_parse_json(response)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.when(kind(k) == "STRING", F.trim(F.try_variant_get(doc, f"$.{k}", "string")))
    number = lambda k: F.when(kind(k).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(doc, f"$.{k}", "double"))
    is_object = lambda schema: schema.rlike("^(OBJECT|ARRAY)")
    sound = {
        "text": lambda k: text(k).isNotNull(),
        "object": lambda k: is_object(kind(k)),
        "count": lambda k: ~is_object(kind(k.rpartition(".")[0])) | F.coalesce(number(k) >= 0, F.lit(False)),
        "share": lambda k: F.coalesce(number(k).between(0, 1), F.lit(False)),
    }
    start, end = number("characterOffsets.start"), number("characterOffsets.end")
    found = (text("valueRaw") != "") & (number("extractionConfidence") > 0)
    rules = [(~sound[rule](k), f"{k}:{rule}") for k, rule in RESPONSE_FIELDS]
    rules += [(found & (F.coalesce(text("sourceSentence"), F.lit("")) == ""), "sourceSentence:bound"), (found & (start == 0) & (end == 0), "characterOffsets:bound"), (found & (end < start), "characterOffsets:order")]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules]))
    return F.when(is_object(F.coalesce(F.schema_of_variant(doc), F.lit("VOID"))), codes).otherwise(F.array(F.lit("response:object")))


def reviewer_change(row_id: Column, reviewer: Column, now: Column) -> Column:
    """struct(error, assigned_to, assigned_at) of an assignment: both ids are UUIDs, an empty reviewer clears."""
    row, who = F.trim(row_id), F.coalesce(F.trim(reviewer), F.lit(""))
    error = F.when(~F.coalesce(row.rlike(UUID), F.lit(False)), "invalid row").when((who != "") & ~who.rlike(UUID), "invalid reviewer")
    set_ = error.isNull() & (who != "")
    return F.struct(error.alias("error"), F.when(set_, who).alias("assigned_to"), F.when(set_, now).alias("assigned_at"))
