"""Indicator scores on 0..100 as Columns: every rule is an expression, so a cohort is scored in one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGHER, LOWER = "higher_is_better", "lower_is_better"
NO_LIMIT = ["999", "none", "no_cap", "no_limit"]
TRUE_WORDS, FALSE_WORDS = ["yes", "true", "1"], ["no", "false", "0"]
# The rational approximation 26.2.17 of the normal distribution in Abramowitz and Stegun.
PHI_P = 0.2316419
PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null, which least() and greatest() alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def phi(z: Column) -> Column:
    """The normal distribution function."""
    a = F.abs(z)
    t = 1.0 / (1.0 + PHI_P * a)
    tail = F.lit(0.0)
    for b in reversed(PHI_B):
        tail = (tail + F.lit(b)) * t
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * tail
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def min_max(x: Column, low: Column, high: Column, direction: Column) -> Column:
    """Null where the range is missing or degenerate (error_of() names why)."""
    share = (x - low) / F.nullif(high - low, F.lit(0.0))
    return clamp(100 * F.when(direction == LOWER, 1 - share).otherwise(share))


def z_score(x: Column, mean: Column, stddev: Column, direction: Column) -> Column:
    z = (x - mean) / F.nullif(stddev, F.lit(0.0))
    return clamp(100 * phi(F.when(direction == LOWER, -z).otherwise(z)))


def categorical(value: Column, rubric: Column) -> Column:
    """The rubric's score for a value; null where the rubric doesn't hold it."""
    return F.try_element_at(rubric, value).cast("double")


def boolean(value: Column, direction: Column) -> Column:
    return F.when(value.isNotNull(), F.when(value == (direction != LOWER), 100.0).otherwise(0.0))


def annotated_boolean(value_json: Column, key: Column, direction: Column) -> Column:
    """A boolean below a key of a JSON object."""
    found = F.try_element_at(F.from_json(value_json, "map<string,string>"), key)
    return boolean(F.when(found == "true", True).when(found == "false", False), direction)


def no_limit(raw: Column) -> Column:
    """Whether a raw text stands for 'no limit'."""
    return F.coalesce(F.lower(F.trim(raw)).isin(NO_LIMIT), F.lit(False))


def number_of(raw: Column) -> Column:
    """The number that a raw text begins with, after dropping $, commas, white space and %; else null."""
    plain = F.regexp_replace(raw, r"(?U)[$,\s%]", "")
    return F.regexp_extract(plain, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def truth_of(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def indicator_score(fn: Column, direction: Column, number: Column, text: Column, truth: Column, unlimited: Column, low: Column, high: Column, mean: Column, stddev: Column, rubric: Column, annotated: Column | None = None, regional: Column | None = None) -> Column:
    """Dispatch over the normalisation function; a missing value gives null, 'no limit' 100 or 0. annotated: the boolean
    of an annotated value; regional: the score that the country's region stands in with."""
    return (
        F.when(unlimited & fn.isin("min_max", "z_score"), F.when(direction == LOWER, 0.0).otherwise(100.0))
        .when(fn == "min_max", min_max(number, low, high, direction))
        .when(fn == "z_score", z_score(number, mean, stddev, direction))
        .when(fn == "categorical", categorical(text, rubric))
        .when(fn == "boolean", boolean(truth, direction))
        .when(fn == "boolean_with_annotation", boolean(F.lit(None).cast("boolean") if annotated is None else annotated, direction))
        .when(fn == "country_substitute_regional", F.lit(None).cast("double") if regional is None else regional)
    )


def error_of(fn: Column, number: Column, text: Column, low: Column, high: Column, stddev: Column, rubric: Column) -> Column:
    """Why a present value can't be scored, else null: a cohort isn't stopped by one bad row."""
    return (
        F.when((fn == "min_max") & (low.isNull() | high.isNull()), "missing range")
        .when((fn == "min_max") & (low == high), "degenerate range")
        .when((fn == "z_score") & (stddev.isNull() | (stddev == 0)), "degenerate deviation")
        .when((fn == "categorical") & text.isNotNull() & F.try_element_at(rubric, text).isNull(), "value not in rubric")
        .when(~fn.isin("min_max", "z_score", "categorical", "boolean", "boolean_with_annotation", "country_substitute_regional"), "unknown function")
    )


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding to digits with halves towards plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def rounded(x: Column, digits: int) -> Column:
    """Rounding of the double x * 10**digits, halves away from zero, as SQL engines on doubles do. F.round looks at the
    shortest decimal text of x instead, so 0.5005, whose thousandfold is 500.49999999999994, differs."""
    k = float(10**digits)
    return F.round(x * k, 0) / k


def change_severity(before: Column, after: Column, scoring_changed: Column) -> Column:
    """struct(severity, delta, reason): above 5 points breaking, from 1 material, else minor."""
    delta = after - before
    size = F.abs(delta)
    severity = F.when(~scoring_changed | delta.isNull(), "minor").when(size > 5, "breaking").when(size >= 1, "material").otherwise("minor")
    reason = F.when(~scoring_changed, "no scoring field changed").when(delta.isNull(), "no score on both sides").otherwise(F.concat(F.lit("score moved by "), F.format_string("%.2f", delta)))
    return F.struct(severity.alias("severity"), F.when(scoring_changed, delta).alias("delta"), reason.alias("reason"))
