"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path``: it fits its host and every subdomain when the url's path starts with the rule's path
(``*`` in the path stands for any characters). Each rule is filed under one literal token that every matching url must
hold, the one that fewest urls hold; a url fetches candidate rules by its own tokens, and only those run their regular
expression. The longest fitting rule decides.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default verdict; repeated urls
are judged once and every row gets the verdict; of fitting rules of equal length an allow rule wins, then the smaller
rule string; a rule without any literal token is tried on every url; null rules are ignored; with an empty rule table
every url gets the default verdict; a url of any length is judged whole. Other columns of the input stay, but for those
named like an output (host, path, rule, verdict), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """The literal tokens of a url: host labels as ``h:label``, alphanumeric runs of the path as ``p:run``, and ``*``."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    runs = F.transform(F.regexp_extract_all(path, F.lit("([0-9A-Za-z]+)"), 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, runs, F.array(F.lit("*"))))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^0-9A-Za-z/_-])", r"\\$1")


def compiled_rules(rules: DataFrame) -> DataFrame:
    """rules (rule, verdict) with their regular expression over host||path and the literal tokens a match must hold."""
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    body = F.regexp_replace(_quoted(path), r"\\\*", "(?s:.*)")
    regex = F.concat(
        F.lit(r"\A"),
        F.when(host == "", F.lit(r"[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), _quoted(host))),
        F.when(path == "", F.lit(r"(?=/|\z)")).otherwise(body),
    )
    # a run that the pattern may continue (at its end, or beside a *) isn't a whole token of the url
    whole = F.regexp_replace(path, r"[0-9A-Za-z]*\*[0-9A-Za-z]*|[0-9A-Za-z]+\z", "/")
    literal = F.filter(_tokens(host, whole), lambda t: t != "*")
    return (
        rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .select("rule", "verdict")
        .distinct()
        .select("rule", "verdict", regex.alias("regex"), F.when(F.size(literal) == 0, F.array(F.lit("*"))).otherwise(literal).alias("tokens"))
    )


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Each compiled rule under its rarest literal token; url_tokens (token) holds a row for each url and token."""
    held = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = url_tokens.join(held, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    rarest = F.min_by("token", F.struct("n_urls", "token")).alias("token")
    return (
        rules.withColumn("token", F.explode("tokens"))
        .join(counts, "token", "left")
        .withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
        .groupBy("rule", "verdict", "regex")
        .agg(rarest)
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages with the columns host, path, rule and verdict; columns of those names in pages are replaced."""
    compiled = compiled_rules(rules)
    plain = pages.drop("host", "path", "rule", "verdict")
    parsed = plain.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    # A verdict hangs on host and path only, so each pair is judged once, however often it comes.
    distinct = parsed.select("host", "path").where(F.col("host") != "").distinct()
    tokens = distinct.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    index = rule_index(compiled, tokens.select("token"))
    fitting = tokens.join(index, "token").where(F.expr("rlike(host || path, regex)"))
    better = F.struct(F.length("rule").alias("longest"), (F.col("verdict") == "allow").alias("allows"), F.expr("transform(split(rule, ''), c -> -ascii(c))").alias("smaller"))
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), better).alias("_best"))
    return parsed.join(best, ["host", "path"], "left").select(
        *[parsed[c] for c in plain.columns],
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )
