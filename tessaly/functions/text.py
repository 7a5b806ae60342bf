"""Text, URL and time rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rules below look for.
SOFT_404 = [
    r"(?is)\b404\b.*\bnot found\b",
    r"(?i)\bpage (not|cannot be) found\b",
    r"(?i)\bcan't find (the )?page\b",
    r"(?i)\bthis page (doesn't|does not) exist\b",
]
CHALLENGE_MARKERS = [
    "performing security verification",
    "you have been blocked",
    "unable to access",
    "checking your browser before",
    "attention required | cloudflare",
    "ray id:",
    "please enable javascript and cookies",
    "access denied",
    "just a moment...",
    "enable javascript to continue",
    "one more step",
    "verify you are human",
]
STOP_WORDS = ["and", "or", "the", "a", "an", "of", "for", "in", "on", "to", "by", "as", "at", "with", "from", "vs", "per", "no", "not"]
# The patterns of each severity, strongest first.
NEWS_SEVERITIES = [
    ("breaking", r"\b(suspend|abolish|repeal|terminat|shut down|closes?)\b"),
    ("material", r"\b(announce|launch|expand|cap|quota|cut|raise|introduc)\b"),
    ("minor", r"\b(extend|renew|update|revise|amend)\b"),
]
TRACKING = "utm_[^=&]*|gclid|fbclid|mc_cid|mc_eid"
CURRENCIES = [
    ("AUD", "AUD|A\\$"), ("SGD", "SGD|S\\$"), ("HKD", "HKD|HK\\$"), ("NZD", "NZD|NZ\\$"), ("CAD", "CAD|C\\$"), ("USD", "USD|US\\$"), ("EUR", "EUR|€"), ("GBP", "GBP|£"), ("JPY", "JPY|¥"), ("INR", "INR|₹"),
    ("AED", "AED"), ("SAR", "SAR"), ("QAR", "QAR"), ("MYR", "MYR|RM"), ("THB", "THB|฿"), ("CHF", "CHF"), ("SEK", "SEK"), ("DKK", "DKK"), ("NOK", "NOK"),
]
DOLLARS = {"AUS": "AUD", "CAN": "CAD", "NZL": "NZD", "SGP": "SGD", "HKG": "HKD", "USA": "USD"}
MIN_VISIBLE, HEAD_CHARS, WINDOW_CHARS = 1500, 2048, 30000


def visible_length(text: Column) -> Column:
    """Characters left after images, links, marks and repeated white space of a markdown text."""
    plain = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    plain = F.regexp_replace(plain, r"\[[^\]]*\]\([^)]*\)", "")
    plain = F.regexp_replace(plain, r"[#*`_>|-]+", " ")
    return F.length(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def scrape_status(text: Column, http_status: Column) -> Column:
    """http_error, soft_404, short_content or ok, in this order."""
    head = F.substring(text, 1, HEAD_CHARS)
    soft = F.lit(False)
    for pattern in SOFT_404:
        soft = soft | head.rlike(pattern)
    return F.when(http_status >= 400, "http_error").when(soft, "soft_404").when(visible_length(text) < MIN_VISIBLE, "short_content").otherwise("ok")


def is_challenge(text: Column) -> Column:
    marks = F.array(*[F.lit(m) for m in CHALLENGE_MARKERS])
    return F.coalesce((F.length(F.trim(text)) < 2000) & F.exists(marks, lambda m: F.contains(F.lower(text), m)), F.lit(False))


def usable(text: Column, is_pdf: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= F.when(is_pdf, 100).otherwise(300), F.lit(False))


def first_usable(layers: list[Column], is_pdf: Column) -> Column:
    """The first layer of a scrape that is usable and no challenge page."""
    return F.coalesce(*[F.when(usable(x, is_pdf) & ~is_challenge(x), x) for x in layers])


def link_status(code: Column, length: Column, failure: Column) -> Column:
    return (
        F.when(failure.isNotNull(), F.upper(failure))
        .when(code.isin(404, 410), "GONE")
        .when(code >= 500, "ERROR_5xx")
        .when(code >= 400, "ERROR_4xx")
        .when(code >= 300, "REDIRECT")
        .when(length < MIN_VISIBLE, "SOFT_404")
        .otherwise("LIVE")
    )


def keywords(label: Column, most: int = 4) -> Column:
    words = F.split(F.lower(label), r"[\s/(),\-–]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))), 1, most)


def _whole_word(text: Column, words: Column) -> Column:
    """Any of the words in the text between ASCII word borders."""
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([^0-9A-Za-z_])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![A-Za-z0-9_])"))
    return F.when(F.size(words) > 0, F.regexp_like(text, pattern)).otherwise(False)


def gap_class(words: Column, text: Column, truncated: Column) -> Column:
    """Why a value is missing: no page, keyword only beyond the window, keyword seen, or absent."""
    head = _whole_word(F.substring(text, 1, WINDOW_CHARS), words)
    tail = truncated & _whole_word(F.substring(text, F.lit(WINDOW_CHARS + 1), F.length(text)), words)
    return F.when(text.isNull(), "URL_MISSING").when(F.size(words) == 0, "ABSENT").when(tail & ~head, "TRUNCATION").when(head, "LLM_MISS").otherwise("ABSENT")


def news_severity(text: Column) -> Column:
    """The first class with a whole-word match; stems only match as whole words."""
    out = F.lit("unknown")
    for name, pattern in reversed(NEWS_SEVERITIES):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def mostly_foreign(text: Column, least: int = 200, share: float = 0.5) -> Column:
    foreign = F.length(F.regexp_replace(text, r"[\t\n\r\x20-\x7e]", ""))
    return F.coalesce((F.length(text) >= least) & (foreign / F.length(text) > share), F.lit(False))


def unfenced_json(text: Column) -> Column:
    """What a code fence holds, else the widest span of braces, else the trimmed text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text), r"\A\s+|\s+\z", "")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("::", *parts), 256)


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, default ports and tracking parameters dropped, no slash at the path's end; what
    isn't a URL is trimmed."""
    part = lambda i: F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(#\S*)?\s*$", i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), r"/$", "")).otherwise(part(3)))
    query = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)")), "&")
    return F.when(part(1) == "", F.trim(url)).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), part(5)))


def hostname(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def shown_domain(url: Column) -> Column:
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    return F.when(F.length(host) > 32, F.concat(F.substring(host, 1, 31), F.lit("…"))).otherwise(host)


def currency(raw: Column, country: Column) -> Column:
    """struct(code, amount): the currency that a raw text begins with, and the rest; null where none is known."""
    text = F.trim(raw)
    out = F.lit(None).cast("struct<code:string,amount:string>")
    local = F.try_element_at(F.create_map(*[F.lit(x) for kv in DOLLARS.items() for x in kv]), country)
    out = F.when(text.startswith("$") & local.isNotNull(), F.struct(local.alias("code"), F.regexp_replace(text, r"^\$\s*", "").alias("amount"))).otherwise(out)
    for code, names in reversed(CURRENCIES):
        out = F.when(text.rlike(rf"(?i)^(?:{names})"), F.struct(F.lit(code).alias("code"), F.regexp_replace(text, rf"(?i)^(?:{names})\s*", "").alias("amount"))).otherwise(out)
    return out


def to_usd(amount: Column, code: Column, rate: Column) -> Column:
    """rate: units of the currency for one dollar."""
    return F.when(code == "USD", amount).otherwise(amount / F.nullif(rate, F.lit(0.0)))


def hash_tag(text: Column) -> Column:
    """RV- and the last six hexadecimal digits of a 32-bit FNV-1a whose factors are signed and whose products are rounded
    as doubles; RV-000000 for an empty or null text."""
    start = F.lit(2166136261).cast("bigint")

    def step(h: Column, c: Column) -> Column:
        mixed = h.bitwiseXOR(F.ascii(c).cast("bigint"))
        mixed = F.when(mixed >= 2**31, mixed - 2**32).otherwise(mixed)
        return F.pmod((mixed.cast("double") * F.lit(16777619.0)).cast("bigint"), F.lit(4294967296))

    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return F.when(F.coalesce(text, F.lit("")) == "", "RV-000000").otherwise(F.concat(F.lit("RV-"), F.lpad(F.hex(F.pmod(h, F.lit(1 << 24))), 6, "0")))


NONE_TEXT = "—"


def score_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise(NONE_TEXT)


def rank_text(rank: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), rank.cast("string")), F.lit(NONE_TEXT))


def day_text(stamp: Column) -> Column:
    """The first ten characters of an ISO time."""
    return F.coalesce(F.nullif(F.substring(stamp, 1, 10), F.lit("")), F.lit(NONE_TEXT))


def archive_path(country: Column, program: Column, time: Column, content: Column, kind: Column) -> Column:
    return F.concat_ws("/", country, program, F.date_format(time, "yyyy-MM-dd"), F.concat(F.sha2(content, 256), F.lit("."), kind))
