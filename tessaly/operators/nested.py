"""Nested results and the semi-structured side: trees, flattened JSON, key checks, content windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.sources.stored import stored

# Keys of a provenance record.
PROVENANCE_KEYS = [
    "sourceUrl", "geographicLevel", "sourceTier", "scrapeTimestamp", "contentHash", "sourceSentence", "characterOffsets", "extractionModel",
    "extractionConfidence", "validationModel", "validationConfidence", "crossCheckResult", "methodologyVersion",
]
APPROVED_KEYS = ["reviewedBy", "reviewedAt", "reviewDecision"]
NULLABLE_KEYS = {"sourceTier"}


def tree(df: DataFrame, top: list[str], middle: list[str], leaf: list[str]) -> DataFrame:
    """top columns and children, an ordered array of middle columns with their own ordered array of leaf columns."""
    inner = df.groupBy(*top, *middle).agg(F.array_sort(F.collect_list(F.struct(*leaf))).alias("children"))
    return inner.groupBy(*top).agg(F.array_sort(F.collect_list(F.struct(*middle, "children"))).alias("children"))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once for a row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _lacking(found: Column, keys: list[str], nullable: set[str] = frozenset(NULLABLE_KEYS)) -> Column:
    there = lambda k: F.map_contains_key(found, k) if k in nullable else F.try_element_at(found, F.lit(k)).isNotNull()
    return F.array_compact(F.array(*[F.when(~F.coalesce(there(k), F.lit(False)), F.lit(k)) for k in keys]))


def missing_keys(record: Column, keys: list[str], nullable: set[str] = frozenset(NULLABLE_KEYS)) -> Column:
    """The keys that a JSON object lacks, in the given order; null counts as lacking unless the key may be null."""
    return _once(F.from_json(record, "map<string,string>"), lambda found: _lacking(found, keys, nullable))


def _kind(value: Column, path: str) -> Column:
    """The kind of what a parsed JSON text has at path: object, array, number, string, boolean, null, or null where
    nothing is."""

    def of(schema: Column) -> Column:
        number = schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL")
        return F.when(schema == "VOID", "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(number, "number").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")

    return _once(F.schema_of_variant(F.try_variant_get(value, path, "variant")), of)


def _read(record: Column, paths: dict[str, str], use) -> Column:
    """use(found, kinds) of a JSON text that is parsed once: its map of keys to texts, and a struct with the kind at each
    path."""
    kinds = lambda v: F.struct(*[_kind(v, path).alias(name) for name, path in paths.items()])
    read = F.struct(F.from_json(record, "map<string,string>").alias("found"), _once(F.try_parse_json(record), kinds).alias("kinds"))
    return _once(read, lambda r: use(r["found"], r["kinds"]))


def provenance_issues(record: Column, status: Column) -> Column:
    """What a provenance record lacks: keys, reviewer keys once it is approved, then the shapes of offsets and tier. A
    text that isn't a JSON object has the one issue not_an_object."""

    def issues(found: Column, kind: Column) -> Column:
        offsets, tier = kind["offsets"], kind["tier"]
        numbers = (offsets == "object") & (kind["start"] == "number") & (kind["end"] == "number")
        bad_offsets = offsets.isNotNull() & (offsets != "null") & ~F.coalesce(numbers, F.lit(False))
        bad_tier = tier.isNotNull() & ~tier.isin("null", "number")
        shapes = F.array_compact(F.array(F.when(bad_offsets, "shape:characterOffsets"), F.when(bad_tier, "shape:sourceTier")))
        lacking = F.concat(_lacking(found, PROVENANCE_KEYS), F.when(status == "approved", _lacking(found, APPROVED_KEYS)).otherwise(F.array().cast("array<string>")), shapes)
        return F.when(kind["record"] == "object", lacking).otherwise(F.array(F.lit("not_an_object")))

    return _read(record, {"record": "$", "offsets": "$.characterOffsets", "start": "$.characterOffsets.start", "end": "$.characterOffsets.end", "tier": "$.sourceTier"}, issues)


# Keys of a provenance record as the web pages read it.
SHOWN_KEYS = [
    "sourceUrl", "geographicLevel", "sourceTier", "scrapedAt", "contentHash", "sourceSentence", "charOffsets", "extractionModel",
    "extractionConfidence", "validationModel", "validationConfidence", "crossCheckResult", "methodologyVersion",
]
SHOWN_REVIEW_KEYS = ["reviewer", "reviewedAt", "reviewerNotes"]


def shown_provenance(record: Column, status: Column) -> Column:
    """struct(ok, missing): the keys that a record for the pages lacks, reviewer keys only once it is approved; charOffsets
    also lacks if it isn't a pair of numbers. Without an object or array all core keys lack."""

    def lacking(found: Column, kind: Column) -> Column:
        review = F.when(status == "approved", _lacking(found, SHOWN_REVIEW_KEYS)).otherwise(F.array().cast("array<string>"))
        offsets = kind["offsets"]
        pair = (offsets == "array") & (kind["first"] == "number") & (kind["second"] == "number") & (F.json_array_length(F.get_json_object(record, "$.charOffsets")) == 2)
        bad = offsets.isNotNull() & (offsets != "null") & ~F.coalesce(pair, F.lit(False))
        missing = F.array_distinct(F.concat(_lacking(found, SHOWN_KEYS), review, F.when(bad, F.array(F.lit("charOffsets"))).otherwise(F.array().cast("array<string>"))))
        return F.when(kind["record"].isin("object", "array"), missing).otherwise(F.array(*map(F.lit, SHOWN_KEYS)))

    missing = _read(record, {"record": "$", "offsets": "$.charOffsets", "first": "$.charOffsets[0]", "second": "$.charOffsets[1]"}, lacking)
    return _once(missing, lambda m: F.struct((F.size(m) == 0).alias("ok"), m.alias("missing")))


def flattened(df: DataFrame, key: str, record: str) -> DataFrame:
    """key, path and value for each scalar of a JSON column, level by level until no object is left; arrays stay as JSON
    text, a null value is kept, an empty object gives nothing, and so does what isn't JSON. There are as many jobs as the
    deepest record has levels, and each explodes what the one before has left."""
    value = F.col("_v")
    inside = F.try_variant_get(value, "$", "map<string,variant>")
    level = df.select(key, F.lit(None).cast("string").alias("path"), F.try_parse_json(record).alias("_v")).where("_v IS NOT NULL")
    done = None
    while True:
        level = stored(level.withColumn("_object", inside.isNotNull()), "level")
        text = F.when(F.is_variant_null(value), None).otherwise(F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.to_json(value)))
        leaves = level.where("NOT _object").select(key, F.coalesce("path", F.lit("")).alias("path"), text.alias("value"))
        done = leaves if done is None else done.union(leaves)
        level = level.where("_object").select(key, "path", F.explode(inside).alias("_k", "_v")).select(key, F.concat_ws(".", "path", "_k").alias("path"), "_v")
        if level.isEmpty():
            return done


#: Between parts of a window, and its sizes in characters.
GAP = "\n[...]\n"
CHUNK, STRIDE, HEAD, TAIL = 2000, 1800, 1500, 800


def _whole_words(text: Column, terms: Column) -> Column:
    """How often the terms stand in text as whole words, all terms together."""
    pattern = lambda t: F.concat(F.lit(r"(?<![A-Za-z0-9_])"), F.regexp_replace(t, r"([^A-Za-z0-9_ ])", r"\\$1"), F.lit(r"(?![A-Za-z0-9_])"))
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.regexp_count(text, pattern(t)))


def pattern_matches(text: Column, terms: Column) -> Column:
    """How often the terms, read as regular expressions, stand in text between its words; every other character is set
    apart by blanks first, so a term is met by one word or sign."""
    apart = F.concat(F.lit(" "), F.regexp_replace(text, "([^A-Za-z0-9_])", r" $1 "), F.lit(" "))
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.regexp_count(apart, F.concat(F.lit("(?d) "), t, F.lit(" "))))


def content_windows(df: DataFrame, key: str, content: str, terms: str, most: int, matches: Callable[[Column, Column], Column] = _whole_words) -> DataFrame:
    """key, chunks (the numbers of those taken, null for a text that isn't cut) and window: at most most characters of a
    text. A longer one is cut into chunks; those that touch its first HEAD and last TAIL characters are taken, then those
    with most whole-word terms (an array of lower-cased words or phrases in the row), the first ones first, while they
    fit; one that doesn't fit is passed over. A chunk costs what it adds: neighbours share their overlap and have no gap
    between. Chunks without terms aren't taken; without any term given, the text's beginning is the window. matches says
    how often the terms stand in a lower-cased chunk: as they are written, or by pattern_matches."""
    text, size = F.coalesce(F.col(content), F.lit("")), F.char_length(F.coalesce(F.col(content), F.lit("")))
    rows = df.select(key, text.alias("_text"), size.alias("_size"), F.coalesce(F.col(terms), F.array().cast("array<string>")).alias("_terms"))
    n = F.greatest(F.lit(0), F.ceil((F.col("_size") - CHUNK) / STRIDE)).cast("int")
    cut = (F.col("_size") > most) & (F.size("_terms") > 0)
    end = lambda i: F.least(i * STRIDE + CHUNK, F.col("_size"))
    piece = lambda i: F.substring(F.col("_text"), i * STRIDE + 1, end(i) - i * STRIDE)
    base = lambda i: (i * STRIDE < HEAD) | (end(i) > F.col("_size") - TAIL)
    every = F.sequence(F.lit(0), n)
    rows = rows.withColumn("_base", F.when(cut, F.filter(every, base)))
    scored = F.transform(F.filter(every, lambda i: ~base(i)), lambda i: F.struct((-matches(F.lower(piece(i)), F.col("_terms"))).alias("less"), i.alias("i")))
    rows = rows.withColumn("_ranked", F.when(cut, F.array_sort(F.filter(scored, lambda x: x["less"] < 0))))

    def cost(chosen: Column, i: Column) -> Column:
        """What chunk i adds to the window of the chosen ones."""
        left, right = F.array_contains(chosen, i - 1), F.array_contains(chosen, i + 1)
        own = end(i) - i * STRIDE + len(GAP)
        return own - F.when(left, end(i - 1) - i * STRIDE + len(GAP)).otherwise(0) - F.when(right, end(i) - (i + 1) * STRIDE + len(GAP)).otherwise(0)

    def take(state: Column, i: Column) -> Column:
        return F.struct((state["total"] + cost(state["chosen"], i)).alias("total"), F.array_append(state["chosen"], i).alias("chosen"))

    empty = F.struct(F.lit(-len(GAP)).alias("total"), F.array().cast("array<int>").alias("chosen"))
    rows = rows.withColumn("_state", F.aggregate("_base", empty, take))
    filled = F.aggregate("_ranked", F.col("_state"), lambda s, x: F.when(s["total"] + cost(s["chosen"], x["i"]) <= most, take(s, x["i"])).otherwise(s))
    rows = rows.withColumn("chunks", F.array_sort(filled["chosen"]))
    parts = F.transform("chunks", lambda i, k: F.when(F.array_contains("chunks", i - 1), F.substring(F.col("_text"), end(i - 1) + 1, end(i) - end(i - 1))).otherwise(F.concat(F.when(k > 0, GAP).otherwise(""), piece(i))))
    window = F.when(F.col("_size") <= most, F.col("_text")).when(F.size("_terms") == 0, F.substring("_text", 1, most)).otherwise(F.substring(F.array_join(parts, ""), 1, most))
    return rows.select(key, "chunks", window.alias("window"))
