"""Full-text search over an inverted index of weighted postings.

A posting says how often a term stands in an entity's title and body. A query is a text: sanitised, cut into lexemes,
and all of them must be there. Its rarest term's postings are the candidates; the other terms are looked up for these
alone, so a frequent term's postings are only read where a rarer one leads to them.

Lexemes are lower-cased runs of letters and digits without English stop words. Stems aren't built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.operators.places import ranked
from tessaly.sources.stored import broadcast_if_small, stored

#: What a term counts for in a title and in a body, and how much of a query is read.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
QUERY_CHARS = 200
WORD = r"[\p{L}\p{N}]+"
# The stop words of PostgreSQL's English text search.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when where why how all any both
each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()


def sanitised(text: Column) -> Column:
    """Control characters and runs of white space as one blank, outer ones cut, at most QUERY_CHARS characters; empty
    where no plain letter or digit is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), r"(?U)\s+", " "))
    return F.when(plain.rlike("[A-Za-z0-9]"), F.substring(plain, 1, QUERY_CHARS)).otherwise("")


def lexemes(text: Column) -> Column:
    """The lexemes of a text in their order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """term: the distinct lexemes of all queries."""
    return queries.select(F.explode(lexemes(sanitised(F.col(text)))).alias("term")).distinct()


def inverted_index(df: DataFrame, key: str, title: str, body: str, terms: DataFrame | None = None) -> DataFrame:
    """term, key, n_title, n_body for every lexeme of every row; nulls are empty texts. Written as a table: a search reads
    it several times. With terms (term, distinct), the whole index of these: an index that serves known queries only needs
    no postings of others, and these are neither counted nor shuffled."""
    asked = None if terms is None else broadcast_if_small(stored(terms, "terms"))

    def part(c: str, at: int) -> DataFrame:
        rows = df.select(key, F.explode(lexemes(F.col(c))).alias("term"), F.lit(at).alias("_part"))
        return rows if asked is None else rows.join(asked, "term", "left_semi")

    found = part(title, 0).union(part(body, 1)).groupBy("term", key).agg(F.count_if(F.col("_part") == 0).alias("n_title"), F.count_if(F.col("_part") == 1).alias("n_body"))
    return stored(found, "postings")


def document_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def search(index: DataFrame, queries: DataFrame, key: str, query: str, text: str, counts: DataFrame | None = None) -> DataFrame:
    """query, key, rank for each pair of a query (query, text) and an entity that has all of its lexemes; rank is the
    weighted number of their places. A query without lexemes has no hits. counts: document_counts, if they are kept."""
    terms = queries.select(query, F.explode(F.array_distinct(lexemes(sanitised(F.col(text))))).alias("term"))
    known = terms.join(document_counts(index.join(terms.select("term").distinct(), "term", "left_semi")) if counts is None else counts, "term", "left")
    first = known.groupBy(query).agg(F.min_by("term", F.struct("n_docs", "term")).alias("rarest"), F.count(F.lit(1)).alias("n_terms"), F.count("n_docs").alias("n_known"), F.collect_list("term").alias("terms"))
    first = first.where("n_terms = n_known")  # at most QUERY_CHARS characters of terms a query
    led = first.join(index, F.col("rarest") == F.col("term")).select(query, key, "n_terms", "n_title", "n_body", F.array_except("terms", F.array("rarest")).alias("others"))
    others = led.select(query, key, "n_terms", F.explode("others").alias("term")).join(index, ["term", key]).select(query, key, "n_terms", "n_title", "n_body")
    found = led.select(query, key, "n_terms", "n_title", "n_body").union(others).groupBy(query, key, "n_terms").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_title").alias("n_title"), F.sum("n_body").alias("n_body"))
    return found.where("_n = n_terms").select(query, key, (TITLE_WEIGHT * F.col("n_title") + BODY_WEIGHT * F.col("n_body")).alias("rank"))


def placed_hits(hits: DataFrame, key: str, query: str) -> DataFrame:
    """hits with their place by falling rank, ties to the smaller key."""
    return ranked(hits, [F.col("rank").desc(), F.col(key).asc()], "place", [query])
