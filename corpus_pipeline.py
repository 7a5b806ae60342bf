"""The corpus pipeline: quality rules, language ID, near duplicates, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results, of all stages: a null text has no words, so the quality rules and language ID reject it and the
near-duplicate stage keeps it; rows with a null id are judged like others, and never as copies; repeated rows are judged
one by one, and of one id one stays after the near-duplicate stage; of equal texts the smallest id stays; texts of any
length are taken whole; an empty table stays empty; columns beside doc_id, text, lang and source pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.jaccard import distinct_documents
from tessaly.llm.langid import language_kept
from tessaly.llm.packing import pack_documents
from tessaly.llm.quality import quality_kept
from tessaly.llm.shared import bound_batches, written

#: The near-duplicate stage: words of an n-gram, and the least Jaccard similarity of a link in percent.
WIDTH = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their host's record rejects go."""
    bound_batches(spark)
    return quality_kept(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or that the model rejects, go."""
    bound_batches(spark)
    return language_kept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays. Copies share four fifths of their
    five-word n-grams; op3's own four words and 85 percent hold for its query only."""
    bound_batches(spark)
    return distinct_documents(docs, percent=PERCENT, width=WIDTH)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents with their sequences."""
    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("packing", packing)]

# Language ID and packing aren't SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
