"""op12: fingerprints of every document and of its edited text, their likeness, and the documents within the radius of
every document whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.shared import written
from tessaly.llm.simhash import compared_documents, counted_within


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(compared_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "compared")
    return counted_within(found, F.col("doc_id") % 100 == 0)


QUERIES = {"op12_simhash": op12_simhash}

# Hashes and votes aren't SQL; tests/llm holds fingerprints, edits and the search against brute force.
ORACLE_SQL: dict[str, str] = {}
