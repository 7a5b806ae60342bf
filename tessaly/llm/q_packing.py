"""op1: every document packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessaly.llm.packing import pack_documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}

# No SQL: tests/llm checks pieces against the tokenizers library and the packing against its rules.
ORACLE_SQL: dict[str, str] = {}
