"""op7: the language of every document, learnt from three quarters of the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.langid import held_out, predict, train


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}

# No SQL: tests/llm holds the predictions against a floor of held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
