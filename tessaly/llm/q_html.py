"""op8: the visible text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.html_text import extract


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_text": op8_html_text}

# No SQL: tests/llm holds the rendering against written examples and a word-by-word check on whole pages.
ORACLE_SQL: dict[str, str] = {}
