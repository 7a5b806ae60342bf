"""The opN_ queries over the driver tables, the pipeline, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessaly.llm import q_bpe, q_chat, q_html, q_jaccard, q_langid, q_licenses, q_packing, q_periodic, q_quality, q_simhash, q_topk, q_url_filter, q_variants

_MODULES = (q_packing, q_url_filter, q_jaccard, q_chat, q_licenses, q_bpe, q_langid, q_html, q_topk, q_quality, q_variants, q_simhash, q_periodic)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
