"""Registry of the queries over the driver tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaly.plans import documents, feeds, ingest, links, programmes, rankings, reviews, rollups, scoring, streams, texts, upkeep

_MODULES = (rankings, scoring, feeds, links, texts, documents, ingest, rollups, programmes, reviews, streams, upkeep)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
