"""Connected components by alternating large-star and small-star steps; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.shared import few, small, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that links reach.

    Every step points nodes at the smallest neighbour known, so the number of steps grows with the logarithm of the
    longest path. Null ends and self links are ignored; without links the result is empty.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    links = written(links, "links")
    before = _state(links)
    while (rows := before[0]) > 0:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low")), rows).select("at", F.least("at", "low").alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(small(least, 2 * rows), F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(few(large.distinct(), rows), "links")
        low = few(large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low")), rows)
        below = large.join(small(low, rows), F.col("a") == F.col("at")).where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = written(few(below.union(low.select(F.col("at").alias("a"), F.col("low").alias("b"))).distinct(), rows), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
