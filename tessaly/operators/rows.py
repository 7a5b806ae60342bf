"""Row selection: latest and best per key, series, filters, order, pages, sets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.operators.places import ranked


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order. Spark keeps one row of a key before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def latest_series(df: DataFrame, key: str, time: str, tie: str, value: str, n: int) -> DataFrame:
    """key and series: the n newest values, oldest first."""
    newest = top_per_key(df, [key], [F.col(time).desc(), F.col(tie).desc()], n)
    points = F.array_sort(F.collect_list(F.struct(time, tie, value)))
    return newest.groupBy(key).agg(F.transform(points, lambda p: p[value]).alias("series"))


@dataclass
class Filters:
    """An AND of optional conditions; empty lists and nulls don't filter."""

    lists: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    present: list[str] = field(default_factory=list)

    def column(self) -> Column:
        parts = [F.col(c).isin(v) for c, v in self.lists.items() if v]
        for c, (low, high) in self.ranges.items():
            parts += [F.col(c) >= low] if low is not None else []
            parts += [F.col(c) <= high] if high is not None else []
        parts += [F.col(c).isNotNull() for c in self.present]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


SORTS = ("composite", "paq", "cme", "coverage", "name", "country")


def filters_from_params(params: dict[str, str], columns: dict[str, str], low: float = 0, high: float = 100) -> tuple[Filters, str, bool]:
    """Filters, sort field and whether descending, from the text parameters of a request: comma lists, numbers clamped
    to low..high, an unknown sort is composite, any direction but asc is descending. columns: parameter -> column."""

    def number(name: str) -> float | None:
        try:
            return min(high, max(low, float(params[name])))
        except (KeyError, ValueError):
            return None

    lists = {c: [x.strip() for x in params.get(p, "").split(",") if x.strip()] for p, c in columns.items()}
    sort = params.get("sort", "")
    return Filters(lists, {"composite": (number("min"), number("max"))}), sort if sort in SORTS else "composite", params.get("dir") != "asc"


def ordered(df: DataFrame, sort: str, descending: bool, name: str, scored: str = "composite", relevance: str | None = None) -> DataFrame:
    """Nulls last in both directions, unscored rows last under text sorts, the name as tie-break."""
    key = F.col(relevance or sort)
    first = [F.col(scored).isNull().asc()] if sort in ("name", "country") and not relevance else []
    return df.orderBy(*first, key.desc_nulls_last() if descending or relevance else key.asc_nulls_last(), F.col(name).asc())


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of an ordered frame, and the frame's row count."""
    return df.offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def left_with_zero(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left with the number of right rows for its key, 0 for none."""
    n = right.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    return left.join(n, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def rank_positions(df: DataFrame, value: str, tie: str, place: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Positions 1..n by descending value without gaps or ties, within each of the given keys, whatever their size."""
    return ranked(df, [F.col(value).desc(), F.col(tie).asc()], place, within)


def until_confident(df: DataFrame, key: str, order: str, confidence: str, enough: float) -> DataFrame:
    """The rows of a key up to and including the first that is confident enough; all, if none is."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(confidence).over(before)).where(F.col("_best").isNull() | (F.col("_best") < enough)).drop("_best")


def superseded(df: DataFrame, key: str, time: str, ident: str) -> DataFrame:
    """df with is_published (the newest of its key) and superseded_by (the next newer one's id)."""
    w = Window.partitionBy(key).orderBy(F.col(time), F.col(ident))
    return df.withColumn("superseded_by", F.lead(ident).over(w)).withColumn("is_published", F.col("superseded_by").isNull())
