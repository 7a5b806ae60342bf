"""File sources and sinks: CSV with header variants, escaped CSV, histories, archives, public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """The wanted columns, each from the first of its candidate headers that the file has (null where none is).

    Quotes, doubled quotes and line ends inside quotes are kept; headers are compared lower-cased, trimmed and with
    runs of blanks and dashes as underscores.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    normal = {}
    for c in raw.columns:
        normal.setdefault("_".join(c.strip().lower().replace("-", " ").split()), c)
    pick = lambda names: next((F.col(f"`{normal[n]}`") for n in names if n in normal), F.lit(None).cast("string"))
    return raw.select(*[pick(names).alias(out) for out, names in wanted.items()])


def valid_rows(df: DataFrame, iso: str, numbers: list[str]) -> DataFrame:
    """Rows with a three-letter code and finite numbers; the numbers as doubles."""
    typed = df.withColumns({n: F.col(n).try_cast("double") for n in numbers})
    ok = F.col(iso).rlike("^[A-Z]{3}$")
    for n in numbers:
        ok &= F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return typed.where(ok)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose line ends inside values are blanks."""
    flat = [F.regexp_replace(f.name, r"\r\n|\r|\n", " ").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_archive(df: DataFrame, path: str, country: str, time: Column, hash_column: str, archived: DataFrame | None = None) -> None:
    """Content-addressed rows below country and date, so reads prune by both. Of rows with one hash one is written, and
    none whose hash is archived already, so a rerun adds nothing."""
    new = df.dropDuplicates([hash_column])
    if archived is not None:
        new = new.join(archived.select(hash_column).distinct(), hash_column, "left_anti")
    new.withColumn("date", F.to_date(time)).withColumn("country", F.col(country)).write.mode("append").partitionBy("country", "date").parquet(path)


def latest_archived(archive: DataFrame, keys: list[str], time: str, tie: str, place: str = "storage_path") -> DataFrame:
    from tessaly.operators.rows import first_per_key

    return first_per_key(archive.where(F.col(place).isNotNull()), keys, [F.col(time).desc(), F.col(tie).desc()])


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    return df.where(F.col(expires) > as_of)


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A bulk delete as a rewrite."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def public_views(spark: SparkSession, values: DataFrame, changes: DataFrame) -> None:
    """The rows that the public may see, as views whose filters reach the scans."""
    values.where(F.col("status") == "approved").createOrReplaceTempView("public_field_values")
    changes.where("summary_human_approved").createOrReplaceTempView("public_policy_changes")
