"""Sinks that a rerun doesn't change: each batch or run owns a partition and replaces it as a whole.

What other batches have written is anti-joined before, so a key is written by the first batch that brings it. Two runs at
the same time may both bring a key; readers take the row of the smallest batch, so they still see one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.operators.rows import first_per_key
from tessaly.sources.stored import shared_folder


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has been written under path, with its batch; empty where nothing has."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(path)


def write_batch(rows: DataFrame, path: str, batch: int, keys: list[str], order: list[Column], schema: str) -> None:
    """The first row of each key that no other batch has written, as the batch's own partition. Doing it again with the
    same rows gives the same partition."""
    spark = rows.sparkSession
    others = batches(spark, path, schema).where(F.col("batch") != batch).select(*keys)
    new = first_per_key(rows.select(*[c.strip().split(" ")[0] for c in schema.split(",")]), keys, order)
    new.join(others, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def written_rows(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """One row for each key, of the smallest batch that has it."""
    return first_per_key(batches(spark, path, schema), keys, [F.col("batch").asc()])


def ingest(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str | None = None) -> None:
    """Insert-ignore of a stream into path, to the end of its input. A batch that is run again after a failure replaces
    its own partition; another stream over the same rows adds none."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    place = checkpoint or f"{shared_folder(stream.sparkSession)}/ingest-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, path, batch, keys, order, schema)).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """A history's rows of one run: a rerun replaces them, other runs stay."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def verified(rows: DataFrame, content: str, digest: str) -> DataFrame:
    """rows with intact: whether what was read back still has the checksum that names it."""
    return rows.withColumn("intact", F.sha2(F.col(content).cast("binary"), 256) == F.col(digest))
