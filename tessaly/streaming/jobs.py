"""Structured Streaming twins of the periodic jobs.

Each takes a streaming frame and returns one; `drain` runs it over what is there (availableNow) into Parquet, which is
how the tests and queries hold a stream against its batch twin.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, files_a_trigger: int = 4) -> DataFrame:
    """A file stream over a Parquet folder or file, with the schema of the files there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into the folder for checkpoints and read the result."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessaly-stream-")
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def deduplicated(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark before them."""
    return stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", within).dropDuplicatesWithinWatermark(keys).drop("_at")


def window_counts(stream: DataFrame, time: str, by: str, size: str, late: str) -> DataFrame:
    """Counts by tumbling window and key, each emitted once the watermark has passed it."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    n = at.groupBy(F.window("_at", size), by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("window_start"), by, "n")


def changes_of_value(stream: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """key, at, previous, current whenever a key's value differs from its last one; the last value is the state."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, tie])
        out = []
        for at, now in zip(rows[time], rows[value]):
            if last is not None and now != last:
                out.append((group[0], at, last, now))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "at", "previous", "current"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.select(key, time, tie, value).groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, at {kinds[time]}, previous string, current string", "last string", "append", GroupStateTimeout.NoTimeout
    )
