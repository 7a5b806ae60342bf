"""Tables that are written once in the middle of a job: later steps read what was written, whatever executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay below this in a hashed relation.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a local master (tests), an own folder, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessaly-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df (a stored table) marked for broadcast if its counted rows, of row_bytes beside the row's head, fit."""
    return F.broadcast(df) if df.count() * (64 + row_bytes) <= BROADCAST_BYTES else df
