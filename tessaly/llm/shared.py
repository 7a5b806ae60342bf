"""Places and sizes that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows, at what a row takes in a hashed relation, stay below this. The
#: driver holds a relation several times over while it is built, and what a larger bound saves is a shuffle of narrow rows.
BROADCAST_BYTES = 16 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), an own one, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessaly-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files that the given tables are read from: tables of written() whose readers have all been written
    themselves. What isn't forgotten stays until the folder is cleared by its owner."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of texts that a Python worker is handed at once.
TEXT_ROWS = 200


def bound_batches(spark: SparkSession) -> None:
    """Hand Python workers TEXT_ROWS rows at a time in this session, unless it says less: with texts of some kilobytes the
    default of fifty times as many fills the memory of a worker and the JVM's buffers beside it, which aren't given back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def fits_broadcast(df: DataFrame, rows: int, more_bytes: int = 0) -> bool:
    """Whether counted rows of df stay below the bound as a hashed relation. A row takes 8 bytes of head and 8 a column,
    its place in the hash table up to 40; more_bytes: of texts and arrays in a row."""
    return rows * (48 + 8 * len(df.columns) + more_bytes) <= BROADCAST_BYTES


#: Rows of a narrow table that one task takes.
TASK_ROWS = 250_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in about as many tasks as its counted rows are worth, where the session has more shuffle partitions than that."""
    return df.coalesce(max(8, rows // TASK_ROWS))


def small(df: DataFrame, rows: int, more_bytes: int = 0) -> DataFrame:
    """df marked for broadcast if its counted rows fit; else as it is, and Spark shuffles."""
    return F.broadcast(df) if fits_broadcast(df, rows, more_bytes) else df
