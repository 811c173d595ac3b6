"""The consumption ledger as a stream: batches arrive as files, every micro-batch is written once under its epoch.

An epoch overwrites its own directory, so a restart after a crash between write and commit repeats the epoch without
repeating rows; rows already in the ledger of earlier epochs are dropped by an anti-join on batch_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "batch_index long, batch_id string, seq_count long, token_count long, real_token_count long"


class Crash(RuntimeError):
    """Raised on purpose by a test's crash hook."""


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{SCHEMA}, step long, epoch long"
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows if before is None else rows.where(F.col("epoch") < before)


def consume(spark: SparkSession, source: str, path: str, checkpoint: str, crash: Callable[[int], None] | None = None, files: int = 1) -> StreamingQuery:
    """Reads batch files as they arrive and appends each batch once to the ledger at `path`."""

    def write(df: DataFrame, epoch: int) -> None:
        known = read_ledger(df.sparkSession, path, before=epoch).select("batch_id")
        rows = df.dropDuplicates(["batch_id"]).join(known, "batch_id", "left_anti")
        rows = rows.withColumn("step", F.col("batch_index")).select(*df.columns, "step")
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if crash:
            crash(epoch)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
