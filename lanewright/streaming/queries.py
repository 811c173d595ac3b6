"""Registered queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.plans.queries import Corpus, query
from lanewright.sources.shared import shared_folder
from lanewright.sources.tables import table
from lanewright.streaming import ledger


@query("SELECT batch_index, batch_id, seq_count, token_count, real_token_count, step FROM batches")
def t2_streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T6 and T7 too: the stream stops with an error after its second epoch's write and is started again."""
    at = shared_folder(spark)
    Corpus(spark, sf_dir).batches().select("batch_index", "batch_id", "seq_count", "token_count", "real_token_count").repartition(4, "batch_index").write.parquet(f"{at}/batches")

    def crash(epoch: int) -> None:
        if epoch == 1:
            raise ledger.Crash

    try:
        ledger.consume(spark, f"{at}/batches", f"{at}/ledger", f"{at}/state", crash).awaitTermination()
    except Exception as error:
        if "Crash" not in str(error):
            raise
    ledger.consume(spark, f"{at}/batches", f"{at}/ledger", f"{at}/state").awaitTermination()
    return ledger.read_ledger(spark, f"{at}/ledger").drop("epoch")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t11_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra outside the data path: tumbling event-time windows with a watermark, run as a stream over the events table."""
    at = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{at}/events")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{at}/events")
    totals = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(df: DataFrame, epoch: int) -> None:
        df.select(F.col("window.start").alias("hour"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{at}/out")

    totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
