"""The consumption ledger from keyed state: a repeated batch is known from a state store, not by reading the ledger again.

Batches are keyed by blocks of their index. A block keeps a map of the batch ids it has consumed (which may expire after a time to
live) and a value with its totals; both live in RocksDB stores, are written with each epoch's checkpoint and restored from there.
An epoch overwrites its own folder of the ledger, so a crash between write and commit repeats the epoch from the state before it
and gives the same rows.

With a time to live the query looks for expired ids for ever, so it runs until it is stopped; without one it ends when all files
are read.

Defined cases: the first of equal ids in a block stays, by step order within an epoch; a null id counts as the empty one and a null
index is a block of its own; an epoch without new batches writes an empty folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lanewright.streaming.ledger import SCHEMA

#: Batch indices of a block.
WIDTH = 256
OUT = f"{SCHEMA}, step long, block long, block_batches long, block_tokens long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LedgerKeeper(StatefulProcessor):
    """Passes each batch of a block once, with the block's totals after it."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "batch_id string", "step long", self.ttl_ms)
        self.totals = handle.getValueState("totals", "batches long, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batches, tokens = self.totals.get() or (0, 0)
        got = pd.concat(list(rows), ignore_index=True).sort_values(["batch_index", "batch_id"], kind="stable")  # a block of one epoch
        fresh = []
        for k, (index, id_, n) in enumerate(zip(got["batch_index"], got["batch_id"], got["real_token_count"], strict=True)):
            if self.seen.containsKey((id_,)):
                continue
            step = int(index) if pd.notna(index) else -1
            self.seen.updateValue((id_,), (step,))
            batches, tokens = batches + 1, tokens + (int(n) if pd.notna(n) else 0)
            fresh.append((k, step, batches, tokens))
        if fresh:
            self.totals.update((batches, tokens))
            at, step, total, sum_ = zip(*fresh, strict=True)
            yield got.iloc[list(at)].assign(step=list(step), block_batches=list(total), block_tokens=list(sum_)).astype({"step": "int64"})

    def close(self) -> None:
        pass


def consume(spark: SparkSession, source: str, path: str, checkpoint: str, crash: Callable[[int, str], None] | None = None, files: int = 1, ttl_ms: int | None = None) -> StreamingQuery:
    """Reads batch files as they arrive and appends each batch once to the ledger at `path`; `crash` is called before and after each write."""

    def write(df: DataFrame, epoch: int) -> None:
        if crash:
            crash(epoch, "before")
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if crash:
            crash(epoch, "after")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    block = F.coalesce(F.floor(F.col("batch_index") / WIDTH), F.lit(-1))
    keyed = stream.withColumns({"block": block, "batch_id": F.coalesce("batch_id", F.lit(""))}).groupBy("block")
    kept = keyed.transformWithStateInPandas(LedgerKeeper(ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": "1 second"} if ttl_ms else {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{OUT}, epoch long").option("basePath", path).parquet(path)
