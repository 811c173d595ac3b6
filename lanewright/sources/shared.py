"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under `spark.checkpoint.dir`; only a local run may leave that unset and gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_lanewright_folder", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = sc._lanewright_folder = tempfile.mkdtemp(prefix="lanewright-")
    return f"{base.rstrip('/')}/lanewright-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table: read several times, computed once, and not lost with an executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
