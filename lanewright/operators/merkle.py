"""Hash trees over batches: two long runs are compared at the top, and only below what differs.

Level 0 has a hash for each batch index, level k + 1 one for each FAN neighbours of level k, over their numbers and hashes, so a
batch that is missing or added changes every hash above it. Levels are folders: a comparison reads the top ones and, of those
below, joins only children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.sources.shared import materialised

FAN = 16


def write_tree(leaves: DataFrame, path: str) -> None:
    """Writes the tree of rows of node (a batch index from 0) and hash under `path`, a folder a level."""
    spark = leaves.sparkSession
    leaves.select(F.col("node").cast("long").alias("node"), "hash").write.mode("overwrite").parquet(f"{path}/level=0")
    level = 0
    while spark.read.parquet(f"{path}/level={level}").where(F.col("node") >= (FAN if level == 0 else 1)).limit(1).count():
        below = spark.read.parquet(f"{path}/level={level}")
        child = F.struct("node", F.concat_ws(":", "node", "hash").alias("x"))  # at most FAN of a node
        up = below.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda y: y["x"]), "\n"), 256).alias("hash"))
        level += 1
        up.withColumnRenamed("up", "node").write.mode("overwrite").parquet(f"{path}/level={level}")


def height(spark: SparkSession, path: str) -> int:
    """The number of the top level."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return max(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(p) if x.getPath().getName().startswith("level="))


def differences(spark: SparkSession, stored: str, again: str) -> tuple[DataFrame, list[int]]:
    """node, stored_hash, again_hash of the leaves of two written trees that differ, and how many nodes were compared on each level."""
    level = min(height(spark, stored), height(spark, again))
    suspects, visited = None, []
    while True:
        a, b = (spark.read.parquet(f"{path}/level={level}") for path in (stored, again))
        if suspects is not None:
            a, b = (x.withColumn("up", F.floor(F.col("node") / FAN)).join(suspects.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for x in (a, b))
        both = materialised(a.select("node", F.col("hash").alias("stored_hash")).join(b.select("node", F.col("hash").alias("again_hash")), "node", "full_outer"))
        visited.append(both.count())
        suspects = both.where("not (stored_hash <=> again_hash)")
        if level == 0:
            return suspects, visited
        level -= 1
