"""Sources and sinks: Parquet tables, documents by lane and shard, shard files, JSON lines, tolerant reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.plans.params import LANES

#: Shards for documents without a numbered source, and the number of the first (a multiple of the number of lanes).
OTHERS = 8
FIRST_OTHER = 1_200_000

SHARD_FILE = (
    "manifest STRUCT<shard_id STRING, dataset STRING, document_count BIGINT, content_hash STRING, tokenizer_hash STRING, shard_index INT, is_eval BOOLEAN, created_at STRING>, "
    "documents ARRAY<STRUCT<doc_id STRING, dataset STRING, text STRING, meta STRUCT<source STRING, index INT, word_count INT>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(spark: SparkSession) -> DataFrame:
    rows = [(k, *x) for k, x in enumerate(LANES)]
    return spark.createDataFrame(rows, "lane_idx int, lane string, is_eval boolean, target double, floor double")


def laned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, src, lane_idx, lane, is_eval, shard_id: a source is a shard, its number mod 6 the lane.

    Sources without a number, or none at all, share OTHERS shards of the first lane, so that no document is lost.
    """
    docs = table(spark, sf_dir, "documents")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    other = F.conv(F.substring(F.sha2(source, 256), 1, 6), 16, 10).cast("int") % OTHERS * len(LANES) + FIRST_OTHER
    src = F.when(source.rlike("^src[0-9]{1,6}$"), F.substring(source, 4, 6).try_cast("int")).otherwise(other)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", src.alias("src"))
    rows = docs.withColumn("lane_idx", F.pmod("src", F.lit(len(LANES)))).join(F.broadcast(lanes(spark)), "lane_idx")  # 6 rows
    return rows.select("doc_id", "text", "src", "lane_idx", "lane", "is_eval", F.format_string("%s_shard_%03d", "lane", "src").alias("shard_id"))


def write_shards(docs: DataFrame, path: str) -> None:
    """Documents as Parquet in a directory per lane and shard, so a shard's scan prunes to its directory."""
    docs.write.mode("overwrite").partitionBy("lane", "shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards as they were written."""
    return spark.read.parquet(path)


def write_object(df: DataFrame, path: str) -> None:
    """Rows as JSON, over what was there; for small reports."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_shard(spark: SparkSession, path: str, shard_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard_id") == shard_id)


def read_shard_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of shard files (one JSON object a file), with the manifest's shard_id."""
    files = spark.read.schema(SHARD_FILE).json(path, multiLine=True)
    return files.select(F.col("manifest.shard_id").alias("shard_id"), F.explode("documents").alias("d")).select("shard_id", "d.*")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON rows; none if the path is missing, and none for lines that are not JSON."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], schema)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return empty
    names = empty.columns
    rows = spark.read.schema(f"{schema}, _bad STRING").json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.select("*", F.col("_bad").isNull().alias("_ok")).where("_ok").select(*names)


def missing_files(spark: SparkSession, required: list[str], root: str) -> list[str]:
    """Required paths (relative to root) that are not there: a look-up for each, in whatever file system the root names."""
    conf = spark._jsc.hadoopConfiguration()
    paths = [(name, spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")) for name in required]
    return [name for name, p in paths if not p.getFileSystem(conf).exists(p)]
