"""The stages of the corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Every stage works on all rows that the one before kept. A stage judges a row by its own text, so two texts that share an
id stand or fall apart; rows equal in id and text are one row where duplicates go (near_dedup) and are kept otherwise.
Working columns get names that the table does not have, and all but the last stage return the table's columns, untouched
but for the text (and n_chars) that personal_data rewrites.

Defined cases: a null or empty text has no language and goes in the first stage; a null id never outranks another id
among near-duplicates; ties are settled by the text's MD5; empty tables pass through; very long texts stay whole; extra
columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import decontaminate as benchmark
from lanewright.llm import langid, packing, pii, simhash
from lanewright.llm.common import broadcast_if_small, drop_intermediates, free_name, id_remainder, made, own_columns, shared_dir, written

#: Rows that are broadcast at most to drop other rows (their bytes are bounded too).
LIST_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles name; those without letters (`und`) go."""
    profiles = langid.train_profiles(docs.where(id_remainder(3) != 1))
    guess = free_name(docs, "guess")
    return docs.withColumn(guess, langid.guess(profiles)(F.col("text").cast("string"))).where(F.col(guess)["lang_pred"] != "und").select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate class the document with the least id (rows without one last); of rows equal in id and text one."""
    key = free_name(docs, "row")
    rows = docs.withColumn(key, _row_key())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    prints = written(simhash.fingerprints_of(rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))))
    root = written(simhash.roots(prints))
    rank = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "row")
    # The first of each fingerprint before the join: a fingerprint that many documents share meets it with one row.
    each = prints.groupBy("fp").agg(F.min(rank).alias("rank")).join(root, "fp")
    first = each.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.row")
    counted = prints.groupBy("row").count()
    gone = written(counted.join(first, "row", "left_anti").select("row"))
    again = written(counted.where("count > 1").join(first, "row", "left_semi").select("row"))
    kept = _without(rows, key, gone)
    if not again.isEmpty():
        twice = broadcast_if_small(again.withColumnRenamed("row", key), LIST_ROWS)
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.select(*own_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    key = free_name(docs, "row")
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    bad = written(benchmark.contaminated_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("key", "row"))
    return _without(rows, key, bad).select(*own_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind of data; n_chars, where the table has it, follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their texts, in their bins."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again, what it needed meanwhile is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = ""
    for k, (_, stage) in enumerate(STAGES):
        mark = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, path := shared_dir(spark))
            drop_intermediates(spark, mark, path)
            if before:
                drop_intermediates(spark, mark - 1, path)
            before = path
    return docs


def _row_key() -> Column:
    """MD5 over id and text: all 128 bits, as 64 would make namesakes of other rows in a large corpus."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not listed (gone: row, distinct): a filter in place while the list is short, else a join by shuffle."""
    return rows.join(broadcast_if_small(gone.withColumnRenamed("row", key), LIST_ROWS), key, "left_anti")


