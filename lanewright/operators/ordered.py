"""Ordered computations over large groups: prefix sums and ordered hashes by blocks of rows.

A group's rows are never ordered in one task. The range of the ordering ids is cut into as many equal parts as the rows fill
blocks, so ids that are dense, sparse or hashes of 64 bits all give blocks of about the same size; blocks are summed first,
and windows run over a group's blocks and then within each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.plans.params import P


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = P.block, ties: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one in its group, by `order` (a long) and `ties`."""
    at = F.col(order).cast("double")
    span = df.agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"), F.count("*").alias("__n"))
    step = F.greatest(F.lit(1.0), (F.col("__hi") - F.col("__lo")) / F.greatest(F.lit(1.0), F.col("__n") / width))
    df = df.crossJoin(F.broadcast(span)).withColumn("__block", F.coalesce(F.floor((at - F.col("__lo")) / step), F.lit(-1))).drop("__lo", "__hi", "__n")  # one row
    blocks = df.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "__block").orderBy(order, *([ties] if ties else [])).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(blocks, [*keys, "__block"])
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__block", "__base")


def ordered_hash(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = P.block) -> DataFrame:
    """keys, `out`: SHA-256 over block hashes of block hashes of the values in order (blocks of `width` rows, two levels)."""
    ranked = prefix_sum(df.select(*keys, F.col(order).cast("long").alias("__order"), F.col(value).alias("__v"), F.lit(1).alias("__one")), keys, "__order", "__one", "__at", width, "__v")
    level = ranked.select(*keys, "__at", "__v")
    join = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]), "\n"), 256)
    for _ in range(2):
        level = level.groupBy(*keys, F.floor(F.col("__at") / width).alias("__next")).agg(join.alias("__v")).withColumnRenamed("__next", "__at")
    return level.groupBy(*keys).agg(join.alias(out))
