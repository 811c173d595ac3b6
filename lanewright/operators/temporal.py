"""Joins by time: the nearest row of another table (as-of), and points in intervals.

As-of: both sides are dealt by key, and keys of very many rows also by parts of the time line that hold about equal numbers of rows
(quantiles), so a key with any share of the rows is no task's own. Within a part a running `last` finds the row before; the last row of earlier parts is
carried into a part as one more row, from a table of one row for each key and part. Intervals: each is cut into dyadic cells, two of a size at
most, and a point looks for its cell of every size that occurs: an equi-join. A very long interval is a few cells and not
thousands of bins, and every pair meets once. Keys of few rows meet as they are, without cells: a point is then moved once and not
once for each size.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.sources.shared import materialised

#: Parts of the time line at most, and rows of a part below that.
PARTS, PART_ROWS = 1024, 65_536


def micros(time: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({time} AS TIMESTAMP_NTZ))")


def _parted(rows: DataFrame, part_rows: int) -> tuple[DataFrame, bool]:
    """Adds `part`: for keys of more than `part_rows` rows the number of a stretch of `t`, by quantiles of their rows, else 0; and whether there are such keys."""
    hot = materialised(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part_rows))
    n = hot.agg(F.sum("n")).first()[0] or 0
    if not n:
        return rows.withColumn("part", F.lit(0)), False
    hot = F.broadcast(hot.select("key", F.lit(True).alias("hot")))  # a row for `part_rows` rows at least
    parts = min(PARTS, -(-n // part_rows))
    cuts = sorted(set(rows.join(hot, "key").approxQuantile("t", [k / parts for k in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    if not cuts:
        return rows.withColumn("part", F.lit(0)), False
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="d", outputCol="b")
    marked = split.transform(rows.join(hot, "key", "left").withColumn("d", F.col("t").cast("double")))
    return marked.withColumn("part", F.when(F.col("hot"), F.col("b").cast("int")).otherwise(0)).drop("d", "b", "hot"), True


def _before(rows: DataFrame, out: str, cut: bool) -> DataFrame:
    """Adds to rows of key, t, part, mine (null on the right), yours (null on the left) the last right row at or before each left one."""
    order = Window.partitionBy("key", "part").orderBy("t", F.col("mine").isNotNull(), "yours").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("yours").isNotNull(), F.struct("t", "yours")), ignorenulls=True).over(order)
    if not cut:
        return rows.withColumn(out, hit).where("mine is not null")
    ends = rows.groupBy("key", "part").agg(F.max(F.col("mine").isNotNull()).alias("asks"), F.max(F.when(F.col("yours").isNotNull(), F.struct("t", "yours"))).alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.withColumn("c", carried).where("asks and c is not null").select("key", F.col("c.t").alias("t"), "part", F.col("c.yours").alias("yours"))
    return rows.unionByName(carry, allowMissingColumns=True).withColumn(out, hit).where("mine is not null")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, direction: str = "backward", tolerance: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The left columns and `match`: the right row (a struct) of the same key that is nearest in time, null if there is none.

    Times are longs. `backward` looks at rows at or before the left time, `forward` at or after, `nearest` at both (of two equally near
    the earlier); `tolerance` is the largest distance. Of right rows with equal key and time the greatest wins for backward and the
    least for forward, as structs compare. A left row without key or time keeps its row and matches nothing; repeated rows stay.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction {direction}")
    mine, yours = F.struct(*(F.col(f"`{c}`") for c in left.columns)), F.struct(*(F.col(f"`{c}`") for c in right.columns))
    a = left.select(F.col(key).alias("key"), F.col(left_time).cast("long").alias("t"), mine.alias("mine"))
    b = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("key"), F.col(right_time).cast("long").alias("t"), yours.alias("yours"))
    asks = a.where("key is not null and t is not null")
    rows, cut = _parted(asks.unionByName(b, allowMissingColumns=True), part_rows)
    found = []
    if direction != "forward":
        found.append(_before(rows, "hit", cut).select("key", "t", "part", "mine", F.col("hit.t").alias("bt"), F.col("hit.yours").alias("by")))
    if direction != "backward":
        source = found[0].select("key", "t", "part", "mine", "bt", "by").unionByName(rows.where("yours is not null").select("key", "t", "part", "yours"), allowMissingColumns=True) if found else rows
        back = _after(source, cut)
        found.append(back)
    out = found[-1]
    names = out.columns
    before = (F.col("t") - F.col("bt")) if "bt" in names else F.lit(None).cast("long")
    after = (F.col("ft") - F.col("t")) if "ft" in names else F.lit(None).cast("long")
    kind = right.select(yours.alias("y")).schema["y"].dataType
    none = F.lit(None).cast(kind)
    by, fy = (F.col(c) if c in names else none for c in ("by", "fy"))
    near = F.when(F.coalesce(before <= after, after.isNull()), F.struct(before.alias("far"), by.alias("y"))).otherwise(F.struct(after.alias("far"), fy.alias("y")))
    out = out.withColumn("near", near)
    match = F.col("near.y") if tolerance is None else F.when(F.col("near.far") <= tolerance, F.col("near.y"))
    return out.select("mine.*", match.alias("match")).unionByName(a.where("key is null or t is null").select("mine.*", none.alias("match")))


def _after(rows: DataFrame, cut: bool) -> DataFrame:
    """As _before, for the first right row at or after: ft, fy."""
    order = Window.partitionBy("key", "part").orderBy(F.desc("t"), F.col("mine").isNotNull(), F.desc("yours")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("yours").isNotNull(), F.struct("t", "yours")), ignorenulls=True).over(order)
    kept = [*(c for c in rows.columns if c != "yours"), F.col("hit.t").alias("ft"), F.col("hit.yours").alias("fy")]
    if not cut:
        return rows.withColumn("hit", hit).where("mine is not null").select(*kept)
    ends = rows.groupBy("key", "part").agg(F.max(F.col("mine").isNotNull()).alias("asks"), F.min(F.when(F.col("yours").isNotNull(), F.struct("t", "yours"))).alias("first"))
    carried = F.first("first", ignorenulls=True).over(Window.partitionBy("key").orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    carry = ends.withColumn("c", carried).where("asks and c is not null").select("key", F.col("c.t").alias("t"), "part", F.col("c.yours").alias("yours"))
    return rows.unionByName(carry, allowMissingColumns=True).withColumn("hit", hit).where("mine is not null").select(*kept)


#: Sizes of dyadic cells: 2^0 to 2^62 units.
LEVELS = 63
#: A key's rows meet without cells if there are so many at most, and so many comparisons for each of them at most.
FEW, EACH = 65_536, 64


def dyadic_cells(lo: Column, hi: Column) -> Column:
    """The disjoint dyadic cells (level, cell) that make up the units lo, lo + 1, ..., hi - 1."""
    start = F.struct(lo.cast("long").alias("l"), hi.cast("long").alias("r"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))
    cell = lambda k, at, on: F.when(on, F.array(F.struct(k.cast("int").alias("level"), at.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    def up(s: Column, k: Column) -> Column:
        left = (s["l"] < s["r"]) & (s["l"].bitwiseAND(F.lit(1).cast("long")) == 1)
        right = (s["l"] < s["r"]) & (s["r"].bitwiseAND(F.lit(1).cast("long")) == 1)
        l2, r2 = s["l"] + F.when(left, 1).otherwise(0), s["r"] - F.when(right, 1).otherwise(0)
        cells = F.concat(s["cells"], cell(k, s["l"], left), cell(k, s["r"] - 1, right & (r2 >= l2)))
        return F.struct(F.shiftright(l2, 1).alias("l"), F.shiftright(r2, 1).alias("r"), cells.alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, up)["cells"]


def interval_join(intervals: DataFrame, points: DataFrame, key: str, lo: str, hi: str, at: str, unit: int = 1) -> DataFrame:
    """All columns of both (the key once) for the points at `lo` <= at < `hi` of intervals of the same key; numbers are longs.

    `unit` is the length of the smallest cell: about that of the short intervals. Empty and reversed intervals and nulls match nothing.
    """
    held, asked = intervals.where(F.col(lo) < F.col(hi)), points.where(F.col(at).isNotNull())
    within = (F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = F.col("__i") + F.col("__p")
    dense = materialised(count(held, "__i").join(count(asked, "__p"), key).where((rows > FEW) | (F.col("__i") * F.col("__p") > rows * EACH)).select(key))
    if dense.isEmpty():
        return held.join(asked, key).where(within)
    sparse = held.join(dense, key, "left_anti").join(asked.join(dense, key, "left_anti"), key).where(within)
    held, asked = held.join(dense, key, "left_semi"), asked.join(dense, key, "left_semi")
    first, last = F.floor(F.col(lo) / unit).cast("long"), F.floor((F.col(hi) - 1) / unit).cast("long")
    held = held.withColumn("__c", F.explode(dyadic_cells(first, last + 1))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # LEVELS rows at most
    own = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("level"), F.shiftright(F.floor(F.col(at) / unit).cast("long"), k).alias("cell")) for k in levels)))
    asked = asked.withColumn("__c", own).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    return held.join(asked, [key, "__level", "__cell"]).where(within).drop("__level", "__cell").unionByName(sparse)
