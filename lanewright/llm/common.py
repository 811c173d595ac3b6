"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

U64 = np.uint64


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone (so extra or clashing columns never matter); a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Stands for a null id inside Python functions, where a column of longs with a null would turn into floats.
NO_ID = -(2**63)


def marked(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.withColumn(id_col, F.coalesce(id_col, F.lit(NO_ID)))


def unmarked(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.withColumn(id_col, F.nullif(F.col(id_col), F.lit(NO_ID)))


def id_remainder(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(mod))


#: Folders of intermediate tables that this process has made, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under `spark.checkpoint.dir`, which driver and executors share. Only a local run may leave that unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_lanewright_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lanewright-")
        sc._lanewright_shared = base
        sc.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/lanewright-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def made() -> int:
    """How many intermediate folders there are: a mark for drop_intermediates."""
    return len(_made)


def drop_intermediates(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Deletes the intermediate tables made after the mark. Only for when no frame that reads them is still to be run."""
    for path in _made[since:]:
        if path != keep:
            remove(spark, path)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def own_columns(df: DataFrame) -> list[Column]:
    """The frame's columns as they are named, dots and all."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def local_path(uri: str) -> str:
    """file:///x, file:/x or /x as a plain path."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: the model store needs a shared folder mounted as a file system")
    return uri


#: Bytes of a side that is broadcast at most.
BROADCAST_BYTES = 32_000_000


def _bytes(field: StructField, column: Column) -> Column:
    """About what a value takes in a broadcast table."""
    kind = field.dataType
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        each = F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + _bytes(StructField("x", kind.elementType), x))
        return F.coalesce(each, F.lit(0).cast("long")) + 16
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, [_bytes(f, column[f.name]) for f in kind.fields], F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only when the rows, counted and measured no further than the bounds, are few and small; else the plain frame."""
    size = reduce(lambda a, b: a + b, [_bytes(f, F.col(quoted(f.name))) for f in df.schema.fields])
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= max_bytes else df


#: Places that the rows of one key are spread over in a join.
SPREAD = 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with a table of one row a key, where one key may hold any share of the rows.

    The rows of a key go to SPREAD places by the hash of `by` (which must be the same each time the rows are read), its row
    of the table to those of the places that occur: no task gets all rows of a key, and the table grows no more than the rows.
    """
    place = free_name(rows, "place")
    rows = rows.withColumn(place, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    places = rows.select(key, place).distinct()
    return rows.join(places.join(table, key), [key, place]).drop(place)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        for name, r in (("_POW", _R), ("_INV", _R_INV)):
            p = np.full(size, r, U64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _POW, _INV


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each white-space separated token, its start) in the bytes; no Python code per token."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], SPACE[a], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), U64)
    step, lo = 1 << 16, 0
    while lo < len(start):  # pieces that stay in the processor's cache
        base = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, base + step, "right")))
        power, inverse = _powers(int(end[hi - 1] - base) + 1)
        piece = a[base : end[hi - 1]]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[piece] * power[: len(piece)])))
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        lo = hi
    return out, start
