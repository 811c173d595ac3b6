"""Document fingerprints by locally consistent parsing (deterministic coin tossing).

Every level collapses runs, reduces each symbol's label to under 6 values by comparing it bit by bit with its left
neighbour's (four rounds), and starts a phrase at each local maximum of the labels. A phrase's name is a hash of its
symbols, so a phrase depends on a few neighbours only: equal substrings share all their interior phrase names wherever
they stand. The fingerprint is 64 minima of the names of levels 2 and 3 (phrases of about 10 to 30 characters), 16 bits
each; the likeness of two fingerprints is the share of equal minima among those that either has.

Defined cases: null or empty text has the fingerprint of no phrase (all zeros), which is like another such one and like
no other; equal texts have equal fingerprints; ties of doc_id are ordered by text, a null doc_id comes last; a single
document is its own next one; an empty table gives an empty result; very long texts are parsed whole; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import U64, marked, mix, texts, unmarked

LEVELS = (2, 3)
MINIMA = 64
#: Code points that are parsed at once, so that arrays stay in the processor's cache.
CHUNK = 1 << 17
_K, _R = U64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def _reduced() -> np.ndarray:
    """Table of the next label of a symbol a whose left neighbour is b: twice the lowest bit that differs, plus a's bit."""
    a, b = np.meshgrid(np.arange(256, dtype=np.int64), np.arange(256, dtype=np.int64), indexing="ij")
    x = (a ^ b) | 256
    k = np.bitwise_count((x & -x) - 1).astype(np.int64)
    return (2 * k + ((a >> k) & 1)).astype(np.uint8).ravel()


_TABLE = _reduced()
_POWER = np.ones(1, U64)
_INVERSE = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        out = []
        for r in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(2 * n, r, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWER, _INVERSE = out
    return _POWER, _INVERSE


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level for many texts at once: names of all symbols and where each text (none empty) starts, to the same of phrases."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    v = names[at]
    run = np.diff(at, append=len(names))
    many = np.flatnonzero(run > 1)
    v[many] = mix(v[many].astype(U64) + run[many].astype(U64) * _K).astype(v.dtype)
    starts = np.searchsorted(at, starts)

    left = np.empty_like(v)
    left[1:] = v[:-1]
    left[starts] = v[starts] ^ v.dtype.type(1)
    x = v ^ left
    k = np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))
    label = ((k << 1) | ((v >> k.astype(v.dtype)) & v.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        pair = label.astype(np.uint16) << np.uint16(8)
        pair[1:] |= label[:-1]
        pair[starts] |= np.uint16(255)
        pair[starts] ^= (label[starts] ^ np.uint8(1)) ^ np.uint16(255)
        label = _TABLE[pair]
    cut = np.zeros(len(v), bool)
    up = label[1:] > label[:-1]
    cut[1:-1] = up[:-1] & ~up[1:] & (label[1:-1] != label[2:])
    cut[starts[1:] - 1] = False  # a text's last symbol has no right neighbour
    cut[starts] = True
    begin = np.flatnonzero(cut)
    power, inverse = _powers(len(v) + 1)
    total = np.zeros(len(v) + 1, U64)
    np.cumsum((v.astype(U64) * _K + U64(1)) * power[: len(v)], out=total[1:])
    end = np.append(begin[1:], len(v))
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64)), np.searchsorted(begin, starts)


def fingerprints(texts_: list[str]) -> np.ndarray:
    """A row of MINIMA 16-bit values for each text; 0 where no phrase fell to a minimum."""
    out = np.zeros((len(texts_), MINIMA), np.uint16)
    full = [k for k, t in enumerate(texts_) if t]
    lo = 0
    while lo < len(full):
        hi, size = lo, 0
        while hi < len(full) and (hi == lo or size + len(texts_[full[hi]]) <= CHUNK):
            size += len(texts_[full[hi]])
            hi += 1
        own = [texts_[k] for k in full[lo:hi]]
        names = np.frombuffer("".join(own).encode("utf-32-le", "replace"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in own])[:-1])).astype(np.int64)
        least = np.full(len(own) * MINIMA, 0xFFFFFFFF, np.uint32)
        for level in range(1, max(LEVELS) + 1):
            names, starts = parse(names, starts)
            if level in LEVELS:
                doc = np.repeat(np.arange(len(own)), np.diff(starts, append=len(names)))
                np.minimum.at(least, doc * MINIMA + (names >> U64(58)).astype(np.int64), (names >> U64(8)).astype(np.uint32) & np.uint32(0x7FFFFFFF))
        none = least == 0xFFFFFFFF
        value = (mix(least.astype(U64)) % U64(65535)).astype(np.uint16) + np.uint16(1)
        out[full[lo:hi]] = np.where(none, 0, value).reshape(len(own), MINIMA)
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima among those that either fingerprint has; 1 if neither has any."""
    some = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(some == 0, 1.0, same / np.maximum(some, 1))


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of doc_id, each range also holding the first row of the range below (`helper`)."""
    spark = docs.sparkSession
    docs = marked(docs.withColumn("key", F.col("doc_id")), "key")
    parts = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) or []})
    bounds = np.array(cuts, np.int64)
    # A range's number is one whose hash leaves a remainder of its own, so no two ranges meet in one task.
    spread = spark.range(20 * parts + 100).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("r")).agg(F.min("id"))
    numbers = [r[1] for r in spread.collect()]  # a row a range
    numbers += [k for k in range(-1, -parts - 1, -1)][: parts - len(numbers)]
    number = np.array(numbers, np.int32)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(number[np.searchsorted(bounds, key.to_numpy(np.int64), "right")])

    tops = sorted((r[1], r[0]) for r in docs.select("key").withColumn("part", part_of("key")).groupBy("part").agg(F.max("key")).collect())  # one row a range
    # The highest key of each range helps the range above; the highest of all follows the lowest.
    helps = [(key, tops[(k + 1) % len(tops)][1]) for k, (key, _) in enumerate(tops)]
    helper = F.broadcast(spark.createDataFrame(helps, "key long, helps int"))  # a row a range
    rows = docs.withColumn("part", part_of("key")).join(helper, "key", "left")
    rows = rows.select("key", "text", F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("helper")), F.when(F.col("helps").isNotNull(), F.struct(F.col("helps").alias("part"), F.lit(True).alias("helper")))))).alias("x"))
    return rows.select("key", "text", "x.part", "x.helper"), parts


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likeness."""
    rows, parts = _with_next(texts(docs))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:  # in a range: its own rows by descending key, then the helper
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = b.iloc[-1:]
            yield pairs(b)

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        part, helper, text = b["part"].to_numpy(), b["helper"].to_numpy(bool), b["text"].tolist()
        own = np.flatnonzero(~helper[:-1] & (part[:-1] == part[1:]))
        first = fingerprints(text)
        changed = [edited(text[k], text[k + 1]) for k in own]
        second = fingerprints(changed)
        hexed = lambda x: [r.astype(">u2").tobytes().hex() for r in x]
        return pd.DataFrame(
            {
                "doc_id": b["key"].iloc[own],
                "n_chars": [len(text[k]) for k in own],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
                "fingerprint": hexed(first[own]),
                "edited_fingerprint": hexed(second),
                "near_edited": likeness(first[own], second),
                "near_next": likeness(first[own], first[own + 1]),
            }
        )

    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "helper", F.desc("key"), "text")
    return unmarked(dealt.mapInPandas(each, SCHEMA))
