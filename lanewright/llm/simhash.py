"""SimHash near-duplicate classes found through anchor points of a covering code.

Fingerprints within `max_bits` = 3 differing bits are linked; a class is a connected component. The 64 bits form two
halves, so two linked fingerprints differ in at most one bit of some half. On 31 bits of each half the anchors are the
codewords of the Hamming code [31, 26], whose covering radius is 1. Every fingerprint is replicated to all anchors
within covering radius plus threshold (1 + 1) of each half, so linked fingerprints meet at the anchor nearest to either.
Equal fingerprints are collapsed first, and an anchor emits one row per member (a spanning forest of its links), never
its pairs. The members of one anchor lie within 2 bits of it on that half; the search below visits each member once and
compares it only with the members not yet reached, so a dense group costs about its own size.

Defined cases: null or empty text, or one without words, has fingerprint 0 and is linked like any other; 1 or 2 words
form one shingle; repeated rows share a class; a null doc_id is kept and never names a class while another id is
there; a bit that is set in exactly half the shingles is 0; very long texts are read whole, LONG bytes at a time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import marked, remove, shared_dir, spread_join, texts, unmarked, written

SEED = 42
MAX_BITS = 3


#: Bytes of a long text whose words are held at once.
LONG = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words in lists of about LONG bytes; each but the first begins with the last two words of the one before."""
    at, carry = 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + LONG) if at + LONG < len(data) else None
        end = cut.start() if cut else len(data)
        words = carry + data[at:end].split()
        yield words
        at, carry = end, words[-2:]


def fingerprint(text: str) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included, by XXH64 with seed 42."""
    total, ones, few = 0, np.zeros(64, np.int64), []
    for w in _word_lists(text.encode("utf-8", "replace").lower()):
        few = w
        if len(w) > 2:
            h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(w, w[1:], w[2:], strict=False))), ">u8", len(w) - 2)
            total += len(h)
            for lo in range(0, len(h), 1 << 20):
                ones += np.add.reduce(np.unpackbits(h[lo : lo + (1 << 20)].view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint32)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(few), SEED) if few else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return unmarked(_with_prints(marked(texts(docs)), "doc_id long"))


def fingerprints_of(rows: DataFrame) -> DataFrame:
    """row, doc_id, fp for rows of row, doc_id, text."""
    return unmarked(_with_prints(marked(rows), "row string, doc_id long"))


def _with_prints(rows: DataFrame, schema: str) -> DataFrame:
    names = rows.drop("text").columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64)
            yield b[names].assign(fp=fp.view(np.int64))

    return rows.mapInPandas(each, f"{schema}, fp long")


def _syndrome(bits31: np.ndarray) -> np.ndarray:
    """XOR of the positions 1..31 of the set bits: 0 for codewords, else the position to flip to reach one."""
    out = np.zeros(len(bits31), np.int64)
    for p in range(1, 32):
        out ^= ((bits31 >> (p - 1)) & 1) * p
    return out


def anchors_near(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, codeword) for all codewords within 2 bits of each 31-bit word."""
    rows, words = [np.arange(len(half))], []
    s = _syndrome(half)
    words.append(np.where(s > 0, half ^ (1 << np.maximum(s - 1, 0)), half))  # the nearest: 0 or 1 flips
    odd = np.flatnonzero(s)
    for p in range(1, 32):  # two flips p < q with p xor q = s
        q = s[odd] ^ p
        ok = odd[q > p]
        rows.append(ok)
        words.append(half[ok] ^ (1 << (p - 1)) ^ (1 << (q[q > p] - 1)))
    return np.concatenate(rows), np.concatenate(words)


def replicate(fps: DataFrame) -> DataFrame:
    """anchor (half in bit 31, codeword below), fp."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for side in (0, 1):
                at, word = anchors_near((fp >> (32 * side)) & 0x7FFFFFFF)
                yield pd.DataFrame({"anchor": word | (side << 31), "fp": fp[at]})

    return fps.mapInPandas(each, "anchor long, fp long")


def _forest(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each distinct fingerprint a member of its component (the first reached)."""
    root, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= max_bits
            if near.any():
                got = left[near]
                root[got] = seed
                queue.extend(got.tolist())
                left = left[~near]
    return root


def links(copies: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: links between different fingerprints that span every component of each anchor's members."""

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:  # rows of one anchor follow each other and may run across batches
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["anchor"].iloc[-1] if len(b) else None
            rest = b[b["anchor"] == last]
            yield compare(b[b["anchor"] != last])
        if rest is not None:
            yield compare(rest)

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        anchor, fp = b["anchor"].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))) if len(fp) else np.zeros(1, int)
        one, two = [], []
        for k in np.flatnonzero(np.diff(cut) > 1):
            x = fp[cut[k] : cut[k + 1]].view(np.uint64)
            if len(x) == 2:
                if np.bitwise_count(x[0] ^ x[1]) <= max_bits:
                    one.append(x[:1])
                    two.append(x[1:])
                continue
            root = _forest(x, max_bits)
            far = root != np.arange(len(x))
            one.append(x[root[far]])
            two.append(x[far])
        join = lambda y: np.concatenate(y).view(np.int64) if y else np.zeros(0, np.int64)
        a, c = join(one), join(two)
        return pd.DataFrame({"a": np.minimum(a, c), "b": np.maximum(a, c)})

    met = copies.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return met.mapInPandas(group, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable), for the nodes of the edges, by alternating large and small stars.

    Each round is written to the shared folder; rounds stop once no edge changes. The links of a centre are spread over many
    places when its least neighbour is joined to them, so a large star is no task's own.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), path := shared_dir(spark))
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, low, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", "v").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = written(small.select("e.u", "e.v").where("u <> v").distinct(), new := shared_dir(spark))
        state = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        remove(spark, path)
        now, path = nxt, new
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def roots(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root (one fingerprint of its class) for the distinct fingerprints of rows that have fp."""
    distinct = written(prints.select("fp").distinct())
    root = components(written(links(replicate(distinct), max_bits)))
    return distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    fp = written(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()))
    named = fp.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots(fp, max_bits), "fp")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(best, "root").select("fp", "component_id")
    return spread_join(fp, named, "fp", "row").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
