"""The trie of conversations by their turns: one row for each distinct sequence of first turns.

A node is owned by the smallest conversation that starts with it. If a conversation owns a node it owns all its longer ones, so
its owned depths run from a first one to its end: a chain. That first depth is found by binary search, all conversations at
once: each round joins the digest of every open conversation at its middle depth with the least conversation of each digest.
Chains hang off the node before their first one, on another chain; sums over the subtree of each chain are taken bottom-up by
pointer doubling (each round adds what hangs 1, 2, 4, ... chains below), so long towers of chains take few rounds. Sums at the
nodes of a chain are running sums, from its end, of what hangs there.

A prefix is told by its depth and 128 bits: the exclusive or of the hashes of its turns bound to their places, so a conversation
of any length is digested by blocks of turns and never sits in one task. Texts do not leave the scan, only digests and lengths.

Defined cases: null role or text is empty; a null turn comes first; equal turns of a conversation are ordered by the SHA-256 of
role and text; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a
conversation rebuilt without turns is a member of the root; an empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import remove, shared_dir, spread_join, written
from lanewright.operators.ordered import prefix_sum

#: Turns of a conversation, or ids of a node's ends, that one window or list holds.
BLOCK = 1024
SUMS = ("n", "leaves", "chars", "own")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest, chars: the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(F.concat_ws(":", F.length(role), role, text), 256).alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = written(rows.where("conv_id is not null").withColumn("one", F.lit(1)))
    return prefix_sum(rows, ["conv_id"], "turn", "one", "at", ties="digest").select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with the first crc32(c) mod 6 turns of conversation c - c % 100 before its own turns after that many.

    A conversation left without turns keeps one row of depth 0.
    """
    turns = written(turns)
    lengths = written(turns.groupBy("conv_id").agg(F.max("depth").alias("own")))
    h, base = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(6)), F.col("conv_id") - F.col("conv_id") % 100
    known = lengths.select("conv_id", base.alias("base"), h.alias("h")).join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    known = written(known.select("conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken")))
    first = turns.where("depth <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    taken = known.join(first, "base").where("depth <= taken").select("conv_id", "depth", "digest", "chars")
    own = spread_join(turns, known, "conv_id", "depth").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    start = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return taken.unionByName(own).unionByName(start)


def _running(rows: DataFrame, sums: list[str], xors: tuple[str, ...] = (), from_end: bool = False) -> DataFrame:
    """Each of the columns summed (or exclusively ored) over the conversation's rows up to this one by depth, or from this one on.

    BLOCK depths at a time: blocks are summed first, so a window never holds a whole conversation.
    """
    values = {k: F.bit_xor if k in xors else F.sum for k in (*sums, *xors)}
    plus = lambda k, a, b: a.bitwiseXOR(b) if k in xors else a + b
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(*(f(k).alias(k) for k, f in values.items()))
    by = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(F.desc(keys[-1]) if from_end else keys[-1])
    earlier = by("conv_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    within = by("conv_id", "block", "depth").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(f(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k, f in values.items()))
    met = rows.join(blocks, ["conv_id", "block"])
    return met.select(*(c for c in rows.columns if c not in values and c != "block"), *(plus(k, F.col(f"{k}_before"), f(k).over(within)).alias(k) for k, f in values.items()))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node (the digest of the first `depth` turns), chars (of the last of them), total (of all of them)."""
    place = F.when(F.col("depth") > 0, F.xxhash64("digest", "depth")), F.when(F.col("depth") > 0, F.xxhash64("depth", "digest", F.lit(1)))
    rows = turns.select("conv_id", "depth", "chars", F.col("chars").alias("total"), *(F.coalesce(p, F.lit(0).cast("long")).alias(k) for k, p in zip("xy", place, strict=True)))
    met = _running(rows, ["total"], xors=("x", "y"))
    return met.select("conv_id", "depth", F.concat_ws(":", "depth", F.hex("x"), F.hex("y")).alias("node"), "chars", "total")


def first_owned(prefix: DataFrame, least: DataFrame) -> DataFrame:
    """conv_id, len, first: the first depth whose node the conversation owns (len + 1 if none), by batched binary search."""
    open_ = written(prefix.groupBy("conv_id").agg(F.max("depth").alias("len")).select("conv_id", "len", F.lit(0).cast("long").alias("lo"), (F.col("len") + 1).alias("hi")))
    done: list[DataFrame] = []
    while not open_.isEmpty():
        asked = open_.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(prefix.select("conv_id", "depth", "node"), ["conv_id", "depth"])
        owned = F.col("owner") == F.col("conv_id")
        step = spread_join(asked, least.select("node", "owner"), "node", "conv_id")
        step = written(step.select("conv_id", "len", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi")))
        done.append(step.where("lo = hi").select("conv_id", "len", F.col("lo").alias("first")))
        open_ = step.where("lo < hi")
    return reduce(DataFrame.unionByName, done) if done else open_.select("conv_id", "len", F.col("lo").alias("first"))


def chains(prefix: DataFrame, least: DataFrame) -> DataFrame:
    """conv_id, len, first, up (the conversation whose chain it hangs on, null for the root's), at (the depth there), n, leaves, chars, own.

    The last four are sums over the chain and all chains below it: conversations, childless nodes, characters of the
    conversations and characters of the nodes.
    """
    spark = prefix.sparkSession
    found = written(first_owned(prefix, least))
    ends = found.join(prefix.select("conv_id", F.col("depth").alias("len"), F.col("total").alias("chars")), ["conv_id", "len"])
    hung = found.where("first > 0").select("conv_id", (F.col("first") - 1).alias("at")).join(prefix.select("conv_id", F.col("depth").alias("at"), "node", "total"), ["conv_id", "at"])
    hung = spread_join(hung, least.select("node", F.col("owner").alias("up")), "node", "conv_id").select("conv_id", "up", "at", F.col("total").alias("above"))
    rows = written(ends.join(hung, "conv_id", "left").withColumn("own", F.col("chars") - F.coalesce("above", F.lit(0))))
    inner = rows.where("first <= len and up is not null").select(F.col("up").alias("conv_id"), F.col("at").alias("len")).distinct().withColumn("inner", F.lit(True))
    rows = rows.join(inner, ["conv_id", "len"], "left").withColumn("leaves", F.when((F.col("first") <= F.col("len")) & F.col("inner").isNull(), 1).otherwise(0).cast("long"))
    rows = written(rows.select("conv_id", "len", "first", "up", "at", F.lit(1).cast("long").alias("n"), "leaves", "chars", "own"))
    now, path = rows.select("conv_id", F.col("up").alias("next"), *SUMS), ""
    while True:
        below = now.where("next is not null").groupBy("next").agg(*(F.sum(k).alias(f"{k}_below") for k in SUMS)).withColumnRenamed("next", "conv_id")
        jump = spread_join(now.where("next is not null").select("conv_id", "next"), now.select(F.col("conv_id").alias("next"), F.col("next").alias("beyond")), "next", "conv_id").where("beyond is not null").select("conv_id", "beyond")
        step = now.join(below, "conv_id", "left").join(jump, "conv_id", "left")
        step = written(step.select("conv_id", F.col("beyond").alias("next"), *((F.col(k) + F.coalesce(f"{k}_below", F.lit(0))).alias(k) for k in SUMS)), new := shared_dir(spark))
        if path:
            remove(spark, path)
        now, path = step, new
        if now.where("next is not null").isEmpty():
            break
    return rows.drop(*SUMS).join(now.drop("next"), "conv_id")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the comma-joined pieces of each node; they come in order and pass through one at a time."""
    at, digest = None, None
    for b in batches:
        out = []
        for conv, depth, piece in zip(b["conv_id"].tolist(), b["depth"].tolist(), b["piece"].tolist(), strict=True):
            if at == (conv, depth):
                digest.update(b",")
            else:
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (conv, depth), hashlib.sha256()
            digest.update(piece.encode())
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends"], dtype=object)
    if at:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["conv_id", "depth", "ends"], dtype=object)


def _ends(chain: DataFrame) -> DataFrame:
    """conv_id, depth (a node), ends: SHA-256 of the ids, in order, of the conversations that end there."""
    owned = F.col("first") <= F.col("len")
    rows = chain.select(F.when(owned, F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("len").alias("depth"), F.col("conv_id").alias("id"))
    pieces = rows.groupBy("owner", "depth", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("piece"))
    pieces = pieces.select(F.col("owner").alias("conv_id"), "depth", "block", "piece").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return pieces.mapInPandas(_hashed, "conv_id long, depth long, ends string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of conversations given as conv_id, depth (0 for the start that every conversation has, then 1, 2, ...), digest, chars."""
    prefix = written(prefixes(turns))
    least = written(prefix.groupBy("node").agg(F.min("conv_id").alias("owner"), F.min("depth").alias("depth"), (F.min("total") - F.min("chars")).alias("above")))
    chain = written(chains(prefix, least))
    borne = F.when(F.col("first") <= F.col("len"), 1).otherwise(0)
    hung = chain.where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(*(F.sum(k).alias(k) for k in SUMS), F.sum(borne).alias("hung"))
    marks = chain.where("first <= len").select("conv_id", F.explode(F.array(F.struct(F.col("first").alias("depth"), F.col("up").alias("up"), F.lit(False).alias("last")), F.struct(F.col("len").alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("last")))).alias("m"))
    marks = marks.groupBy("conv_id", F.col("m.depth").alias("depth")).agg(F.max("m.up").alias("up"), F.max("m.last").alias("last"), F.max(~F.col("m.last")).alias("top"))
    nodes = least.select(F.col("owner").alias("conv_id"), "depth", "above")
    for more in (hung, marks, _ends(chain)):
        nodes = nodes.join(more, ["conv_id", "depth"], "left")
    last, top = F.coalesce("last", F.lit(False)), F.coalesce("top", F.lit(False))
    nodes = nodes.select("conv_id", "depth", "above", "ends", last.alias("last"), F.when(top, F.col("up")).when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"), *(F.coalesce(k, F.lit(0)).alias(k) for k in (*SUMS, "hung")))
    leaf = F.when(F.col("last") & (F.col("hung") == 0), 1).otherwise(0)
    nodes = _running(written(nodes.withColumn("children", F.col("hung") + F.when(F.col("last"), 0).otherwise(1)).withColumn("leaf", leaf)), [*SUMS, "leaf"], from_end=True)
    saved = F.col("chars") - F.col("own") - F.col("n") * F.col("above")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", (F.col("n") + 1).alias("n_convs"), F.col("children").cast("long").alias("n_children"), (F.col("leaves") + F.col("leaf")).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(turns_of(conversations)))
