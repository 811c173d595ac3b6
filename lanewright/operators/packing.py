"""Greedy packing in closed form: documents of a shard laid end to end, cut at every context length.

A document covers sequences offset / context .. (offset + n - 1) / context, where offset is the running sum of the token
counts before it. Sequences get a global ordinal from the prefix sum over shards; batches are runs of ordinals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.functions.columns import piece_hashes, token_ids_of, word_counts, words
from lanewright.operators.ordered import ordered_hash, prefix_sum
from lanewright.plans.params import P
from lanewright.sources.tables import laned_documents

SHARD = ["lane_idx", "lane", "is_eval", "src", "shard_id"]


def token_counts(spark: SparkSession, sf_dir: str, encode: Callable[[Column], Column] | None = None, digest: bool = False) -> DataFrame:
    """SHARD, doc_id, n: words, or tokens if `encode` turns a text column into an array of them (built-in functions or a pandas UDF).

    With `digest` also h, the SHA-256 of the text, for queries that need both of one reading.
    """
    n = word_counts(F.col("text")) if encode is None else F.size(encode(F.col("text"))).cast("long")
    return laned_documents(spark, sf_dir).select(*SHARD, "doc_id", n.alias("n"), *([text_digest().alias("h")] if digest else []))


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def offsets(tokens: DataFrame) -> DataFrame:
    """Adds off, the tokens of the shard before this document."""
    return prefix_sum(tokens, ["shard_id"], "doc_id", "n", "off")


def overlaps(offs: DataFrame, context: int = P.context) -> DataFrame:
    """A row per document and sequence: seq, tokens (of the document in it), pos (where in the sequence), skip (where in the document)."""
    lo, hi = F.floor(F.col("off") / context), F.floor((F.col("off") + F.col("n") - 1) / context)
    rows = offs.where("n > 0").select(*SHARD, "doc_id", "off", "n", F.explode(F.sequence(lo, hi)).alias("seq"))
    begin, end = F.greatest("off", F.col("seq") * context), F.least(F.col("off") + F.col("n"), (F.col("seq") + 1) * context)
    return rows.select(*SHARD, "doc_id", "seq", (end - begin).alias("tokens"), (begin - F.col("seq") * context).alias("pos"), (begin - F.col("off")).alias("skip"))


def sequences(over: DataFrame, context: int = P.context) -> DataFrame:
    """A row per sequence: real and padding tokens, number of source documents."""
    return over.groupBy(*SHARD, "seq").agg(F.sum("tokens").alias("real"), (F.lit(context) - F.sum("tokens")).alias("pad"), F.count("*").alias("n_sources"))


def shard_totals(tokens: DataFrame, context: int = P.context) -> DataFrame:
    """A row per shard: documents, tokens, sequences."""
    return tokens.groupBy(*SHARD).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).withColumn("seqs", F.ceil(F.col("tokens") / context))


def shard_bases(tokens: DataFrame, context: int = P.context) -> DataFrame:
    """shard_id, base: sequences of the training shards before this one (the window runs over shards, not sequences)."""
    order = Window.orderBy("lane_idx", "src").rowsBetween(Window.unboundedPreceding, -1)
    return shard_totals(tokens, context).where("not is_eval").select("shard_id", F.coalesce(F.sum("seqs").over(order), F.lit(0)).cast("long").alias("base"))


def in_batches(seqs: DataFrame, bases: DataFrame, batch: int = P.batch) -> DataFrame:
    """Adds ord (global ordinal) and batch_index to rows of training shards that carry shard_id and seq."""
    # One row per shard: as many as sources, a dimension.
    return seqs.join(bases, "shard_id").withColumn("ord", F.col("base") + F.col("seq")).withColumn("batch_index", F.floor(F.col("ord") / batch)).drop("base")


def batch_id(index: str = "batch_index") -> Column:
    return F.format_string("batch_%06d", index)


def piece_hash(words_: Column) -> Column:
    return F.sha2(F.array_join(words_, " "), 256)


def pieces(spark: SparkSession, sf_dir: str, tokens: DataFrame, context: int = P.context, value: Callable[[Column], Column] = piece_hash) -> DataFrame:
    """A row per document and sequence with a value (`hash`) of the document's words in it: their SHA-256 unless told otherwise.

    Offsets meet texts by a join that moves each text once, as it is, and sorts none: the offsets of a part are its hash table, being few
    beside the texts. Words are split after it. The columns of SHARD come with the offsets.
    """
    docs = laned_documents(spark, sf_dir).select("shard_id", "doc_id", "text")
    offs = offsets(tokens).where("n > 0").select(*SHARD, "doc_id", "off")
    rows = docs.join(offs.hint("shuffle_hash"), ["shard_id", "doc_id"]).select(*SHARD, "doc_id", "off", words(F.col("text")).alias("w"))
    lo, hi = F.floor(F.col("off") / context), F.floor((F.col("off") + F.size("w") - 1) / context)

    def piece(k: Column) -> Column:
        skip = F.greatest(k * context - F.col("off"), F.lit(0).cast("long"))
        size = F.least((k + 1) * context - F.col("off"), F.size("w").cast("long")) - skip
        return F.struct(k.alias("seq"), value(F.slice("w", (skip + 1).cast("int"), size.cast("int"))).alias("hash"))

    # A filter on the words would be pushed below them and split every text once more.
    own = F.when(F.size("w") > 0, F.transform(F.sequence(lo, hi), piece))
    return rows.select(*SHARD, "doc_id", F.explode(own).alias("x")).select(*SHARD, "doc_id", "x.seq", "x.hash")


def sequence_hashes(spark: SparkSession, sf_dir: str, offs: DataFrame, bases: DataFrame, context: int = P.context, batch: int = P.batch) -> DataFrame:
    """batch_index, hashes: of the batch's sequences in order, each over the hashes of its pieces in order (at most `context` of them).

    Texts of training shards, and no others, meet `offs` as in `pieces`. A shard's base makes offsets those of the whole training order, so
    pieces carry the ordinals of their sequences and move once, to their batch.
    """
    docs = laned_documents(spark, sf_dir).where("not is_eval").select("shard_id", "doc_id", "text")
    places = offs.where("n > 0").join(F.broadcast(bases), "shard_id")  # a row a shard
    places = places.select("shard_id", "doc_id", (F.col("base") * context + F.col("off")).alias("off"))
    rows = docs.join(places.hint("shuffle_hash"), ["shard_id", "doc_id"])
    own = rows.select("doc_id", F.explode(piece_hashes(F.col("text"), F.col("off"), context)).alias("x"))
    own = own.groupBy(F.floor(F.col("x.seq") / batch).alias("batch_index")).agg(F.array_sort(F.collect_list(F.struct("x.seq", "doc_id", "x.hash"))).alias("x"))

    def hash_(ord_: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.filter("x", lambda x: x["seq"] == ord_), lambda x: F.lower(F.hex(x["hash"]))), "\n"), 256)

    return own.select("batch_index", F.transform(F.array_distinct(F.transform("x", lambda x: x["seq"])), hash_).alias("hashes"))


def arrays(spark: SparkSession, sf_dir: str, tokens: DataFrame, context: int = P.context, vocab: int = P.vocab) -> DataFrame:
    """SHARD, seq, tokens (ids, padded with 0) and mask of every sequence, from the documents' words."""
    own = pieces(spark, sf_dir, tokens, context, lambda w: w).withColumn("hash", token_ids_of(vocab)("hash"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "hash"))), lambda x: x["hash"]))
    rows = own.groupBy(*SHARD, "seq").agg(ids.cast("array<bigint>").alias("ids"))
    pad = F.lit(context) - F.size("ids")
    zeros = F.array_repeat(F.lit(0).cast("long"), pad)
    return rows.select(*SHARD, "seq", F.concat("ids", zeros).alias("tokens"), F.concat(F.transform("ids", lambda _: F.lit(1).cast("long")), zeros).alias("mask"))


def content_hashes(digests: DataFrame) -> DataFrame:
    """SHARD, content_hash over the digests (h) of the documents in order."""
    return ordered_hash(digests, SHARD, "doc_id", "h", "content_hash")
