"""Manifests, firewall, traceability and selection audits as ordinary queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.columns import uniform
from lanewright.operators.ordered import ordered_hash
from lanewright.operators.packing import text_digest
from lanewright.plans.params import EVAL_LANES, P
from lanewright.sources.shared import materialised

TOKENIZER = f"vocab_size={P.vocab}|pad_token_id=0|encoding=sha256_mod|version=v1"


def tokenizer_hash() -> Column:
    return F.sha2(F.lit(TOKENIZER), 256)


def manifests(totals: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row per shard; content_hash is an ordered hash over its documents' hashes."""
    rows = totals.join(hashes.select("shard_id", "content_hash"), "shard_id")
    return rows.select("shard_id", F.col("lane").alias("dataset"), F.col("docs").alias("document_count"), "content_hash", tokenizer_hash().alias("tokenizer_hash"), F.col("src").alias("shard_index"), "is_eval")


def dataset_manifests(manifest: DataFrame) -> DataFrame:
    """A row per dataset; its hash covers the shards' hashes in order."""
    totals = manifest.groupBy("dataset").agg(F.sum("document_count").alias("doc_count"), F.count("*").alias("num_shards"), F.bool_and("is_eval").alias("is_eval"))
    return totals.join(ordered_hash(manifest, ["dataset"], "shard_index", "content_hash", "dataset_hash"), "dataset")


def manifest_errors(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """A row per manifest of `expected`: the errors found in `observed`, and the verdict."""
    o = observed.select("shard_id", *(F.col(c).alias(f"o_{c}") for c in ("dataset", "document_count", "content_hash", "tokenizer_hash")))
    row = expected.join(o, "shard_id", "left")
    there = F.col("o_document_count").isNotNull()
    tests = [(~there, "shard missing")] + [(there & ~F.col(c).eqNullSafe(F.col(f"o_{c}")), f"{c} differs") for c in ("dataset", "document_count", "content_hash", "tokenizer_hash")]
    errors = F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in tests)))
    return row.select("shard_id", F.array_join(errors, "; ").alias("errors"), (F.size(errors) == 0).alias("passed"))


def is_eval_lane(lane: Column) -> Column:
    return lane.isin(*EVAL_LANES)


def firewall_events(shards: DataFrame) -> DataFrame:
    """SHARD_ALLOWED for training shards; FIREWALL_BLOCK and EVAL_SHARD_USED_FOR_EVAL for evaluation shards."""
    # The names of events, and the reason.
    bad = is_eval_lane(F.col("lane"))
    allowed = shards.where(~bad).select(F.lit("SHARD_ALLOWED").alias("event"), "shard_id", F.col("lane").alias("dataset"), F.lit("training").alias("used_for"), F.lit(False).alias("blocked"))
    blocked = shards.where(bad).select(F.lit("FIREWALL_BLOCK").alias("event"), "shard_id", F.col("lane").alias("dataset"), F.lit("training").alias("used_for"), F.lit(True).alias("blocked"), F.lit("evaluation shard").alias("reason"))
    used = shards.where(bad).select(F.lit("EVAL_SHARD_USED_FOR_EVAL").alias("event"), "shard_id", F.col("lane").alias("dataset"), F.lit("evaluation").alias("used_for"), F.lit(False).alias("blocked"))
    return allowed.unionByName(blocked, allowMissingColumns=True).unionByName(used, allowMissingColumns=True)


def ledger_violations(consumed: DataFrame, learned: DataFrame) -> DataFrame:
    """Evaluation lanes met in the consumption and learning ledgers (rows of step and lane)."""
    found = lambda df, name: df.where(is_eval_lane(F.col("lane"))).select(F.lit(name).alias("ledger"), "step", "lane").distinct()
    return found(consumed, "consumption").unionByName(found(learned, "learning"))


def firewall_audit(consumed: DataFrame, learned: DataFrame) -> DataFrame:
    """Evaluation lanes in the four fields of the ledgers: consumption's shard_sources and dataset_contributions (a map), and
    learning's source_datasets and shard_sources (arrays), one row for each field, step and lane."""
    of_shard = lambda x: F.substring_index(x, "_shard_", 1)
    parts = [
        (consumed, "consumption", "shard_sources", F.transform("shard_sources", of_shard)),
        (consumed, "consumption", "dataset_contributions", F.map_keys("dataset_contributions")),
        (learned, "learning", "source_datasets", F.col("source_datasets")),
        (learned, "learning", "shard_sources", F.transform("shard_sources", of_shard)),
    ]
    rows = [df.select(F.lit(name).alias("ledger"), F.lit(field).alias("field"), "step", F.explode(F.array_distinct(x)).alias("lane")).where(is_eval_lane(F.col("lane"))) for df, name, field, x in parts]
    return reduce(DataFrame.unionByName, rows)


def observed_manifests(shards: DataFrame) -> DataFrame:
    """shard_id, dataset, document_count, content_hash, tokenizer_hash of shards as they are read; a shard with two tokenizer hashes has none."""
    rows = materialised(shards.select("shard_id", "lane", "doc_id", "tokenizer_hash", text_digest().alias("h")))  # many files, read once
    one = F.when(F.min("tokenizer_hash") == F.max("tokenizer_hash"), F.min("tokenizer_hash"))
    counts = rows.groupBy("shard_id").agg(F.max("lane").alias("dataset"), F.count("*").alias("document_count"), one.alias("tokenizer_hash"))
    return counts.join(ordered_hash(rows, ["shard_id"], "doc_id", "h", "content_hash"), "shard_id")


class VerificationError(ValueError):
    """A gate that found a fault."""


def require(errors: DataFrame, what: str) -> None:
    """Raises if a row has not passed; the first few are named."""
    bad = errors.where("not passed").limit(5).collect()
    if bad:
        raise VerificationError(f"{what}: {[tuple(r) for r in bad]}")


def selection(docs: DataFrame, seed: int = P.seed) -> DataFrame:
    """Score, decision and reason per candidate document (doc_id, and h, the digest of its text)."""
    base = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 1000 / 1000.0
    noise = (uniform(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), seed) - 0.5) * 0.1
    rows = docs.select("doc_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + noise)), 4).alias("score"))
    rows = rows.withColumn("decision", F.when(F.col("score") >= P.accept, "ACCEPT").when(F.col("score") >= P.defer, "DEFER").otherwise("REJECT"))
    reason = F.when(F.col("decision") == "ACCEPT", f"score >= {P.accept}").when(F.col("decision") == "DEFER", f"score in [{P.defer}, {P.accept})").otherwise(f"score < {P.defer}")
    return rows.withColumn("reason", reason)


def with_override(decisions: DataFrame, floor: float = P.opus_floor) -> DataFrame:
    """If the accepted share is below the floor, deferred candidates are accepted (one total row is joined to all)."""
    share = decisions.agg((F.count_if(F.col("decision") == "ACCEPT") / F.count("*")).alias("share"))
    rows = decisions.crossJoin(F.broadcast(share))
    hit = (F.col("share") < floor) & (F.col("decision") == "DEFER")
    return rows.select("doc_id", "score", F.when(hit, "ACCEPT").otherwise(F.col("decision")).alias("decision"), hit.alias("override"), "reason")
