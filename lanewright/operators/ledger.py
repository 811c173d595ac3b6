"""Consumption and learning ledgers, checkpoints, resume, fork and replay over the batch table.

A step consumes the batch of the same index, so the consumed set of a checkpoint is the prefix of steps up to it; it is kept
as its length and not as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.columns import joined_hash, sorted_join, uniform
from lanewright.operators.packing import batch_id
from lanewright.plans.params import P


def batches(seqs: DataFrame, context: int = P.context) -> DataFrame:
    """batch_index, batch_id, seq_count, token_count (with padding), real_token_count."""
    aggs = [F.count("*").alias("seq_count"), (F.count("*") * context).alias("token_count"), F.sum("real").alias("real_token_count")]
    return seqs.groupBy("batch_index").agg(*aggs).withColumn("batch_id", batch_id())


def inputs(hashes: DataFrame) -> DataFrame:
    """batch_index, batch_id, seq_count, input_hash from the hashes of the batches' sequences."""
    return hashes.select("batch_index", batch_id().alias("batch_id"), F.size("hashes").cast("long").alias("seq_count"), F.sha2(F.array_join("hashes", "\n"), 256).alias("input_hash"))


def consumption(over: DataFrame, seqs: DataFrame) -> DataFrame:
    """A ledger row per step: token counts, the distinct document ids and shards in order of appearance."""
    ids = over.groupBy("batch_index", "doc_id").agg(F.min(F.struct("ord", "pos")).alias("first"))
    ids = ids.groupBy("batch_index").agg(sorted_join(F.collect_list(F.struct("first", "doc_id")), "doc_id").alias("sample_ids"), F.count("*").alias("n_samples"))
    shards = over.groupBy("batch_index", "shard_id", "lane").agg(F.min("ord").alias("first"))
    shards = shards.groupBy("batch_index").agg(sorted_join(F.collect_list(F.struct("first", "shard_id")), "shard_id").alias("shard_sources"), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("datasets"))
    return batches(seqs).join(ids, "batch_index").join(shards, "batch_index").withColumn("step", F.col("batch_index"))


def contributions(over: DataFrame, seqs: DataFrame) -> DataFrame:
    """Per step and lane: contrib_compat (a sequence's whole real count for each source document) and contrib_strict (its own tokens)."""
    real = seqs.select("shard_id", "seq", "real")
    rows = over.join(real, ["shard_id", "seq"])
    return rows.groupBy(F.col("batch_index").alias("step"), "lane").agg(F.sum("real").alias("contrib_compat"), F.sum("tokens").alias("contrib_strict"))


def contribution_maps(contributions_: DataFrame) -> DataFrame:
    """step, dataset_contributions (whole real counts for each source document) and its strict form, as maps of the few lanes."""
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", c))))
    return contributions_.groupBy("step").agg(pairs("contrib_compat").alias("dataset_contributions"), pairs("contrib_strict").alias("strict_contributions"))


def loss(step: str = "step", seed: int = P.seed) -> Column:
    noise = (uniform(F.concat(F.lit("loss:"), F.col(step).cast("string")), seed) - 0.5) * 0.1
    return F.round(F.greatest(F.lit(0.01), F.lit(3.5) * F.exp(F.col(step) * -0.08) + noise), 4)


def sample_loss(step: str, index: str, seed: int = P.seed) -> Column:
    noise = (uniform(F.concat(F.lit("sample:"), F.col(step).cast("string"), F.lit(":"), F.col(index).cast("string")), seed) - 0.5) * 0.04
    return F.round(F.greatest(F.lit(0.001), loss(step, seed) + noise), 4)


def learning(seqs: DataFrame, batch: int = P.batch) -> DataFrame:
    """A row per step and sample (sequence): its loss and real tokens."""
    rows = seqs.select(F.col("batch_index").alias("step"), (F.col("ord") % batch).cast("int").alias("sample_index"), F.col("real").alias("n_tokens"), "shard_id", "lane", "seq")
    return rows.withColumns({"loss": loss(), "sample_loss": sample_loss("step", "sample_index")})


def checkpoints(ledger: DataFrame, every: int = P.checkpoint_every, crash: int = P.crash_at) -> DataFrame:
    """Steps saved: every `every`-th, and the one at which the run crashed."""
    rows = ledger.where(((F.col("step") + 1) % every == 0) | (F.col("step") == crash))
    rows = rows.select("step", "batch_id", (F.col("step") + 1).alias("consumed"), F.format_string("checkpoint_step_%06d", "step").alias("name"))
    return rows.withColumn("state_hash", joined_hash(F.col("step"), F.col("batch_id"), F.col("consumed")))


def latest(checkpoints_: DataFrame) -> DataFrame:
    return checkpoints_.agg(F.max_by(F.struct("step", "batch_id", "consumed", "state_hash"), "name").alias("x")).where("x is not null").select("x.*")


def nearest(checkpoints_: DataFrame, step: int) -> DataFrame:
    """The checkpoint nearest to a step; of two, the lower."""
    return checkpoints_.agg(F.min_by(F.struct("step", "batch_id", "consumed", "state_hash"), F.struct(F.abs(F.col("step") - step), "step")).alias("x")).where("x is not null").select("x.*")


def resume_audit(ledger: DataFrame, expected: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """One row: duplicated, missing and unexpected batches, gaps in the steps, and the first batch after the checkpoint.

    Order is judged by joining each step to the one before it, which needs no global sort.
    """
    counts = ledger.groupBy("batch_id").count()
    duplicate = counts.where("count > 1").agg(F.count("*").alias("duplicated"))
    missing = expected.join(ledger, "batch_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = ledger.join(expected, "batch_id", "left_anti").agg(F.count("*").alias("unexpected"))
    steps = ledger.select("step").distinct()
    gaps = steps.where("step > 0").join(steps.select((F.col("step") + 1).alias("step")), "step", "left_anti").agg(F.count("*").alias("gaps"))
    c = checkpoint.select(F.col("step").alias("saved"))
    first = ledger.crossJoin(F.broadcast(c)).where("step > saved").agg(F.min(F.struct("step", "batch_id"))["batch_id"].alias("first_after"))  # one row
    row = duplicate.crossJoin(missing).crossJoin(extra).crossJoin(gaps).crossJoin(first)  # five single rows
    return row.withColumn("result", F.when((F.col("duplicated") == 0) & (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("gaps") == 0), "PASS").otherwise("FAIL"))


def consumed_sets(ledger: DataFrame, every: int = P.checkpoint_every, crash: int = P.crash_at) -> DataFrame:
    """batch_id, step, first_saved: the first checkpoint that has the batch (null if none yet has).

    The set of a checkpoint is the batches whose first_saved is at most its step: all sets in one table, a row for each batch.
    """
    next_ = F.ceil((F.col("step") + 1) / every) * every - 1
    saved = F.when(F.col("step") <= crash, F.least(next_, F.lit(crash))).otherwise(next_)
    last = ledger.agg(F.max("step").alias("last"))
    return ledger.crossJoin(F.broadcast(last)).select("batch_id", "step", F.when(saved <= F.col("last"), saved).alias("first_saved"))  # one row


def fork(batches_: DataFrame, consumed: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The batches that are not in the checkpoint's consumed set (consumed_sets), whatever their order, with the branch's name."""
    c = checkpoint.select(F.col("step").alias("fork_step"))
    done = consumed.join(F.broadcast(c), F.col("first_saved") <= F.col("fork_step"), "left_semi").select("batch_id")  # one row
    rows = batches_.join(done, "batch_id", "left_anti").crossJoin(F.broadcast(c))
    return rows.select("fork_step", F.format_string("branch_from_step_%06d", "fork_step").alias("branch"), "batch_index", "batch_id")


def fingerprint() -> Column:
    return joined_hash(F.col("batch_id"), F.col("batch_index"), F.col("sample_ids"), F.col("input_hash"), F.col("seq_count"))


def replay(original: DataFrame, again: DataFrame) -> DataFrame:
    """Full outer comparison of two batch tables by index: a row for every batch of either."""
    a = original.select("batch_index", F.col("batch_id").alias("original_id"), fingerprint().alias("original_hash"))
    b = again.select("batch_index", F.col("batch_id").alias("replay_id"), fingerprint().alias("replay_hash"))
    note = F.when(F.col("original_id").isNull(), "extra batch in replay").when(F.col("replay_id").isNull(), "missing batch in replay").otherwise("")
    rows = a.join(b, "batch_index", "full_outer").withColumn("note", note)
    return rows.select("batch_index", F.coalesce("original_id", "replay_id").alias("batch_id"), "original_hash", "replay_hash", F.coalesce(F.col("original_hash") == F.col("replay_hash"), F.lit(False)).alias("match"), "note")
