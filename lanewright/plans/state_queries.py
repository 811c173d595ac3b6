"""Registered queries of keyed streaming state, committed ledgers, shard files and replay against what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import ledger, merkle
from lanewright.plans.params import P
from lanewright.plans.queries import Corpus, printed, query
from lanewright.sources.commits import CommitLog
from lanewright.sources.shard_source import read_shard_files, write_shard_files
from lanewright.sources.shared import shared_folder
from lanewright.sources.tables import laned_documents, table
from lanewright.streaming import state


class Crash(RuntimeError):
    """Raised on purpose."""


@query(f"SELECT batch_index, batch_id, seq_count, token_count, real_token_count, step, count(*) OVER (PARTITION BY batch_index // {state.WIDTH}) AS block_batches, CAST(sum(real_token_count) OVER (PARTITION BY batch_index // {state.WIDTH}) AS BIGINT) AS block_tokens FROM batches")
def t3_stateful_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 and T7: all batches arrive, a third of them twice; the stream is killed after a write and before one, and started again each time."""
    at = shared_folder(spark)
    rows = Corpus(spark, sf_dir).batches().select("batch_index", "batch_id", "seq_count", "token_count", "real_token_count")
    twice = rows.withColumn("copy", F.explode(F.when(F.col("batch_index") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    twice.repartition(4, "batch_index", "copy").drop("copy").write.parquet(f"{at}/batches")
    left = {(1, "after"), (2, "before")}

    def crash(epoch: int, when: str) -> None:
        if (epoch, when) in left:
            left.remove((epoch, when))
            raise Crash

    for last in (False, False, True):
        try:
            state.consume(spark, f"{at}/batches", f"{at}/ledger", f"{at}/state", crash).awaitTermination()
        except Exception as error:
            if last or "Crash" not in str(error):
                raise
    kept = state.read_ledger(spark, f"{at}/ledger")
    totals = kept.groupBy("block").agg(F.max("block_batches").alias("block_batches"), F.max("block_tokens").alias("block_tokens"))
    return kept.drop("block_batches", "block_tokens", "epoch").join(totals, "block").drop("block")


@query(
    f"""SELECT c.step, c.batch_id, c.consumed, c.state_hash, count(l.step) AS ledger_rows, CAST(coalesce(sum(l.real_token_count), 0) AS BIGINT) AS tokens, count(l.step) AS in_set
FROM cps c LEFT JOIN batches l ON l.step <= c.step WHERE c.step <= {P.crash_at} GROUP BY ALL"""
)
def s9_committed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger, checkpoint and consumed set up to each checkpoint before the crash, committed together; each commit is tried once with a
    crash before its rename, which must leave neither. A row a checkpoint, of what its version holds."""
    c = Corpus(spark, sf_dir)
    steps = c.batch_steps().select("step", "batch_id", "real_token_count")
    steps = steps.where(F.col("step") <= P.crash_at)
    log = CommitLog(spark, shared_folder(spark))
    saved = ledger.checkpoints(steps).drop("name")
    out, before = [], -1
    for step in [r["step"] for r in saved.select("step").orderBy("step").collect()]:  # three, whatever the input
        for fails in (True, False):
            tx = log.begin()
            tx.write("ledger", steps.where((F.col("step") > before) & (F.col("step") <= step)), append=True)
            tx.write("consumed", steps.where((F.col("step") > before) & (F.col("step") <= step)).select("batch_id"), append=True)
            tx.write("checkpoint", saved.where(F.col("step") == step))

            def crash(at: str, fails: bool = fails) -> None:
                if fails and at == "rename":
                    raise Crash

            version = log.state()["version"]
            try:
                tx.commit({"step": step}, crash)
            except Crash:
                assert log.state()["version"] == version
        before = step
    log.sweep()
    for version in log.versions():
        totals = log.read("ledger", version).agg(F.count("*").alias("ledger_rows"), F.sum("real_token_count").alias("tokens"))
        sets = log.read("consumed", version).agg(F.count_distinct("batch_id").alias("in_set"))
        out.append(log.read("checkpoint", version).crossJoin(totals).crossJoin(sets))  # single rows
    rows = out[0] if out else saved.where("false").selectExpr("*", "0L AS ledger_rows", "0L AS tokens", "0L AS in_set")
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


@query("SELECT doc_id, shard_id, lane AS dataset, length(text) AS n_chars FROM laned")
def s4_shard_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shard files through the data source and read back through it."""
    at = shared_folder(spark)
    write_shard_files(laned_documents(spark, sf_dir).select("shard_id", F.col("lane").alias("dataset"), "doc_id", "text"), at)
    return read_shard_files(spark, at).select("doc_id", "shard_id", "dataset", F.length("text").alias("n_chars"))


@query("SELECT DISTINCT batch_index, printf('batch_%06d', batch_index) AS batch_id FROM tover WHERE doc_id % 97 = 5 AND skip = 0")
def t9_merkle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are computed and their hash tree is stored; then the first token of every 97th document changes, and replay from the
    changed texts must name just the batches that hold one, by descent from the top of the tree."""
    at = shared_folder(spark)
    merkle.write_tree(printed(Corpus(spark, sf_dir, keep=True)).select(F.col("batch_index").alias("node"), ledger.fingerprint().alias("hash")), f"{at}/stored")
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 97 == 5, F.regexp_replace("text", r"\A([\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*)(?=[^\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])", "$1changed")).otherwise(F.col("text"))
    docs.withColumn("text", changed).write.parquet(f"{at}/tables/documents.parquet")
    again = printed(Corpus(spark, f"{at}/tables", keep=True))
    merkle.write_tree(again.select(F.col("batch_index").alias("node"), ledger.fingerprint().alias("hash")), f"{at}/again")
    found, _ = merkle.differences(spark, f"{at}/stored", f"{at}/again")
    return found.select(F.col("node").alias("batch_index"), F.format_string("batch_%06d", "node").alias("batch_id"))
