"""The whole data path in one call: `python -m lanewright.plans.run SF_DIR OUT` writes every artifact, the evidence and a report."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import audit, ledger, merkle
from lanewright.plans import queries as q
from lanewright.plans import verify_queries
from lanewright.plans.params import P
from lanewright.sources.commits import CommitLog
from lanewright.sources.tables import laned_documents, missing_files, read_shards, write_shards

log = logging.getLogger("lanewright")

#: Artifact, and the function of (spark, sf_dir) that gives its rows; written in this order over what was there.
def resume_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the run itself; the query that also tries a faulty ledger is a demonstration."""
    return q.t8_resume_audit(spark, sf_dir).where("run = 'clean'")


ARTIFACTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifests/datasets": q.s8_dataset_manifests,
    "manifests/tokenizer": q.s8_tokenizer_manifest,
    "audits/firewall_events": q.p4_firewall_events,
    "audits/firewall_report": q.a16_firewall_report,
    "audits/selection": q.p6_selection_decisions,
    "reports/packing": q.pack_report,
    "reports/packing_validation": q.a1_packing_validation,
    "batches": q.w5_batches,
    "reports/mixture": q.a4_mixture_deviation,
    "reports/floors": q.a5_floor_audit,
    "reports/curriculum": q.a6_curriculum_report,
    "audits/resume": resume_audit,
    "audits/fork": q.t10_fork,
    "audits/traceability": q.v3_forward_traceability,
    "audits/verification": q.v5_final_verification,
    "evidence": q.v6_evidence,
}

#: Tables of the log that are committed together: the ledgers, and the saved state that they belong to.
LEDGERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "consumption": q.t4_consumption_ledger,
    "learning": q.t5_learning_ledger,
    "checkpoints": q.s9_checkpoints,
    "consumed": verify_queries.w9_consumed_sets,
    "scheduler": verify_queries.s9_sampler_states,
}


def commit_ledgers(spark: SparkSession, sf_dir: str, log: CommitLog, info: dict, crash: Callable[[str], None] = lambda _: None) -> int:
    """Writes LEDGERS as the log's next version: all of them or, if anything fails, none."""
    tx = log.begin()
    for name, build in LEDGERS.items():
        crash(name)
        tx.write(name, build(spark, sf_dir))
    return tx.commit(info, crash)


def store_batches(spark: SparkSession, sf_dir: str, out: str) -> None:
    """The batches' fingerprints, from the texts, and their hash tree, kept for replay."""
    prints = q.printed(q.Corpus(spark, sf_dir, keep=True)).select("batch_index", "batch_id", ledger.fingerprint().alias("fingerprint"))
    prints.write.mode("overwrite").parquet(f"{out}/replay/stored")
    merkle.write_tree(spark.read.parquet(f"{out}/replay/stored").select(F.col("batch_index").alias("node"), F.col("fingerprint").alias("hash")), f"{out}/replay/tree")


def replay(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """The batches that differ from the stored ones when they are computed from the texts again (none: the replay is exact)."""
    again = q.printed(q.Corpus(spark, sf_dir, keep=True)).select(F.col("batch_index").alias("node"), ledger.fingerprint().alias("hash"))
    merkle.write_tree(again, f"{out}/replay/again")
    found, _ = merkle.differences(spark, f"{out}/replay/tree", f"{out}/replay/again")
    return found.withColumnRenamed("node", "batch_index")


def throughput(batches: int, samples: int, tokens: int, seconds: float) -> dict[str, float]:
    """Rates of a run, its packing efficiency and mean use of a sequence."""
    rate = lambda n: round(n / (seconds + 1e-9), 2)
    used = tokens / (samples * P.context) if samples else 0.0
    return {"batches_per_sec": rate(batches), "samples_per_sec": rate(samples), "tokens_per_sec": rate(tokens), "packing_efficiency": round(used, 4), "average_sequence_tokens": round(used * P.context, 1)}


def markdown(evidence: list[tuple[str, bool, str]], rates: dict[str, float]) -> str:
    rows = "\n".join(f"| {name} | {'PASS' if ok else 'FAIL'} | {figure} |" for name, ok, figure in evidence)
    return f"# Evidence\n\n| Requirement | Result | Figure |\n|---|---|---|\n{rows}\n\n# Throughput\n\n" + "\n".join(f"- {k}: {v}" for k, v in rates.items()) + "\n"


def verify(spark: SparkSession, out: str) -> None:
    """Raises unless the shards under `out` are what their manifests say."""
    found = audit.observed_manifests(read_shards(spark, f"{out}/shards"))
    errors = audit.manifest_errors(spark.read.parquet(f"{out}/manifests/shards"), found)
    errors.write.mode("overwrite").parquet(f"{out}/audits/manifests")
    audit.require(spark.read.parquet(f"{out}/audits/manifests"), "shards differ from their manifests")


def run(spark: SparkSession, sf_dir: str, out: str, keep_shards: bool = False) -> dict[str, object]:
    """Writes shards and all artifacts under `out`; returns the verdict, which also lists artifacts that are not there.

    The shards are read back and compared with their manifests before anything is packed: a fault ends the run.
    """
    began = time.time()
    if not keep_shards:
        write_shards(laned_documents(spark, sf_dir).withColumn("tokenizer_hash", audit.tokenizer_hash()), f"{out}/shards")
        q.s2_shard_manifests(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/manifests/shards")
    verify(spark, out)
    # What the ledgers record of time is of the run, not of the data, and no hash holds it.
    spark.createDataFrame([(datetime.now(timezone.utc).isoformat(),)], "started_at string").coalesce(1).write.mode("overwrite").json(f"{out}/started")
    for name, build in ARTIFACTS.items():
        log.info("writing %s", name)
        build(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
    commit_ledgers(spark, sf_dir, CommitLog(spark, f"{out}/log"), {"steps": P.steps})
    store_batches(spark, sf_dir, out)
    replay(spark, sf_dir, out).write.mode("overwrite").parquet(f"{out}/replay/log")
    total = spark.read.parquet(f"{out}/batches").groupBy().sum("seq_count", "real_token_count").first()
    rates = throughput(spark.read.parquet(f"{out}/batches").count(), total[0] or 0, total[1] or 0, time.time() - began)
    evidence = [tuple(r) for r in spark.read.parquet(f"{out}/evidence").select("requirement", "passed", "evidence").collect()]  # nine rows
    required = spark.read.parquet(f"{out}/audits/verification").collect()  # nine rows
    failed = sorted({name for name, ok, _ in evidence if not ok} | {r["requirement"] for r in required if not r["passed"]})
    if not spark.read.parquet(f"{out}/replay/log").isEmpty():
        failed.append("replay_of_stored_batches")
    missing = missing_files(spark, [f"{name}/_SUCCESS" for name in (*ARTIFACTS, "replay/log")], out)
    missing += [f"log/{name}" for name in LEDGERS if name not in CommitLog(spark, f"{out}/log").state()["tables"]]
    text = spark.createDataFrame([(markdown(evidence, rates),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{out}/evidence_md")
    verdict = {"result": "FAIL" if missing or failed else "PASS", "failed": failed, "missing": missing, "throughput": rates, "tokenizer": audit.TOKENIZER, "steps": P.steps}
    spark.createDataFrame([(json.dumps(verdict),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/verdict")
    return verdict


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    print(json.dumps(run(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2])))
