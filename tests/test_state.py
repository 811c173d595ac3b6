"""Keyed streaming state, the commit log, hash trees and the shard-file source, with crashes and faults put in."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from compare import DATA, connection, difference
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import ledger, merkle
from lanewright.plans import run, state_queries
from lanewright.plans.queries import ORACLE, QUERIES
from lanewright.sources import shard_source
from lanewright.sources.commits import CommitLog, Conflict
from lanewright.streaming import state

SMALL = f"{DATA}/sf0.001"


class Stop(RuntimeError):
    pass


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n].__module__ == state_queries.__name__])
def test_query_equals_sql(spark: SparkSession, name: str) -> None:
    assert difference(QUERIES[name](spark, SMALL), connection(SMALL), ORACLE[name]) == ""


def test_stateful_ledger(spark: SparkSession, tmp_path) -> None:
    rng = random.Random(1)
    rows = [(k, f"b{k}", 4, 512, rng.randrange(500)) for k in range(600)]
    feeds = [rows[:200] + rows[:20], rows[150:400], rows[390:600] + [(7, None, 1, 1, 1), (None, "x", 1, 1, None)], rows[::5]]
    for k, feed in enumerate(feeds):
        spark.createDataFrame(feed, state.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        left = {(k, "after"), (k, "before")}

        def crash(epoch: int, when: str, left: set = left) -> None:
            if (epoch, when) in left:
                left.remove((epoch, when))
                raise Stop

        for tries in range(3):  # killed after the write, before the write, then to the end
            try:
                state.consume(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", crash, ttl_ms=None).awaitTermination()
            except Exception as error:
                assert "Stop" in str(error) and tries < 2
        assert not left
    got = state.read_ledger(spark, f"{tmp_path}/out").collect()
    want = {r[:2] for r in rows} | {(7, ""), (None, "x")}
    assert len(got) == len(want) and {(r["batch_index"], r["batch_id"]) for r in got} == want
    for block in (0, 1, 2):
        own = [r for r in got if r["block"] == block]
        assert max(r["block_batches"] for r in own) == len(own) and max(r["block_tokens"] for r in own) == sum(r["real_token_count"] for r in own)


def test_state_expires(spark: SparkSession, tmp_path) -> None:
    for n in (1, 2):
        spark.createDataFrame([(1, "b1", 4, 512, 5)], state.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        running = state.consume(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", ttl_ms=1)
        try:
            ends = time.time() + 60
            while time.time() < ends and not (os.path.exists(f"{tmp_path}/out") and state.read_ledger(spark, f"{tmp_path}/out").count() == n):
                time.sleep(1)
        finally:
            running.stop()
    assert state.read_ledger(spark, f"{tmp_path}/out").count() == 2  # the id was forgotten between the two runs


def test_commits(spark: SparkSession, tmp_path) -> None:
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.versions() == [] and log.state()["version"] == 0
    with pytest.raises(LookupError):
        log.read("ledger")
    first = log.begin()
    first.write("ledger", spark.range(5))
    first.write("checkpoint", spark.range(1))
    assert first.commit({"step": 4}) == 1 and log.read("ledger").count() == 5 and log.state()["info"] == {"step": 4}
    for at in ("describe", "rename", "done"):  # a crash at every point of a commit: neither table moves, or both do
        tx = log.begin()
        tx.write("ledger", spark.range(2), append=True)
        tx.write("checkpoint", spark.range(3))

        def crash(step: str, at: str = at) -> None:
            if step == at:
                raise Stop

        before = log.read("ledger").count(), log.read("checkpoint").count()
        with pytest.raises(Stop):
            tx.commit(crash=crash)
        after = log.read("ledger").count(), log.read("checkpoint").count()
        assert after == (before if at != "done" else (7, 3))
    one, two = log.begin(), log.begin()
    one.write("ledger", spark.range(1))
    two.write("checkpoint", spark.range(9))
    assert one.commit() == 3
    with pytest.raises(Conflict):
        two.commit()
    assert log.read("ledger").count() == 1 and log.read("checkpoint").count() == 3 and log.read("ledger", 2).count() == 7
    with pytest.raises(ValueError, match="columns"):
        log.begin().write("ledger", spark.range(1).withColumn("more", F.lit(1)), append=True)
    folders = len(list((tmp_path / "log" / "data").iterdir()))
    log.remove_before(3)
    assert log.versions() == [3] and len(list((tmp_path / "log" / "data").iterdir())) < folders
    assert log.read("ledger").count() == 1 and not list((tmp_path / "log" / "versions").glob("*.tmp"))
    with pytest.raises(LookupError):
        log.read("ledger", 1)


def test_run_commits_all_ledgers_or_none(spark: SparkSession, tmp_path) -> None:
    log = CommitLog(spark, f"{tmp_path}/log")
    for at in ("learning", "rename"):

        def crash(step: str, at: str = at) -> None:
            if step == at:
                raise Stop

        with pytest.raises(Stop):
            run.commit_ledgers(spark, SMALL, log, {}, crash)
        assert log.versions() == []
    assert run.commit_ledgers(spark, SMALL, log, {}) == 1
    assert log.read("consumption").count() == log.read("consumed").count() > 0 and log.read("checkpoints").count() > 0
    log.sweep()
    assert log.read("learning").count() > 0


def leaves(spark: SparkSession, hashes: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(hashes.items()), "node long, hash string").repartition(3)


def test_merkle(spark: SparkSession, tmp_path) -> None:
    rows = {k: f"h{k}" for k in range(1000)}
    merkle.write_tree(leaves(spark, rows), f"{tmp_path}/stored")
    assert merkle.height(spark, f"{tmp_path}/stored") == 3
    for k, change in enumerate(({}, {5: "x"}, {5: "x", 6: "y", 900: "z"}, {17: None}, {1000: "new", 5000: "far"}, {j: None for j in range(10, 1000)})):
        now = {n: h for n, h in (rows | change).items() if h is not None}
        merkle.write_tree(leaves(spark, now), f"{tmp_path}/again{k}")
        found, visited = merkle.differences(spark, f"{tmp_path}/stored", f"{tmp_path}/again{k}")
        assert {(r["node"], r["stored_hash"], r["again_hash"]) for r in found.collect()} == {(n, rows.get(n), now.get(n)) for n in rows.keys() | now.keys() if rows.get(n) != now.get(n)}
        if k < 2:
            assert visited == ([1, 0, 0, 0] if k == 0 else [1, 4, 16, 16])  # below the top only children of what differs
    empty = leaves(spark, {0: "a"}).where("false")
    merkle.write_tree(empty, f"{tmp_path}/empty")
    assert merkle.differences(spark, f"{tmp_path}/empty", f"{tmp_path}/empty")[0].count() == 0


def test_replay_of_stored_batches(spark: SparkSession, tmp_path) -> None:
    run.store_batches(spark, SMALL, str(tmp_path))
    assert run.replay(spark, SMALL, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") == 0, F.concat(F.lit("changed"), "text")).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/tables/documents.parquet")
    found = run.replay(spark, f"{tmp_path}/tables", str(tmp_path))
    assert [r["batch_index"] for r in found.collect()] == [0]
    assert ledger.fingerprint() is not None


def test_shard_source(spark: SparkSession, tmp_path) -> None:
    rows = [(f"s{k % 5}", "LANE", k, f"text {k}\n\"quoted\" é😀  ") for k in range(200)] + [("s1", "LANE", None, None), ("s2", "LANE", 7, ""), ("s2", "LANE", 7, "")]
    docs = spark.createDataFrame(rows, shard_source.COLUMNS).repartition(4)
    at = f"{tmp_path}/shards"
    shard_source.write_shard_files(docs, at)
    assert sorted(os.listdir(at)) == [f"s{k}.json" for k in range(5)]
    got = shard_source.read_shard_files(spark, at)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    whole = json.loads((tmp_path / "shards" / "s2.json").read_text())
    assert whole["manifest"]["document_count"] == len(whole["documents"]) == 42
    half, rest = got.where("shard_id in ('s0', 's1')"), got.where("shard_id = 's2'")
    assert (half.count(), rest.count(), got.count(), half.union(got).count()) == (81, 42, 203, 284)  # filters of one scan leave others alone
    # Shards asked for by name are opened alone: the others can be broken and nobody notices.
    only = lambda *names: shard_source.read_shard_files(spark, at, list(names))
    for k in (0, 1, 3):
        (tmp_path / "shards" / f"s{k}.json").write_text("not JSON")
    assert only("s2").count() == 42 and only("s2", "s4").where("doc_id > 100").count() == 40
    assert only("none").count() == 0 and only().count() == 0
    with pytest.raises(Exception, match="JSON|Expecting"):
        got.count()
    # Another layout of the same object is read too.
    (tmp_path / "shards" / "s3.json").write_text(json.dumps({"manifest": {"shard_id": "s3"}, "documents": [{"doc_id": 1, "dataset": "L", "text": "a"}]}, indent=2))
    assert [tuple(r) for r in only("s3").collect()] == [("s3", "L", 1, "a")]
    # A failed write leaves what was there; a shard in two tasks is refused.
    with pytest.raises(Exception, match="two tasks|follow each other"):
        docs.where("shard_id = 's2'").repartition(4, "doc_id").write.format(shard_source.NAME).mode("overwrite").save(at)
    with pytest.raises(Exception, match="cannot name"):
        shard_source.write_shard_files(docs.withColumn("shard_id", F.lit("../x")), at)
    assert only("s2").count() == 42 and not os.path.exists(f"{at}/_parts")
    shard_source.write_shard_files(docs.where("shard_id = 's0'"), at)
    assert os.listdir(at) == ["s0.json"]
    assert shard_source.read_shard_files(spark, f"{tmp_path}/nothing").count() == 0
