"""The registered queries of the data-path operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.functions.columns import sorted_join, token_ids, word_counts, words
from lanewright.operators import audit, ledger, mixture, packing
from lanewright.operators.ordered import prefix_sum
from lanewright.plans.oracle import WORDS, sql
from lanewright.plans.params import FLOORS, STAGES, P
from lanewright.sources.shared import materialised, shared_folder
from lanewright.sources.tables import laned_documents, lanes, read_shards, table, write_shards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
C, B = P.context, P.batch


def query(text: str | None, plain: bool = False) -> Callable[[Query], Query]:
    """Registers the function under its name, with its SQL (over the common table expressions unless `plain`)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text if plain else sql(text)
        return f

    return add


class Corpus:
    """The frames that most queries start from. With `keep` those of rows and batches are written once, for queries that read them many times;
    with `digest` the texts' digests are written with their token counts, for queries that need both."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False, digest: bool = False) -> None:
        self.spark, self.dir, self.keep, self.digest = spark, sf_dir, keep, digest
        self._counted: DataFrame | None = None
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.keep:
            return make()
        if name not in self._kept:
            self._kept[name] = materialised(make())
        return self._kept[name]

    def docs(self) -> DataFrame:
        return table(self.spark, self.dir, "documents")

    def tokens(self) -> DataFrame:
        """Token counts, written once: the texts are read a single time however often a query needs them."""
        return self._texts().drop("h")

    def _texts(self) -> DataFrame:
        if self._counted is None:
            self._counted = materialised(packing.token_counts(self.spark, self.dir, digest=self.digest))
        return self._counted

    def digests(self) -> DataFrame:
        return self._texts().drop("n") if self.digest else laned_documents(self.spark, self.dir).select(*packing.SHARD, "doc_id", packing.text_digest().alias("h"))

    def totals(self) -> DataFrame:
        return packing.shard_totals(self.tokens())

    def offs(self) -> DataFrame:
        return self._once("offs", lambda: packing.offsets(self.tokens()))

    def over(self) -> DataFrame:
        return packing.overlaps(self.offs())

    def seqs(self) -> DataFrame:
        return self._once("seqs", lambda: packing.sequences(self.over()))

    def bases(self) -> DataFrame:
        return self._once("bases", lambda: packing.shard_bases(self.tokens()))

    def training_over(self) -> DataFrame:
        return packing.in_batches(self.over(), self.bases())

    def training_seqs(self) -> DataFrame:
        return packing.in_batches(self.seqs(), self.bases())

    def batches(self) -> DataFrame:
        return self._once("batches", lambda: ledger.batches(self.training_seqs()))

    def batch_steps(self) -> DataFrame:
        return self.batches().withColumn("step", F.col("batch_index"))

    def consumption(self) -> DataFrame:
        return self._once("consumption", lambda: ledger.consumption(self.training_over(), self.training_seqs()))

    def learning(self) -> DataFrame:
        return ledger.learning(self.training_seqs())

    def checkpoints(self) -> DataFrame:
        return ledger.checkpoints(self.batch_steps())

    def manifests(self) -> DataFrame:
        return audit.manifests(self.totals(), packing.content_hashes(self.digests()))

    def observed(self) -> DataFrame:
        """Manifests with planted faults: a count off by one, a changed hash, a lost tokenizer hash, a missing shard."""
        m, k = self.manifests(), F.col("shard_index") % 7
        return m.where(k != 6).select("shard_id", "dataset", (F.col("document_count") + F.when(k == 3, 1).otherwise(0)).alias("document_count"), F.when(k == 4, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(k != 5, F.col("tokenizer_hash")).alias("tokenizer_hash"))

    def written_shards(self, change: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> tuple[DataFrame, DataFrame]:
        """Manifests, and what is found in the shards after they were written and read back; `change` spoils what is written."""
        at = shared_folder(self.spark)
        self.manifests().write.parquet(f"{at}/manifests")
        docs = laned_documents(self.spark, self.dir).withColumn("tokenizer_hash", audit.tokenizer_hash())
        write_shards(change(docs), f"{at}/shards")
        return self.spark.read.parquet(f"{at}/manifests"), audit.observed_manifests(read_shards(self.spark, f"{at}/shards"))

    def decisions(self) -> DataFrame:
        return audit.selection(self.digests().where("lane = 'OPUS'"))

    def drawn(self) -> DataFrame:
        return mixture.sampled(self.spark)


# Scans, shards and catalogues


@query(f"SELECT shard_id, lane, docs, tokens, seqs, seqs * {C} - tokens AS pad, round(tokens / (seqs * {C}), 4) AS efficiency FROM totals")
def pack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Corpus(spark, sf_dir).totals()
    return t.select("shard_id", "lane", "docs", "tokens", "seqs", (F.col("seqs") * C - F.col("tokens")).alias("pad"), F.round(F.col("tokens") / (F.col("seqs") * C), 4).alias("efficiency"))


@query("SELECT shard_id, dataset, document_count, content_hash, tokenizer_hash, shard_index, is_eval FROM manifest")
def s2_shard_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).manifests()


@query("""SELECT lane, part, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
  SELECT lane, doc_id, least((row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1) // greatest(1, count(*) OVER (PARTITION BY lane) // 3), 2) AS part FROM laned) GROUP BY ALL""")
def s3_contiguous_split(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    docs = laned_documents(spark, sf_dir).select("lane", "doc_id", F.lit(1).alias("one"))
    ranked = prefix_sum(docs, ["lane"], "doc_id", "one", "before")
    sizes = docs.groupBy("lane").agg(F.greatest(F.lit(1), F.floor(F.count("*") / parts)).alias("size"))
    rows = ranked.join(F.broadcast(sizes), "lane")  # a row a lane
    return rows.withColumn("part", F.least(F.floor(F.col("before") / F.col("size")), F.lit(parts - 1))).groupBy("lane", "part").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("SELECT doc_id, length(text) AS n_chars FROM laned WHERE shard_id = 'CODE_shard_002'")
def s4_shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laned_documents(spark, sf_dir).where("shard_id = 'CODE_shard_002'").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT m.dataset, sum(document_count)::BIGINT AS doc_count, count(*) AS num_shards, bool_and(is_eval) AS is_eval, any_value(h.hash) AS dataset_hash
FROM manifest m JOIN (SELECT dataset, sha256(sha256(sha256(string_agg(content_hash, chr(10) ORDER BY shard_index)))) AS hash FROM manifest GROUP BY ALL) h USING (dataset) GROUP BY m.dataset""")
def s8_dataset_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dataset_manifests(Corpus(spark, sf_dir).manifests())


@query("SELECT count(*) AS total_shards, count_if(is_eval) AS eval_shards, string_agg(shard_id, ',' ORDER BY shard_id) AS shards FROM totals")
def s8_master_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = laned_documents(spark, sf_dir).select("shard_id", "is_eval").distinct()
    return shards.agg(F.count("*").alias("total_shards"), F.count_if("is_eval").alias("eval_shards"), F.array_join(F.sort_array(F.collect_list("shard_id")), ",").alias("shards"))


@query(f"SELECT sha256('{audit.TOKENIZER}') AS tokenizer_hash, {P.vocab} AS vocab_size, 0 AS pad_token_id, 'sha256_mod' AS encoding, 'v1' AS version")
def s8_tokenizer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(audit.tokenizer_hash().alias("tokenizer_hash"), F.lit(P.vocab).alias("vocab_size"), F.lit(0).alias("pad_token_id"), F.lit("sha256_mod").alias("encoding"), F.lit("v1").alias("version"))


@query("SELECT step, batch_id, consumed, name, state_hash FROM cps")
def s9_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).checkpoints()


@query("SELECT step, batch_id, consumed, state_hash FROM cps ORDER BY name DESC LIMIT 1")
def s10_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(Corpus(spark, sf_dir).checkpoints())


@query("""SELECT doc_id, len(w) AS n, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum, list_min(ids) AS id_min, list_max(ids) AS id_max FROM (
  SELECT doc_id, w, list_transform(w, lambda x: (""" + " + ".join(f"(CAST('0x' || substr(sha256(x), {at + 1}, {min(15, 64 - at)}) AS BIGINT) % 511) * {pow(16, 64 - at - min(15, 64 - at), 511)}" for at in range(0, 64, 15)) + """) % 511 + 1) AS ids FROM worded)""")
def f1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laned_documents(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), token_ids(F.col("w"), P.vocab).alias("ids"))
    return rows.select("doc_id", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.array_min("ids").alias("id_min"), F.array_max("ids").alias("id_max"))


# Projections and predicates


@query("SELECT shard_id, lane FROM totals WHERE NOT is_eval")
def p1_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laned_documents(spark, sf_dir).where("not is_eval").select("shard_id", "lane").distinct()


@query("SELECT shard_id, lane FROM totals WHERE is_eval")
def p2_eval_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laned_documents(spark, sf_dir).where("is_eval").select("shard_id", "lane").distinct()


@query("SELECT lane, lane IN ('EVAL', 'VALIDATION') AS by_name, is_eval, (lane IN ('EVAL', 'VALIDATION')) = is_eval AS agrees FROM lanes")
def p3_eval_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = audit.is_eval_lane(F.col("lane"))
    return lanes(spark).select("lane", by_name.alias("by_name"), "is_eval", (by_name == F.col("is_eval")).alias("agrees"))


@query("SELECT * FROM events_")
def p4_firewall_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.firewall_events(Corpus(spark, sf_dir).totals())


@query("SELECT shard_id, dataset FROM events_ WHERE event = 'FIREWALL_BLOCK'")
def p5_blocked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.firewall_events(Corpus(spark, sf_dir).totals()).where("event = 'FIREWALL_BLOCK'").select("shard_id", "dataset")


@query(f"SELECT doc_id, score, decision, CASE decision WHEN 'ACCEPT' THEN 'score >= {P.accept}' WHEN 'DEFER' THEN 'score in [{P.defer}, {P.accept})' ELSE 'score < {P.defer}' END AS reason FROM decided")
def p6_selection_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).decisions()


@query(f"SELECT shard_id, coalesce(tokenizer_hash = sha256('{audit.TOKENIZER}'), false) AS passed FROM observed")
def p8_tokenizer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).observed().select("shard_id", F.coalesce(F.col("tokenizer_hash") == audit.tokenizer_hash(), F.lit(False)).alias("passed"))


# Joins


@query("""SELECT m.shard_id, array_to_string(list_filter([
    CASE WHEN o.shard_id IS NULL THEN 'shard missing' END,
    CASE WHEN o.shard_id IS NOT NULL AND m.dataset IS DISTINCT FROM o.dataset THEN 'dataset differs' END,
    CASE WHEN o.shard_id IS NOT NULL AND m.document_count IS DISTINCT FROM o.document_count THEN 'document_count differs' END,
    CASE WHEN o.shard_id IS NOT NULL AND m.content_hash IS DISTINCT FROM o.content_hash THEN 'content_hash differs' END,
    CASE WHEN o.shard_id IS NOT NULL AND m.tokenizer_hash IS DISTINCT FROM o.tokenizer_hash THEN 'tokenizer_hash differs' END], lambda x: x IS NOT NULL), '; ') AS errors, m.shard_index % 7 NOT IN (3, 4, 5, 6) AS passed
FROM manifest m LEFT JOIN observed o ON m.shard_id = o.shard_id""")
def j1_manifest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return audit.manifest_errors(c.manifests(), c.observed())


@query("SELECT m.shard_id, m.document_count IS NOT DISTINCT FROM o.document_count AS count_matches, m.tokenizer_hash IS NOT DISTINCT FROM o.tokenizer_hash AS tokenizer_matches FROM manifest m JOIN observed o USING (shard_id)")
def j2_null_safe_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    o = c.observed().select("shard_id", F.col("document_count").alias("o_count"), F.col("tokenizer_hash").alias("o_tokenizer"))
    return c.manifests().join(o, "shard_id").select("shard_id", F.col("document_count").eqNullSafe(F.col("o_count")).alias("count_matches"), F.col("tokenizer_hash").eqNullSafe(F.col("o_tokenizer")).alias("tokenizer_matches"))


@query("SELECT step, batch_id FROM batches WHERE batch_index % 11 = 5")
def j3_consumption_without_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose index leaves 5 mod 11 are taken off the batch table first."""
    c = Corpus(spark, sf_dir)
    return c.batch_steps().join(c.batches().where("batch_index % 11 <> 5").select("batch_id"), "batch_id", "left_anti").select("step", "batch_id")


@query("SELECT b.step, b.batch_id, l.loss FROM batches b LEFT JOIN (SELECT step, max(loss) AS loss FROM learn GROUP BY ALL) l USING (step)")
def j4_consumption_with_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of several learning rows of a step counts."""
    c = Corpus(spark, sf_dir)
    last = c.learning().groupBy("step").agg(F.max_by("loss", "sample_index").alias("loss"))
    return c.batch_steps().join(last, "step", "left").select("step", "batch_id", "loss")


@query("SELECT DISTINCT batch_index AS step, doc_id FROM tover WHERE doc_id % 97 = 13")
def j5_untraceable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id leaves 13 mod 97 are taken off the document table first."""
    c = Corpus(spark, sf_dir)
    used = c.training_over().select(F.col("batch_index").alias("step"), "doc_id").distinct()
    return used.join(c.docs().where("doc_id % 97 <> 13").select("doc_id"), "doc_id", "left_anti").select("step", "doc_id")


@query("SELECT DISTINCT batch_index AS step, t.shard_id, s.lane FROM tover t JOIN (SELECT shard_id, lane FROM totals) s USING (shard_id)")
def j6_shard_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    used = c.training_over().select(F.col("batch_index").alias("step"), "shard_id").distinct()
    return used.join(c.totals().select("shard_id", "lane"), "shard_id").select("step", "shard_id", "lane")


@query("SELECT l.step, g.batch_id, l.sample_index, l.sample_loss, l.n_tokens, l.shard_id, g.n_samples FROM learn l JOIN ledger g USING (step)")
def j7_loss_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return c.learning().join(c.consumption().select("step", "batch_id", "n_samples"), "step").select("step", "batch_id", "sample_index", "sample_loss", "n_tokens", "shard_id", "n_samples")


@query("SELECT DISTINCT step FROM learn WHERE step % 13 = 7")
def j8_learning_without_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return c.learning().select("step").distinct().join(c.batch_steps().where("step % 13 <> 7").select("step"), "step", "left_anti")


@query("""SELECT batch_index, batch_id, CASE WHEN batch_index % 17 <> 4 THEN print END AS original_hash,
  CASE WHEN batch_index % 17 <> 9 THEN CASE WHEN batch_index % 17 = 2 THEN sha256(batch_id || '|' || batch_index || '|' || sample_ids || '|' || 'x' || substr(input_hash, 2) || '|' || seq_count) ELSE print END END AS replay_hash,
  batch_index % 17 NOT IN (2, 4, 9) AS match, CASE batch_index % 17 WHEN 4 THEN 'extra batch in replay' WHEN 9 THEN 'missing batch in replay' ELSE '' END AS note
FROM prints JOIN (SELECT batch_index, sample_ids, seq_count FROM ledger) USING (batch_index) JOIN inputs USING (batch_index)""")
def j9_replay_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay against a table with a lost, an extra and a changed batch in every 17."""
    rows, k = printed(Corpus(spark, sf_dir, keep=True)), F.col("batch_index") % 17
    again = rows.where(k != 9).withColumn("input_hash", F.when(k == 2, F.concat(F.lit("x"), F.substring("input_hash", 2, 63))).otherwise(F.col("input_hash")))
    return ledger.replay(rows.where(k != 4), again)


def printed(c: Corpus) -> DataFrame:
    hashes = packing.sequence_hashes(c.spark, c.dir, c.offs(), c.bases())
    return ledger.inputs(hashes).join(c.consumption().select("batch_index", "sample_ids"), "batch_index")


@query(f"SELECT {P.crash_at} AS fork_step, 'branch_from_step_{P.crash_at:06d}' AS branch, batch_index, batch_id FROM batches WHERE batch_index > {P.crash_at}")
def j10_future_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return ledger.fork(c.batches(), ledger.consumed_sets(c.batch_steps()), c.checkpoints().where(F.col("step") == P.crash_at))


@query(f"SELECT batch_id FROM batches WHERE step > {P.crash_at} ORDER BY step LIMIT 1")
def j11_first_unconsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    done = c.batch_steps().where(F.col("step") <= P.crash_at).select("batch_id")
    return c.batch_steps().join(done, "batch_id", "left_anti").agg(F.min_by("batch_id", "step").alias("batch_id")).where("batch_id is not null")


@query(f"SELECT min(batch_id) AS batch_id FROM batches WHERE step > {P.crash_at}")
def j12_first_after_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    before = c.batch_steps().where(F.col("step") <= P.crash_at).select("batch_id")
    after = c.batch_steps().join(before, "batch_id", "left_anti").join(c.consumption().select("batch_id"), "batch_id", "left_semi")
    return after.agg(F.min_by("batch_id", "step").alias("batch_id"))


@query("SELECT batch_index AS position, batch_id AS expected, CASE WHEN batch_index % 2 = 0 AND batch_index + 1 < total THEN printf('batch_%06d', batch_index + 1) WHEN batch_index % 2 = 1 THEN printf('batch_%06d', batch_index - 1) ELSE batch_id END AS processed FROM batches, (SELECT count(*) AS total FROM batches)")
def j13_positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against processed order by ordinal; in the processed order neighbours are swapped."""
    c = Corpus(spark, sf_dir)
    total = c.batches().agg(F.count("*").alias("total"))
    k = F.col("batch_index")
    place = F.when((k % 2 == 0) & (k + 1 < F.col("total")), k + 1).when(k % 2 == 1, k - 1).otherwise(k)
    done = c.batches().crossJoin(F.broadcast(total)).select(place.alias("position"), F.col("batch_id").alias("processed"))  # one row
    return c.batches().select(k.alias("position"), F.col("batch_id").alias("expected")).join(done, "position")


@query(f"SELECT step, batch_id, consumed, state_hash FROM cps ORDER BY abs(step - {P.fork_from}), step LIMIT 1")
def j14_nearest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.nearest(Corpus(spark, sf_dir).checkpoints(), P.fork_from)


@query("SELECT b.step, coalesce(s.stage, 'cooldown') AS stage FROM batches b LEFT JOIN stages s ON b.step >= s.lo AND b.step < s.hi")
def j15_step_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.staged(Corpus(spark, sf_dir).batch_steps().select("step")).select("step", "stage")


@query("SELECT 'consumption' AS ledger, batch_index AS step, lane FROM (SELECT seq // 4 AS batch_index, lane FROM over_) WHERE lane IN ('EVAL', 'VALIDATION') GROUP BY ALL UNION ALL SELECT 'learning', seq // 4, lane FROM seqs WHERE lane IN ('EVAL', 'VALIDATION') GROUP BY ALL")
def j16_ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger packed without the firewall (each shard's own batches), so evaluation lanes must be found."""
    c = Corpus(spark, sf_dir)
    step = F.floor(F.col("seq") / B).alias("step")
    return audit.ledger_violations(c.over().select(step, "lane"), c.seqs().select(step, "lane"))


# Windows and ordered computations


@query("SELECT shard_id, doc_id, n, off FROM offs")
def w1_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.offsets(Corpus(spark, sf_dir).tokens()).select("shard_id", "doc_id", "n", "off")


@query("SELECT shard_id, doc_id, seq, tokens, pos, skip FROM over_")
def w2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).over().select("shard_id", "doc_id", "seq", "tokens", "pos", "skip")


@query("SELECT shard_id, seq, array_to_string(list_concat(range(0, real), list_resize([]::BIGINT[], pad, 0)), ',') AS position_ids FROM seqs")
def w3_position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.lit(C - 1)), lambda i: F.when(i < F.col("real"), i).otherwise(0))
    return Corpus(spark, sf_dir).seqs().select("shard_id", "seq", F.array_join(ids.cast("array<string>"), ",").alias("position_ids"))


@query("SELECT shard_id, seq, repeat('1', CAST(real AS INT)) || repeat('0', CAST(pad AS INT)) AS mask, (SELECT string_agg(o.doc_id || 'x' || o.tokens, ',' ORDER BY o.pos) FROM over_ o WHERE o.shard_id = seqs.shard_id AND o.seq = seqs.seq) || CASE WHEN pad > 0 THEN ',PADx' || pad ELSE '' END AS segments FROM seqs")
def w4_mask_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.struct("pos", F.concat_ws("x", F.col("doc_id").cast("string"), F.col("tokens").cast("string")).alias("run"))
    rows = Corpus(spark, sf_dir).over().groupBy("shard_id", "seq").agg(F.sum("tokens").alias("real"), sorted_join(F.collect_list(runs), "run").alias("segments"))
    pad = F.lit(C) - F.col("real")
    mask = F.concat(F.repeat(F.lit("1"), F.col("real").cast("int")), F.repeat(F.lit("0"), pad.cast("int")))
    return rows.select("shard_id", "seq", mask.alias("mask"), F.when(pad > 0, F.concat(F.col("segments"), F.lit(",PADx"), pad.cast("string"))).otherwise(F.col("segments")).alias("segments"))


@query("SELECT batch_index, batch_id, seq_count, token_count, real_token_count FROM batches")
def w5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).batches().select("batch_index", "batch_id", "seq_count", "token_count", "real_token_count")


@query("SELECT step, lag_ AS from_stage, stage AS to_stage FROM (SELECT step, stage, coalesce(lag(stage) OVER (ORDER BY step), 'warmup') AS lag_ FROM (SELECT step, (SELECT stage FROM stages WHERE step >= lo AND step < hi) AS stage FROM steps40)) WHERE stage <> lag_")
def w6_stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the bounded list of sampler steps."""
    rows = mixture.staged(mixture.steps(spark, P.steps)).withColumn("from_stage", F.coalesce(F.lag("stage").over(Window.orderBy("step")), F.lit(STAGES[0][0])))
    return rows.where("stage <> from_stage").select("step", "from_stage", F.col("stage").alias("to_stage"))


@query(mixture.sampler_sql(spark=False), plain=True)
def t1_mixture_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 too: before_* are the lanes' shares among the draws before each."""
    return Corpus(spark, sf_dir).drawn()


@query("SELECT shard_id, seq, real FROM seqs WHERE seq < 4")
def w8_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sequences of each shard; their ordinal is their rank."""
    return Corpus(spark, sf_dir).seqs().where("seq < 4").select("shard_id", "seq", "real")


@query("SELECT name, consumed, (SELECT min(batch_id) FROM batches) AS first_batch, batch_id AS last_batch FROM cps")
def w9_consumed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).checkpoints().select("name", "consumed", F.format_string("batch_%06d", F.lit(0)).alias("first_batch"), F.col("batch_id").alias("last_batch"))


# Aggregations


@query(f"SELECT count(*) AS sequences, sum(real)::BIGINT AS real_tokens, sum(pad)::BIGINT AS pad_tokens, bool_and(real + pad = {C}) AS lengths_ok, round(sum(real) / (count(*) * {C}), 4) AS efficiency, sum(real)::BIGINT = (SELECT sum(n) FROM tok)::BIGINT AS conserved FROM seqs")
def a1_packing_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    total = c.tokens().agg(F.sum("n").alias("all_tokens"))
    s = c.seqs().agg(F.count("*").alias("sequences"), F.sum("real").alias("real_tokens"), F.sum("pad").alias("pad_tokens"), F.bool_and((F.col("real") + F.col("pad") == C) & (F.col("real") > 0)).alias("lengths_ok"))
    return s.crossJoin(total).select("sequences", "real_tokens", "pad_tokens", "lengths_ok", F.round(F.col("real_tokens") / (F.col("sequences") * C), 4).alias("efficiency"), (F.col("real_tokens") == F.col("all_tokens")).alias("conserved"))  # two single rows


@query(f"SELECT coalesce(shard_id, 'ALL') AS shard_id, count(*) AS sequences, sum(real)::BIGINT AS real_tokens, round(sum(real) / (count(*) * {C}), 4) AS efficiency FROM seqs GROUP BY ROLLUP (shard_id)")
def a2_packing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Corpus(spark, sf_dir).seqs().rollup("shard_id").agg(F.count("*").alias("sequences"), F.sum("real").alias("real_tokens"))
    return rows.select(F.coalesce("shard_id", F.lit("ALL")).alias("shard_id"), "sequences", "real_tokens", F.round(F.col("real_tokens") / (F.col("sequences") * C), 4).alias("efficiency"))


def _mix(text: str) -> str:
    """SQL over the sampler's draws as `drawn`."""
    walk = mixture.sampler_sql(spark=False).strip()
    return "WITH RECURSIVE " + sql("").strip().removeprefix("WITH ") + f", drawn AS (SELECT * FROM ({walk}))\n{text}"


@query(_mix(f"SELECT l.lane, count(d.step) AS draws, round(count(d.step) / {P.steps}, 4) AS actual, l.target AS planned, round(round(count(d.step) / {P.steps}, 4) - l.target, 4) AS deviation FROM lanes l LEFT JOIN drawn d USING (lane) WHERE NOT l.is_eval GROUP BY l.lane, l.target"), plain=True)
def a4_mixture_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 and J18 too: planned left-joined to actual shares."""
    counts = Corpus(spark, sf_dir).drawn().groupBy("lane").agg(F.count("*").alias("draws"))
    rows = lanes(spark).where("not is_eval").join(counts, "lane", "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
    actual = F.round(F.col("draws") / P.steps, 4)
    return rows.select("lane", "draws", actual.alias("actual"), F.col("target").alias("planned"), F.round(actual - F.col("target"), 4).alias("deviation"))


@query("SELECT lane, contrib_strict, round(contrib_strict / sum(contrib_strict) OVER (), 4) AS consumed_share FROM (SELECT lane, sum(contrib_strict)::BIGINT AS contrib_strict FROM contrib GROUP BY ALL)")
def a4_consumed_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Corpus(spark, sf_dir).training_over().groupBy("lane").agg(F.sum("tokens").alias("contrib_strict"))
    total = rows.agg(F.sum("contrib_strict").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("lane", "contrib_strict", F.round(F.col("contrib_strict") / F.col("total"), 4).alias("consumed_share"))  # one row


@query(_mix(f"SELECT f.lane, f.floor, round(count(d.step) / {P.steps}, 4) AS actual, round(count(d.step) / {P.steps}, 4) >= f.floor AS passed FROM floors f LEFT JOIN drawn d USING (lane) GROUP BY f.lane, f.floor"), plain=True)
def a5_floor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Corpus(spark, sf_dir).drawn().groupBy("lane").count()
    rows = spark.createDataFrame(list(FLOORS.items()), "lane string, floor double").join(counts, "lane", "left")
    actual = F.round(F.coalesce("count", F.lit(0)) / P.steps, 4)
    return rows.select("lane", "floor", actual.alias("actual"), (actual >= F.col("floor")).alias("passed"))


@query(_mix("SELECT s.stage, w.lane, count(d.step) AS draws, round(coalesce(count(d.step) / nullif(sum(count(d.step)) OVER (PARTITION BY s.stage), 0), 0), 4) AS share FROM stages s JOIN weights w USING (stage) LEFT JOIN drawn d ON d.stage = s.stage AND d.lane = w.lane GROUP BY s.stage, w.lane"), plain=True)
def a6_curriculum_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty stages stay."""
    counts = Corpus(spark, sf_dir).drawn().groupBy("stage", "lane").agg(F.count("*").alias("draws"))
    rows = mixture.stage_weights(spark).join(counts, ["stage", "lane"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
    total = F.sum("draws").over(Window.partitionBy("stage"))
    return rows.select("stage", "lane", "draws", F.round(F.when(total > 0, F.col("draws") / total).otherwise(0.0), 4).alias("share"))


@query(f"SELECT count(*) AS candidates, count_if(decision = 'ACCEPT') AS accepted, count_if(decision = 'DEFER') AS deferred, count_if(decision = 'REJECT') AS rejected, round(count_if(decision = 'ACCEPT') / count(*), 4) AS ratio, count_if(decision = 'ACCEPT') / count(*) < {P.opus_floor} AS overridden FROM decided")
def a7_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda d: F.count_if(F.col("decision") == d)
    ratio = one("ACCEPT") / F.count("*")
    return Corpus(spark, sf_dir).decisions().agg(F.count("*").alias("candidates"), one("ACCEPT").alias("accepted"), one("DEFER").alias("deferred"), one("REJECT").alias("rejected"), F.round(ratio, 4).alias("ratio"), (ratio < P.opus_floor).alias("overridden"))


@query("SELECT doc_id, score, CASE WHEN decision = 'DEFER' THEN 'ACCEPT' ELSE decision END AS decision, decision = 'DEFER' AS override FROM decided")
def a7_floor_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a floor above any share, so that the override must fire."""
    return audit.with_override(Corpus(spark, sf_dir).decisions(), 1.1).select("doc_id", "score", "decision", "override")


@query("SELECT step, lane, contrib_compat, contrib_strict FROM contrib")
def a8_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return ledger.contributions(c.training_over(), c.training_seqs())


@query("SELECT step, batch_id, seq_count, token_count, real_token_count, sample_ids, n_samples, shard_sources, datasets FROM ledger")
def t4_consumption_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, A9, A10 and A11 too: a step per batch until the pool is empty, with ordered distinct ids, shards and datasets."""
    return Corpus(spark, sf_dir).consumption().select("step", "batch_id", "seq_count", "token_count", "real_token_count", "sample_ids", "n_samples", "shard_sources", "datasets")


@query("SELECT batch_index, string_agg(x, ',' ORDER BY ord, pos) AS sources, count(*) AS n FROM (SELECT batch_index, doc_id || '@' || shard_id AS x, min(ord) AS ord, arg_min(pos, ord) AS pos FROM tover GROUP BY ALL) GROUP BY ALL")
def a12_batch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = Corpus(spark, sf_dir).training_over().groupBy("batch_index", "doc_id", "shard_id").agg(F.min(F.struct("ord", "pos")).alias("first"))
    item = F.struct("first", F.concat_ws("@", F.col("doc_id").cast("string"), "shard_id").alias("x"))
    return each.groupBy("batch_index").agg(sorted_join(F.collect_list(item), "x").alias("sources"), F.count("*").alias("n"))


@query("SELECT batch_index, input_hash FROM inputs")
def a13_input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return ledger.inputs(packing.sequence_hashes(spark, sf_dir, c.offs(), c.bases())).select("batch_index", "input_hash")


@query("SELECT count_if(event = 'FIREWALL_BLOCK') AS blocked, count_if(event = 'SHARD_ALLOWED') AS allowed, count_if(event = 'EVAL_SHARD_USED_FOR_EVAL') AS used_for_eval, array_to_string(list_sort(list(DISTINCT dataset) FILTER (event = 'FIREWALL_BLOCK')), ',') AS blocked_datasets FROM events_")
def a16_firewall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 too: the sorted list of blocked datasets."""
    e = audit.firewall_events(Corpus(spark, sf_dir).totals())
    one = lambda x: F.count_if(F.col("event") == x)
    return e.agg(one("FIREWALL_BLOCK").alias("blocked"), one("SHARD_ALLOWED").alias("allowed"), one("EVAL_SHARD_USED_FOR_EVAL").alias("used_for_eval"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("event") == "FIREWALL_BLOCK", F.col("dataset")))), ",").alias("blocked_datasets"))


@query("SELECT step, sample_index, loss, sample_loss, n_tokens FROM learn")
def t5_learning_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 too: real tokens of every sample."""
    return Corpus(spark, sf_dir).learning().select("step", "sample_index", "loss", "sample_loss", "n_tokens")


# Sets


@query("SELECT 'training' AS pool, count(*) AS shards FROM totals WHERE NOT is_eval UNION ALL SELECT 'evaluation', count(*) FROM totals WHERE is_eval")
def u1_union_of_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Corpus(spark, sf_dir).totals()
    return t.where("not is_eval").agg(F.lit("training").alias("pool"), F.count("*").alias("shards")).unionByName(t.where("is_eval").agg(F.lit("evaluation").alias("pool"), F.count("*").alias("shards")))


@query(f"SELECT batch_id FROM batches EXCEPT SELECT batch_id FROM batches WHERE step <= {P.crash_at}")
def u3_consumed_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Corpus(spark, sf_dir).batch_steps()
    return rows.select("batch_id").subtract(rows.where(F.col("step") <= P.crash_at).select("batch_id"))


@query(f"SELECT batch_id FROM batches WHERE step > {P.crash_at} INTERSECT SELECT batch_id FROM ledger WHERE step % 2 = 0")
def u4_not_before_but_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    before = c.batch_steps().where(F.col("step") <= P.crash_at).select("batch_id")
    after = c.batch_steps().where("step % 2 = 0").select("batch_id")
    return c.batches().select("batch_id").join(before, "batch_id", "left_anti").join(after, "batch_id", "left_semi")


@query("SELECT DISTINCT lane, shard_id FROM tover")
def u5_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laned_documents(spark, sf_dir).where("not is_eval").where(F.size(words(F.col("text"))) > 0).select("lane", "shard_id").distinct()


# Resume, replay, fork and verdicts


def _faulty(c: Corpus) -> DataFrame:
    """A ledger in which batch 3 came twice and batch 5 never."""
    rows = c.batch_steps().select("step", "batch_id")
    return rows.where("step <> 5").unionByName(rows.where("step = 3"))


@query(f"""SELECT 'clean' AS run, 0 AS duplicated, 0 AS missing, 0 AS unexpected, 0 AS gaps, (SELECT min(batch_id) FROM batches WHERE step > (SELECT max(step) FROM cps)) AS first_after, 'PASS' AS result
UNION ALL SELECT 'faulty', 1, 1, 0, 1, (SELECT min(batch_id) FROM batches WHERE step > (SELECT max(step) FROM cps)), 'FAIL'""")
def t8_resume_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir, keep=True)
    return _audited(c, c.batch_steps(), "clean").unionByName(_audited(c, _faulty(c), "faulty"))


def _audited(c: Corpus, run: DataFrame, name: str) -> DataFrame:
    """The audit of a ledger against the batches, after the latest checkpoint."""
    steps = lambda df: df.select("step", "batch_id")
    out = ledger.resume_audit(steps(run), steps(c.batch_steps()), ledger.latest(c.checkpoints())).withColumn("run", F.lit(name))
    return out.select("run", *(F.col(x).cast("int").alias(x) for x in ("duplicated", "missing", "unexpected", "gaps")), "first_after", "result")


@query("SELECT batch_index, batch_id, print AS original_hash, print AS replay_hash, true AS match, '' AS note FROM prints")
def t9_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are computed from the raw documents; neither reads the other's result."""
    return _replayed(Corpus(spark, sf_dir, keep=True))


def _replayed(c: Corpus) -> DataFrame:
    return ledger.replay(printed(c), printed(Corpus(c.spark, c.dir, keep=True)))


@query(f"SELECT n.step AS fork_step, printf('branch_from_step_%06d', n.step) AS branch, b.batch_index, b.batch_id FROM batches b, (SELECT step FROM cps ORDER BY abs(step - {P.fork_from}), step LIMIT 1) n WHERE b.batch_index > n.step")
def t10_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return ledger.fork(c.batches(), ledger.consumed_sets(c.batch_steps()), ledger.nearest(c.checkpoints(), P.fork_from))


@query("SELECT l.step, l.batch_id, l.n_samples, count(DISTINCT t.doc_id) AS traced, l.n_samples = count(DISTINCT t.doc_id) AS passed FROM ledger l LEFT JOIN tover t ON t.batch_index = l.step GROUP BY l.step, l.batch_id, l.n_samples")
def v3_forward_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of every step found again among the documents of a training shard."""
    c = Corpus(spark, sf_dir)
    known = laned_documents(spark, sf_dir).where("not is_eval").select("doc_id")
    ids = c.consumption().select("step", "batch_id", "n_samples", F.explode(F.split("sample_ids", ",").cast("array<bigint>")).alias("doc_id"))
    traced = ids.join(known, "doc_id", "left_semi").groupBy("step").agg(F.count_distinct("doc_id").alias("traced"))
    rows = c.consumption().select("step", "batch_id", "n_samples").join(traced, "step", "left").withColumn("traced", F.coalesce("traced", F.lit(0)))
    return rows.withColumn("passed", F.col("traced") == F.col("n_samples"))


@query(_mix(f"""SELECT 'tokenizer_integrity' AS requirement, bool_and(tokenizer_hash = sha256('{audit.TOKENIZER}')) AS passed FROM manifest
UNION ALL SELECT 'evaluation_firewall', NOT EXISTS (SELECT 1 FROM tover WHERE is_eval) AND (SELECT count_if(event = 'FIREWALL_BLOCK') FROM events_) = (SELECT count_if(is_eval) FROM totals)
UNION ALL SELECT 'packing_correctness', (SELECT sum(real) FROM seqs) = (SELECT sum(len({WORDS})) FROM documents) AND (SELECT bool_and(real + pad = {C}) FROM seqs)
UNION ALL SELECT 'mixture_compliance', (SELECT bool_and(n >= floor * {P.steps}) FROM (SELECT f.floor, count(d.step) AS n FROM floors f LEFT JOIN drawn d USING (lane) GROUP BY f.lane, f.floor))
UNION ALL SELECT 'opus_audit', count(*) = (SELECT count(*) FROM laned WHERE lane = 'OPUS') AND bool_and(score BETWEEN 0 AND 1) FROM decided
UNION ALL SELECT 'crash_recovery', (SELECT count(*) = count(DISTINCT batch_id) AND count(*) = max(step) + 1 FROM ledger)
UNION ALL SELECT 'replay', (SELECT count(*) FROM prints) = (SELECT count(*) FROM batches)
UNION ALL SELECT 'learning_trace', NOT EXISTS (SELECT 1 FROM learn l LEFT JOIN ledger g USING (step) WHERE g.step IS NULL)
UNION ALL SELECT 'throughput', (SELECT sum(real_token_count) > 0 FROM batches)"""), plain=True)
def v5_final_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine requirements, each a query over the data (P9, A15, V1, V2, V6): shards are written, read back and verified."""
    c = Corpus(spark, sf_dir, keep=True, digest=True)
    events = audit.firewall_events(c.totals()).agg(F.count_if(F.col("event") == "FIREWALL_BLOCK").alias("blocked")).crossJoin(c.totals().agg(F.count_if("is_eval").alias("evals")))  # two single rows
    violations = audit.firewall_audit(*ledger_fields(c)).agg(F.count("*").alias("n"))
    words_ = c.docs().agg(F.coalesce(F.sum(word_counts(F.col("text"))), F.lit(0)).alias("b"))
    floors = spark.createDataFrame(list(FLOORS.items()), "lane string, floor double").join(c.drawn().groupBy("lane").count(), "lane", "left")
    candidates = laned_documents(spark, sf_dir).where("lane = 'OPUS'").agg(F.count("*").alias("all"))
    traced = c.learning().join(c.batch_steps().select("step", "batch_id"), "step", "left").join(c.consumption().select("batch_id", F.lit(True).alias("there")), "batch_id", "left")
    parts = {
        "tokenizer_integrity": audit.manifest_errors(*c.written_shards()).agg(F.bool_and("passed").alias("passed")),
        "evaluation_firewall": events.crossJoin(violations).select(((F.col("blocked") == F.col("evals")) & (F.col("n") == 0)).alias("passed")),
        "packing_correctness": c.seqs().agg(F.sum("real").alias("a"), F.bool_and(F.col("real") + F.col("pad") == C).alias("ok")).crossJoin(words_).select(((F.col("a") == F.col("b")) & F.col("ok")).alias("passed")),
        "mixture_compliance": floors.agg(F.bool_and(F.coalesce("count", F.lit(0)) >= F.col("floor") * P.steps).alias("passed")),
        "opus_audit": c.decisions().agg(F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("ok")).crossJoin(candidates).select(((F.col("n") == F.col("all")) & F.coalesce("ok", F.lit(True))).alias("passed")),
        "crash_recovery": _audited(c, c.batch_steps(), "clean").select((F.col("result") == "PASS").alias("passed")),
        "replay": _replayed(c).agg(F.bool_and("match").alias("passed")),
        "learning_trace": traced.agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("passed")),
        "throughput": c.batches().agg((F.sum("real_token_count") > 0).alias("passed")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("requirement"), "passed") for name, df in parts.items()])


def ledger_fields(c: Corpus, guarded: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ledgers' fields as arrays and maps: of the training batches, or of a ledger packed without the firewall."""
    step = F.col("batch_index") if guarded else F.floor(F.col("seq") / B)
    over = (c.training_over() if guarded else c.over()).withColumn("step", step)
    seqs = (c.training_seqs() if guarded else c.seqs()).withColumn("step", step)
    lists = over.groupBy("step").agg(F.sort_array(F.collect_set("shard_id")).alias("shard_sources"))  # at most the sources of four sequences
    maps = ledger.contribution_maps(ledger.contributions(over.withColumn("batch_index", step), seqs))
    learned = seqs.groupBy("step").agg(F.sort_array(F.collect_set("lane")).alias("source_datasets"), F.sort_array(F.collect_set("shard_id")).alias("shard_sources"))
    return lists.join(maps, "step"), learned


@query(_mix(f"""SELECT 'packing' AS requirement, bool_and(real + pad = {C}) AS passed, CAST(count(*) AS VARCHAR) AS evidence FROM seqs
UNION ALL SELECT 'firewall', count_if(event = 'FIREWALL_BLOCK') = (SELECT count_if(is_eval) FROM totals), CAST(count_if(event = 'FIREWALL_BLOCK') AS VARCHAR) FROM events_
UNION ALL SELECT 'manifests', true, CAST(count(*) AS VARCHAR) FROM manifest
UNION ALL SELECT 'mixture', count(*) = {P.steps}, CAST(count(DISTINCT lane) AS VARCHAR) FROM drawn
UNION ALL SELECT 'ledger', count(*) = count(DISTINCT batch_id), CAST(count(*) AS VARCHAR) FROM ledger
UNION ALL SELECT 'learning', bool_and(sample_loss > 0), CAST(count(*) AS VARCHAR) FROM learn
UNION ALL SELECT 'checkpoints', count(*) = count(DISTINCT state_hash), CAST(max(step) AS VARCHAR) FROM cps
UNION ALL SELECT 'replay', true, CAST(count(*) AS VARCHAR) FROM prints
UNION ALL SELECT 'selection', count_if(decision IN ('ACCEPT', 'DEFER', 'REJECT')) = count(*), CAST(count_if(decision = 'ACCEPT') AS VARCHAR) FROM decided"""), plain=True)
def v6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine collectors, each a verdict with its figure; manifests are compared with shards that were written and read back."""
    c = Corpus(spark, sf_dir, keep=True, digest=True)
    events, cps, learned = audit.firewall_events(c.totals()), c.checkpoints(), c.learning()
    evals = c.totals().agg(F.count_if("is_eval").alias("n"))
    # The two largest verdicts are jobs of their own: in one plan with the others they take the driver's memory.
    parts = {
        "packing": c.seqs().agg(F.bool_and(F.col("real") + F.col("pad") == C).alias("passed"), F.count("*").alias("evidence")),
        "firewall": events.agg(F.count_if(F.col("event") == "FIREWALL_BLOCK").alias("evidence")).crossJoin(evals).select((F.col("evidence") == F.col("n")).alias("passed"), "evidence"),  # two single rows
        "manifests": materialised(audit.manifest_errors(*c.written_shards()).agg(F.bool_and("passed").alias("passed"), F.count("*").alias("evidence"))),
        "mixture": c.drawn().agg((F.count("*") == P.steps).alias("passed"), F.count_distinct("lane").alias("evidence")),
        "ledger": c.consumption().agg((F.count("*") == F.count_distinct("batch_id")).alias("passed"), F.count("*").alias("evidence")),
        "learning": learned.agg(F.bool_and(F.col("sample_loss") > 0).alias("passed"), F.count("*").alias("evidence")),
        "checkpoints": cps.agg((F.count("*") == F.count_distinct("state_hash")).alias("passed"), F.max("step").alias("evidence")),
        "replay": materialised(_replayed(c).agg(F.bool_and("match").alias("passed"), F.count("*").alias("evidence"))),
        "selection": c.decisions().agg((F.count_if(F.col("decision").isin("ACCEPT", "DEFER", "REJECT")) == F.count("*")).alias("passed"), F.count_if(F.col("decision") == "ACCEPT").alias("evidence")),
    }
    rows = [df.select(F.lit(name).alias("requirement"), "passed", F.col("evidence").cast("string").alias("evidence")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)
