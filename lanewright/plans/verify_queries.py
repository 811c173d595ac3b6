"""Registered queries of verification against written shards, ledger fields, saved states and the plan's further rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.columns import canonical_json, decoded, json_of_map, sorted_join, token_ids, words
from lanewright.operators import audit, ledger, mixture, packing
from lanewright.plans.oracle import values
from lanewright.plans.params import TRAIN_LANES, P
from lanewright.plans.queries import Corpus, _mix, ledger_fields, query
from lanewright.sources.tables import laned_documents

C, B = P.context, P.batch


def spoiled(docs: DataFrame) -> DataFrame:
    """By shard number mod 7: 3 loses its first document, 4 gets one character more, 5 another tokenizer hash, 6 is not written."""
    k = F.col("src") % 7
    first = docs.groupBy("shard_id").agg(F.min("doc_id").alias("first"))
    docs = docs.join(F.broadcast(first), "shard_id")  # a row a shard
    at = F.col("doc_id") == F.col("first")
    docs = docs.where((k != 6) & ~((k == 3) & at))
    return docs.withColumns({"text": F.when((k == 4) & at, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")), "tokenizer_hash": F.when((k == 5) & at, F.lit("other")).otherwise(F.col("tokenizer_hash"))}).drop("first")


@query("SELECT shard_id, '' AS errors, true AS passed FROM manifest")
def j1_written_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2 and V1: manifests against the shards that were written, read back from their files."""
    return audit.manifest_errors(*Corpus(spark, sf_dir).written_shards())


@query("SELECT shard_id, CASE shard_index % 7 WHEN 3 THEN 'document_count differs; content_hash differs' WHEN 4 THEN 'content_hash differs' WHEN 5 THEN 'tokenizer_hash differs' WHEN 6 THEN 'shard missing' ELSE '' END AS errors, shard_index % 7 NOT IN (3, 4, 5, 6) AS passed FROM manifest")
def j1_changed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demonstration: the same verification finds every fault of shards that were spoiled before they were written."""
    return audit.manifest_errors(*Corpus(spark, sf_dir).written_shards(spoiled))


@query("""SELECT l.step, b.batch_id, l.sample_index, l.sample_loss, b.seq_count, g.n_samples, p.preview FROM learn l JOIN batches b ON b.batch_index = l.step JOIN ledger g ON g.batch_id = b.batch_id
JOIN (SELECT batch_index, array_to_string((list(x ORDER BY ord, pos))[1:8], ',') AS preview FROM (SELECT batch_index, doc_id || '@' || shard_id AS x, min(ord) AS ord, arg_min(pos, ord) AS pos FROM tover GROUP BY ALL) GROUP BY ALL) p ON p.batch_index = l.step""")
def v4_reverse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 with all three sides, and W8: every loss with its batch, its ledger row and the batch's first eight sources."""
    c = Corpus(spark, sf_dir)
    each = c.training_over().groupBy("batch_index", "doc_id", "shard_id").agg(F.min(F.struct("ord", "pos")).alias("first"))
    item = F.struct("first", F.concat_ws("@", F.col("doc_id").cast("string"), "shard_id").alias("x"))
    sources = F.slice(F.array_sort(F.collect_list(item)), 1, 8)  # a batch of four sequences holds few documents
    preview = each.groupBy("batch_index").agg(F.array_join(F.transform(sources, lambda y: y["x"]), ",").alias("preview"))
    rows = c.learning().join(c.batches().withColumn("step", F.col("batch_index")).select("step", "batch_index", "batch_id", "seq_count"), "step")
    rows = rows.join(c.consumption().select("batch_id", "n_samples"), "batch_id").join(preview, "batch_index")
    return rows.select("step", "batch_id", "sample_index", "sample_loss", "seq_count", "n_samples", "preview")


@query("""SELECT g.step, CASE WHEN g.step % 11 = 5 THEN 1 ELSE 0 END AS lost_batches, coalesce(s.n, 0) AS lost_shards, coalesce(d.n, 0) AS lost_documents FROM ledger g
LEFT JOIN (SELECT batch_index AS step, count(DISTINCT shard_id) AS n FROM tover WHERE src % 7 = 6 GROUP BY ALL) s USING (step)
LEFT JOIN (SELECT batch_index AS step, count(DISTINCT doc_id) AS n FROM tover WHERE doc_id % 97 = 13 GROUP BY ALL) d USING (step)""")
def v3_full_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward traces of batches, shards and documents, tried on tables that lack some of each."""
    c = Corpus(spark, sf_dir)
    over = c.training_over().withColumn("step", F.col("batch_index"))
    n = lambda df, name: df.groupBy("step").agg(F.count("*").alias(name))
    batches = n(c.batch_steps().select("step", "batch_id").join(c.batches().where("batch_index % 11 <> 5").select("batch_id"), "batch_id", "left_anti"), "lost_batches")
    shards = n(over.select("step", "shard_id").distinct().join(c.totals().where("src % 7 <> 6").select("shard_id"), "shard_id", "left_anti"), "lost_shards")
    docs = n(over.select("step", "doc_id").distinct().join(c.docs().where("doc_id % 97 <> 13").select("doc_id"), "doc_id", "left_anti"), "lost_documents")
    rows = c.batch_steps().select("step")
    for part in (batches, shards, docs):
        rows = rows.join(part, "step", "left")
    return rows.select("step", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("lost_batches", "lost_shards", "lost_documents")))


_EVAL = "lane IN ('EVAL', 'VALIDATION')"


@query(f"""SELECT ledger, field, step, lane FROM (SELECT DISTINCT seq // {B} AS step, lane FROM over_ WHERE {_EVAL}), (VALUES ('consumption', 'shard_sources'), ('consumption', 'dataset_contributions'), ('learning', 'source_datasets'), ('learning', 'shard_sources')) f(ledger, field)""")
def v2_firewall_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 and J16 with all four fields, over a ledger packed without the firewall, so that every field must show its violations."""
    return audit.firewall_audit(*ledger_fields(Corpus(spark, sf_dir), guarded=False))


@query("""SELECT b.batch_id, b.step, '{' || string_agg('"' || c.lane || '": ' || c.contrib_compat, ', ' ORDER BY c.lane) || '}' AS dataset_contributions, '{' || string_agg('"' || c.lane || '": ' || c.contrib_strict, ', ' ORDER BY c.lane) || '}' AS strict_contributions
FROM contrib c JOIN batches b USING (step) GROUP BY b.batch_id, b.step""")
def t4_contributions_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's maps of datasets to tokens, as canonical JSON."""
    c = Corpus(spark, sf_dir)
    maps = ledger.contribution_maps(ledger.contributions(c.training_over(), c.training_seqs()))
    return c.batch_steps().select("batch_id", "step").join(maps, "step").select("batch_id", "step", json_of_map(F.col("dataset_contributions")).alias("dataset_contributions"), json_of_map(F.col("strict_contributions")).alias("strict_contributions"))


@query("SELECT g.step, g.batch_id, max(l.loss) AS loss, string_agg(l.sample_index || ':' || l.n_tokens, ',' ORDER BY l.sample_index) AS per_sample_tokens, any_value(g.datasets) AS source_datasets, any_value(g.sample_ids) AS sample_ids, any_value(g.shard_sources) AS shard_sources FROM learn l JOIN ledger g USING (step) GROUP BY g.step, g.batch_id")
def t5_learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning ledger with a row a step: its samples, source datasets, sample ids and shards."""
    c = Corpus(spark, sf_dir)
    item = F.struct("sample_index", F.concat_ws(":", F.col("sample_index").cast("string"), F.col("n_tokens").cast("string")).alias("x"))
    own = c.learning().groupBy("step").agg(F.max("loss").alias("loss"), sorted_join(F.collect_list(item), "x").alias("per_sample_tokens"))
    return own.join(c.consumption(), "step").select("step", "batch_id", "loss", "per_sample_tokens", F.col("datasets").alias("source_datasets"), "sample_ids", "shard_sources")


@query(f"SELECT shard_id, count(*) AS sequences, 0::BIGINT AS bad, sum(pad)::BIGINT AS pads FROM seqs GROUP BY ALL")
def a1_mask_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and mask arrays of every sequence as they are built: lengths, and a mask of 0 on padding and nowhere else."""
    c = Corpus(spark, sf_dir)
    rows = packing.arrays(spark, sf_dir, c.tokens())
    pairs = F.arrays_zip("tokens", "mask")
    ok = (F.size("tokens") == C) & (F.size("mask") == C) & F.forall(pairs, lambda x: (x["mask"] == 1) == (x["tokens"] != 0))
    return rows.groupBy("shard_id").agg(F.count("*").alias("sequences"), F.count_if(~ok).alias("bad"), F.sum(F.size(F.filter("mask", lambda x: x == 0))).alias("pads"))


_COUNTS = "'{' || " + " || ', ' || ".join(f"'\"{x}\": ' || count_if(d.lane = '{x}')" for x in sorted(TRAIN_LANES)) + " || '}'"


@query(_mix(f"SELECT c.step, {_COUNTS} AS counts, count(*) AS total, (SELECT idx FROM stages s WHERE c.step >= lo AND c.step < hi) AS stage_idx, count(*) AS rng_position FROM cps c JOIN drawn d ON d.step <= c.step WHERE c.step < {P.steps} GROUP BY c.step"), plain=True)
def s9_sampler_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampler's state at each checkpoint within the walk: counts, draws, stage and the generator's position."""
    c = Corpus(spark, sf_dir)
    out = mixture.states(c.drawn(), c.checkpoints().where(F.col("step") < P.steps).select(F.col("step").cast("int").alias("step")))
    return out.select("step", json_of_map(F.col("counts")).alias("counts"), "total", "stage_idx", "rng_position")


@query(mixture.sampler_sql(spark=False), plain=True)
def t1_sampler_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk stopped at the crash, its state saved, and taken up again from that state alone: the same draws as without a stop."""
    first = mixture.sampled(spark, P.crash_at + 1)
    saved = mixture.states(first, spark.createDataFrame([(P.crash_at,)], "step int")).first()
    return first.unionByName(mixture.sampled(spark, P.steps, dict(saved["counts"])))


@query(f"SELECT batch_id, step, CASE WHEN s <= last THEN s END AS first_saved FROM (SELECT batch_id, step, (SELECT max(step) FROM batches) AS last, CASE WHEN step <= {P.crash_at} THEN least((step + {P.checkpoint_every}) // {P.checkpoint_every} * {P.checkpoint_every} - 1, {P.crash_at}) ELSE (step + {P.checkpoint_every}) // {P.checkpoint_every} * {P.checkpoint_every} - 1 END AS s FROM batches)")
def w9_consumed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumed sets of all checkpoints: each batch with the first that has it."""
    return ledger.consumed_sets(Corpus(spark, sf_dir).batch_steps())


@query("SELECT shard_id, array_to_string(list_transform(string_split(lower(replace(lane, '_', ' ')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title, starts_with(shard_id, 'COMMON') AS common, ends_with(shard_id, '001') AS first, substr(shard_id, 1, 4) AS prefix FROM totals")
def f2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.col("shard_id")
    return Corpus(spark, sf_dir).totals().select("shard_id", F.initcap(F.replace("lane", F.lit("_"), F.lit(" "))).alias("title"), F.startswith(shard, F.lit("COMMON")).alias("common"), F.endswith(shard, F.lit("001")).alias("first"), F.substring(shard, 1, 4).alias("prefix"))


@query("SELECT doc_id, array_to_string(list_transform(w[1:5], lambda x: '<' || ((" + " + ".join(f"(CAST('0x' || substr(sha256(x), {at + 1}, {min(15, 64 - at)}) AS BIGINT) % 511) * {pow(16, 64 - at - min(15, 64 - at), 511)}" for at in range(0, 64, 15)) + ") % 511 + 1) || '>'), ' ') AS decoded FROM worded")
def f3_lossy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five tokens of each document, encoded and decoded."""
    rows = laned_documents(spark, sf_dir).select("doc_id", F.slice(words(F.col("text")), 1, 5).alias("w"))
    return rows.select("doc_id", decoded(token_ids(F.col("w"), P.vocab)).alias("decoded"))


@query("""SELECT shard_id, j AS object, sha256(j) AS object_hash FROM (SELECT shard_id, '{"content_hash": "' || content_hash || '", "dataset": "' || dataset || '", "document_count": ' || document_count || ', "is_eval": ' || CASE WHEN is_eval THEN 'true' ELSE 'false' END || ', "shard_id": "' || shard_id || '"}' AS j FROM manifest)""")
def f4_object_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as canonical JSON and its hash."""
    m = Corpus(spark, sf_dir).manifests()
    text = canonical_json(shard_id=F.col("shard_id"), dataset=F.col("dataset"), document_count=F.col("document_count"), content_hash=F.col("content_hash"), is_eval=F.col("is_eval"))
    return m.select("shard_id", text.alias("object")).withColumn("object_hash", F.sha2("object", 256))


# The plan's rules. Band, share of the steps from which it is allowed, and from which it is sampled less.
BANDS = ((1, 0.0, 0.30), (2, 0.0, None), (3, 0.15, None), (4, 0.25, None))
# Stage, and what it must not hold.
BANNED = (("seed", "band 4"), ("seed", "rlvr"), ("seed", "long context"), ("seed", "agentic multi-step"), ("growth1", "band 4"), ("growth1", "agentic multi-step"))
# Language or format, tokens per word of the baseline, target.
FERTILITY = (("Hindi", 3.7, 1.5), ("Bengali", 3.2, 1.5), ("Telugu", 6.3, 2.0), ("Tamil", 5.7, 2.0), ("Gujarati", 4.5, 1.7), ("Kannada", 5.8, 2.0), ("Malayalam", 6.8, 2.2), ("Odia", 5.5, 2.0), ("Urdu", 4.8, 1.7), ("Punjabi", 4.9, 1.8), ("English", 1.15, 1.2), ("Code", 1.10, 1.05), ("LaTeX", 1.40, 1.25), ("JSON", 1.30, 1.15))
# Component of the reserve, what selects it, the least value, billions of tokens.
RESERVE = (("educational web", "score", 4.8, 15), ("papers", "citations", 50.0, 10), ("verified Indic", "tier", 1.0, 8), ("code", "passing suites", 1.0, 10), ("reasoning", "pass rate", 0.9, 7))


@query(f"SELECT b.step, string_agg(CAST(g.band AS VARCHAR), ',' ORDER BY g.band) AS bands, count_if(b.step >= g.less * total) AS sampled_less FROM (SELECT step, count(*) OVER () AS total FROM batches) b JOIN {values(list(BANDS))} g(band, opens, less) ON b.step >= g.opens * total GROUP BY b.step")
def g10_band_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difficulty bands that each step may draw from, and how many of them it draws less of."""
    steps = Corpus(spark, sf_dir).batch_steps().select("step")
    bands = F.broadcast(spark.createDataFrame(list(BANDS), "band int, opens double, less double"))  # four rows
    rows = steps.crossJoin(F.broadcast(steps.agg(F.count("*").alias("total")))).join(bands, F.col("step") >= F.col("opens") * F.col("total"))
    return rows.groupBy("step").agg(F.array_join(F.sort_array(F.collect_list(F.col("band").cast("string"))), ",").alias("bands"), F.count_if(F.col("step") >= F.col("less") * F.col("total")).alias("sampled_less"))


@query(f"SELECT s.stage, k.kind, b.stage IS NULL AS allowed FROM (VALUES ('seed'), ('growth1'), ('growth2'), ('main'), ('anneal')) s(stage), (SELECT DISTINCT kind FROM {values(list(BANNED))} x(stage, kind)) k LEFT JOIN {values(list(BANNED))} b(stage, kind) ON b.stage = s.stage AND b.kind = k.kind")
def g12_banned_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banned = spark.createDataFrame(list(BANNED), "stage string, kind string")
    stages = spark.createDataFrame([(x,) for x in ("seed", "growth1", "growth2", "main", "anneal")], "stage string")
    return stages.crossJoin(banned.select("kind").distinct()).join(banned.withColumn("hit", F.lit(True)), ["stage", "kind"], "left").select("stage", "kind", F.col("hit").isNull().alias("allowed"))  # lists of a few rows


@query(f"SELECT language, baseline, target, round(baseline / target, 2) AS improvement, target <= baseline AS lower FROM {values(list(FERTILITY))} t(language, baseline, target)")
def g11_fertility_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(FERTILITY), "language string, baseline double, target double")
    return rows.select("language", "baseline", "target", F.round(F.col("baseline") / F.col("target"), 2).alias("improvement"), (F.col("target") <= F.col("baseline")).alias("lower"))


@query(f"SELECT component, selector, least, tokens, round(tokens / sum(tokens) OVER (), 4) AS share FROM {values(list(RESERVE))} t(component, selector, least, tokens)")
def g9_reserve_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(RESERVE), "component string, selector string, least double, tokens int")
    return rows.crossJoin(rows.agg(F.sum("tokens").alias("total"))).select("component", "selector", "least", "tokens", F.round(F.col("tokens") / F.col("total"), 4).alias("share"))  # one row
