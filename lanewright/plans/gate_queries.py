"""Registered queries of the planned gates and of the plan's arithmetic (specified, never implemented by a program)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.columns import words
from lanewright.operators import gates, mixture, slicing, units, vectors
from lanewright.plans.oracle import WORDS, ngrams, values
from lanewright.plans.params import P
from lanewright.plans.queries import query
from lanewright.sources.shared import materialised
from lanewright.sources.tables import laned_documents, table

# The plan's tables. Lane, share, tokens (billions), floor, seed / 3 B / 8 B / main / anneal percentages, estimate.
PLAN_LANES = (
    ("Web Foundation", 28, 2240, 20, 42, 32, 28, 28, 25, 1900),
    ("Web Diverse", 11, 880, 8, 15, 13, 11, 11, 0, 720),
    ("Code", 18, 1440, 12, 8, 14, 16, 18, 20, 1100),
    ("STEM & Math", 13, 1040, 10, 8, 12, 13, 13, 20, 500),
    ("Indic", 10, 800, 8, 10, 10, 10, 10, 10, 371),
    ("Agentic", 8, 640, 5, 0, 5, 8, 8, 0, 350),
    ("Reasoning", 8, 640, 5, 0, 4, 8, 8, 15, 230),
)
# Language, and billions of tokens: verified, unverified, translated, synthetic, total as stated.
PLAN_LANGUAGES = (
    ("Hindi", 10.0, 35.0, 22.0, 12.0, 79.0),
    ("Bengali", 8.0, 18.0, 14.0, 7.0, 47.0),
    ("Telugu", 4.0, 14.0, 12.0, 7.0, 37.0),
    ("Marathi", 6.0, 11.0, 9.0, 5.0, 31.0),
    ("Tamil", 5.0, 12.0, 10.0, 6.0, 33.0),
    ("Gujarati", 4.0, 9.0, 7.0, 4.0, 24.0),
    ("Kannada", 4.0, 9.0, 8.0, 4.0, 25.0),
    ("Malayalam", 4.0, 8.0, 7.0, 3.0, 22.0),
    ("Punjabi", 3.0, 6.0, 5.0, 3.0, 17.0),
    ("Odia", 2.0, 5.0, 5.0, 2.0, 14.0),
    ("Urdu", 3.0, 6.0, 5.0, 2.0, 16.0),
    ("Cross-lingual", 5.0, 12.0, 6.0, 3.0, 26.0),
)
# Tier, largest number of epochs, largest share of the budget.
TIERS = (("verified", 2.0, None), ("unverified", 1.5, None), ("translated", 1.0, 0.35), ("synthetic", 1.5, 0.20))
# Stage, parameters (billions), tokens (billions).
GROWTH = (("Seed", 1, 20), ("Growth 1", 3, 60), ("Growth 2", 8, 200), ("Full", 40, 8000))
STAGES = ("seed", "growth1", "growth2", "main", "anneal")
# Component of the final phase and its share.
ANNEAL = (("best", 0.35), ("web", 0.25), ("stem", 0.20), ("indic", 0.10), ("reasoning", 0.10))
LANE_NAMES = "lane string, share int, tokens int, floor int, seed int, growth1 int, growth2 int, main int, anneal int, estimate int"
LANES_SQL = f"{values(list(PLAN_LANES))} t(lane, share, tokens, floor, seed, growth1, growth2, main, anneal, estimate)"
UNPIVOT = " UNION ALL ".join(f"SELECT lane, floor, '{s}' AS stage, {s} AS weight FROM {LANES_SQL}" for s in STAGES)


def plan_lanes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLAN_LANES), LANE_NAMES)


def stage_mix(spark: SparkSession) -> DataFrame:
    return plan_lanes(spark).unpivot(["lane", "floor"], list(STAGES), "stage", "weight")


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) >= 128 AS passed FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def g1a_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(words(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), (n >= 128).alias("passed"))


@query(f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CASE WHEN len(g) > 0 THEN round(1 - len(list_distinct(g)) / len(g), 6) ELSE 0 END AS repeated, CASE WHEN len(g) > 0 THEN round(1 - len(list_distinct(g)) / len(g), 6) ELSE 0 END <= 0.3 AS passed
FROM (SELECT *, {ngrams("w", 5)} AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents))""")
def g1b_repetition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.repetition(table(spark, sf_dir, "documents")).withColumn("passed", F.col("repeated") <= 0.3)


@query("SELECT lang, count(*) AS docs, count(lang) = count(*) AS labelled FROM documents GROUP BY ALL")
def g1c_language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only labels exist for this gate, no confidence; `llm` has an identifier with a score."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), (F.count("lang") == F.count("*")).alias("labelled"))


@query("SELECT d.doc_id, l.quality, coalesce(l.quality = 1, true) AS passed FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) l USING (doc_id)")
def g1d_quality_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0/1 label stands for the 5-point score; documents without a label pass."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("passed"))


@query(f"""SELECT doc_id, cross_, CASE WHEN cross_ >= 0.2 THEN 'CROSS_LINGUAL' ELSE 'MONOLINGUAL' END AS route FROM (SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Latin}}') AND regexp_matches(regexp_replace(x, '\\p{{Latin}}', '', 'g'), '\\p{{L}}'))) / len(w), 6) ELSE 0 END AS cross_ FROM (SELECT doc_id, {WORDS} AS w FROM documents))""")
def g1e_code_switch_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.scripts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("cross").alias("cross_"), F.when(F.col("cross") >= 0.2, "CROSS_LINGUAL").otherwise("MONOLINGUAL").alias("route"))


_LINE_GRAMS = ngrams("w", 3)


@query(f"""SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) d JOIN (
  SELECT l.line, i.item_id FROM (SELECT line, list_distinct({_LINE_GRAMS}) AS g FROM (SELECT line, {WORDS.replace("text", "line")} AS w FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents))) l,
  (SELECT item_id, list_distinct({_LINE_GRAMS}) AS g FROM (SELECT item_id, {WORDS} AS w FROM benchmark)) i
  WHERE len(l.g) >= 0.8 * len(i.g) AND len(i.g) >= 0.8 * len(l.g) AND len(list_intersect(l.g, i.g)) > 0 AND len(list_intersect(l.g, i.g)) >= 0.8 * (len(l.g) + len(i.g) - len(list_intersect(l.g, i.g)))) p USING (line)""")
def g2a_lexical_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose shingles have an exact Jaccard of 0.8 or more with an item's."""
    return gates.similar_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RUNS = ngrams("w", "k")


@query(
    f"""WITH i AS (SELECT item_id, k, list_distinct({_RUNS}) AS gs FROM (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark)) WHERE k > 0),
d AS (SELECT doc_id, k, {_RUNS} AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents), (SELECT DISTINCT k FROM i)),
pairs AS (SELECT doc_id, item_id, g, gs FROM d JOIN i USING (k) WHERE 5 * len(list_intersect(list_distinct(g), gs)) >= 4 * len(gs)),
spots AS (SELECT doc_id, item_id, len(gs) AS n, p, list_contains(gs, s) AS hit, coalesce(lag(p) OVER (PARTITION BY doc_id, item_id, s ORDER BY p), 0) AS before FROM (SELECT doc_id, item_id, gs, unnest(range(1, len(g) + 1)) AS p, unnest(g) AS s FROM pairs)),
runs AS (SELECT a.doc_id, a.item_id, a.n, count(*) FILTER (b.before < a.p) OVER w AS all_, count(*) FILTER (b.before < a.p AND b.hit) OVER w AS common FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p WHERE a.hit WINDOW w AS (PARTITION BY a.doc_id, a.item_id, a.p ORDER BY b.p))
SELECT DISTINCT doc_id, item_id FROM runs WHERE 5 * common >= 4 * (n + all_ - common)""",
    plain=True,
)
def g2a_window_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window, over any lines or part of one, whose 5-word shingles have a Jaccard of 0.8 or more with a whole item's."""
    return gates.similar_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FIVE = ngrams("w", 5)


@query(f"""SELECT doc_id, item_id, share FROM (SELECT doc_id, item_id, round(count(*) / any_value(size), 6) AS share FROM
  (SELECT doc_id, unnest(list_distinct({_FIVE})) AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents)) d JOIN
  (SELECT item_id, len(gs) AS size, unnest(gs) AS g FROM (SELECT item_id, list_distinct({_FIVE}) AS gs FROM (SELECT item_id, {WORDS} AS w FROM benchmark))) i USING (g) GROUP BY doc_id, item_id) WHERE share > 0.8""")
def g2b_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.overlap_with_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("share > 0.8")


@query("""SELECT query_id, vec_id, similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS similarity
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v WHERE q.vec_id <> v.vec_id) WHERE similarity > 0.85""")
def g2c_semantic_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"))


_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY source, {_NORM}) AS kept FROM documents")
def g3_snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.snapshot_duplicates(table(spark, sf_dir, "documents"), ["source"])


@query(f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {_NORM}) AS kept FROM documents")
def g3_global_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.snapshot_duplicates(table(spark, sf_dir, "documents"), [])


@query("""SELECT conv_id, turns, conv_id = min(conv_id) OVER (PARTITION BY h) AS kept FROM (SELECT conv_id, count(*) AS turns, sha256(string_agg(sha256(coalesce(role, '') || ':' || coalesce(text, '')), chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY ALL)""")
def g3b_conversation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations by the ordered hash of their turns (a conversation's turns are few)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n"), 256).alias("h"))
    least = conv.groupBy("h").agg(F.min("conv_id").alias("keep"))
    return conv.join(least, "h").select("conv_id", "turns", (F.col("conv_id") == F.col("keep")).alias("kept"))


@query(
    """WITH u AS (SELECT doc_id, h, unit, k FROM (SELECT doc_id, h, unnest(us) AS unit, unnest(range(len(us))) AS k FROM (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS h, [trim(x, ' ') FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, ' ') <> ''] AS us FROM documents))),
f AS (SELECT doc_id, h, count(*) AS n, string_agg(unit, chr(10) ORDER BY k) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, h, k) AS r FROM u) WHERE r = 1 GROUP BY ALL),
c AS (SELECT doc_id, h, count(*) AS n FROM u GROUP BY ALL)
SELECT d.doc_id, coalesce(c.n, 0) AS n_units, coalesce(f.n, 0) AS n_kept, sha256(coalesce(f.kept, '')) AS kept_sha256 FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) d LEFT JOIN c USING (doc_id, h) LEFT JOIN f USING (doc_id, h)""",
    plain=True,
)
def g3b_line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in a document before, or before in the same."""
    out = units.first_occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_units", "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("""SELECT doc_id, n_letters, latin, latin >= 0.7 AS passed FROM (SELECT doc_id, CAST(n AS BIGINT) AS n_letters, CASE WHEN n > 0 THEN round(m / n, 6) ELSE 0 END AS latin FROM
  (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS n, length(regexp_replace(coalesce(text, ''), '[^\\p{Latin}]', '', 'g')) AS m FROM documents))""")
def g4_script_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.scripts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_letters", "latin", (F.col("latin") >= 0.7).alias("passed"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{n}') THEN '{n}'" for n, _ in gates.LICENSE_RULES) + " END AS phrase, CASE " + " ".join(f"WHEN contains(text, '{n}') THEN '{r}'" for n, r in gates.LICENSE_RULES) + " ELSE 'NOT_USABLE' END AS policy FROM documents")
def g5_license_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.license_policy(table(spark, sf_dir, "documents"))


def g6_domain_mining(spark: SparkSession, sf_dir: str, least: float = 0.7, rounds: int = 3, small: float = 0.05) -> DataFrame:
    """The mining loop with a logistic classifier over hashed words: seeds are the labelled good documents; at most `rounds`
    rounds, fewer once a round adds under `small` of the seed. The models are fitted by Spark; only counts reach the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.lower("text")).alias("w"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    data = HashingTF(numFeatures=4096, inputCol="w", outputCol="features").transform(docs).select("doc_id", "features").join(labels, "doc_id", "left").select("doc_id", "features", "quality")
    data = materialised(data)  # words are counted once; rounds read their counts
    seed = F.col("quality") == 1
    state = data.withColumn("round", F.when(seed, 0))
    size = state.where("round = 0").count()
    for k in range(1, rounds + 1):
        train = state.where("round is not null or quality = 0").withColumn("label", F.col("round").isNotNull().cast("double"))
        if train.select("label").distinct().count() < 2:
            break
        model = LogisticRegression(maxIter=20, regParam=0.1).fit(train)
        scored = model.transform(state).withColumn("p", vector_to_array("probability")[1])
        state = materialised(scored.withColumn("round", F.coalesce("round", F.when((F.col("p") >= least) & F.col("quality").isNull(), k))).select("doc_id", "features", "quality", "round"))
        added = state.where(F.col("round") == k).count()
        if added < small * max(1, size):
            break
        size += added
    return state.select("doc_id", "round", F.col("round").isNotNull().alias("mined"))


@query(f"""SELECT tier, supply, epochs, supply * epochs AS usable, round(supply / sum(supply) OVER (), 4) AS share, cap, coalesce(supply / sum(supply) OVER () <= cap, true) AS within FROM (
  SELECT t.tier, t.epochs, t.cap, CASE t.tier WHEN 'verified' THEN v WHEN 'unverified' THEN u WHEN 'translated' THEN tr ELSE s END AS supply FROM {values(list(TIERS))} t(tier, epochs, cap),
  (SELECT sum(verified)::DOUBLE AS v, sum(unverified)::DOUBLE AS u, sum(translated)::DOUBLE AS tr, sum(synthetic)::DOUBLE AS s FROM {values(list(PLAN_LANGUAGES))} l(lang, verified, unverified, translated, synthetic, stated)))""")
def g7_tier_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = spark.createDataFrame(list(PLAN_LANGUAGES), "lang string, verified double, unverified double, translated double, synthetic double, stated double")
    supply = langs.unpivot("lang", ["verified", "unverified", "translated", "synthetic"], "tier", "b").groupBy("tier").agg(F.sum("b").alias("supply"))
    rows = spark.createDataFrame(list(TIERS), "tier string, epochs double, cap double").join(supply, "tier")
    share = F.col("supply") / F.col("total")
    rows = rows.crossJoin(rows.agg(F.sum("supply").alias("total")))  # one row
    return rows.select("tier", "supply", "epochs", (F.col("supply") * F.col("epochs")).alias("usable"), F.round(share, 4).alias("share"), "cap", F.coalesce(share <= F.col("cap"), F.lit(True)).alias("within"))


@query(f"""WITH RECURSIVE base AS (SELECT lane, stage, floor / 100.0 AS f, weight / 100.0 AS w FROM ({UNPIVOT})), fill(k, lane, stage, f, w, fixed) AS (
  SELECT 0, lane, stage, f::DOUBLE, w::DOUBLE, false FROM base
  UNION ALL SELECT k + 1, lane, stage, f, w, fixed OR CASE WHEN fixed THEN f ELSE w * greatest(1 - sum(CASE WHEN fixed THEN f ELSE 0 END) OVER (PARTITION BY stage), 0) / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (PARTITION BY stage), 0) END < f FROM fill WHERE k < 8)
SELECT stage, lane, round(w, 6) AS weight, round(greatest(f, CASE WHEN fixed THEN f ELSE w * greatest(1 - sum(CASE WHEN fixed THEN f ELSE 0 END) OVER (PARTITION BY stage), 0) / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (PARTITION BY stage), 0) END), 6) AS clamped FROM fill WHERE k = 8""", plain=True)
def g8_hard_floor_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage_mix(spark).select("stage", "lane", (F.col("floor") / 100.0).alias("f"), (F.col("weight") / 100.0).alias("w"))
    return mixture.clamped(rows, "stage", "lane", "w", "f").select("stage", "lane", F.round("w", 6).alias("weight"), F.round("clamped", 6).alias("clamped"))


@query(f"SELECT b.step, b.batch_id, a.component, a.share FROM (SELECT *, count(*) OVER () AS total FROM batches) b, {values(list(ANNEAL))} a(component, share) WHERE b.step >= 0.85 * total OR a.component <> 'best'")
def g9_anneal_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components allowed at each step: the reserve only from 85 % of the steps on."""
    from lanewright.plans.queries import Corpus

    steps = Corpus(spark, sf_dir).batch_steps()
    total = steps.agg(F.count("*").alias("total"))
    parts = F.broadcast(spark.createDataFrame(list(ANNEAL), "component string, share double"))  # 5 rows
    rows = steps.crossJoin(F.broadcast(total)).crossJoin(parts)
    return rows.where((F.col("step") >= 0.85 * F.col("total")) | (F.col("component") != "best")).select("step", "batch_id", "component", "share")


@query(f"SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) <= 256 THEN 1 WHEN len(w) <= 1024 THEN 2 WHEN len(w) <= 4096 THEN 3 ELSE 4 END AS band FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'assistant')")
def g10_turn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(words(F.col("text"))).cast("long")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", n.alias("n"), gates.band(n).alias("band"))


@query(f"SELECT band, count(*) AS docs, sum(n)::BIGINT AS tokens FROM (SELECT n, CASE WHEN n <= 256 THEN 1 WHEN n <= 1024 THEN 2 WHEN n <= 4096 THEN 3 ELSE 4 END AS band FROM (SELECT len({WORDS}) AS n FROM documents)) GROUP BY ALL")
def g10_document_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(words(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select(n.alias("n")).groupBy(gates.band(F.col("n")).alias("band")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query(f"SELECT lang, sum(n)::BIGINT AS words, sum(b)::BIGINT AS bytes, round(sum(b) / sum(n), 4) AS bytes_per_word, 1.0::DOUBLE AS tokens_per_word FROM (SELECT lang, len({WORDS}) AS n, strlen(coalesce(text, '')) AS b FROM documents) GROUP BY ALL")
def g11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word tokenizer has fertility 1 by definition; bytes per word tell languages apart."""
    rows = table(spark, sf_dir, "documents").select("lang", F.size(words(F.col("text"))).cast("long").alias("n"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    return rows.groupBy("lang").agg(F.sum("n").alias("words"), F.sum("b").alias("bytes"), F.round(F.sum("b") / F.sum("n"), 4).alias("bytes_per_word"), F.lit(1.0).alias("tokens_per_word"))


@query(f"""SELECT stage, lane, weight, round(weight + CASE WHEN stage NOT IN ('main', 'anneal') AND lane IN ('Web Foundation', 'Web Diverse') THEN (100 - total) * weight / web ELSE 0 END, 4) AS filled, weight < floor AS below_floor
FROM (SELECT *, sum(weight) OVER (PARTITION BY stage) AS total, sum(CASE WHEN lane IN ('Web Foundation', 'Web Diverse') THEN weight ELSE 0 END) OVER (PARTITION BY stage) AS web FROM ({UNPIVOT}))""")
def g12_stage_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a stage before the last goes to the two web lanes in proportion; lanes below their floor are flagged."""
    rows, web = stage_mix(spark), F.col("lane").isin("Web Foundation", "Web Diverse")
    sums = rows.groupBy("stage").agg(F.sum("weight").alias("total"), F.sum(F.when(web, F.col("weight")).otherwise(0)).alias("web"))
    extra = F.when(web & ~F.col("stage").isin("main", "anneal"), (100 - F.col("total")) * F.col("weight") / F.col("web")).otherwise(0)
    return rows.join(sums, "stage").select("stage", "lane", "weight", F.round(F.col("weight") + extra, 4).alias("filled"), (F.col("weight") < F.col("floor")).alias("below_floor"))


RULES = (("A", 86.5, 86.0), ("B", 52.0, 55.0), ("C", 71.0, 70.0))


@query(f"SELECT run, score, target, CASE WHEN score >= target THEN 'ADOPT' ELSE 'REVISE' END AS decision FROM {values(list(RULES))} t(run, score, target)")
def g13_proxy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No proxy run exists; the rule is applied to a small list of stand-in scores."""
    rows = spark.createDataFrame(list(RULES), "run string, score double, target double")
    return rows.select("run", "score", "target", F.when(F.col("score") >= F.col("target"), "ADOPT").otherwise("REVISE").alias("decision"))


@query(f"SELECT lane, tokens, estimate, tokens - estimate AS gap, share * 80 AS from_share, share * 80 <> tokens AS differs FROM {LANES_SQL} UNION ALL SELECT 'TOTAL', sum(tokens)::INT, sum(estimate)::INT, sum(tokens - estimate)::INT, sum(share)::INT * 80, sum(share) <> 100 FROM {LANES_SQL}")
def g14_supply_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are of 8,000 billion tokens; the total row shows that the stated shares do not reach 100 %."""
    rows = plan_lanes(spark)
    each = rows.select("lane", "tokens", "estimate", (F.col("tokens") - F.col("estimate")).alias("gap"), (F.col("share") * 80).alias("from_share"), (F.col("share") * 80 != F.col("tokens")).alias("differs"))
    total = rows.agg(F.lit("TOTAL").alias("lane"), F.sum("tokens").cast("int").alias("tokens"), F.sum("estimate").cast("int").alias("estimate"), F.sum(F.col("tokens") - F.col("estimate")).cast("int").alias("gap"), (F.sum("share").cast("int") * 80).alias("from_share"), (F.sum("share") != 100).alias("differs"))
    return each.unionByName(total)


@query(f"SELECT stage, parameters, tokens, round(tokens / parameters, 2) AS per_parameter, tokens < 20 * parameters AS under_minimum FROM {values(list(GROWTH))} t(stage, parameters, tokens)")
def g14_stage_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(GROWTH), "stage string, parameters int, tokens int")
    return rows.select("stage", "parameters", "tokens", F.round(F.col("tokens") / F.col("parameters"), 2).alias("per_parameter"), (F.col("tokens") < 20 * F.col("parameters")).alias("under_minimum"))


@query("SELECT user_id, count(*) AS rollouts, round(avg(CASE WHEN value >= 50 THEN 1 ELSE 0 END), 6) AS pass_rate, avg(CASE WHEN value >= 50 THEN 1 ELSE 0 END) >= 0.8 AS kept, avg(CASE WHEN value >= 50 THEN 1 ELSE 0 END) >= 0.9 AS best FROM events GROUP BY ALL")
def g15_verified_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rollouts exist; events stand for them: a user is a problem, a value of 50 or more a pass."""
    rate = F.avg(F.when(F.col("value") >= 50, 1).otherwise(0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rollouts"), F.round(rate, 6).alias("pass_rate"), (rate >= 0.8).alias("kept"), (rate >= 0.9).alias("best"))


@query("SELECT shard_id, CAST(ceil(sum(n) / 8192.0) AS BIGINT) AS windows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN n > 8192 THEN 1 ELSE 0 END) AS BIGINT) AS sliced FROM tok GROUP BY ALL")
def g16_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing with windows of 8,192 tokens."""
    from lanewright.operators import packing

    tokens = packing.token_counts(spark, sf_dir)
    wide = packing.sequences(packing.overlaps(packing.offsets(tokens), 8192), 8192).groupBy("shard_id").agg(F.count("*").alias("windows"), F.sum("real").alias("tokens"))
    return wide.join(tokens.groupBy("shard_id").agg(F.count_if(F.col("n") > 8192).alias("sliced")), "shard_id")


def slices_sql(limit: int) -> str:
    """doc_id, piece, first, n, ends of operators.slicing: the best cut of every prefix of a text, one after the other, then the way back."""
    counts = f"list_filter(list_transform(string_split(regexp_replace(par, '{slicing.SENTENCE.replace("'", "''")}', '\\1' || chr(30), 'g'), chr(30)), lambda s: len({WORDS.replace("coalesce(text, '')", "s")})), lambda k: k > 0)"
    return f"""(WITH RECURSIVE pars AS (SELECT doc_id, unnest(ps) AS par, generate_subscripts(ps, 1) AS a FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{slicing.PARAGRAPH}') AS ps FROM documents)),
sents AS (SELECT doc_id, a, unnest(ns) AS n, generate_subscripts(ns, 1) AS b, len(ns) AS of_ FROM (SELECT doc_id, a, {counts} AS ns FROM pars)),
runs AS (SELECT doc_id, a, b, k, least({limit}, n - k * {limit}) AS n, CASE WHEN (k + 1) * {limit} < n THEN 2 WHEN b < of_ THEN 1 ELSE 0 END AS c FROM (SELECT *, unnest(range(0, (n - 1) // {limit} + 1)) AS k FROM sents)),
lists AS MATERIALIZED (SELECT doc_id, list(c ORDER BY a, b, k) AS cs, list_prepend(0, list(s ORDER BY a, b, k)) AS cum FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY a, b, k) AS BIGINT) AS s FROM runs) GROUP BY doc_id),
step AS (SELECT doc_id, 0 AS i, [0::BIGINT] AS best, []::BIGINT[] AS came FROM lists
  UNION ALL SELECT doc_id, i + 1, list_append(best, m // 1000000 + 1000000 + cs[i + 1]), list_append(came, m % 1000000) FROM (
    SELECT doc_id, i, best, came, cs, list_min(list_transform(range(greatest(0, i + 1 - {limit}), i + 1), lambda j: CASE WHEN cum[i + 2] - cum[j + 1] <= {limit} THEN best[j + 1] * 1000000 + j END)) AS m FROM step JOIN lists USING (doc_id) WHERE i < len(cs))),
ways AS MATERIALIZED (SELECT doc_id, came, cs, cum FROM step JOIN lists USING (doc_id) WHERE i = len(cs)),
back AS (SELECT doc_id, CAST(len(came) AS BIGINT) AS cut FROM ways UNION ALL SELECT doc_id, came[cut] FROM back JOIN ways USING (doc_id) WHERE came[cut] > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cut) - 1 AS INT) AS piece, cum[came[cut] + 1] AS first, cum[cut + 1] - cum[came[cut] + 1] AS n, {list(slicing.ENDS)}[cs[cut] + 1] AS ends FROM back JOIN ways USING (doc_id))"""


@query(f"SELECT * FROM {slices_sql(P.context)}", plain=True)
def g16_natural_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in slices of at most the context length, cut where paragraphs and sentences end."""
    return slicing.slice_rows(table(spark, sf_dir, "documents"), P.context, keep=["doc_id"])


@query(
    f"""SELECT * FROM (WITH RECURSIVE pieces AS (SELECT shard_id, off // {slicing.PART * 8192} AS part, s.* FROM {slices_sql(8192)} s JOIN offs USING (doc_id)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard_id, part ORDER BY doc_id, piece) AS r FROM pieces),
w AS (SELECT shard_id, part, doc_id, piece, n, r, 0::BIGINT AS win, n AS fill FROM r WHERE r = 1
  UNION ALL SELECT r.shard_id, r.part, r.doc_id, r.piece, r.n, r.r, win + CASE WHEN fill + r.n > 8192 THEN 1 ELSE 0 END, CASE WHEN fill + r.n > 8192 THEN 0 ELSE fill END + r.n FROM w JOIN r ON r.shard_id = w.shard_id AND r.part = w.part AND r.r = w.r + 1)
SELECT shard_id, part, win, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w GROUP BY ALL)"""
)
def g16_natural_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8,192 tokens put together in order from texts, or from their slices if they are longer."""
    placed = slicing.concatenated(laned_documents(spark, sf_dir), "shard_id", "doc_id", 8192)
    return placed.groupBy("shard_id", "part", "win").agg(F.count("*").alias("pieces"), F.sum("n").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


query(None)(g6_domain_mining)
