"""Registered queries of near copies by MinHash, the vector index, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import minhash, temporal, vectors
from lanewright.plans.oracle import WORDS, ngrams
from lanewright.plans.queries import query
from lanewright.sources.shared import materialised
from lanewright.sources.tables import table

_SET = f"list_distinct({ngrams('w', 'k')})"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, {_SET} AS gs FROM (SELECT doc_id, w, greatest(least(5, len(w)), 1) AS k FROM (SELECT doc_id, {WORDS} AS w FROM documents))),
s AS (SELECT min(doc_id) AS id, any_value(len(gs)) AS n, any_value(gs) AS gs, h FROM (SELECT doc_id, gs, md5(array_to_string(list_sort(gs), chr(10))) AS h FROM d) GROUP BY h),
x AS (SELECT id, n, unnest(gs) AS g FROM s),
links AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b USING (g) WHERE a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b),
roots AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, class_id, CAST(n AS BIGINT) AS n_shingles FROM d JOIN s ON s.h = md5(array_to_string(list_sort(d.gs), chr(10))) JOIN roots USING (id)""",
    plain=True,
)
def g2a_minhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies: candidates from 32 bands of 128 minima, verified by exact Jaccard."""
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def _parts(source: str, key: str) -> str:
    rows = f"SELECT {key}, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t]*\\n')))) AS part FROM {source}"
    return f"SELECT {key}, part, {_SET} AS gs FROM (SELECT {key}, part, w, least(5, len(w)) AS k FROM (SELECT {key}, part, {WORDS.replace('text', 'part')} AS w FROM ({rows}))) WHERE k > 0"


@query(
    f"""WITH d AS ({_parts("documents", "doc_id")}), i AS ({_parts("(SELECT * FROM benchmark UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 50 = 7)", "item_id")}),
dp AS (SELECT part, any_value(gs) AS gs FROM d GROUP BY part), ip AS (SELECT part, any_value(gs) AS gs FROM i GROUP BY part),
x AS (SELECT part, len(gs) AS n, unnest(gs) AS g FROM dp), y AS (SELECT part, len(gs) AS n, unnest(gs) AS g FROM ip),
near AS (SELECT x.part AS a, y.part AS b, count(*) / (x.n + y.n - count(*)) AS jaccard FROM x JOIN y USING (g) GROUP BY x.part, y.part, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8)
SELECT doc_id, item_id, round(max(jaccard), 6) AS jaccard FROM near JOIN d ON d.part = near.a JOIN i ON i.part = near.b GROUP BY ALL""",
    plain=True,
)
def g2a_minhash_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents against those of benchmark items; a fiftieth of the documents stand among the items, so that there is something to find."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    held = docs.where("doc_id % 50 = 7").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text")
    return minhash.near_paragraphs(docs, items.unionByName(held))


_ALL_VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000001, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 8 = 0 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 20 = 0"


@query(
    f"""WITH v AS ({_ALL_VECTORS}), u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v) WHERE n > 0)
SELECT query_id, vec_id, similarity FROM (SELECT q.vec_id AS query_id, w.vec_id, round(list_dot_product(q.e, w.e), 6) AS similarity FROM u q JOIN u w ON q.vec_id <> w.vec_id WHERE q.vec_id % 100 = 0) WHERE similarity > 0.6""",
    plain=True,
)
def g2c_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by id against all vectors and near copies of a twentieth of them, through the inverted file, over a similarity of 0.6."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    twins = rows.where("vec_id % 20 = 0").select((F.col("vec_id") + 1_000_000_001).alias("vec_id"), F.transform("embedding", lambda x, i: F.when((i + 1) % 8 == 0, -x).otherwise(x)).alias("embedding"))
    return vectors.similar_vectors(rows.unionByName(twins), least=0.6)


_SHIPPED = "SELECT l_orderkey, l_linenumber, o_custkey AS key, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "key", "l_quantity", temporal.micros("l_shipdate").alias("at"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), temporal.micros("o_orderdate").alias("placed"), "o_orderkey")


@query(
    f"""SELECT s.l_orderkey, s.l_linenumber, o.o_orderkey AS latest_order FROM ({_SHIPPED}) s ASOF LEFT JOIN (SELECT o_custkey AS key, o_orderdate AS placed, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON s.key = o.key AND s.at >= o.placed""",
    plain=True,
)
def j14_asof_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment with the customer's latest order at that time."""
    met = temporal.asof_join(_shipments(spark, sf_dir).drop("l_quantity"), _placed(spark, sf_dir), "key", "at", "placed")
    return met.select("l_orderkey", "l_linenumber", F.col("match.o_orderkey").alias("latest_order"))


_ERRORS = "(SELECT user_id, ts, max(event_id) AS late, min(event_id) AS early FROM events WHERE event_type = 'error' GROUP BY ALL)"


@query(
    f"""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'),
b AS (SELECT c.event_id, c.ts, e.ts AS bt, e.late FROM c ASOF LEFT JOIN {_ERRORS} e ON c.user_id = e.user_id AND c.ts >= e.ts),
f AS (SELECT c.event_id, e.ts AS ft, e.early FROM c ASOF LEFT JOIN {_ERRORS} e ON c.user_id = e.user_id AND c.ts <= e.ts),
n AS (SELECT event_id, epoch_us(ts) - epoch_us(bt) AS before, epoch_us(ft) - epoch_us(ts) AS after, late, early FROM b JOIN f USING (event_id))
SELECT event_id, CASE WHEN coalesce(before <= after, after IS NULL) THEN CASE WHEN before <= 43200000000 THEN late END WHEN after <= 43200000000 THEN early END AS nearest_error FROM n""",
    plain=True,
)
def j14_asof_nearest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event with the user's error event nearest in time, within half a day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", temporal.micros("ts").alias("at"))
    errors = events.where("event_type = 'error'").select("user_id", "at", F.col("event_id").alias("error_id"))
    met = temporal.asof_join(events.where("event_type <> 'error'").drop("event_type"), errors, "user_id", "at", "at", "nearest", 12 * 3_600_000_000)
    return met.select("event_id", F.col("match.error_id").alias("nearest_error"))


@query(
    f"""WITH s AS (SELECT l_orderkey, o_custkey AS key, l_shipdate AS at, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT o_orderkey, o_custkey AS key, CASE WHEN o_orderkey % 1000 = 0 THEN TIMESTAMP '1990-01-01' ELSE o_orderdate END AS lo, max(l_shipdate) AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, count(*) AS shipments, round(sum(l_quantity), 4) AS quantity FROM i JOIN s ON s.key = i.key AND s.at >= i.lo AND s.at < i.hi GROUP BY o_orderkey""",
    plain=True,
)
def j15_shipments_in_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the shipments to its customer between the order and its own last shipment; a thousandth of the intervals begin years earlier."""
    sent = materialised(_shipments(spark, sf_dir))
    long_ = F.when(F.col("o_orderkey") % 1000 == 0, F.lit(631_152_000_000_000).cast("long")).otherwise(F.col("placed"))
    span = sent.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("at").alias("hi")).join(_placed(spark, sf_dir), "o_orderkey").select("o_orderkey", "key", long_.alias("lo"), "hi")
    met = temporal.interval_join(materialised(span), sent.select("key", "at", "l_quantity"), "key", "lo", "hi", "at", unit=7 * 86_400_000_000)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("shipments"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
