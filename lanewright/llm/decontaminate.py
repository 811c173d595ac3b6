"""Benchmark decontamination by winnowing, in DataFrame functions only.

Training and benchmark texts are cut into words; every window of `SPAN - GRAM + 1` consecutive `GRAM`-word hashes keeps
its minimum. A shared span of `SPAN` words holds the same window of hashes on both sides, so its minimum is a
fingerprint of both: the join on fingerprints misses no such span. Around each hit all `SPAN`-word windows that hold the
hit are then compared word by word with the benchmark's windows. Items shorter than `SPAN` words are one window of
their own length, joined directly (their lengths are at most 12 numbers).

Defined cases: null or empty text has no words, so nothing hits; repeated documents get equal rows; repeated items
count each id once; an item with a null id marks words but is in no list; an empty benchmark leaves every document
clean; very long texts give rows in proportion to their words; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import broadcast_if_small, texts, written

SPAN = 13
GRAM = 8
#: Rows of a side that is broadcast at most; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and all other non-ASCII characters."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD, -1), "")


def _grams(h: Column) -> Column:
    n = F.size(h) - GRAM
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(h, i + 1, GRAM)))).otherwise(F.array().cast("array<bigint>"))


def _minima(g: Column) -> Column:
    """The minimum of every window of SPAN - GRAM + 1 hashes."""
    n = F.size(g) - (SPAN - GRAM + 1)
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array_min(F.slice(g, i + 1, SPAN - GRAM + 1))))).otherwise(F.array().cast("array<bigint>"))


def _hashes(rows: DataFrame) -> DataFrame:
    """Adds g, the hash of the GRAM words from each position on. Columns by steps: each is computed once."""
    return rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("g", _grams(F.col("h"))).drop("h")


def fingerprints(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct fingerprint of the word array w."""
    return _hashes(rows.where(F.size("w") >= SPAN)).select(*keep, F.explode(_minima(F.col("g"))).alias("fp"))


def _windows(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """Every window of n words with its start (from 0)."""
    starts = F.sequence(F.lit(0), F.size("w") - n)
    return rows.where(F.size("w") >= n).select(*keep, "w", F.explode(starts).alias("at")).select(*keep, "at", F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("window"))


def _short_windows(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """key, at, window, n of the document windows of n words whose hash an item of n words has; words are joined on a hit only."""
    known = broadcast_if_small(items.where(F.size("w") == n).select(F.xxhash64("w").alias("fp")).distinct(), BROADCAST_ROWS)
    starts = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("w", i + 1, n)).alias("fp")))
    each = docs.where(F.size("w") >= n).select("key", "w", F.explode(starts).alias("x")).select("key", "w", "x.at", "x.fp")
    return each.join(known, "fp", "left_semi").select("key", "at", F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("window"), F.lit(n).alias("n")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (MD5 of the text), n_hit, n_items, items_sha256 for the texts that hold a window; docs: key and words w."""
    items = written(texts(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0))
    short = sorted(r[0] for r in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect())

    prints = broadcast_if_small(fingerprints(items).distinct(), BROADCAST_ROWS)
    hit = written(fingerprints(docs, "key").join(prints, "fp", "left_semi").distinct())
    lists = hit.groupBy("key").agg(F.collect_set("fp").alias("fps"))  # at most the text's own fingerprints
    found = docs.select("key", "w").join(broadcast_if_small(hit.select("key").distinct(), BROADCAST_ROWS), "key", "left_semi")
    found = _hashes(found.dropDuplicates(["key"]).join(lists, "key"))
    spots = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains("fps", x), i)), lambda i: i.isNotNull())
    around = found.select("key", "w", F.explode(spots).alias("p"))
    n = F.size("w") - SPAN
    starts = F.sequence(F.greatest(F.col("p") - (SPAN - GRAM), F.lit(0)), F.least("p", n))
    spans = around.where(F.size("w") >= SPAN).select("key", "w", F.explode(F.when(F.least(F.col("p"), n) >= F.greatest(F.col("p") - (SPAN - GRAM), F.lit(0)), starts)).alias("at"))
    spans = spans.select("key", "at", F.array_join(F.slice("w", F.col("at") + 1, SPAN), " ").alias("window"), F.lit(SPAN).alias("n")).distinct()
    parts = [spans, *(_short_windows(docs, items, m) for m in short)]
    whole = [_windows(items.where(F.size("w") >= SPAN), SPAN, "item_id"), *(_windows(items.where(F.size("w") == m), m, "item_id") for m in short)]
    owner = reduce(DataFrame.unionByName, whole).select("item_id", "window").distinct()
    known = broadcast_if_small(owner.select("window").distinct(), BROADCAST_ROWS)
    real = written(reduce(DataFrame.unionByName, [p.join(known, "window", "left_semi").select("key", "at", "n", "window") for p in parts]))

    # Words covered: from each window on, those before the furthest end so far are counted already.
    ends = F.array_sort(F.collect_set(F.struct("at", F.col("n").cast("long").alias("n"))))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["total"] + F.greatest(F.lit(0).cast("long"), x["at"] + x["n"] - F.greatest(s["end"], x["at"].cast("long")))).alias("total"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    covered = real.groupBy("key").agg(F.aggregate(ends, zero, step)["total"].alias("n_hit"))
    # Windows held by the same items are one class, so a window common to many items gives a text one row and not one an item.
    by_window = owner.where("item_id is not null").groupBy("window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    by_window = written(by_window.withColumn("class", F.md5(F.array_join("items", ","))))
    by_class = broadcast_if_small(by_window.groupBy("class").agg(F.first("items").alias("items")), BROADCAST_ROWS)
    by_item = real.select("key", "window").distinct().join(broadcast_if_small(by_window.select("window", "class"), BROADCAST_ROWS), "window").select("key", "class").distinct()
    by_item = by_item.join(by_class, "class").groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return written(covered.join(by_item, "key", "left").select("key", "n_hit", F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256")))


def _worded(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.md5("text").alias("key"), words(F.col("text")).alias("w"))


def _bad(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = _worded(docs)
    result = broadcast_if_small(hits(docs, benchmark), BROADCAST_ROWS)
    n_hit, zero = F.coalesce("n_hit", F.lit(0).cast("long")), F.lit(0).cast("long")
    plain = docs.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    empty = F.col("key") == F.md5(F.lit(""))  # rows without a text meet no join
    out = plain.where(~empty).join(result, "key", "left").unionByName(plain.where(empty), allowMissingColumns=True)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), _bad(n_hit, F.col("n_words")).alias("contaminated"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key: the MD5 of each contaminated text, once."""
    docs = _worded(docs)
    found = broadcast_if_small(hits(docs, benchmark).select("key", "n_hit"), BROADCAST_ROWS)
    return docs.select("key", F.size("w").alias("n_words")).join(found, "key").where(_bad(F.col("n_hit"), F.col("n_words"))).select("key").distinct()
