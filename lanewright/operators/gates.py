"""Document gates: length, repetition, scripts, licences, contamination, duplicates, bands and plan arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.columns import words
from lanewright.sources.shared import materialised


def ngrams(w: Column, n: int | Column) -> Column:
    """All runs of n words, joined by a blank; none if the text has fewer words."""
    last = F.size(w) - n
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def distinct_ngrams(column: str, n: int) -> Column:
    """Hashes of the distinct n-grams of a column of words (a column: an expression would be evaluated for every n-gram)."""
    return F.array_distinct(ngram_hashes(F.col(column), n))


def ngram_hashes(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, of the words in place: no text is built."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def repetition(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_words, repeated: 1 - distinct / all n-grams (0 if there is none)."""
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), ngram_hashes(F.col("w"), n).alias("g"))
    share = F.when(F.size("g") > 0, F.round(1 - F.size(F.array_distinct("g")) / F.size("g"), 6)).otherwise(F.lit(0.0))
    return rows.select("doc_id", "n_words", share.alias("repeated"))


def scripts(docs: DataFrame) -> DataFrame:
    """doc_id, n_letters, latin (share of letters in Latin script), cross (share of words with two scripts or more)."""
    text = F.coalesce("text", F.lit(""))
    letters, latin = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    w = words(text)
    mixed = F.size(F.filter(w, lambda x: x.rlike(r"\p{IsLatin}") & x.rlike(r"[\p{L}&&[^\p{IsLatin}]]")))
    return docs.select("doc_id", letters.cast("long").alias("n_letters"), F.round(F.when(letters > 0, latin / letters).otherwise(0.0), 6).alias("latin"), F.round(F.when(F.size(w) > 0, mixed / F.size(w)).otherwise(0.0), 6).alias("cross"))


# Licence phrases and what the plan's rules say of them.
LICENSE_RULES = (
    ("CC BY-NC", "NOT_USABLE"),
    ("CC BY-SA", "USABLE_SHARE_ALIKE"),
    ("CC BY", "USABLE_ATTRIBUTION"),
    ("GODL", "USABLE_ATTRIBUTION"),
    ("Apache License", "REVIEW"),
    ("MIT License", "REVIEW"),
    ("GNU General Public License", "REVIEW"),
)


def license_policy(docs: DataFrame) -> DataFrame:
    """doc_id, phrase (the first rule that occurs), policy; no phrase means not usable."""
    phrase, policy = F.lit(None).cast("string"), F.lit("NOT_USABLE")
    for name, rule in reversed(LICENSE_RULES):
        hit = F.contains(F.coalesce("text", F.lit("")), F.lit(name))
        phrase, policy = F.when(hit, name).otherwise(phrase), F.when(hit, rule).otherwise(policy)
    return docs.select("doc_id", phrase.alias("phrase"), policy.alias("policy"))


def snapshot_duplicates(docs: DataFrame, by: list[str]) -> DataFrame:
    """doc_id, and whether it is the kept (least) one of its group: equal normalised text within the same `by`.

    The least id is a partial aggregate joined back, so a group of very many copies is never sorted in one task.
    """
    norm = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+", " ")), 256)
    rows = docs.select("doc_id", *by, norm.alias("h"))
    least = rows.groupBy(*by, "h").agg(F.min("doc_id").alias("keep"))
    return rows.join(least, [*by, "h"]).select("doc_id", (F.col("doc_id") == F.col("keep")).alias("kept"))


def overlap_with_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 5, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_id, share of the item's distinct n-grams that the document holds. An inverted index: equi-join on n-grams."""
    mine = docs.select(key, words(F.col(text_col)).alias("w")).select(key, F.explode(distinct_ngrams("w", n)).alias("g"))
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).select("item_id", distinct_ngrams("w", n).alias("gs"))
    index = items.select("item_id", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    hits = mine.join(index, "g").groupBy(key, "item_id", "size").count()
    return hits.select(key, "item_id", F.round(F.col("count") / F.col("size"), 6).alias("share"))


def similar_lines(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 3) -> DataFrame:
    """doc_id, item_id of lines whose n-word shingle sets have Jaccard >= `least` with an item's.

    Only distinct lines are compared; candidates share a shingle, counted by an equi-join; sets that differ too much in size
    to reach the threshold are dropped in the join.
    """
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).withColumn("lh", F.md5("line"))
    text = lines.groupBy("lh").agg(F.first("line").alias("line")).select("lh", words(F.col("line")).alias("w")).select("lh", distinct_ngrams("w", n).alias("gs"))
    a = text.select("lh", F.size("gs").alias("na"), F.explode("gs").alias("g"))
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).select("item_id", distinct_ngrams("w", n).alias("gs"))
    b = items.select("item_id", F.size("gs").alias("nb"), F.explode("gs").alias("g"))
    near = a.join(b, "g").where((F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)).groupBy("lh", "item_id", "na", "nb").count()
    near = near.where(F.col("count") >= least * (F.col("na") + F.col("nb") - F.col("count"))).select("lh", "item_id")
    return lines.select("doc_id", "lh").join(near, "lh").select("doc_id", "item_id").distinct()


def window_reaches(text: np.ndarray, item: np.ndarray, least: float) -> bool:
    """Whether the distinct shingles of some run of the text's have Jaccard >= `least` with the item's distinct ones.

    The best run starts and ends at shingles of the item and holds at most len(item) / least distinct ones.
    """
    hit, at = np.isin(text, item), np.arange(len(text))
    order = np.argsort(text, kind="stable")
    before = np.full(len(text), -1)  # where the same shingle stood last
    before[order[1:]] = np.where(text[order[1:]] == text[order[:-1]], order[:-1], -1)
    for start in at[hit]:
        size = 4 * len(item)
        while True:
            new = before[start : start + size] < start
            union, common = np.cumsum(new), np.cumsum(new & hit[start : start + size])
            if (common / (len(item) + union - common) >= least).any():
                return True
            if start + size >= len(text) or union[-1] * least > len(item):
                break
            size *= 4
    return False


def similar_windows(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, item_id of documents with a window (any run of n-word shingles) of Jaccard >= `least` with a whole item's.

    Line breaks are white space on both sides. Items of fewer than n words count as one shingle of their own length.
    Candidates hold `least` of an item's shingles, counted by an equi-join; only their texts are read again.
    """
    items = benchmark.select("item_id", F.md5("text").alias("ih"), words(F.col("text")).alias("w")).withColumn("k", F.least(F.size("w"), F.lit(n))).where("k > 0")
    items = items.select("item_id", "ih", "k", F.array_distinct(F.transform(ngrams(F.col("w"), F.col("k")), lambda x: F.xxhash64(x))).alias("gs"))
    texts = docs.select("doc_id", F.md5("text").alias("h"), words(F.col("text")).alias("w"))
    sizes = F.broadcast(items.select("k").distinct())  # n rows at most
    mine = texts.crossJoin(sizes).select("h", "k", F.explode(F.array_distinct(F.transform(ngrams(F.col("w"), F.col("k")), lambda x: F.xxhash64(x)))).alias("g"))
    index = items.dropDuplicates(["ih"]).select("ih", "k", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    held = mine.join(index, ["k", "g"]).groupBy("h", "ih", "k", "size").agg(F.count_distinct("g").alias("held"))
    pairs = materialised(held.where(F.col("held") / F.col("size") >= least).select("h", "ih", "k"))

    @F.pandas_udf("boolean")
    def reaches(text: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([window_reaches(t, i, least) for t, i in zip(text, item, strict=True)], dtype=bool)

    found = texts.join(pairs, "h").select("doc_id", "ih", F.transform(ngrams(F.col("w"), F.col("k")), lambda x: F.xxhash64(x)).alias("g"))
    return found.join(items.select("item_id", "ih", "gs"), "ih").where(reaches("g", "gs")).select("doc_id", "item_id").distinct()


def band(n: Column) -> Column:
    """Difficulty band by output length in tokens."""
    return F.when(n <= 256, 1).when(n <= 1024, 2).when(n <= 4096, 3).otherwise(4)
