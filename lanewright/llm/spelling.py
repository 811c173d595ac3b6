"""Spelling variants of one word, found in forward and reversed sorted dictionaries.

Two words within one edit, the shorter of L letters: cut it in halves, and the edit leaves either the first half of both or the
second half of both as it was. So every word stands in a forward dictionary under its first half and in a reversed one under its
second, once for L its own length and once for L one less, and only words that share such a block are compared. A block is a
stretch (lo, hi) of letters in which the edit lies, with all letters around it shared. Blocks of more than `split` words are
subdivided: the stretch is cut in halves again and the words go into a longer shared prefix and a longer shared suffix, until a
block is small or its stretch is one letter, where the alphabet bounds it. No block is capped. Every pair is verified letter by
letter in the one block that holds its first different letter, so it is found exactly once.

The form of a word is the near word of the largest count (ties: smallest in code-point order) if that is at least `factor` times
its own; roots follow forms by pointer doubling. Counts grow by the factor along forms, so there is no cycle.

Defined cases: null text has no words, a null doc_id counts as empty text; repeated rows count again; texts without runs and empty
tables give no rows; very long runs and texts are read whole; only A-Z is lower-cased; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import remove, shared_dir, texts, written

RUN = "[a-z\\u00C0-\\u00FF]"
SPLIT = 128


def counted(docs: DataFrame, min_chars: int = 7, min_count: int = 2, misspell: int = 0) -> DataFrame:
    """word, n: runs of letters of at least `min_chars` code points that occur `min_count` times in all.

    With `misspell`, each run of a document whose unsigned crc32 h of `<doc_id>:<run>` it divides loses the code point h % length.
    """
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))).alias("word"))
    if misspell:
        h = F.crc32(F.concat("doc", F.lit(":"), "word"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(misspell)) == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _stretch(length: Column, lo: Column, hi: Column) -> Column:
    """The rows of a word in the block of a stretch: its id sorts by the shared letters, the suffix from its end."""
    longer = F.length("word") - length
    prefix, suffix = F.substring("word", F.lit(1), lo), F.reverse(F.substring("word", hi + longer + 1, F.length("word")))
    block = F.concat(prefix, F.lit("|"), suffix, F.lit("|"), length.cast("string"), F.lit("|"), lo.cast("string"), F.lit("|"), hi.cast("string"))
    return F.struct(block.alias("block"), length.alias("length"), lo.alias("lo"), hi.alias("hi"), longer.alias("longer"))


def _halves(rows: DataFrame, length: Column, lo: Column, hi: Column) -> DataFrame:
    """Each row in the two halves of its stretch: block, length, lo, hi, longer, word, n."""
    mid = F.floor((lo + hi) / 2).cast("int")
    return rows.select(F.explode(F.array(_stretch(length, mid, hi), _stretch(length, lo, mid))).alias("x"), "word", "n").select("x.*", "word", "n")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of each word within its block; rows come sorted by block, the words of `length` letters before the longer ones."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        open_ = b["block"] == b["block"].iloc[-1] if len(b) else []
        rest = b[open_]
        yield _near(b[~np.asarray(open_, bool)])
    if rest is not None:
        yield _near(rest)


def _near(b: pd.DataFrame) -> pd.DataFrame:
    found = [x for r, part in b.groupby(b["hi"] - b["lo"], sort=False) for x in _near_of(part, int(r))]
    return pd.DataFrame(found, columns=["word", "n_near", "form", "form_n"], dtype=object)


def _near_of(b: pd.DataFrame, width: int) -> Iterator[tuple[str, int, str, int]]:
    """word, n_near, form, form_n for blocks whose stretch has `width` letters: each row is compared with the rows after it in its block."""
    words, lo, longer = b["word"].tolist(), b["lo"].to_numpy(), b["longer"].to_numpy()
    n, ends = b["n"].to_numpy(), (b["hi"] == b["length"]).to_numpy()
    block = pd.factorize(b["block"])[0]
    letters = np.array([w[x : x + width + g] for w, x, g in zip(words, lo.tolist(), longer.tolist(), strict=True)], f"U{width + 1}").view(np.uint32).reshape(-1, width + 1)
    rank = np.empty(len(b), np.int64)
    best_first = sorted(range(len(b)), key=lambda k: (-int(n[k]), words[k]))
    rank[best_first] = np.arange(len(b))
    count, best = np.zeros(len(b), np.int64), np.full(len(b), len(b))
    alive, step = np.flatnonzero(longer == 0), 0
    while True:
        step += 1
        alive = alive[alive + step < len(b)]
        alive = alive[block[alive] == block[alive + step]]
        if not len(alive):
            break
        a, c, insert = letters[alive], letters[alive + step], longer[alive + step] == 1
        same = a[:, :width] == c[:, :width]
        first = np.where(same.all(1), width, same.argmin(1))
        shifted = ((a[:, :width] == c[:, 1:]) | (np.arange(width) < first[:, None])).all(1)
        near = np.where(insert, shifted & ((first < width) | ends[alive]), same.sum(1) == width - 1)
        for one, two in ((alive[near], alive[near] + step), (alive[near] + step, alive[near])):
            np.add.at(count, one, 1)
            np.minimum.at(best, one, rank[two])
    got = np.flatnonzero(count)
    for k in got.tolist():
        form = best_first[best[k]]
        yield words[k], int(count[k]), words[form], int(n[form])


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, n_near, best (n, word) of the near word of largest count, for the words that have one; `words` (word, n) are distinct."""
    least = words.agg(F.min(F.length("word"))).first()[0] or 0
    frames = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("f")).where(F.col("f") >= max(least, 1))
    rows = _halves(frames, F.col("f"), F.lit(0), F.col("f"))
    ready: list[DataFrame] = []
    while True:
        blocks = rows.groupBy("block").agg(F.count("*").alias("size"), F.min("longer").alias("least"))
        blocks = written(blocks.where("size > 1 and least = 0").select("block", "size"))  # written: a join of two tables, which Spark splits where a key is hot
        wide = (F.col("size") > split) & (F.col("hi") - F.col("lo") > 1)
        met = written(rows.join(blocks, "block").select(*rows.columns, wide.alias("wide")))
        ready.append(met.where(~F.col("wide")).drop("wide"))
        big = met.where("wide")
        if big.isEmpty():
            break
        rows = _halves(big, F.col("length"), F.col("lo"), F.col("hi"))
    met = reduce(DataFrame.unionByName, ready).repartitionByRange("block").sortWithinPartitions("block", "longer", "word")
    found = met.mapInPandas(_scan, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")).select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows of word, form: the last word reached by following forms."""
    spark = forms.sparkSession
    now = written(forms.select("word", F.col("form").alias("root")), path := shared_dir(spark))
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        nxt = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), new := shared_dir(spark))
        remove(spark, path)
        now, path = nxt.select("word", "root"), new
        if nxt.where("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = 10, split: int = SPLIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with counts (word, n)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    held = (F.col("form_n") >= factor * F.col("n")).alias("held")
    met = written(words.join(near_words(words, split), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("form")).alias("form"), F.when(held, F.col("form_n")).alias("form_n")))
    root = roots(met.where("form is not null").select("word", "form"))
    return met.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of the documents, a 31st of whose runs have lost a letter."""
    return variants(counted(docs, misspell=31))
