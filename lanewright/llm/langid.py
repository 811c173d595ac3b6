"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the list of the most frequent character 1- to 3-grams, by rank. A document's own profile is compared with
each language's: every n-gram adds the difference of its two ranks, or the profile length when the language lacks it.

Defined cases: null text or a text without letters gives `und` with score 0; equal frequencies rank by n-gram code;
equal distances go to the smaller language name; repeated rows count once each; an empty table or no labelled row
gives `und` throughout; very long texts are counted whole, CHUNK code points at a time; other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import id_remainder

PROFILE = 400
CHUNK = 1 << 20
_GAP = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point if it is a letter, else 0."""
    table = np.zeros(0x110000, np.int64)
    known = [c for c in range(len(table)) if chr(c).isalpha()]
    table[known] = known
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the lower-cased words, each word padded by one gap."""
    code = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    keep = code > 0
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code[~keep] = _GAP
    keep[1:] |= keep[:-1]  # the first non-letter after a letter stays, as the gap
    code = np.concatenate(([_GAP], code[keep], [_GAP]))
    if code[-2] == _GAP:
        code = code[:-1]
    if len(code) <= CHUNK:
        return _counted(code)
    parts = [_counted(code[lo : lo + CHUNK + 2], CHUNK) for lo in range(0, len(code), CHUNK)]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(code: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams that start among the first `size` codes."""
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    one = code[:size]
    return np.unique(np.concatenate((one[one != _GAP], two[:size], three[:size])), return_counts=True)


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, by rank; ties by code."""
    if len(keys) > 4 * n:  # all that tie with the n-th stay for the exact order below
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:n]]


def train_profiles(docs: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles from all labelled rows. Only `size` n-grams of each language reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang", sort=False)["text"]:
                each = [grams(t) for t in part]
                keys, at = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.bincount(at, np.concatenate([c for _, c in each]), len(keys)).astype(np.int64)})

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("r", rank).where(F.col("r") <= size).select("lang", "r", "gram").toPandas().sort_values(["lang", "r"])
    return {lang: part["gram"].to_numpy() for lang, part in best.groupby("lang")}


class Ranker:
    """Distances of one document's profile to all language profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        self.by_code = [(np.sort(profiles[x]), np.argsort(profiles[x], kind="stable")) for x in self.names]

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text or "")
        if not len(keys) or not self.names:
            return "und", 0.0
        own = top(keys, counts, self.size)
        rank, far = np.arange(len(own)), []
        for codes, ranks in self.by_code:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far.append(int(np.where(codes[at] == own, np.abs(ranks[at] - rank), self.size).sum()))
        best = int(np.argmin(far))
        return self.names[best], 1.0 - far[best] / (self.size * len(own))


def guess(profiles: dict[str, np.ndarray], size: int = PROFILE) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        model = Ranker(profiles, size)
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict


def language_id(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Learn from the documents whose id remainder mod 3 is not 1, then predict for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = train_profiles(rows.where(id_remainder(3) != 1), size)
    found = rows.select("doc_id", (id_remainder(3) == 1).alias("held_out"), guess(profiles, size)(F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score")
