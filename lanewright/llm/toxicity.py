"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of two lexicons, how near second-person words stand to their entries, capitals, punctuation and
obfuscation. The fixed lexicon holds general English insults; the learnt one holds words and beginnings of words that labelled
toxic texts have more often than clean ones, in any language. The model (lexicon, trees, calibration) is fitted by Spark on at most
about `TRAIN_ROWS` labelled rows, taken by the hash of the id (a documented bound; with fewer rows all are used). So the labels that
are learnt from can be broadcast, and texts are neither shuffled nor read but in their scan, however many there are. Of the
lexicon's document frequencies only the best entries, at most `LEXICON`, reach the driver.

Three parts of the labelled rows keep the parts of the model apart: each half of the training rows gets lexicon features from the
lexicon learnt on the other half, trees learn from four fifths of those, and the calibration learns from the rest, which no tree saw.

Defined cases: null and empty texts and texts without words have features of zero and get a score like any other; repeated rows are
scored each, and learnt from each; a null id counts as the empty string; rows without a label are scored and not learnt from; several
labels of an id count each; if one class is missing among the training rows, every score is the share of the other (0 without
rows); very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import broadcast_if_small, id_remainder, written

#: Entries of the learnt lexicon, and about how many labelled rows the model is fitted on at most.
LEXICON = 2000
TRAIN_ROWS = 400_000
#: Least documents that an entry occurs in, and least deviation (in standard errors) of its share among toxic ones.
LEAST_DOCS, LEAST_Z = 3, 4.0
TREES, DEPTH = 30, 4

INSULTS = frozenset(
    "arse arsehole ass asshole bastard bitch braindead bullshit clown coward crap creep cretin cunt degenerate dick dimwit dirtbag disgrace disgusting douche dumb dumbass "
    "dunce fag failure fool freak fuck fucker fucking garbage gross hate hideous horrible idiot idiotic ignorant imbecile jackass jerk liar loser lowlife lunatic maggot moron "
    "moronic motherfucker nasty nitwit parasite pathetic pig prick psycho rat repulsive retard retarded rubbish scum scumbag shit shithead shut sick sleaze slime slut snake "
    "stupid sucker sucks swine trash twat twit ugly useless vermin vile wanker whore wimp worthless worst kill die despicable filth filthy lazy".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti tuyo usted ustedes vosotros".split())
#: Signs that stand for letters.
DISGUISE = str.maketrans("013457@$!|€", "oieastasiie")
#: Words within which a second-person word is near.
NEAR = 5
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W_]+(?:[@$!|€*'’-]+[^\W_]+)*", re.UNICODE)
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_LONG = re.compile(r"(.)\1{2,}")
_MARKS = re.compile(r"[!?]{2,}")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def plain(word: str) -> str:
    """The word without disguise: signs become letters, other signs go, letters met three times or more are met once."""
    return _LONG.sub(r"\1", re.sub(r"[\W_]", "", word.lower().translate(DISGUISE)))


def entries(words: list[str]) -> set[str]:
    """What of a text can be an entry of the learnt lexicon: its words and, marked by a star, their beginnings."""
    low = {w.lower() for w in words}
    return low | {f"{w[:k]}*" for w in low for k in STEMS if len(w) > k}


#: Words whose kinds a task remembers at most.
REMEMBERED = 200_000


class Kinds(dict):
    """What each word is: (insult, hidden insult, weight, disguised, capitals, a letter met three times, second person); None, as most are, if nothing of it."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.heads = {w[: STEMS[0]] for w in weights if w.endswith("*")}

    def __missing__(self, word: str) -> tuple | None:
        if len(self) >= REMEMBERED:
            self.clear()
        w = word.lower()
        odd = not w.isalpha() and any(c.isalpha() for c in w)
        long_ = _LONG.search(w) is not None
        insult = w in INSULTS or w.endswith("s") and w[:-1] in INSULTS
        weight = max(self.weights.get(w, 0.0), 0.0)
        if w[: STEMS[0]] in self.heads:
            weight = max([weight, *(self.weights.get(f"{w[:k]}*", 0.0) for k in STEMS if len(w) > k)])
        out = (insult, not insult and (odd or long_) and plain(w) in INSULTS, weight, odd, word.isupper() and len(word) > 1, long_, w in YOU)
        self[word] = out if any(out) else None
        return self[word]


#: Code points up to here are counted by table.
TABLE = 0x400
_CHARS = [chr(k) for k in range(TABLE)]


def signs_of(text: str) -> dict[str, int]:
    """How often each code point occurs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max() >= TABLE:
        return Counter(text)
    n = np.bincount(codes, minlength=TABLE)
    at = np.flatnonzero(n)
    return {_CHARS[c]: k for c, k in zip(at.tolist(), n[at].tolist(), strict=True)}


def features(text: str | None, weights: dict[str, float], kinds: Kinds | None = None) -> list[float]:
    """The dense features, in the order of NAMES; `kinds` remembers words between texts."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = Kinds(weights) if kinds is None else kinds
    insults = hidden = learnt = strong = odd = capitals = long_ = 0
    weight, most, strong_words = 0.0, 0.0, set()
    told = [kinds[w] for w in words]
    at, you = [], []
    for k, kind in enumerate(told):
        if kind is None:
            continue
        is_insult, is_hidden, w, is_odd, is_upper, is_long, is_you = kind
        insults += is_insult
        hidden += is_hidden
        odd += is_odd
        capitals += is_upper
        long_ += is_long
        if is_you:
            you.append(k)
        if w > 0:
            learnt += 1
            weight += w
            most = max(most, w)
            if w >= 2 * LEAST_Z:
                strong += 1
                strong_words.add(words[k].lower())
        if is_insult or is_hidden or w >= 2 * LEAST_Z:
            at.append(k)
    yours, near, j = len(you), 0, 0
    if you:
        for k in at:
            while j < len(you) and you[j] < k - NEAR:
                j += 1
            near += j < len(you) and you[j] <= k + NEAR
    signs = signs_of(text)
    letters = sum(k for c, k in signs.items() if c.isalpha()) or 1
    upper = sum(k for c, k in signs.items() if c.isupper())
    other = sum(k for c, k in signs.items() if not (c.isalnum() or c.isspace()))
    marks = signs.get("!", 0) + signs.get("?", 0)
    spelled = [plain(m) for m in _SPELLED.findall(text)]
    chars = len(text)
    return [
        insults / n, math.log1p(insults), hidden / n, math.log1p(hidden),
        learnt / n, strong / n, math.log1p(strong), weight / n, most, len(strong_words) / n,
        near / n, near / max(len(at), 1), yours / n,
        upper / letters, capitals / n, sum(told[k][4] for k in at) / max(len(at), 1),
        marks / chars, (len(_MARKS.findall(text)) if marks > 1 else 0) / n, other / chars,
        odd / n, long_ / n, len(spelled) / n, float(any(x in INSULTS for x in spelled)), math.log1p(n),
    ]


NAMES = (
    "insult_density insults hidden_density hidden learnt_density strong_density strong learnt_weight learnt_most strong_kinds near_you_density near_you_share you_density "
    "capital_letters capital_words capital_hits marks marks_runs punctuation disguised repeated spelled spelled_insult words"
).split()


def entry_counts(rows: DataFrame) -> DataFrame:
    """entry and, for each half (0 or 1), the toxic (a0, a1) and clean (b0, b1) texts that have it; from rows of half, text and toxic."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):  # bounded tables of counts
                each = [Counter() for _ in range(4)]
                part = b.iloc[lo : lo + 500]
                for half, text, toxic in zip(part["half"], part["text"], part["toxic"], strict=True):
                    each[2 * int(half) + 1 - int(toxic)].update(entries(words_of(text)))
                found = [(w, *(c[w] for c in each)) for w in set().union(*each)]
                yield pd.DataFrame(found, columns=["entry", "a0", "b0", "a1", "b1"], dtype=object)

    counted = rows.select("half", "text", "toxic").mapInPandas(count, "entry string, a0 long, b0 long, a1 long, b1 long")
    return counted.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")))


def lexicons(rows: DataFrame, size: int = LEXICON) -> tuple[dict[str, float], ...]:
    """Entries with their weights (standard errors) learnt on half 0, on half 1 and on both, from one count of the texts; ties by entry."""
    n = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows
    counts = written(entry_counts(rows).where(F.col("a0") + F.col("a1") >= LEAST_DOCS))  # no other entry can be in any of them

    def best(halves: tuple[int, ...]) -> dict[str, float]:
        one, two = (sum(n.get((h, t), 0) for h in halves) for t in (1, 0))
        if not one or not two:
            return {}
        a, b = (reduce(Column.__add__, [F.col(f"{c}{h}") for h in halves]) for c in "ab")
        share = (a + b + 1) / F.lit(one + two)
        z = (a / F.lit(one) - b / F.lit(two)) / F.sqrt(share * F.lit(1 / one + 1 / two))
        top = counts.where(a >= LEAST_DOCS).select("entry", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "entry").limit(size)
        return {r["entry"]: r["z"] for r in top.collect()}  # at most `size` rows

    return best((0,)), best((1,)), best((0, 1))


def lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """The lexicon of all rows (text, toxic)."""
    return lexicons(rows.withColumn("half", F.lit(0)), size)[2]


def with_features(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All columns but the text, and x: the features as a vector."""
    kept = [c for c in rows.columns if c != "text"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(weights)
        for b in batches:
            yield b[kept].assign(x=[features(t, weights, kinds) for t in b["text"]])

    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*kept).dtypes)
    return rows.mapInPandas(each, f"{schema}, x array<double>").withColumn("x", array_to_vector("x"))


def learn(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """From rows of part (0 to 4), text and toxic: a function that turns rows with text into rows with p instead of it."""
    rows = written(rows)
    halves = [rows.where("part < 2"), rows.where("part >= 2")]
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return lambda df: df.drop("text").withColumn("p", F.lit(float(toxic) / n if n else 0.0))
    first, second, weights = lexicons(rows.withColumn("half", (F.col("part") >= 2).cast("int")))
    crossed = [with_features(halves[0], second), with_features(halves[1], first)]
    crossed = crossed[0].unionByName(crossed[1])
    crossed = written(crossed.withColumn("label", F.col("toxic").cast("double")))
    fitted, apart = crossed.where("part <> 4"), crossed.where("part = 4")
    kinds = fitted.agg(F.min("toxic"), F.max("toxic")).first()
    if kinds[0] == kinds[1]:
        fitted = crossed
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=2, seed=7).fit(fitted)
    told = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    kinds = apart.agg(F.min("toxic"), F.max("toxic")).first()
    # Equal scores count as one, so a large group of copies is one row.
    points = told(apart).groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    level = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="level").fit(points) if kinds[0] != kinds[1] else None

    def score(df: DataFrame) -> DataFrame:
        out = told(with_features(df, weights))
        return level.transform(out).drop("p").withColumnRenamed("level", "p") if level else out

    return score


def sampled(known: DataFrame) -> DataFrame:
    """Of labels (id, toxic) about TRAIN_ROWS, by the hash of the id; all if they are no more."""
    n = known.count()
    share = min(1.0, TRAIN_ROWS / n) if n else 1.0
    return known if share == 1 else known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt where the id's remainder mod 5 is not 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null")
    part = F.pmod(F.floor(F.crc32(F.col("id").cast("string")) / 5), F.lit(5)).cast("int")
    known = sampled(known.where(id_remainder(5, "id") != 0).select("id", (F.col("toxic") > 0).cast("int").alias("toxic")))
    # Only an id with very many labels can make the sample larger than the bound; then the join is by shuffle.
    score = learn(rows.join(broadcast_if_small(known, 2 * TRAIN_ROWS), F.col("doc_id") == F.col("id")).select(part.alias("part"), "text", "toxic"))
    asked = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), (id_remainder(5) == 0).alias("held_out"), "text")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0))))
    return score(asked).select(F.nullif("doc", F.lit("")).cast("long").alias("doc_id"), "held_out", p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"))
