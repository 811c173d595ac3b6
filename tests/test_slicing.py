"""Natural slices and windows against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanewright.operators import slicing


def every_cut(ns: list[int], costs: list[int], limit: int) -> list[list[int]]:
    """All cuts tried; the best by number, cost, and then the earliest begin of the last slice, of the one before it, and so on."""
    found = []
    for inner in itertools.product([False, True], repeat=max(0, len(ns) - 1)):
        ends = [k + 1 for k, x in enumerate(inner) if x] + [len(ns)]
        begins = [0, *ends[:-1]]
        if all(sum(ns[a:b]) <= limit for a, b in zip(begins, ends, strict=True)):
            found.append((len(ends), sum(costs[e - 1] for e in ends), begins[::-1], ends))
    _, _, begins, ends = min(found)
    return [[sum(ns[:a]), sum(ns[a:b]), costs[b - 1]] for a, b in zip(begins[::-1], ends, strict=True)]


def test_best_cut_by_brute_force() -> None:
    rng = random.Random(3)
    for _ in range(400):
        limit = rng.randint(3, 12)
        k = rng.randint(1, 11)
        ns, costs = [rng.randint(1, limit) for _ in range(k)], [*(rng.randint(0, 2) for _ in range(k - 1)), 0]
        assert slicing.best_cut(ns, costs, limit) == every_cut(ns, costs, limit)
    assert slicing.best_cut([], [], 5) == []
    long_ = slicing.best_cut([3] * 300_000, [1] * 299_999 + [0], 8)  # linear
    assert len(long_) == 150_000 and sum(x[1] for x in long_) == 900_000


TEXTS = [
    (1, "One two three. Four five! Six seven eight nine?\nTen eleven."),
    (2, "no sentence ends in this text of eleven words at all"),
    (3, ""), (4, None), (5, " \n \n"), (6, "a"), (6, "a"), (6, "b c"), (None, "He said \"go.\" Then (he left.) And 3.5 is a number"),
    (7, "wide paragraph. end… more  words\there"), (8, "x. " * 40),
]


@pytest.mark.parametrize("limit", [1, 4, 6, 50])
def test_slices_keep_every_word(spark: SparkSession, limit: int) -> None:
    docs = spark.createDataFrame([(*r, 9) for r in TEXTS], "id long, text string, n_ int").repartition(3)
    got = slicing.slice_rows(docs, limit).withColumn("words", slicing.slice_text(F.col("text"), F.col("first"), F.col("n"))).collect()
    assert all(1 <= r["n"] <= limit and len(r["words"].split()) == r["n"] for r in got)
    for id_, text in set(TEXTS):
        mine = sorted((r for r in got if (r["id"], r["text"]) == (id_, text)), key=lambda r: r["piece"])
        copies = TEXTS.count((id_, text))
        assert " ".join(r["words"] for r in mine[::copies]) == " ".join((text or "").split()) and len(mine) % copies == 0
    assert slicing.slice_rows(docs.where("false"), limit).count() == 0


def test_slices_end_where_sentences_do(spark: SparkSession) -> None:
    docs = spark.createDataFrame(TEXTS[:1] + TEXTS[8:10], "id long, text string")
    got = [(r["id"], r["words"], r["ends"]) for r in slicing.slice_rows(docs, 6).withColumn("words", slicing.slice_text(F.col("text"), F.col("first"), F.col("n"))).orderBy("id", "piece").collect()]
    assert got == [
        (None, 'He said "go." Then (he left.)', "sentence"), (None, "And 3.5 is a number", "paragraph"),
        (1, "One two three. Four five!", "sentence"), (1, "Six seven eight nine? Ten eleven.", "paragraph"),
        (7, "wide paragraph. end… more words here", "paragraph"),
    ]


@pytest.mark.parametrize("part", [1, 2, 64])
def test_windows_by_brute_force(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, part: int) -> None:
    monkeypatch.setattr(slicing, "PART", part)
    rng, limit = random.Random(part), 10
    rows = [("hot" if k % 3 else f"s{k % 5}", k, " ".join(rng.choice(["w", "w", "w", "end."]) for _ in range(rng.choice([0, 1, 3, 8, 35])))) for k in range(120)]
    docs = spark.createDataFrame(rows, "shard string, doc long, text string").repartition(4)
    got = slicing.concatenated(docs, "shard", "doc", limit).collect()
    mine = {(r["shard"], r["doc"], r["piece"]): r for r in got}
    assert len(mine) == len(got) and sum(r["n"] for r in got) == sum(len(t.split()) for *_, t in rows)
    for shard in {r[0] for r in rows}:
        off, was, win, fill = 0, None, 0, 0
        for _, doc, text in sorted(r for r in rows if r[0] == shard):
            at = off // (part * limit)
            for piece in itertools.takewhile(lambda p, d=doc, s=shard: (s, d, p) in mine, itertools.count()):
                r = mine[shard, doc, piece]
                if at != was:
                    was, win, fill = at, 0, 0
                if fill + r["n"] > limit:
                    win, fill = win + 1, 0
                assert (r["part"], r["win"], r["pos"]) == (at, win, fill) and fill + r["n"] <= limit
                fill += r["n"]
            off += len(text.split())
    assert slicing.concatenated(docs.where("false"), "shard", "doc", limit).count() == 0
