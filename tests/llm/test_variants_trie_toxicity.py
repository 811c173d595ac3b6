"""Spelling variants, the trie of conversations and toxicity against brute force, on small tables with nulls, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import DataFrame, SparkSession

from lanewright.llm import prefix_trie, spelling, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows: list[tuple], misspell: int) -> dict[str, int]:
    out: collections.Counter = collections.Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words: dict[str, int]) -> set[tuple]:
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelled() -> list[tuple]:
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    many = ["receved"] * 2 + ["received"] * 25 + ["receivedd"] * 300 + ["Received"] * 3
    runs = []
    for w in base:
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w))
            runs += [w] * rng.choice([1, 2, 40]) + [w[:k] + rng.choice("abéz") + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]] * 2
    runs += many + ["x" * 900, "x" * 901] * 2 + ["short"] * 9
    rng.shuffle(runs)
    rows = [(k, " ".join(runs[k * 40 : k * 40 + 40]), "a", 1) for k in range(len(runs) // 40 + 1)]
    return [*rows, rows[0], rows[0], (None, "Ohne Nummer: unnumbered unnumbered"), (None, None), (90, None), (91, ""), (92, "!! 12 ×÷ ÀÉÎÕÜÝß ÀÉÎÕÜÝß"), (93, "÷×÷×÷×÷ ÷×÷×÷×÷")]


@pytest.mark.parametrize("split", [128, 3])
def test_spelling(spark: SparkSession, split: int) -> None:
    rows = [(*r, "a", 1)[:4] for r in spelled()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    for misspell in (31, 0) if split == 128 else (31,):
        words = spelling.counted(docs, misspell=misspell)
        expected = plain_words(rows, misspell)
        assert {(r["word"], r["n"]) for r in words.collect()} == set(expected.items())
        got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(words, split=split).collect()]
        assert len(got) == len(expected) and set(got) == plain_variants(expected)
        assert any(r[1] and r[2] != r[1] for r in got)  # a chain of two forms
    if split == 128:
        assert spelling.spelling_variants(docs.where("false")).count() == 0
        assert spelling.spelling_variants(docs.where("text = ''")).count() == 0


def plain_trie(rows: list[tuple]) -> set[tuple]:
    convs: dict[int, list] = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).hexdigest(), r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + v[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, set()
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(m) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.add((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(5)
    say = lambda: (rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "é😀", "", "no"]))
    rows: list[tuple] = [(c, t, *say()) for c in [*range(40), *range(100, 130), 205, 300, 999, 2**40 + 1] for t in range(rng.randint(1, 9))]
    tower = [say() for _ in range(30)]
    rows += [(10_000 + 100 * k, t, *tower[t]) for k in range(30) for t in range(k + 1)]  # each is the one before and a turn more
    rows += [(500, t, "user", f"turn {t}") for t in range(200)]
    rows += [(700, None, "user", "unknown turn"), (700, None, None, None), (700, 3, "x", "tie"), (700, 3, "x", "tie"), (700, 3, "w", "tie"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    schema = "conv_id long, turn long, role string, text string, depth int, node string, n int"
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(3)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    got = [tuple(r[c] for c in TRIE) for r in prefix_trie.conversation_trie(table).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
    assert prefix_trie.conversation_trie(table.where("false")).count() == 0


def toxic_rows(n: int = 400) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(11)
    prose = lambda k: [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()) for _ in range(k)]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(rng.randint(20, 60))
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "stupid", "quarkolon", "quarkesse", "quarkant"]) if k % 8 else rng.choice(["quarkolon", "quarkesse", "quarkant"]))
        docs.append((k, " ".join(words), "zz"))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity(spark: SparkSession) -> None:
    docs, labels = toxic_rows()
    odd = [(1000, None, "a"), (1001, "", "a"), (1002, "  ...  ", "a"), (1003, "idiot " * 5000, "a"), (None, "you stupid idiot and quarkolon", "a"), docs[0], docs[0]]
    table = spark.createDataFrame([(*d, 0.5) for d in docs + odd], "doc_id long, text string, p string, toxic double").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, known).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(k, t) for k, t in labels if by[k]["held_out"]]
    wrong = [k for k, t in held if by[k]["predicted"] != t]
    assert len(held) > 60 and len(wrong) <= 0.06 * len(held)  # toxic texts without any listed insult among them
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"]


def test_toxicity_without_classes(spark: SparkSession) -> None:
    docs, labels = toxic_rows(30)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for rows, score in (([], 0.0), ([(k, 1) for k, _ in labels], 1.0), ([(k, 0) for k, _ in labels], 0.0)):
        got = toxicity.toxicity(table, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == 30 and {r["score"] for r in got} == {score}
    assert toxicity.toxicity(table.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_toxicity_from_a_bounded_sample(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """With more labels than the bound about as many are learnt from, the same each time, and every text has a score."""
    docs, labels = toxic_rows()
    known = spark.createDataFrame(labels, "id long, toxic int")
    assert toxicity.sampled(known).count() == len(labels)
    assert toxicity.sampled(known.where("false")).count() == 0
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 200)
    some = sorted(tuple(r) for r in toxicity.sampled(known).collect())
    assert 150 < len(some) < 250 and some == sorted(tuple(r) for r in toxicity.sampled(known.repartition(5)).collect())
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string, p string"), known.withColumnRenamed("id", "doc_id")).collect()
    truth = dict(labels)
    assert len(got) == len(docs)
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in got if r["held_out"]) <= 0.15 * sum(r["held_out"] for r in got)


def test_toxicity_features() -> None:
    x = dict(zip(toxicity.NAMES, toxicity.features("You are an IDIOT!! st*pid 1d10t s-t-u-p-i-d fine quarkolon", {"quark*": 9.0}), strict=True))
    assert x["words"] == pytest.approx(math.log1p(9)) or x["words"] > 0
    assert x["insults"] == pytest.approx(math.log1p(1)) and x["hidden"] >= math.log1p(1) and x["strong"] == pytest.approx(math.log1p(1))
    assert x["near_you_share"] > 0 and x["marks_runs"] > 0 and x["spelled_insult"] == 1 and x["capital_hits"] > 0 and x["learnt_most"] == 9.0
    assert toxicity.features(None, {}) == toxicity.features("", {}) == [0.0] * len(toxicity.NAMES)
    assert len(toxicity.features("word", {})) == len(toxicity.NAMES)


def test_lexicon(spark: SparkSession) -> None:
    docs, labels = toxic_rows()
    rows: DataFrame = spark.createDataFrame([(t, y) for (_, t, _), (_, y) in zip(docs, labels, strict=True)], "text string, toxic int").repartition(3)
    got = toxicity.lexicon(rows)
    one, two = (collections.Counter(e for (_, t, _), (_, y) in zip(docs, labels, strict=True) if y == k for e in toxicity.entries(toxicity.words_of(t))) for k in (1, 0))
    n1, n0 = sum(y for _, y in labels), sum(1 - y for _, y in labels)
    z = lambda e: (one[e] / n1 - two[e] / n0) / math.sqrt((one[e] + two[e] + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    expected = {e: z(e) for e in one if one[e] >= toxicity.LEAST_DOCS and z(e) >= toxicity.LEAST_Z}
    assert set(got) == set(expected) and all(got[e] == pytest.approx(expected[e]) for e in got) and "quark*" in got
