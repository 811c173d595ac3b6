"""Steps that must not grow faster than their input."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanewright.functions import columns
from lanewright.functions.columns import piece_hashes, token_ids_of, word_counts, words
from lanewright.operators import audit, minhash, packing, temporal
from lanewright.plans.queries import QUERIES, Corpus


def test_interval_join_without_cells(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Keys of few rows are not cut into cells; a key of many rows is, and loses nothing."""
    a = spark.range(40).select((F.col("id") % 4).alias("key"), F.col("id").alias("i"), F.col("id").alias("lo"), (F.col("id") + 9).alias("hi"))
    b = spark.range(40).select((F.col("id") % 4).alias("key"), F.col("id").alias("p"), F.col("id").alias("t"))
    want = sorted((i, p) for i in range(40) for p in range(40) if i % 4 == p % 4 and i <= p < i + 9)
    got = lambda: sorted((r["i"], r["p"]) for r in temporal.interval_join(a, b, "key", "lo", "hi", "t").collect())
    more = a.unionByName(a.where("key = 1"))
    monkeypatch.setattr(temporal, "FEW", 25)
    mixed = sorted((r["i"], r["p"]) for r in temporal.interval_join(more, b, "key", "lo", "hi", "t").collect())
    assert mixed == sorted([*want, *((i, p) for i, p in want if i % 4 == 1)])
    monkeypatch.setattr(temporal, "FEW", 65_536)
    monkeypatch.setattr(temporal, "dyadic_cells", lambda *_: pytest.fail("cells"))
    assert got() == want


def test_asof_without_quantiles(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Keys of few rows need no parts of the time line, however many rows there are in all."""
    a = spark.range(90).select((F.col("id") % 9).alias("key"), F.col("id").alias("t"))
    b = spark.range(0, 90, 2).select((F.col("id") % 9).alias("key"), F.col("id").alias("t"), F.col("id").alias("y"))
    monkeypatch.setattr(temporal, "Bucketizer", lambda **_: pytest.fail("quantiles"))
    got = {r["t"]: r["match"] and r["match"]["y"] for r in temporal.asof_join(a, b, "key", "t", "t", part_rows=20).collect()}
    assert got == {t: max((y for y in range(0, t + 1, 2) if y % 9 == t % 9), default=None) for t in range(90)}


def test_token_ids_by_batch(spark: SparkSession) -> None:
    words_ = [["a", "b", "a"], [], ["\u00e9", "x" * 300], None]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words_)], "k int, w array<string>").coalesce(1)
    for vocab in (512, 50_000):
        got = {r["k"]: r["x"] for r in df.select("k", token_ids_of(vocab)("w").alias("x")).collect()}
        plain = lambda w: int(hashlib.sha256(w.encode()).hexdigest(), 16) % (vocab - 1) + 1  # noqa: B023, E731
        assert all(got[k] == [plain(x) for x in w or []] for k, w in enumerate(words_))


def test_other_spaces() -> None:
    """The characters that are turned into blanks are those of the pattern."""
    spaces = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", columns.SPACES))
    assert set(columns._OTHERS) == {chr(c) for c in range(0x10000) if spaces.fullmatch(chr(c))} - {" "}


def test_texts_are_split_once(spark: SparkSession) -> None:
    """In the plan of the pieces' hashes the texts are split in one place, after the join."""
    tokens = spark.createDataFrame([(0, "COMMON_CRAWL", False, 0, "COMMON_CRAWL_shard_000", 1, 5)], "lane_idx int, lane string, is_eval boolean, src int, shard_id string, doc_id long, n long")
    plan = packing.pieces(spark, "/root/testdata/sf0.001", tokens)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "split(" in line]
    assert len(lines) == 1


def test_square_join(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(minhash, "SIDE", 4)
    a = spark.range(60).select((F.col("id") % 60 % 7 % 3).alias("on"), F.col("id").alias("a"))
    b = spark.range(25).select((F.col("id") % 4).alias("on"), F.col("id").alias("b"))
    met, total = minhash._met(a, b, "on")
    want = sorted((x, y) for x in range(60) for y in range(25) if x % 7 % 3 == y % 4)
    assert sorted((r["a"], r["b"]) for r in met.collect()) == want and total == len(want)


def test_words_of_batches(spark: SparkSession) -> None:
    """Counts and pieces are those of the words that the JVM finds, at every white space and for every place of a text in its shard."""
    spaces = "".join(f"{chr(c)}w{c}" for c in range(0x10000) if re.fullmatch(r"\s", chr(c)))
    texts = [None, "", " \u3000", "a", "  \u00e9\u00a0b\u200bc\n", spaces, "x" * 300, " ".join(f"w{k}" for k in range(300)), "\U0001f600 \ufeffb\u0000c"]
    at = [0, 1, 127, 128, 200, 2**33 + 5]
    df = spark.createDataFrame([(k, t, off) for k, t in enumerate(texts) for off in at], "k int, text string, off long")
    out = df.select("k", "off", words(F.col("text")).alias("w"), word_counts(F.col("text")).alias("n"), piece_hashes(F.col("text"), F.col("off"), 128).alias("x")).collect()
    assert len(out) == len(texts) * len(at)
    for r in out:
        cut: dict[int, list[str]] = {}
        for i, w in enumerate(r["w"]):
            cut.setdefault((r["off"] + i) // 128, []).append(w)
        assert r["n"] == len(r["w"]) and [(p["seq"], bytes(p["hash"])) for p in r["x"]] == [(q, hashlib.sha256(" ".join(ws).encode()).digest()) for q, ws in cut.items()]


@pytest.mark.parametrize("name", ["v5_final_verification", "v6_evidence"])
def test_one_count_of_the_texts_a_side(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, name: str) -> None:
    """The verdicts share one packing, and only the replay computes another from the texts; neither offsets nor ledgers are computed twice a side."""
    made: dict[str, int] = {}
    for module, f in ((packing, "token_counts"), (packing, "offsets"), (packing, "sequence_hashes")):
        monkeypatch.setattr(module, f, lambda *a, f=getattr(module, f), key=f, **b: (made.update({key: made.get(key, 0) + 1}), f(*a, **b))[1])
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made == {"token_counts": 2, "offsets": 2, "sequence_hashes": 2}


def test_kept_frames_are_the_same(spark: SparkSession) -> None:
    a, b = (Corpus(spark, "/root/testdata/sf0.001", keep) for keep in (False, True))
    for f in ("offs", "training_over", "training_seqs", "batches", "consumption"):
        x, y = getattr(a, f)(), getattr(b, f)()
        assert x.columns == y.columns and sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())), f
    assert b.batches() is b.batches()


def test_words_across_parts() -> None:
    """Texts that touch, that are not UTF-8 or that end within a character give Python's words, in parts of any size."""
    texts = [b"a", b"b c", None, b"", b"\xc2", b"\x85d", "\u3000e\u2003\u00a0f\u200b\u00e9".encode(), b"\xe2\x80 g\x1fh\n\ni ", b" j"]
    want = [len((x or b"").decode("utf-8", "replace").split()) for x in texts]
    for size in (1, 4, 1 << 19):
        for some in (texts, [x for x in texts if x not in (b"\xc2", b"\x85d", texts[7])]):
            parts = [np.diff(columns._begins(space, edges)[1]) for _, space, edges in columns._found(pa.array(some, pa.binary()), size)]
            assert np.concatenate(parts).tolist() == [n for n, x in zip(want, texts) if x in some]


def test_hashes_of_batches(spark: SparkSession) -> None:
    """Pieces go to their batch in one move, those of training shards only, and give the hashes of sequences laid out one by one."""
    c = Corpus(spark, "/root/testdata/sf0.001", keep=True)
    rows = packing.laned_documents(spark, c.dir).where("not is_eval").orderBy("lane_idx", "src", "doc_id").collect()
    want: list[str] = []
    for _, docs in itertools.groupby(rows, lambda r: r["shard_id"]):
        laid = [(r["doc_id"], w) for r in docs for w in (r["text"] or "").split()]
        for i in range(0, len(laid), 128):
            own = [" ".join(w for _, w in g) for _, g in itertools.groupby(laid[i : i + 128], lambda x: x[0])]
            want.append(hashlib.sha256("\n".join(hashlib.sha256(x.encode()).hexdigest() for x in own).encode()).hexdigest())
    hashes = packing.sequence_hashes(spark, c.dir, c.offs(), c.bases())
    got = sorted((r["batch_index"], r["hashes"]) for r in hashes.collect())
    assert got == [(i // 4, want[i : i + 4]) for i in range(0, len(want), 4)]
    plan = hashes._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan.split("== Initial Plan ==")[-1])) == 3  # texts, offsets, pieces


def test_digests_come_with_the_counts(spark: SparkSession) -> None:
    """A verdict's manifests and decisions read no text again, and are those of the texts."""
    c, plain = Corpus(spark, "/root/testdata/sf0.001", keep=True, digest=True), Corpus(spark, "/root/testdata/sf0.001")
    assert c.tokens().columns == plain.tokens().columns
    for f in ("manifests", "decisions"):
        x, y = getattr(c, f)(), getattr(plain, f)()
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())), f
        assert not any("documents.parquet" in name for name in x.inputFiles()) and any("documents.parquet" in name for name in y.inputFiles())


def test_shards_are_read_once(spark: SparkSession) -> None:
    """What is observed of shards comes from one reading of their files."""
    docs = packing.laned_documents(spark, "/root/testdata/sf0.001").withColumn("tokenizer_hash", audit.tokenizer_hash())
    found = audit.observed_manifests(docs)
    assert not any("documents.parquet" in name for name in found.inputFiles())
    want = Corpus(spark, "/root/testdata/sf0.001").manifests().select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_sieve_loses_none(spark: SparkSession) -> None:
    """Every text with a Jaccard of 0.8 or more with a known one passes, a Jaccard of just 0.8 and texts of repeats too; unknown texts don't."""
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(3000)}é" for _ in range(n)]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t and t.split() else set()
    known = [" ".join(prose(n)) for n in (1, 2, 4, 5, 6, 8, 9, 30, 200) for _ in range(6)] + ["ha " * 40, "ab " * 9 + "c d e f g", "x" * 5000, "", " 　"]
    near = []
    for t in known:
        w = t.split()
        near += [t, " " + "\t ".join(w) + " ", " ".join([*w, *w[-1:]]), t + " a b a b a b a b a b"]
        for k in range(1, 8):
            near.append(" ".join([*w[: len(w) - k], *["new"] * k]))
            near.append(" ".join([*w, *[f"more{j}" for j in range(k)]]))
    far = [" ".join(prose(n)) for n in (1, 3, 5, 50, 400) for _ in range(20)]
    items = spark.createDataFrame([(t,) for t in [*known, None]], "t string").repartition(3)
    field = minhash.sieve(items, "t")
    kept = minhash.sieved(pa.array([*near, *far, None, ""]), field).tolist()
    sets = [shingles(t) for t in known]
    alike = lambda t: any(s and x and len(s & x) / len(s | x) >= 0.8 for s in [shingles(t)] for x in sets)
    assert all(k for t, k in zip(near, kept, strict=False) if alike(t)) and sum(map(alike, near)) > 250
    assert sum(kept[len(near) :]) <= 5 and not any(kept[-2:])
    assert sum(kept[: len(near)]) < len(near) - 50
    full = np.full(1 << 17, 255, np.uint8)  # a field that is full lets all pass
    assert minhash.sieved(pa.array([*far, None]), full).tolist() == [True] * len(far) + [False]
    assert minhash.sieve(items.where("false"), "t").any() == 0 and len(minhash.sieved(pa.array([], pa.string()), field)) == 0


@pytest.mark.parametrize(("cell", "held", "step"), [(16_000_000, 1_000_000, 1 << 18), (50, 7, 5)])
def test_best_pairs(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, cell: int, held: int, step: int) -> None:
    """The largest Jaccard of the codes that two sides share: many cells, documents that go on over batches, null ids."""
    rng = random.Random(7)
    given = sorted({(rng.choice([None, 0, -5, *range(60)]), rng.choice([0, 0, *range(30)])) for _ in range(400)}, key=repr)
    asked = {(rng.choice([0, 1, *range(5, 35)]), rng.choice([None, 0, -7, *range(40)])): rng.randrange(800, 1000) / 1000 for _ in range(300)}
    want: dict[tuple, float] = {}
    for d, c in given:
        for (k, i), x in asked.items():
            if c == k:
                want[d, i] = max(x, want.get((d, i), 0))
    for name, value in (("CELL", cell), ("HELD", held), ("STEP", step)):
        monkeypatch.setattr(minhash, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        one = spark.createDataFrame(given, "doc_id long, code long")
        two = spark.createDataFrame([(*k, x) for k, x in asked.items()], "code long, item_id long, jaccard double")
        got = [(r["doc_id"], r["item_id"], r["jaccard"]) for r in minhash.best_pairs(one, two).collect()]
        assert len(got) == len(want) and {(d, i): x for d, i, x in got} == want
        assert minhash.best_pairs(one.where("false"), two).count() == minhash.best_pairs(one, two.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paragraphs_move_less_than_pairs(spark: SparkSession) -> None:
    """A line in 1,200 documents and 300 items gives 360,000 pairs: neither they nor lines that no item has are shuffled."""
    line = "this one line stands in very many documents and in very many items"
    own = lambda k: f" w{k}a w{k}b".join(f"x{k * j}" for j in range(1, 30))
    docs = spark.createDataFrame([(k, f"{own(k)}\n{line}\n" + "\n".join(own(10_000 * j + k) for j in range(1, 9))) for k in range(1, 1201)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, f"{line}\n{own(-k)}") for k in range(1, 301)], "item_id long, text string").repartition(4)

    def moved() -> int:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        records = {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}
        new = sum(n for k, n in records.items() if k not in seen)
        seen.update(records)
        return new

    seen: set[int] = set()
    moved()
    out = minhash.near_paragraphs(docs, items)
    assert out.agg(F.count("*"), F.min("jaccard")).first() == (360_000, 1.0)
    assert 0 < moved() < 60_000
