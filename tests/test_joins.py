"""Near copies by MinHash, the vector index, as-of and interval joins, against brute force on small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from compare import DATA, connection, difference
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import minhash, temporal, units, vectors
from lanewright.operators.graph import components
from lanewright.plans import join_queries
from lanewright.plans.queries import ORACLE, QUERIES


def near_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out: list[tuple[int | None, str | None]] = []
    for k in range(60):
        base = prose(rng.choice([30, 80, 200]))
        out.append((10 * k, " ".join(base)))
        for j in range(rng.randint(0, 4)):
            twin = list(base)
            for _ in range(rng.choice([1, 1, 2, 4])):
                twin[rng.randrange(len(twin))] = "changed"
            out.append((10 * k + j + 1, " ".join(twin)))
    hub = prose(300)  # a large group whose members are alike, not all to one another
    for k in range(80):
        hub[rng.randrange(300)] = f"step{k}"
        out.append((5000 + k, " ".join(hub)))
    return [*out, (9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "one two"), (9005, "two one"), (None, "one two"), (None, None), out[3], out[3]]


def plain_sets(rows: list[tuple]) -> list[frozenset]:
    def of(t: str | None) -> frozenset:
        w = (t or "").split()
        k = min(5, len(w))
        return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    return [of(t) for _, t in rows]


def plain_classes(rows: list[tuple]) -> list[int | None]:
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                root[find(a)] = find(b)
    ids: dict[int, list[int]] = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), [])
        if d is not None:
            ids[find(k)].append(d)
    return [min(ids[find(k)], default=None) for k in range(len(rows))]


@pytest.mark.parametrize("block", [500_000, 800])
def test_near_copies(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, block: int) -> None:
    rows = near_texts()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, bands int").repartition(3)
    monkeypatch.setattr(minhash.set_classes, "__defaults__", (0.8, block))
    got = sorted(((r["doc_id"], r["class_id"], r["n_shingles"]) for r in minhash.near_copies(docs).collect()), key=repr)
    want = sorted(((d, c, len(s)) for (d, _), c, s in zip(rows, plain_classes(rows), plain_sets(rows), strict=True)), key=repr)
    assert got == want
    assert minhash.near_copies(docs.where("false")).count() == 0


def test_bands_recall() -> None:
    """Pairs with a Jaccard from 0.8 to 0.84: at least 0.9 of them, in fact all, share a band; few of those near 0.3 do."""
    rng = np.random.default_rng(1)
    found = {0.8: 0, 0.3: 0}
    for least in found:
        for _ in range(200):
            n, common = 300, round(2 * 300 * least / (1 + least)) + 1
            x = rng.integers(-(2**62), 2**62, 2 * n - common)
            a, b = (set(minhash.band_hashes(minhash.signature(s)).tolist()) for s in (x[:n], x[n - common :]))
            found[least] += bool(a & b)
    assert found[0.8] == 200 and found[0.3] < 80


def test_near_paragraphs(spark: SparkSession) -> None:
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    para = prose(60)
    two = prose(30) + "\n" + prose(30)
    docs = spark.createDataFrame([(1, prose(40) + "\n" + para + " more\n" + prose(20)), (2, "intro\n\n" + two + "\n\nend"), (3, prose(200)), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, para), (8, two), (9, None), (10, prose(50))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["jaccard"] for r in minhash.near_paragraphs(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 8)} and got[2, 8] == 1.0 and 0.8 <= got[1, 7] < 1
    assert minhash.near_paragraphs(docs, items.where("false")).count() == 0


def test_components(spark: SparkSession) -> None:
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"c{k}", f"c{k + 1}") for k in range(100)] + [("hub", f"h{k}") for k in range(200)] + [("self", "self")]
    root: dict[str, str] = {x: x for e in edges for x in e}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def points(rng: np.random.Generator, n: int, spread: float) -> list[tuple[int, list[float]]]:
    centers = rng.normal(size=(12, 16))
    return [(k, (centers[rng.integers(12)] + spread * rng.normal(size=16)).tolist()) for k in range(n)]


def test_vector_index(spark: SparkSession) -> None:
    rows: list[tuple] = points(np.random.default_rng(3), 900, 0.4)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, 2.0]), (1004, [None] * 16), (1100, rows[5][1]), (1101, rows[5][1]), (1100, rows[6][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string").repartition(3)
    known = [(k, np.array(v) / np.linalg.norm(v)) for k, v in rows if v and len(v) == 16 and v[0] is not None and any(v)]
    for least in (0.85, 0.97):
        want = sorted((q, v, round(float(x @ y), 4)) for q, x in known if q % 100 == 0 for v, y in known if q != v and x @ y > least + 1e-9)
        index = vectors.VectorIndex(table)
        queries = index.rows.where("vec_id % 100 = 0").select("vec_id", "v")
        for block in (vectors.BLOCK, 20):  # every cell in one part, and in several
            got = sorted((r["query_id"], r["vec_id"], round(r["similarity"], 4)) for r in index.within(queries, least, block=block).collect())
            assert [g[:2] for g in got] == [w[:2] for w in want]
        some = index.within(queries, least, probes=4).count()
        assert 0.9 * len(want) <= some <= len(want)  # recall of the four nearest cells
    assert vectors.similar_vectors(table.where("false")).count() == 0
    assert vectors.similar_vectors(table.where("vec_id = 1000")).count() == 0


def plain_asof(left: list[tuple], right: list[tuple], direction: str, tolerance: int | None) -> list[tuple]:
    out = []
    for row in left:
        key, t, _ = row
        same = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None]
        back = max((r for r in same if r[1] <= t), key=lambda r: (r[1], r[2]), default=None) if direction != "forward" else None
        ahead = min((r for r in same if r[1] >= t), key=lambda r: (r[1], r[2]), default=None) if direction != "backward" else None
        best = back if back and (not ahead or t - back[1] <= ahead[1] - t) else ahead
        if best and tolerance is not None and abs(best[1] - t) > tolerance:
            best = None
        out.append((*row, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark: SparkSession, direction: str) -> None:
    rng = random.Random(6)
    side = lambda n: [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(0, 4000, 3)]), k) for k in range(n)]
    left, right = side(700), side(300)
    left += left[:5] + [("only left", 5, 1), ("a", -(2**60), 2)]
    right += right[:5] + [("only right", 5, 1)]
    a = spark.createDataFrame(left, "key string, t long, part long").repartition(3)
    b = spark.createDataFrame(right, "key string, t long, n long").repartition(2)
    for part_rows, tolerance in ((65_536, None), (40, None), (40, 10)):
        got = temporal.asof_join(a, b, "key", "t", "t", direction, tolerance, part_rows)
        assert sorted(((r["key"], r["t"], r["part"], r["match"]["n"] if r["match"] else None) for r in got.collect()), key=repr) == plain_asof(left, right, direction, tolerance)
    assert temporal.asof_join(a, b.where("false"), "key", "t", "t", direction).where("match is not null").count() == 0
    assert temporal.asof_join(a.where("false"), b, "key", "t", "t", direction).count() == 0


def test_dyadic_cells(spark: SparkSession) -> None:
    rng = random.Random(8)
    pairs = [(lo, lo + rng.choice([0, 1, 2, 3, 7, 100, 5000])) for lo in (rng.randrange(-300, 300) for _ in range(200))] + [(-(2**40), 2**41), (5, 4)]
    got = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", temporal.dyadic_cells(F.col("lo"), F.col("hi")).alias("c")).collect()
    for lo, hi, cells in got:
        spans = sorted((c << k, (c + 1) << k) for k, c in cells)
        assert len(spans) <= 2 * 63 and sum(b - a for a, b in spans) == max(0, hi - lo)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][0], spans[-1][1]) == (lo, hi))
    assert max(len(c) for *_, c in got) < 90


@pytest.mark.parametrize("unit", [1, 7, 1000])
def test_intervals(spark: SparkSession, unit: int) -> None:
    rng = random.Random(10)
    held = [(rng.choice(["hot", "hot", "a", None]), lo, lo + rng.choice([0, 1, 5, 40, 900]), k) for k, lo in enumerate(rng.randrange(-500, 3000) for _ in range(150))]
    held += [("hot", -(2**40), 2**40, 900), ("a", 50, 20, 901), ("a", None, 20, 902), ("a", 5, None, 903), held[0]]
    at = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-600, 4000)]), k) for k in range(300)]
    one = spark.createDataFrame(held, "key string, lo long, hi long, i long").repartition(2)
    two = spark.createDataFrame(at, "key string, t long, p long").repartition(2)
    got = sorted((r["i"], r["p"]) for r in temporal.interval_join(one, two, "key", "lo", "hi", "t", unit).collect())
    assert got == sorted((h[3], p[2]) for h in held for p in at if h[0] is not None and h[0] == p[0] and None not in (h[1], h[2], p[1]) and h[1] <= p[1] < h[2])
    assert temporal.interval_join(one.where("false"), two, "key", "lo", "hi", "t").count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n].__module__ == join_queries.__name__])
def test_query_finds_something(spark: SparkSession, name: str) -> None:
    small = f"{DATA}/sf0.001"
    out: DataFrame = QUERIES[name](spark, small)
    assert difference(out, connection(small), ORACLE[name]) == "" and out.count() > 0


@pytest.mark.parametrize(("separator", "plain"), [("\n", "\n"), ("\\s*---\\s*", "---")])
def test_units_by_brute_force(spark: SparkSession, separator: str, plain: str) -> None:
    """Lines and threads, with null ids and texts, blank units, repeated rows, two texts of one id, a unit in most texts."""
    rng = random.Random(4)
    rows: list[tuple] = [(k, plain.join(rng.choice(["all", " all ", "", "  ", f"u{rng.randrange(40)}", f"own{k}"]) for _ in range(rng.randint(0, 9))), k % 3) for k in range(60)]
    rows += [(5, "all" + plain + "new of five", 7), (None, "u1" + plain + "nobody", 1), (None, None, 1), (61, None, 2), (62, "", 2), rows[3], rows[3]]
    cut = lambda t: [x for x in ((y.strip(" ") for y in (t or "").split(plain))) if x]
    seen: set[str] = set()
    want = {}
    texts = {(r[0], hashlib.md5((r[1] or "").encode()).hexdigest()): r[1] for r in rows}
    for key in sorted(texts, key=lambda k: (k[0] is not None, k[0] or 0, k[1])):
        kept = []
        for unit in cut(texts[key]):
            if unit not in seen:
                seen.add(unit)
                kept.append(unit)
        want[key] = (len(cut(texts[key])), len(kept), "\n".join(kept))
    df = spark.createDataFrame(rows, "id long, text string, unit int").repartition(5)
    got = [(r["id"], r["text"], r["unit"], r["n_units"], r["n_kept"], r["kept_text"]) for r in units.first_occurrences(df, "id", "text", separator).collect()]
    assert sorted(got, key=repr) == sorted(((*r, *want[r[0], hashlib.md5((r[1] or "").encode()).hexdigest()]) for r in rows), key=repr)
    assert units.first_occurrences(df.limit(0), "id", "text").count() == 0
