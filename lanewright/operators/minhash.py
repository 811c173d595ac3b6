"""Near copies by MinHash: signatures of 128 minima, bands of 4, exact Jaccard of what meets in a band.

A text is the set of its distinct 5-word shingles. Two sets with a Jaccard of 0.8 agree in all 4 minima of a band with probability
0.41, and in none of 32 bands with 5e-8, so candidates miss next to no link; every candidate is then verified on whole sets.

Texts with equal sets are one row from the start. A group of many near copies meets in every band, and comparing it there pair by
pair would grow with its square, so classes form in two passes. First each set is compared with one other: the least set that it
meets in any band, which ties a dense group together at one comparison a member. What remains are bands whose sets are not all
of one class yet; of these, only pairs of different classes are compared, in blocks of bounded size, each its own group, and bands
with the same sets count once. A link inside a class decides nothing and is not looked for.

Paragraphs of documents go through a sieve before they are hashed 128 times: a set of which more than a fifth is in no item at all
cannot have a Jaccard of 0.8 with one. The sieve is a field of bits of bounded size, which lets some pass that need not and loses none.

Defined cases: a text of fewer than 5 words is one shingle, one without words (or null) the empty set, alike to its equals only;
repeated rows and equal texts share a class; a null id is kept and never names a class unless alone.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.columns import _begins, _found, words
from lanewright.operators.graph import components
from lanewright.sources.shared import materialised

SHINGLE, LEAST = 5, 0.8
HASHES, BANDS = 128, 32
#: Shingles of all sets in a block of a band.
BLOCK = 500_000
#: Words of the texts that are hashed at a time.
PART = 65_536
#: Rows on either side of a square of a join, and rows of a part that is grouped in one task.
SIDE, DEALT = 1024, 2_000_000
#: Of the sieve: the binary logarithm of its bits, at most, and of those that a task collects in one piece.
FIELD, PIECE = 28, 20
#: Pairs that one task makes, rows of items that it holds meanwhile, and pairs that it makes at a time.
CELL, HELD, STEP = 16_000_000, 1_000_000, 1 << 18
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(0, 2**64, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of shingles that begins at one of `starts`, the least of each of 128 hashes."""
    flat = shingles.astype(np.int64).view(np.uint64)
    return np.stack([np.minimum.reduceat(_mix(flat ^ seed), starts) for seed in _SEEDS], axis=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of 128 hashes over the shingles."""
    return signatures(shingles, np.zeros(1, np.int64))[0]


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of a signature (or of each of several); the band's number is part of it."""
    rows = sig.reshape(*sig.shape[:-1], BANDS, HASHES // BANDS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:-1])
    for k in range(rows.shape[-1]):
        h = _mix(h * _FOLD + rows[..., k])
    return h.view(np.int64)


def _windows(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-word shingles of texts laid end to end, repeats included: the text and the hash."""
    wide = np.minimum(sizes, n)
    row = np.repeat(np.arange(len(sizes)), np.where(sizes > 0, sizes - wide + 1, 0))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    at = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) + (np.cumsum(sizes) - sizes)[row]
    w, k = hashes.view(np.uint64), wide[row]
    h = k.astype(np.uint64)
    for j in range(n):
        h = np.where(j < k, _mix(h * _FOLD + w[np.minimum(at + j, len(w) - 1)]), h)
    return row, h.view(np.int64)


def _shingles(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of texts laid end to end, sorted within each text, and how many each text has."""
    row, h = _windows(hashes, sizes, n)
    order = np.lexsort((h, row))
    h = h[order]
    new = (np.diff(h, prepend=0) != 0) | (np.diff(row, prepend=-1) != 0)
    return h[new], np.bincount(row[new], minlength=len(sizes))


def prints(words_: pa.ListArray, n: int) -> pa.StructArray:
    """From the hashes of each text's words: its set of shingles, a digest of the set and its bands (none for the empty set)."""
    flat, ends = words_.flatten().to_numpy(), np.cumsum(np.asarray(words_.value_lengths().fill_null(0), np.int64))
    sets, digests, bands, sizes, done = [], [], [], [], 0
    while done < len(ends):  # some texts at a time: what is held beside the input stays small
        begin = ends[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(ends, begin + PART, "right")))
        own, count = _shingles(flat[begin : ends[to - 1]], np.diff(ends[done:to], prepend=begin), n)
        starts = np.cumsum(count) - count
        digests += [hashlib.md5(own[a : a + k].tobytes()).hexdigest() for a, k in zip(starts, count, strict=True)]
        if len(own):
            bands.append(band_hashes(signatures(own, starts[count > 0])).ravel())
        sets.append(own)
        sizes.append(count)
        done = to
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    many = joined(sizes)
    lists = lambda values, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(values, pa.int64()))
    return pa.StructArray.from_arrays([lists(joined(sets), many), pa.array(digests, pa.string()), lists(joined(bands), np.where(many > 0, BANDS, 0))], ["gs", "digest", "bands"])


def printed(rows: DataFrame, text: str, n: int = SHINGLE) -> DataFrame:
    """The other columns, gs (the set), digest and bands."""
    kept = [c for c in rows.columns if c != text]

    def own(words_: pa.Array) -> pa.Array:
        return prints(words_, n)

    found = F.arrow_udf(own, "gs array<bigint>, digest string, bands array<bigint>")
    return rows.select(*kept, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h")).select(*kept, found("h").alias("x")).select(*kept, "x.gs", "x.digest", "x.bands")


def jaccard(a: str, b: str) -> Column:
    """Of two columns of distinct elements."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _met(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, int]:
    """The join of two written tables, their other columns being different, and how many rows it has.

    A value that many rows share on both sides is cut into squares of SIDE rows by SIDE, each dealt out by itself.
    """
    count = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    sizes = materialised(count(left, "__l").join(count(right, "__r"), on))
    cut = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    hot = F.broadcast(sizes.where(F.col("__l") * F.col("__r") > SIDE * SIDE).select(on, cut("__l").alias("__ls"), cut("__r").alias("__rs")))  # a row for SIDE * SIDE rows of the result
    part = lambda df, own, other, mine: df.join(hot, on, "left").select(*df.columns, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias("__o"))
    a, b = part(left, "__ls", "__rs", "__m").withColumnRenamed("__o", "__n"), part(right, "__rs", "__ls", "__n").withColumnRenamed("__o", "__m")
    total = sizes.agg(F.sum(F.col("__l") * F.col("__r"))).first()[0] or 0
    return a.join(b, [on, "__m", "__n"]).drop("__m", "__n"), total


def _dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """Rows by keys in as many parts as keep each to about DEALT rows: what is grouped by them next is grouped within a part."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DEALT)), *keys)


def similar_pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """digest, right_digest, jaccard of distinct printed sets (written tables) of two tables whose Jaccard is `least` or more."""
    spread = lambda df, name: df.select(F.col("digest").alias(name), F.explode("bands").alias("band"), F.size("gs").alias(f"n_{name}"))
    same = left.where(F.size("gs") > 0).select("digest").join(right.select("digest"), "digest")
    asked = spread(right, "b")
    met, total = _met(materialised(spread(left, "a").join(asked.select("band").distinct(), "band", "left_semi")), materialised(asked), "band")
    sizes = (F.col("n_a") >= F.col("n_b") * least) & (F.col("n_b") >= F.col("n_a") * least)
    pairs = materialised(_dealt(met.where(sizes & (F.col("a") != F.col("b"))).select("a", "b"), total, "a", "b").distinct())
    near = pairs.join(left.select(F.col("digest").alias("a"), F.col("gs").alias("ga")), "a").join(right.select(F.col("digest").alias("b"), F.col("gs").alias("gb")), "b")
    near = near.select(F.col("a").alias("digest"), F.col("b").alias("right_digest"), jaccard("ga", "gb").alias("jaccard")).where(F.col("jaccard") >= least)
    return near.unionByName(same.select("digest", F.col("digest").alias("right_digest"), F.lit(1.0).alias("jaccard")))


def _across(least: float):  # noqa: ANN202
    """For the sorted rows of blocks (group, label, digest, gs): links between different labels that tie the block's classes together."""

    def links(rows: list[tuple]) -> Iterator[tuple[str, str]]:
        root = {r[0]: r[0] for r in rows}

        def find(x: str) -> str:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        rows = sorted(rows, key=lambda r: len(r[2]))
        for k, (label, digest, gs) in enumerate(rows):
            for other, twin, more in rows[k + 1 :]:
                if len(gs) < least * len(more):
                    break
                if find(label) != find(other):
                    common = len(np.intersect1d(gs, more, assume_unique=True))
                    if common >= least * (len(gs) + len(more) - common):
                        root[find(label)] = find(other)
                        yield digest, twin

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, []
        for b in batches:
            out = []
            for g, label, digest, gs in zip(b["group"], b["label"], b["digest"], b["gs"], strict=True):
                if g != group:
                    out += links(held)
                    group, held = g, []
                held.append((label, digest, np.asarray(gs)))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)
        yield pd.DataFrame(list(links(held)), columns=["a", "b"], dtype=object)

    return each


def set_classes(sets: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """digest, label (the least digest of its class) for distinct printed sets."""
    met = sets.select("digest", F.size("gs").alias("size"), F.explode("bands").alias("band"))
    bands = materialised(met.groupBy("band").agg(F.min("digest").alias("first"), F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("y")).where("n > 1"))
    bands = bands.groupBy("x", "y", "n").agg(F.min(F.struct("band", "first", "total")).alias("b")).select("b.*")  # bands with the same sets count once
    members = materialised(met.join(bands, "band").select("band", "digest", "first", "total"))
    star = members.where("digest <> first").groupBy("digest").agg(F.min("first").alias("other"))
    gs = lambda name, as_: sets.select(F.col("digest").alias(name), F.col("gs").alias(as_))
    tied = star.join(gs("digest", "ga"), "digest").join(gs("other", "gb"), "other").where(jaccard("ga", "gb") >= least)
    links = materialised(tied.select(F.col("digest").alias("a"), F.col("other").alias("b")))
    label = materialised(components(links).select("node", F.col("root").alias("label")))
    labelled = materialised(members.join(label, F.col("digest") == F.col("node"), "left").select("band", "digest", "total", F.coalesce("label", "digest").alias("label")))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    parts = F.ceil(F.col("total") / block).cast("int")
    rows = labelled.join(mixed, "band").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("digest", "label", "band", "part", other.alias("other"))
    rows = rows.select("digest", "label", F.concat_ws(":", "band", F.least("part", "other"), F.greatest("part", "other")).alias("group"))
    rows = rows.join(gs("digest", "gs"), "digest").select("group", "label", "digest", "gs").repartition("group").sortWithinPartitions("group")
    more = rows.mapInPandas(_across(least), "a string, b string")
    every = materialised(links.unionByName(more))
    return components(every).select(F.col("node").alias("digest"), F.col("root").alias("label"))


def near_copies(docs: DataFrame, least: float = LEAST, n: int = SHINGLE) -> DataFrame:
    """doc_id, class_id (the least id of the texts linked with it, however far), n_shingles."""
    rows = printed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", n)
    rows = materialised(rows)
    sets = materialised(rows.select("digest", "gs", "bands").dropDuplicates(["digest"]))
    label = set_classes(sets, least)
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max(F.size("gs")).alias("n_shingles"))
    named = materialised(ids.join(label, "digest", "left").select("digest", "first", "n_shingles", F.coalesce("label", "digest").alias("label")))
    least_id = named.groupBy("label").agg(F.min("first").alias("class_id"))
    named = materialised(named.join(least_id, "label").select("digest", "class_id", F.col("n_shingles").cast("long").alias("n_shingles")))
    return materialised(rows.select("doc_id", "digest")).join(named, "digest").select("doc_id", "class_id", "n_shingles")


def _word_hashes(raw: np.ndarray, space: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each word of UTF-8 bytes, from its bytes alone."""
    if not len(begins):
        return np.zeros(0, np.int64)
    gaps = np.diff(begins, append=len(raw))
    at = np.arange(len(raw) - begins[0]) - np.repeat(begins - begins[0], gaps)
    own = np.where(space, np.uint64(0), raw + np.uint64(1))[begins[0] :] * np.cumprod(np.full(gaps.max(), _FOLD))[at]
    return _mix(np.add.reduceat(own, begins - begins[0])).view(np.int64)


def _rough(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: how many they are; of their shingles, repeats included, the text and a hash (another than that of the sets)."""
    for raw, space, edges in _found(texts):
        begins, upto = _begins(space, edges)
        row, h = _windows(_word_hashes(raw, space, begins), np.diff(upto), n)
        yield len(edges) - 1, row, h.view(np.uint64)


def sieve(parts: DataFrame, text: str, n: int = SHINGLE) -> np.ndarray:
    """A field of bits in which those of all shingles of the texts are set: 32 MB at most, a byte of it for 8 bytes of texts below that."""
    size = parts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(FIELD, max(PIECE, size.bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h in _rough(b.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(64 - bits)).astype(np.int32))], ["at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.asarray(b.column(0))
            for k in np.unique(at >> PIECE).tolist():
                own = at[at >> PIECE == k] & ((1 << PIECE) - 1)
                np.bitwise_or.at(pieces.setdefault(k, np.zeros(1 << PIECE - 3, np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], ["piece", "bits"])

    dealt = parts.select(F.col(text).cast("binary")).mapInArrow(places, "at int").repartition(F.shiftright("at", PIECE))
    field = np.zeros((1 << bits - PIECE, 1 << PIECE - 3), np.uint8)
    for r in dealt.mapInArrow(packed, "piece int, bits binary").toLocalIterator():  # the field, not the shingles
        field[r["piece"]] |= np.frombuffer(r["bits"], np.uint8)
    return field.ravel()


def sieved(texts: pa.Array, field: np.ndarray, least: float = LEAST, n: int = SHINGLE) -> np.ndarray:
    """Which texts may have a Jaccard of `least` with a text of the field: of their distinct shingles that share or more may be known."""
    kept, bits = [np.zeros(0, bool)], len(field).bit_length() + 2
    for count, row, h in _rough(texts, n):
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        known = (field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        met = np.bincount(row[known], minlength=count)  # repeats included: no less than the distinct ones
        lost = ~known & (met > 0)[row]
        shift = np.uint64(min(63, 64 - int(count).bit_length()))
        key = np.sort(row[lost].astype(np.uint64) << shift | h[lost] >> (np.uint64(64) - shift))
        new = key[np.diff(key, prepend=np.uint64(2**64 - 1)) != 0]
        every = met + np.bincount((new >> shift).astype(np.int64), minlength=count)
        kept.append((met > 0) & (met >= (least - 1e-9) * every))
    return np.concatenate(kept)


def _indexed(code: np.ndarray, item: np.ndarray, none: np.ndarray, jaccard: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by item: the codes, where the rows of each begin and how many there are; by code each row's item and Jaccard; the items."""
    new = (np.diff(item, prepend=0) != 0) | (np.diff(none, prepend=False) != 0)
    new[0] = True
    order = np.argsort(code, kind="stable")
    codes, begin, size = np.unique(code[order], return_index=True, return_counts=True)
    return codes, begin, size, (np.cumsum(new) - 1)[order], jaccard[order], item[new], none[new]


def _pairs(index: tuple[np.ndarray, ...], code: np.ndarray, doc: np.ndarray, none: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For whole documents, their rows side by side: every item that shares a code with them, and the largest Jaccard of such codes."""
    codes, begin, size, item, jaccard, items, no_item = index
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    hit = codes[at] == code
    at, doc, none = at[hit], doc[hit], none[hit]
    new = (np.diff(doc, prepend=0) != 0) | (np.diff(none, prepend=False) != 0)
    new[:1] = True
    own = np.cumsum(new) - 1
    alone = (np.bincount(own) == 1)[own]
    for rows in (np.flatnonzero(alone), np.flatnonzero(~alone)):
        first = np.append(np.flatnonzero(np.diff(own[rows], prepend=-1)), len(rows))  # of each document
        upto = np.append(0, np.cumsum(size[at[rows]]))
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(upto[first], upto[first[i]] + STEP, "right")) - 1)
            r = rows[first[i] : first[j]]
            n = size[at[r]]
            row = np.repeat(r, n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - begin[at[r]], n)
            which, near = item[k], jaccard[k]
            if len(r) > j - i:
                key = own[row] * len(items) + which
                order = np.argsort(key, kind="stable")
                key = key[order]
                head = np.flatnonzero(np.diff(key, prepend=-1))
                row, which, near = row[order][head], key[head] % len(items), np.maximum.reduceat(near[order], head)
            yield pa.RecordBatch.from_arrays([pa.array(doc[row], mask=none[row]), pa.array(items[which], mask=no_item[which]), pa.array(near)], ["doc_id", "item_id", "jaccard"])
            i = j


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell, from rows sorted by cell, side (items come first) and id."""
    now, held, index, rest = None, [], None, None
    for b in batches:
        cell, side, *cols = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "code", "id", "none", "jaccard"))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for i, j in itertools.pairwise([0, *cuts.tolist(), len(cell)] if len(cell) else []):
            if cell[i] != now:
                if rest:
                    yield from _pairs(index, *rest)
                now, held, index, rest = cell[i], [], None, None
            own = [c[i:j] for c in cols]
            if side[i] == 0:
                held.append(own)
            elif held:
                index = index or _indexed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                rest = [np.concatenate(c) for c in zip(rest, own[:3], strict=True)] if rest else own[:3]
                last = np.flatnonzero((np.diff(rest[1]) != 0) | (np.diff(rest[2]) != 0))
                if len(last):  # the last document may go on in the next batch
                    yield from _pairs(index, *(c[: last[-1] + 1] for c in rest))
                    rest = [c[last[-1] + 1 :] for c in rest]
    if rest:
        yield from _pairs(index, *rest)


def best_pairs(given: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, item_id, jaccard: the largest Jaccard of a code that both have. given: distinct doc_id, code; asked: code, item_id, jaccard, one row for each code and item.

    Such pairs can be as many as the product of both sides, so they are neither moved nor written: documents and items are dealt out to the
    cells of a grid, their own rows to each cell of their row or column, and a cell's task makes its pairs once and for all.
    """
    count = lambda df, name: df.groupBy("code").agg(F.count("*").alias(name))
    g, a, total = (x or 1 for x in count(given, "g").join(count(asked, "a"), "code").agg(F.sum("g"), F.sum("a"), F.sum(F.col("g") * F.col("a"))).first())
    cells = max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CELL))
    columns = max(1, -(-a // HELD), min(cells, round(math.sqrt(cells * a / g))))
    lines = -(-cells // columns)
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def rows(df: DataFrame, side: int, key: str, line, column, jaccard) -> DataFrame:  # noqa: ANN001
        df = df.select("code", F.coalesce(key, F.lit(0).cast("long")).alias("id"), F.col(key).isNull().alias("none"), jaccard.alias("jaccard"), line.alias("line"), column.alias("column"))
        return df.select((F.col("line") * columns + F.col("column")).alias("cell"), F.lit(side).alias("side"), "code", "id", "none", "jaccard")

    both = rows(asked, 0, "item_id", every(lines), place("item_id", columns), F.col("jaccard")).unionByName(rows(given, 1, "doc_id", place("doc_id", lines), every(columns), F.lit(0.0)))
    return both.repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "side", "none", "id").mapInArrow(_best, "doc_id bigint, item_id bigint, jaccard double")


def near_paragraphs(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, n: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, jaccard: the best Jaccard, `least` or more, of a paragraph of the document and one of the item.

    A paragraph is a line, or a run of lines up to an empty one: both are tried on either side.
    """

    def lines(df: DataFrame, key: str) -> DataFrame:
        part = F.explode(F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \t]*\n"))))
        return df.select(F.col(key).cast("long").alias(key), part.alias("part")).where("part rlike '[^ \\t\\n]'")

    hashed = lambda df, key: df.select(key, F.md5("part").alias("key"), "part")
    items = materialised(hashed(lines(benchmark, "item_id"), "item_id"))
    field = docs.sparkSession.sparkContext.broadcast(sieve(items, "part", n))

    def may_meet(texts: pa.Array) -> pa.Array:
        return pa.array(sieved(texts, field.value, least, n))

    mine = materialised(hashed(lines(docs, "doc_id").where(F.arrow_udf(may_meet, "boolean")(F.col("part").cast("binary"))), "doc_id"))
    field.unpersist()
    side = lambda df, own: df.select("key", "part", F.lit(own).alias("own"), F.lit(not own).alias("item"))
    sides = [F.max("own").alias("own"), F.max("item").alias("item")]
    parts = side(mine, True).unionByName(side(items, False)).groupBy("key").agg(F.first("part").alias("part"), *sides)
    prints_ = materialised(printed(parts, "part", n))
    sets = materialised(prints_.groupBy("digest").agg(F.first("gs").alias("gs"), F.first("bands").alias("bands"), *sides))
    found = materialised(similar_pairs(sets.where("own"), sets.where("item"), least))
    codes = materialised(found.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("code")))
    own = prints_.where("own").join(codes, "digest").select("key", "code")
    given = materialised(mine.select("doc_id", "key").join(own, "key").select("doc_id", "code").distinct())
    near = prints_.where("item").select("key", F.col("digest").alias("right_digest")).join(found, "right_digest").join(codes, "digest").select("key", "code", "jaccard")
    asked = items.select("item_id", "key").join(near, "key").groupBy("code", "item_id").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))
    return best_pairs(given, materialised(asked))
