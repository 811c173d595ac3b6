"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of document shards.

A byte goes if a string of SPAN = 200 bytes that covers it also starts anywhere else. Every start of such a string belongs
to the group of its least CONTEXT-byte hash (equal strings hold equal hashes, so they share the group), and neighbouring
starts of one group travel as one segment. Groups met once in the corpus drop out before any text moves.

A shard is the documents that one task reads together. It sends its segments, equal ones once and weighted, to the tasks of
their groups. There every shard's segments get a transform of their own, sorted within the shard alone, and the transforms
of all shards are merged by interleave refinement: a round stably deals the merged order by the preceding symbol, which
sorts it by one more symbol, and marks where neighbours begin to differ (their common prefix). Symbols are 8 bytes at
8 phases, so SPAN / 8 = 25 rounds give all intervals of at least 200 common bytes without sorting all suffixes together.
A start is repeated if the weights of its interval come to two or more. Equal segments have equal transforms, which merge
into one by adding their weights; segments that differ are interleaved. Within a shard, a segment that stands at two
places is an interval of weight two by itself: its places are known there and then, and only one segment of weight two
goes on to tell the other shards.

Hot groups (a passage of very many documents) are split by the hash of each start's whole 200 bytes before they meet: a
shard that meets a group LOCAL times or more sends the runs to tasks dealt by shard, and only a mark to the group's own
task. So the group's task gets fewer than LOCAL runs from each shard, and the task of one 200-byte string one segment.

Documents whose whole texts are equal (MD5) count as copies: of 200 bytes or more, all goes. One of them stands for
the others. Tasks know texts by 64 bits of the digest; the texts of which these 64 bits are not their own (few in any
corpus: they are counted, and listed up to CLASHES) go by the other 64.

Defined cases: null or empty text keeps its zero bytes; texts under 200 bytes keep all; repeated rows are copies of
each other; an empty table gives an empty result; very long and periodic texts travel as segments of at most SEGMENT
starts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import U64, broadcast_if_small, mix, texts, written

SPAN = 200
CONTEXT = 100
HOT = 4000
SEGMENT = 4096
#: Runs of a group in one shard from which on the group is hot; most texts that may share 64 bits of their digests.
LOCAL = 32
CLASHES = 10_000
#: Suffixes that one merge takes together (a group that is larger is merged alone).
MERGE = 60_000
#: Bytes of text for each part of the group hashes, and bytes hashed at once.
PART_BYTES = 8_000_000
CHUNK = 1 << 18
BROADCAST_ROWS = 200_000

_R = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
_POWER = np.ones(1, U64)
_INVERSE = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        out = []
        for r in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(2 * n, r, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWER, _INVERSE = out
    return _POWER, _INVERSE


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on."""
    power, inverse = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, U64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(a) - n + 1])


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


def runs(texts_: list[bytes]) -> tuple[np.ndarray, ...]:
    """(group hash, text number, first start, number of starts, may it repeat itself) of every run of starts of one group.

    A run has at most SEGMENT starts. It may repeat itself if its least hash stands at two places in it.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    long = [k for k, t in enumerate(texts_) if len(t) >= SPAN]
    lo = 0
    while lo < len(long):
        hi, size = lo, 0
        while hi < len(long) and (hi == lo or size + len(texts_[long[hi]]) <= CHUNK):
            size += len(texts_[long[hi]])
            hi += 1
        own = long[lo:hi]
        n = np.array([len(texts_[k]) for k in own])
        begin = np.cumsum(n) - n
        a = np.frombuffer(b"".join(texts_[k] for k in own), np.uint8)
        h = gram_hashes(a, CONTEXT)
        width = SPAN - CONTEXT + 1
        least = _sliding_min(h, width)
        edge = np.full(width - 1, ~U64(0))
        most = _sliding_min(np.concatenate((edge, ~least, edge)), width)  # complements: the greatest minimum that a place can be
        minima = np.flatnonzero(h == ~most)
        again = np.concatenate(([0], np.cumsum(h[minima][1:] == h[minima][:-1]), [0]))
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[begin] = True
        closed = begin[1:] - SPAN + 1  # the first start of a text that would run into the next
        new[closed] = True
        at = np.flatnonzero(new)
        count = np.diff(at, append=len(least))
        text = np.searchsorted(begin, at, "right") - 1
        inside = at - begin[text] <= n[text] - SPAN
        at, count, text = at[inside], count[inside], text[inside]
        low, high = np.searchsorted(minima, at), np.searchsorted(minima, at + count + width - 1)
        twice = again[np.maximum(high - 1, low)] > again[low]
        if (count > SEGMENT).any():
            pieces = -(-count // SEGMENT)
            first = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.repeat(count, pieces) - first * SEGMENT
            twice = np.repeat(twice, pieces)
            at, text, count = np.repeat(at, pieces) + first * SEGMENT, np.repeat(text, pieces), np.minimum(left, SEGMENT)
        for x, y in zip(out, (least[at], np.array(own)[text], at - begin[text], count, twice), strict=True):
            x.append(y)
        lo = hi
    kinds = (U64, np.int64, np.int64, np.int64, bool)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))  


def _symbols(a: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number that sorts like them (the last 7 are of no use)."""
    x = np.concatenate((a, np.zeros(8, np.uint8))).astype(U64)
    for k in (1, 2, 4):
        x = (x[:-k] << U64(8 * k)) | x[k:]
    return x[: len(a)]


def _sorted_shard(rank: np.ndarray, after: np.ndarray, rounds: int) -> np.ndarray:
    """Order of a shard's suffixes by at least 2^rounds symbols: rank of each first symbol, and the suffix one symbol on (-1: none)."""
    for _ in range(rounds):
        nxt = np.where(after >= 0, rank[np.maximum(after, 0)] + 1, 0)
        pair = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate(([0], p[1:] != p[:-1])))
        after = np.where(after >= 0, after[np.maximum(after, 0)], -1)
    return np.argsort(rank, kind="stable")


def repeated_starts(segments: list[bytes], shard: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each segment and each start in it whether the weights of all places where its SPAN bytes start come to two or more."""
    n = np.array([len(s) for s in segments])
    size = n + 1  # the last 8 suffixes of a segment are empty, one of each phase
    begin = np.cumsum(size) - size
    m = int(size.sum())
    seg = np.repeat(np.arange(len(segments)), size)
    place = np.arange(m) - begin[seg]
    a = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8)
    symbol = _symbols(a)
    full = place <= n[seg] - 8
    cls = np.zeros(m, np.int64)
    values, cls[full] = np.unique(symbol[full], return_inverse=True)
    cls[full] += 1
    before = np.where(place >= 8, cls[np.maximum(np.arange(m) - 8, 0)], 0)  # the transform's symbol, 0 where a segment's phase begins
    kind = np.uint16 if len(values) < 65_535 else np.int64

    # Each shard sorted for itself (its number leads), and its transform.
    names, own = np.unique(shard, return_inverse=True)
    owner = own[seg]
    first = np.unique(owner * (len(values) + 1) + cls, return_inverse=True)[1]
    suffix = _sorted_shard(first, np.where(full, np.minimum(np.arange(m) + 8, m - 1), -1), int(np.ceil(np.log2(SPAN // 8))))
    transform = before[suffix].astype(kind)

    # The interleave: which shard each merged place belongs to; block: places whose prefixes are equal so far.
    interleave = owner[suffix].astype(np.uint16 if len(names) < 65_536 else np.int64)
    at, block = np.arange(m), np.zeros(m, np.int64)
    for _ in range(SPAN // 8):
        c = transform[at]
        o = np.argsort(c, kind="stable")
        c, b = c[o], block[o]
        interleave = interleave[o]
        block = np.cumsum(np.concatenate(([0], (c[1:] != c[:-1]) | (b[1:] != b[:-1]))))
        at = np.empty(m, np.int64)
        at[np.argsort(interleave, kind="stable")] = np.arange(m)  # the next of its shard, each in turn
    hit = np.zeros(m, bool)
    hit[suffix[at]] = np.bincount(block, weight[seg[suffix[at]]])[block] > 1
    return [hit[b : b + k - SPAN + 1] for b, k in zip(begin, n, strict=True)]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return lo, hi - lo


def shared_starts(shard: np.ndarray, group: np.ndarray, weight: np.ndarray, key: np.ndarray, start: np.ndarray, segments: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, first start, number of starts) of the repeated strings among the segments of weight 1, group after group.

    Transforms of equal segments are equal and merge into one with their weights added; only different ones are interleaved.
    """
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True]))) if len(order) else np.zeros(1, int)
    held: list[list[int]] = []
    total = 0

    def merge() -> Iterator[tuple[int, int, int]]:
        one = np.array([own[0] for own in held])
        sums = np.array([int(weight[own].sum()) for own in held])
        for own, w, flags in zip(held, sums.tolist(), repeated_starts([segments[k] for k in one.tolist()], shard[one], sums), strict=True):
            if w == 1:
                for lo, count in zip(*_intervals(flags), strict=True):
                    yield int(key[own[0]]), int(start[own[0]] + lo), int(count)

    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        equal: dict[bytes, list[int]] = {}
        for k in order[lo:hi].tolist():
            equal.setdefault(segments[k], []).append(k)
        undecided = False
        for segment, own in equal.items():
            if len(own) > 1 or weight[own[0]] > 1:  # an interval of two or more, whatever else is there
                for k in own:
                    if weight[k] == 1:
                        yield int(key[k]), int(start[k]), len(segment) - SPAN + 1
            else:
                undecided |= len(equal) > 1 or len(segment) > SPAN
        if not undecided:
            continue
        size = sum(len(x) + 1 for x in equal)
        if held and total + size > MERGE:
            yield from merge()
            held, total = [], 0
        held += equal.values()
        total += size
    if held:
        yield from merge()


def shard_runs(keys: np.ndarray, texts_: list[bytes], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed runs) of a shard. Bit 31 of a count: may repeat itself; bit 30: its group is hot; a count of 0 marks a hot group."""
    group, text, start, count, twice = runs(texts_)
    count = count.astype(np.uint32) | (twice.astype(np.uint32) << np.uint32(31))
    part = (group % U64(parts)).astype(np.int64)
    names, at, many = np.unique(group, return_inverse=True, return_counts=True)
    hot = many[at] >= LOCAL
    if hot.any():
        marks = names[many >= LOCAL]
        count[hot] |= np.uint32(1 << 30)
        part[hot] = int(mix(keys[:1].view(U64))[0] % U64(parts))
        zero = np.zeros(len(marks), np.int64)
        part = np.concatenate((part, (marks % U64(parts)).astype(np.int64)))
        group, text, start = np.concatenate((group, marks)), np.concatenate((text, zero)), np.concatenate((start, zero))
        count = np.concatenate((count, np.zeros(len(marks), np.uint32)))
    yield from _pack(part, group, keys[text] if len(text) else keys[:0], start.astype(np.uint32), count)


def groups_met_twice(blobs: list[bytes]) -> pd.DataFrame:
    """key, g, s, c, hot: the runs of one part whose group is met twice, may repeat itself or is hot."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for b in blobs:
        n, at = int.from_bytes(b[:8], "little"), 8
        for c, kind in zip(cols, ("<u8", "<i8", "<u4", "<u4"), strict=True):
            c.append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    group, keys, start, count = (np.concatenate(c) for c in cols)
    marked_ = np.isin(group, np.unique(group[(count & np.uint32(0x3FFFFFFF)) == 0]))
    hot = marked_ | ((count >> np.uint32(30)) & np.uint32(1) > 0)
    order = np.argsort(group, kind="stable")
    g = group[order]
    same = np.concatenate(([False], g[1:] == g[:-1], [False]))
    order = order[(same[1:] | same[:-1] | (count[order] >> np.uint32(31) > 0) | hot[order]) & (count[order] & np.uint32(0x3FFFFFFF) > 0)]
    order = order[np.lexsort((start[order], keys[order], group[order]))]
    g, k, s, c, hot = group[order], keys[order], start[order], count[order], hot[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(g) else np.zeros(0, bool)
    g, k, s, c, hot = g[new], k[new], s[new], c[new], hot[new]
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
    many = np.repeat(np.diff(at, append=len(g)), np.diff(at, append=len(g)))
    ok = (many > 1) | (c >> np.uint32(31) > 0) | hot
    c = c & np.uint32(0x3FFFFFFF)
    return pd.DataFrame({"key": k[ok], "g": g[ok].view(np.int64), "s": s[ok].astype(np.int32), "c": c[ok].astype(np.int32), "hot": hot[ok] | (many[ok] > HOT)})


#: Characters of the texts whose segments a task sends together.
SHARD_CHARS = 4_000_000
#: Stands in place of a number of segments before starts that a shard knows by itself.
_TOLD = b"\xff" * 8
_KNOWN = np.dtype([("key", "<i8"), ("s", "<i4"), ("c", "<i4")])
#: A segment of a shard: its group, weight (2: at several places), and text and start if it stands at one.
_HEAD = np.dtype([("group", "<i8"), ("key", "<i8"), ("start", "<i4"), ("size", "<i4"), ("weight", "<i4")])


def shard_segments(keys: list[int], texts_: list[bytes], lists: list[list], parts: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, int]]]:
    """(part, packed segments) that a shard sends, and (text, start, starts) of the segments that it holds twice."""
    pack = zstandard.ZstdCompressor(level=1)
    places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k, data, own in zip(keys, texts_, lists, strict=True):
        hashes = None
        for r in own:
            g, s, c = r["g"], r["s"], r["c"]
            if not r["hot"]:
                places.setdefault((g, data[s : s + c + SPAN - 1]), []).append((k, s))
                continue
            if hashes is None:
                hashes = gram_hashes(np.frombuffer(data, np.uint8), SPAN).view(np.int64)
            for j in range(s, s + c):
                places.setdefault((int(hashes[j]), data[j : j + SPAN]), []).append((k, j))
    out: dict[int, tuple[list[tuple], list[bytes]]] = {}
    known = []
    for (g, segment), at in places.items():
        at = list(dict.fromkeys(at))
        if len(at) > 1:
            known += [(k, s, len(segment) - SPAN + 1) for k, s in at]
        heads, bodies = out.setdefault((g & 0xFFFFFFFFFFFFFFFF) % parts, ([], []))
        heads.append((g, *(at[0] if len(at) == 1 else (0, 0)), len(segment), min(len(at), 2)))
        bodies.append(segment)
    rows = [(p, len(heads).to_bytes(8, "little") + pack.compress(np.array(heads, _HEAD).tobytes() + b"".join(bodies))) for p, (heads, bodies) in out.items()]
    return rows, known


def merged_parts(blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """The repeated starts among the segments of one part; a blob is a shard's."""
    open_ = zstandard.ZstdDecompressor()
    heads, shard, found = [], [], []
    for j, b in enumerate(blobs):
        n = int.from_bytes(b[:8], "little")
        raw = open_.decompress(b[8:])
        head = np.frombuffer(raw, _HEAD, n)
        end = np.cumsum(head["size"].astype(np.int64)) + n * _HEAD.itemsize
        found += [raw[e - k : e] for e, k in zip(end.tolist(), head["size"].tolist(), strict=True)]
        heads.append(head)
        shard.append(np.full(n, j))
    head = np.concatenate(heads)
    yield from shared_starts(np.concatenate(shard), head["group"], head["weight"], head["key"], head["start"].astype(np.int64), found)


def remaining(data: bytes, intervals: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, SHA-256 of the rest) for intervals of repeated starts."""
    kept, at, end, spans = [], 0, -1, 0
    for start, count in sorted(intervals):
        if start > end:
            spans += 1
            kept.append(data[at:start] if end < 0 else data[end:start])
        end = max(end, start + count - 1 + SPAN)
        at = end
    kept.append(data[max(end, 0) :])
    rest = b"".join(kept)
    return len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()


def _pack(parts: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(parts, kind="stable")
    p, cols = parts[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, int)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(p[lo]), int(hi - lo).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c[lo:hi]).tobytes() for c in cols)


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """The blobs of each part, for rows that come sorted by it."""
    now, held = None, []
    for b in batches:
        for part, data in zip(b["part"], b["data"], strict=True):
            if part != now and held:
                yield held
                held = []
            now = part
            held.append(data)
    if held:
        yield held


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    half = lambda at: F.conv(F.substring("md5", at, 16), 16, -10).cast("long")
    rows = texts(docs).withColumn("md5", F.md5("text"))
    # A document per text, and how many have it. A null id stands for a text only where no other id does.
    same = written(rows.select("doc_id", "md5", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    by_text = written(same.groupBy("md5").agg(F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("doc_id"), F.count("*").alias("n")).withColumn("key", half(1)))
    clashes = [r[0] for r in by_text.join(by_text.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi").select("md5").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise ValueError("too many texts share 64 bits of their digests")
    key = F.when(F.col("md5").isin(*clashes), half(17)).otherwise(half(1)) if clashes else half(1)
    rows, same, by_key = rows.withColumn("key", key).drop("md5"), same.withColumn("key", key).drop("md5"), by_text.withColumn("key", key).drop("md5")
    size = same.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(64, -(-size // PART_BYTES))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b.drop_duplicates("key")
            yield pd.DataFrame(shard_runs(own["key"].to_numpy(np.int64), [t.encode("utf-8", "replace") for t in own["text"]], parts), columns=["part", "data"])

    def met_twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blobs in _grouped(batches):
            yield groups_met_twice(blobs)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lot = np.cumsum(b["text"].str.len().to_numpy(np.int64)) // SHARD_CHARS
            for j in np.unique(lot):
                own = b[lot == j]
                sent, known = shard_segments(own["key"].tolist(), [t.encode("utf-8", "replace") for t in own["text"]], own["runs"].tolist(), parts)
                told = [(own["key"].iloc[0] % parts, _TOLD + np.array(known, _KNOWN).tobytes())] if known else []
                yield pd.DataFrame([*sent, *told], columns=["part", "data"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blobs in _grouped(batches):
            yield from (pd.DataFrame(np.frombuffer(b, _KNOWN, offset=8)) for b in blobs if b[:8] == _TOLD)
            if blobs := [b for b in blobs if b[:8] != _TOLD]:
                yield pd.DataFrame(list(merged_parts(blobs)), columns=["key", "s", "c"]).astype({"key": "int64", "s": "int32", "c": "int32"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [remaining(t.encode("utf-8", "replace"), [(r["s"], r["c"]) for r in own]) for t, own in zip(b["text"], b["runs"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "n_removed": [d[0] for d in done], "n_spans": [d[1] for d in done], "kept": [d[2] for d in done]})

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    def with_texts(lists: DataFrame) -> DataFrame:
        """key, text, runs: the text of each key from the one document that stands for it."""
        lists = written(lists.join(stands, "key"))
        ids = broadcast_if_small(lists.select("doc_id", "key"), BROADCAST_ROWS)
        return rows.join(ids, ["doc_id", "key"], "left_semi").join(lists, ["doc_id", "key"]).select("key", "text", "runs")

    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    stands = by_key.select("key", "doc_id")
    spread = rows.select("key", "text").where(F.octet_length("text") >= SPAN).mapInPandas(scan, "part int, data binary")
    twice = dealt(spread).mapInPandas(met_twice, "key long, g long, s int, c int, hot boolean")
    lists = twice.groupBy("key").agg(F.collect_list(F.struct("g", "s", "c", "hot")).alias("runs"))
    sent = with_texts(lists).mapInPandas(segments, "part int, data binary")
    hits = dealt(sent).mapInPandas(compare, "key long, s int, c int")
    single = by_key.where("n = 1").select("key")
    lists = hits.groupBy("key").agg(F.collect_list(F.struct("s", "c")).alias("runs")).join(single, "key", "left_semi")
    removed = written(with_texts(lists).dropDuplicates(["key"]).mapInPandas(cut, "key long, n_removed long, n_spans long, kept string"))
    copies = by_key.where("n > 1").select("key", F.lit(True).alias("copied"))
    verdict = written(removed.withColumn("copied", F.lit(False)).unionByName(copies, allowMissingColumns=True))
    out = same.join(verdict, "key", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
