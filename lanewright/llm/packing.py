"""Best-fit packing into bins of several permitted lengths, chosen jointly.

A bin of c tokens costs what training on it costs, in tokens' worth: a fixed part, c, and attention, which grows with c
squared. Short bins are cheap per token but for the fixed part, long ones hold more but for attention; which size is best
depends on how well what is still to be placed would fill it. Documents longer than the largest capacity give full pieces
and one remainder. The remainders are dealt by a hash of id and text to independent shards of bounded size and placed
longest first: each goes where it leaves the least room among the open bins; if none has room, a bin opens of the size
with the least cost per token, where each size is tried against the lengths not yet placed (longest that fits first). At
the end every bin is downsized to the smallest permitted length that holds its contents.

A shard's lengths come before its texts in one sorted partition, so a task holds the numbers of one shard and a batch of
texts, and texts are shuffled once.

Defined cases: null or empty text has no token and no place in a bin (piece -1, bin_id null); equal lengths are placed in
order of id, then of the text's MD5; repeated rows are packed each; rows without an id are spread over shards by their
text and partition; very long texts are cut between words into pieces of the largest capacity, which joined give the text
again; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import marked, texts, unmarked

CAPACITIES = (512, 1024, 2048, 4096)
#: Fixed cost of a bin in tokens; the length at which attention costs as much as all else; documents of a shard on average.
OVERHEAD = 64
ATTENTION = 12_288
SHARD = 5_000
SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id string, capacity int, bin_start long, text string"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_count(text: Column) -> Column:
    """White-space separated words and one end token; none for an empty text."""
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""))
    return F.when(text == "", 0).otherwise(words + 1).cast("long")


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + capacity + capacity * capacity / attention


def _filled(lengths: list[int], minus: list[int], after: int, room: int) -> int:
    """Tokens of `room` that the lengths from index `after` on (longest first; `minus`: negated) would fill."""
    left, at = room, after
    while left and (at := bisect_left(minus, -left, at)) < len(lengths):
        n = lengths[at]
        end = bisect_left(minus, -n + 1, at)
        left -= n * min(end - at, left // n)
        at = end
    return room - left


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its place in the bin, final capacity of each bin). Items: longest first, none over the largest."""
    sizes = sorted(capacities)
    price = {c: cost(c, overhead, attention) for c in sizes}
    minus = [-n for n in lengths]
    bin_of: list[int] = []
    place: list[int] = []
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free tokens, -bin), sorted
    for k, n in enumerate(lengths):
        at = bisect_left(room, (n, -len(used) - 1))
        if at < len(room):
            free, b = room.pop(at)
            b = -b
        else:
            free = min((c for c in sizes if c >= n), key=lambda c: (price[c] / (n + _filled(lengths, minus, k + 1, c - n)), c))
            b = len(used)
            used.append(0)
        bin_of.append(b)
        place.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, -b))
    return bin_of, place, [sizes[bisect_left(sizes, u)] for u in used]


def pieces(text: str, n: int, most: int, count: int) -> list[str]:
    """The text cut before every n-th word into `count` pieces."""
    begin = [0, *(m.start() for k, m in enumerate(_WORD.finditer(text)) if k and k % most == 0)]
    begin += [len(text)] * (count + 1 - len(begin))
    return [text[a:b] for a, b in zip(begin, begin[1:], strict=False)]


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """One row per piece: doc_id, piece, start (in the document), n_tokens, bin_id, capacity, bin_start (in the bin), text."""
    most = max(capacities)
    rows = texts(docs)
    rows = rows.select("doc_id", "text", F.md5("text").alias("h"), token_count(F.col("text")).alias("n"))
    shards = max(1, -(-docs.count() // shard))
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id())  # rows alike in all else must not meet in one shard
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", spread), F.lit(shards)).cast("int"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, items, plan, fulls = None, [], None, 0
        where: dict[tuple[int, str], list[int]] = {}

        def placed(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal fulls
            bin_of, place, sizes = plan
            out = []
            for doc, h, n, text in zip(part["doc_id"].tolist(), part["h"].tolist(), part["n"].tolist(), part["text"].tolist(), strict=True):
                if not n:
                    out.append((doc, -1, 0, 0, None, None, None, text))
                    continue
                full, left = divmod(n, most)
                own = pieces(text, n, most, full + (left > 0)) if full else [text]
                for k in range(full):
                    out.append((doc, k, k * most, most, f"{now}-full-{fulls}", most, 0, own[k]))
                    fulls += 1
                if left:
                    at = where[doc, h].pop()
                    out.append((doc, full, full * most, left, f"{now}-{bin_of[at]}", sizes[bin_of[at]], place[at], own[full]))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "bin_start", "text"])
            return frame.astype({"capacity": "Int32", "bin_start": "Int64"})

        for b in batches:
            key = b["shard"].to_numpy() * 2 + b["kind"].to_numpy()
            cuts = [0, *((key[1:] != key[:-1]).nonzero()[0] + 1).tolist(), len(b)] if len(b) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = b.iloc[lo:hi]
                if now != (s := int(part["shard"].iloc[0])):
                    now, items, plan, fulls, where = s, [], None, 0, {}
                if part["kind"].iloc[0] == 0:
                    for doc, h, left in zip(part["doc_id"].tolist(), part["h"].tolist(), (part["n"] % most).tolist(), strict=True):
                        if left:
                            where.setdefault((doc, h), []).append(len(items))
                            items.append(left)
                    continue
                if plan is None:
                    plan = pack(items, capacities, overhead, attention)
                for begin in range(0, len(part), 500):
                    yield placed(part.iloc[begin : begin + 500])

    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("text"))))
    dealt = marked(rows.select("shard", "doc_id", "h", "n", both.alias("x")).select("shard", "x.kind", "doc_id", "h", "n", "x.text"))
    # Lengths come longest first, texts in the order of their digests: a batch of texts then has no more than its share of long ones.
    longest = F.when(F.col("kind") == 0, -(F.col("n") % most))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind", longest, F.when(F.col("kind") == 0, F.col("doc_id")), "h")
    return unmarked(dealt.mapInPandas(each, SCHEMA))
