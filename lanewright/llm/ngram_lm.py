"""Bigram language model with interpolated modified Kneser-Ney smoothing, counted in Spark.

Tokens are 64-bit hashes. Map tasks collapse equal bigrams and send packed columns to ranges of the bigram hash (salted
by the second token, so a frequent first token is spread over four ranges). Each range merges its counts, writes a
sorted hash array and a count array to the shared folder, and sends per-token statistics on to ranges of the token
hash, which write the token arrays. Scoring tasks map these files into memory and look up sorted queries: what a worker
holds of the model is page cache. Only discounts (counts of counts, one row a range) pass through the driver.

Files are written under a temporary name and renamed; a task that runs again writes the same content.

Defined cases: null or empty text is the end token alone; tokens of equal hash (64 bits; as first token of a bigram, 48 bits) count as one; counts have 64 bits; with no training row every probability is that of an unknown
token in an empty model (uniform over one); repeated rows count each; a null doc_id counts as the empty string for the
split; very long texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import U64, id_remainder, local_path, marked, mix, shared_dir, texts, token_hashes, unmarked

START = U64(0x5354415254000001)
END = U64(0x454E44000000002B)
#: Bytes of text for each range of the model.
RANGE_BYTES = 8_000_000
LEAST_RANGES = 64
#: Bytes of text that are scored at once (a text is never cut).
SCORE_BYTES = 4_000_000
#: Tokens that a map task collapses at once.
FLUSH = 3_000_000
_A, _B, _S = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def sequences(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, number of tokens of each text), each text closed by END and opened by START."""
    raw = [t.encode("utf-8", "replace").lower() for t in rows]
    offset = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    h, start = token_hashes(b"\n".join(raw))
    doc = np.searchsorted(offset, start, "right") - 1
    count = np.bincount(doc, minlength=len(rows)) + 1
    cur = np.full(len(h) + len(rows), END, U64)
    cur[np.arange(len(h)) + doc] = h
    before = np.empty_like(cur)
    before[1:] = cur[:-1]
    before[np.cumsum(count) - count] = START
    return before, cur, count


def bigram_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hash of a bigram (u by its top 48 bits); the top 16 bits depend on u and two bits of v and choose the range."""
    top = mix((u >> U64(16)) * _A + (v & U64(3)) * _S)
    return (top & U64(0xFFFF000000000000)) | (mix((u >> U64(16)) * _B + mix(v)) >> U64(16))


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return (((key >> U64(48)) * U64(ranges)) >> U64(16)).astype(np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first index, index after the last) of the parts that occur, for sorted parts."""
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(part[lo]), lo, hi


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _packed(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = int.from_bytes(b[:8], "little"), 8
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True)]


def merged_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first tokens (their top 48 bits), second tokens and counts of the bigrams in packed parts; counts in 64 bits."""
    v, low, high, n = _unpacked(blobs, "<u8", "<u4", "<u2", "<u4")  # a part counts one batch, so 32 bits hold it
    u = low.astype(U64) | (high.astype(U64) << U64(32))
    key = bigram_key(u << U64(16), v)
    order = np.argsort(key)
    key, u, v, n = key[order], u[order], v[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], u[first], v[first], np.add.reduceat(n, first)


def narrow(c: np.ndarray) -> np.ndarray:
    """The same counts in 32 bits if all fit, as they mostly do."""
    return c.astype(np.uint32) if not len(c) or c.max() < 2**32 else c


def _save(path: str, array: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(key, rows) for rows that come sorted by `part`."""
    now: int | None = None
    held: list[pd.DataFrame] = []
    for b in batches:
        for part, rows in b.groupby("part", sort=False):
            if part != now and held:
                yield now, pd.concat(held)
                held = []
            now = part
            held.append(rows)
    if held:
        yield now, pd.concat(held)


@lru_cache(8192)
def _mapped(path: str) -> np.ndarray | None:
    """The array mapped into memory; every run has a folder of its own, so a path never changes its content."""
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


@dataclass(frozen=True)
class Model:
    """Where the arrays are and what the driver knows: ranges, tokens, distinct tokens, bigram types, discounts."""

    path: str
    ranges: int
    tokens: int
    vocabulary: int
    types: int
    bigram_discounts: tuple[float, float, float]
    token_discounts: tuple[float, float, float]
    counts_of_types: tuple[int, int, int]

    def _open(self, name: str, part: int) -> np.ndarray | None:
        return _mapped(f"{self.path}/{name}-{part}.npy")

    def _lookup(self, keys: np.ndarray, name: str, columns: int, shift: int) -> np.ndarray:
        """Values (columns x keys, 0 if absent) for sorted keys."""
        out = np.zeros((columns, len(keys)), np.int64)
        part = _range_of(keys, self.ranges)
        for p, lo, hi in _slices(part):
            if (known := self._open(name, p)) is None or not len(known):
                continue
            values = self._open(f"{name}-values", p)
            at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
            ok = np.flatnonzero(known[at] == keys[lo:hi])
            out[:, lo + ok] = values[:, at[ok]]
        return out

    def score(self, before: np.ndarray, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the token in training, log10 probability after the token before it)."""
        d, dt = self.bigram_discounts, self.token_discounts
        words, at = np.unique(np.concatenate((before, cur)), return_inverse=True)
        count, preceding, follow, n1, n2, n3 = self._lookup(words, "token", 6, 0)
        u, v = at[: len(cur)], at[len(cur) :]
        keys, back = np.unique(bigram_key(before, cur), return_inverse=True)
        c = self._lookup(keys, "bigram", 1, 0)[0][back]
        less = np.array([0.0, *dt])
        uniform = 1.0 / (self.vocabulary + 1)
        if self.types:
            t1, t2, t3 = self.counts_of_types
            rest = (dt[0] * t1 + dt[1] * t2 + dt[2] * t3) / self.types
            low = np.maximum(preceding - less[np.minimum(preceding, 3)], 0) / self.types + rest * uniform
        else:
            low = np.full(len(words), uniform)
        less = np.array([0.0, *d])
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.where(follow > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / follow, 1.0)
            high = np.where(follow[u] > 0, np.maximum(c - less[np.minimum(c, 3)], 0) / follow[u], 0.0)
        return count[v], np.log10(high + spread[u] * low[v])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of types with counts 1 to 4."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else float(k + 1) / 2 for k in range(3)]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))  # type: ignore[return-value]


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame) -> Model:
    """Count all rows (text) and write the model to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    path = local_path(shared_dir(spark))

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tokens = [], 0
        for b in batches:
            before, cur, _ = sequences(b["text"].tolist())
            held.append((before, cur))
            tokens += len(cur)
            if tokens >= FLUSH:
                yield from sent(held)
                held, tokens = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        u, v = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        key, first, n = np.unique(bigram_key(u, v), return_index=True, return_counts=True)
        u, v = u[first] >> U64(16), v[first]
        part = _range_of(key, ranges)
        rows = [(p, _packed(v[lo:hi], (u[lo:hi]).astype(np.uint32), (u[lo:hi] >> U64(32)).astype(np.uint16), n[lo:hi].astype(np.uint32))) for p, lo, hi in _slices(part)]
        yield pd.DataFrame(rows, columns=["part", "data"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, rows in _groups(batches):
            key, u, v, c = merged_counts(rows["data"].tolist())
            _save(f"{path}/bigram-{p}.npy", key)
            _save(f"{path}/bigram-values-{p}.npy", narrow(c)[None, :])
            as_u = _sum_by(u, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))
            as_v = _sum_by(v, c, np.ones(len(c), np.int64))
            stats = np.array([*_counts_of_counts(c), len(c)], np.int64)
            # Only ranges that get something, and this one, which takes the counts of counts on.
            of_u = {q: (a, b) for q, a, b in _slices(_range_of(as_u[0] << U64(16), ranges))}
            of_v = {q: (e, f) for q, e, f in _slices(_range_of(as_v[0], ranges))}
            out = []
            for q in sorted({p, *of_u, *of_v}):
                (a, b), (e, f) = of_u.get(q, (0, 0)), of_v.get(q, (0, 0))
                own = stats if q == p else np.zeros(5, np.int64)
                out.append((q, _packed(*(x[a:b] for x in as_u)), _packed(*(x[e:f] for x in as_v)), own.tolist()))
            yield pd.DataFrame(out, columns=["part", "before", "after", "stats"])

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, rows in _groups(batches):
            u, follow, n1, n2, n3 = _sum_by(*_unpacked(rows["before"].tolist(), "<u8", *["<i8"] * 4))
            v, count, types = _sum_by(*_unpacked(rows["after"].tolist(), "<u8", *["<i8"] * 2))
            if np.isin(START >> U64(16), u) and not np.isin(START, v):  # it begins texts but is no token of them
                at = int(np.searchsorted(v, START))
                v, count, types = np.insert(v, at, START), np.insert(count, at, 0), np.insert(types, at, 0)
            values = np.zeros((6, len(v)), np.int64)
            values[0], values[1] = count, types
            if len(u):
                at = np.minimum(np.searchsorted(u, v >> U64(16)), len(u) - 1)
                ok = u[at] == v >> U64(16)
                for k, x in enumerate((follow, n1, n2, n3)):
                    values[2 + k] = np.where(ok, x[at], 0)
            _save(f"{path}/token-{p}.npy", v)
            _save(f"{path}/token-values-{p}.npy", values)
            own = [*_counts_of_counts(types), int((types >= 3).sum()), int(count.sum()), int((count > 0).sum())]
            yield pd.DataFrame({"stats": [np.sum(np.stack(rows["stats"].to_numpy()), axis=0).tolist() + own]})

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(ranges, "part").sortWithinPartitions("part")

    counted = dealt(docs.select("text").mapInPandas(collapse, "part int, data binary"))
    merged = dealt(counted.mapInPandas(merge, "part int, before binary, after binary, stats array<long>"))
    rows = [r[0] for r in merged.mapInPandas(tokens, "stats array<long>").collect()]  # one row a range
    s = np.array(rows, np.int64).sum(axis=0).tolist() if rows else [0] * 12
    return Model(path, ranges, s[10], s[11], s[4], discounts(s[:4]), discounts(s[5:9]), (s[5], s[6], s[9]))


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in slices of about SCORE_BYTES."""
    for b in batches:
        part = np.cumsum(b["text"].str.len().to_numpy(np.int64)) // SCORE_BYTES
        for k in np.unique(part):
            yield b[part == k]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows of doc_id, held_out, text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            before, cur, n = sequences(b["text"].tolist())
            count, logp = model.score(before, cur)
            base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            first = np.cumsum(n) - n
            add = lambda x: np.add.reduceat(x, first) if len(n) else x[:0]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": n.astype(np.int64), "n_known": add((count > 0).astype(np.int64)), "train_tokens": model.tokens, "base_score": add(base), "score": add(logp)})

    return unmarked(marked(docs).mapInPandas(each, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose id remainder mod 5 is not 1, then score all."""
    rows = texts(docs).select("doc_id", (id_remainder(5) == 1).alias("held_out"), "text")
    return score(rows, train(rows.where("not held_out")))
