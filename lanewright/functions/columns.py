"""Column functions: words, token ids, hashes and hash-derived uniform numbers, JVM-side but for `word_counts`, `piece_hashes` and `token_ids_of`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode.
SPACES = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The same but for the blank, one by one.
_OTHERS = "".join(chr(c) for c in (*range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Those of two and three bytes of UTF-8, as numbers.
_WIDE = {size: np.array([int.from_bytes(x.encode(), "big") for x in _OTHERS if len(x.encode()) == size]) for size in (2, 3)}


def words(text: Column) -> Column:
    """Split at blanks, into which other spaces are turned first: a pattern of all spaces takes over half as long again."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _OTHERS, " " * len(_OTHERS)), " ", -1), "")


def _found(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a column of UTF-8 texts, some `size` bytes of texts at a time: bytes, which of them are white space (that of `words`),
    and where each text begins (and the last one ends)."""
    texts = texts.fill_null(b"")
    try:
        texts = texts.cast(pa.large_string())
    except pa.ArrowInvalid:  # not UTF-8
        texts = pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        raw = every[at[i] : at[j]]
        yield raw, _spaces(raw), at[i : j + 1] - at[i]
        i = j


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    space = (raw == 32) | (raw - np.uint8(9) < 5) | (raw - np.uint8(28) < 4)
    if len(raw) and raw.max() > 127:
        k = np.flatnonzero(raw[:-1] == 0xC2)
        k = k[np.isin(raw[k + 1], _WIDE[2] & 0xFF)]
        space[k] = space[k + 1] = True
        k = np.flatnonzero(raw[:-2] - np.uint8(0xE1) < 3)
        k = k[np.isin(raw[k] * np.int64(65536) + raw[k + 1] * np.int64(256) + raw[k + 2], _WIDE[3])]
        space[k] = space[k + 1] = space[k + 2] = True
    return space


def _begins(space: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and how many of them before each text."""
    first = ~space
    first[1:] &= space[:-1]
    edges_ = edges[edges < len(space)]
    first[edges_] = ~space[edges_]  # the words of two texts may touch
    begins = np.flatnonzero(first)
    return begins, np.searchsorted(begins, edges)


def word_counts(text: Column) -> Column:
    """F.size(words(text)), where the words themselves are not wanted: translating every character in the JVM takes several times as long."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(_begins(space, edges)[1]) for _, space, edges in _found(texts))]), pa.int64())

    return F.arrow_udf(count, "long")(text.cast("binary"))


def piece_hashes(text: Column, off: Column, context: int) -> Column:
    """seq and hash of each piece of a text whose first word is word `off` of its shard: SHA-256 of the piece's words, joined by blanks."""

    def encode(texts: pa.Array, offs: pa.Array) -> pa.Array:
        at, done = np.asarray(offs, np.int64), 0
        sizes, seqs, digests = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], []
        for raw, space, edges in _found(texts):
            begins, upto = _begins(space, edges)
            ends = len(space) - _begins(space[::-1], len(space) - edges[::-1])[0][::-1]
            raw = np.where(space, np.uint8(32), raw)
            wide = np.concatenate([[0], np.cumsum(begins[1:] - ends[:-1] != 1)])  # gaps between words of more than a blank, up to each word
            n = np.diff(upto)
            off_ = at[done : done + len(n)]
            done += len(n)
            # A piece ends where a sequence does.
            k = np.where(n > 0, (off_ + n - 1) // context - off_ // context + 1, 0)
            row = np.repeat(np.arange(len(n)), k)
            seq = off_[row] // context + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            skip = upto[row] - off_[row]  # from words of the shard to words of these texts
            lo, hi = np.maximum(seq * context + skip, upto[row]), np.minimum((seq + 1) * context + skip, upto[row + 1])
            view = memoryview(raw)
            own = [view[i:j] for i, j in zip(begins[lo].tolist(), ends[hi - 1].tolist())]
            for i in np.flatnonzero(wide[hi - 1] > wide[lo]):
                own[i] = b" ".join(own[i].tobytes().split())
            digests += [hashlib.sha256(x).digest() for x in own]
            sizes.append(k)
            seqs.append(seq)
        pieces = pa.StructArray.from_arrays([pa.array(np.concatenate(seqs)), pa.array(digests, pa.binary())], ["seq", "hash"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pieces)

    return F.arrow_udf(encode, "array<struct<seq: bigint, hash: binary>>")(text.cast("binary"), off)


def token_ids(words_: Column, vocab: int) -> Column:
    """The ids of an array of words. Each word is hashed once: the fold below reads its digest five times."""
    return F.transform(F.transform(words_, lambda x: F.sha2(x, 256)), lambda d: folded(d, vocab))


def token_ids_of(vocab: int) -> Callable[[str], Column]:
    """The same as ints for whole columns of long texts: an Arrow batch's distinct words are hashed once each, not every word."""

    def encode(words_: pa.Array) -> pa.Array:
        sizes = np.asarray(words_.value_lengths().fill_null(0), np.int64)
        flat = words_.flatten().dictionary_encode()
        ids = np.array([int(hashlib.sha256(x.encode()).hexdigest(), 16) % (vocab - 1) + 1 for x in flat.dictionary.to_pylist()], np.int32)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(ids[flat.indices.to_numpy()] if len(flat) else ids, pa.int32()))

    return F.arrow_udf(encode, "array<int>")


def token_id(word: Column, vocab: int) -> Column:
    """int(sha256(word)) mod (vocab - 1) + 1."""
    return token_ids(F.array(word), vocab)[0]


def folded(digest: Column, vocab: int) -> Column:
    """int(digest) mod (vocab - 1) + 1, over 15 hex digits at a time."""
    m = vocab - 1
    acc: Column = F.lit(0).cast("long")
    for at in range(0, 64, 15):
        size = min(15, 64 - at)
        chunk = F.conv(F.substring(digest, at + 1, size), 16, 10).cast("long")
        acc = (acc * F.lit(pow(16, size, m)) + chunk % m) % m
    return acc + 1


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as text, separated by '|'."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def decoded(ids: Column) -> Column:
    """Token ids as `<id>`, joined by a blank: hashing cannot be undone."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), " ")


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and the separators ', ' and ': '; texts are quoted as JSON quotes them, all else is as it prints."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_of_map(entries: Column) -> Column:
    """The same for a map of texts to numbers."""
    keys = F.sort_array(F.map_keys(entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('": '), F.element_at(entries, k).cast("string"))), ", "), F.lit("}"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and key, the same wherever it is computed."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sorted_join(items: Column, field: str, sep: str = ",") -> Column:
    """Texts of structs sorted by their leading fields, joined."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x[field]), sep)
