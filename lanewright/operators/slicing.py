"""Long texts sliced at natural boundaries, and slices joined in order to windows of bounded length.

A text is a row of sentences in paragraphs (lines). It is cut into the fewest slices of at most `limit` words; among those cuts
the one with the least cost is taken: the end of a paragraph costs nothing, the end of a sentence 1. A sentence longer than the
limit is first cut into runs of `limit` words, the last with the rest; the end of such a run costs 2. Words are counted beside the
scan; only the numbers, a long for each sentence, go to Python, where the best cut takes time linear in them.

Slices are joined in order, none split, each to the open window if it fits there, else to the next. A shard is dealt to parts of
`PART` windows' worth of words by the running sum of words, so that no task orders a whole shard; windows end with their part.

Defined cases: null and blank texts have no slices and are in no window; of equally good cuts the one whose last slice is longest is
taken, then the last but one, and so on; repeated rows are sliced each; texts of one id are ordered by their digest; a null id
comes before all others; an empty table gives an empty result; columns that a frame has stay, but for the names that are added.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lanewright.functions.columns import SPACES, words
from lanewright.operators.ordered import prefix_sum
from lanewright.sources.shared import materialised

#: What parts paragraphs; what ends a sentence, with closing marks and the white space after; the sign put in place of that space.
PARAGRAPH = r"[\n\x{2029}]"
SENTENCE = r"([.!?\x{2026}][\"'\x{201D}\x{2019})\]]*)" + SPACES
MARK = "\x1e"
ENDS = ("paragraph", "sentence", "word")
#: Windows' worth of words in a part of a shard.
PART = 64


def atoms(text: Column, limit: int) -> Column:
    """What is never cut, in order: 4 * words + index in ENDS of where it ends, at most `limit` words each."""

    def of_sentences(ns: Column) -> Column:
        runs = lambda n, i: F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / limit).cast("int")),
            lambda k: F.least(F.lit(limit), n - k * limit).cast("long") * 4 + F.when((k + 1) * limit < n, 2).when(i + 1 < F.size(ns), 1).otherwise(0),
        )
        return F.flatten(F.transform(ns, runs))

    sentences = lambda p: F.split(F.regexp_replace(p, SENTENCE, f"$1{MARK}"), MARK)
    counts = lambda p: F.filter(F.transform(sentences(p), lambda s: F.size(words(s))), lambda n: n > 0)
    # An array of one element names the counts, so that they are computed once.
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: F.transform(F.array(counts(p)), of_sentences)[0]))


def best_cut(ns: list[int], costs: list[int], limit: int) -> list[list[int]]:
    """first word, words and end of each slice; ns are at most `limit` each."""
    total, best, came = [0], [(0, 0)], [0]
    open_: deque[int] = deque([0])  # places where the last slice may begin, from the best to the latest
    for n, cost in zip(ns, costs, strict=True):
        total.append(total[-1] + n)
        while total[-1] - total[open_[0]] > limit:
            open_.popleft()
        came.append(open_[0])
        slices, paid = best[open_[0]]
        best.append((slices + 1, paid + cost))
        while open_ and best[open_[-1]] > best[-1]:
            open_.pop()
        open_.append(len(best) - 1)
    out, at = [], len(ns)
    while at:
        out.append([total[came[at]], total[at] - total[came[at]], costs[at - 1]])
        at = came[at]
    return out[::-1]


def with_slices(docs: DataFrame, limit: int, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns `keep`, and __slices: first word, words and end (index in ENDS) of each slice. Kept columns pass through Python unread."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best_cut([x >> 2 for x in row], [x & 3 for x in row], limit) for row in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.list_(pa.int64())))], names=[*b.schema.names[:-1], "__slices"])

    rows = docs.select(*keep, atoms(F.col(text_col), limit).alias("__atoms"))
    return rows.mapInArrow(cut, StructType([*rows.schema.fields[:-1], StructField("__slices", ArrayType(ArrayType(LongType())))]))


def exploded(rows: DataFrame) -> DataFrame:
    """A row per slice: the columns before __slices, and piece, first, n, ends."""
    kept = [F.col(c) for c in rows.columns if c != "__slices"]
    each = rows.select(*kept, F.posexplode("__slices").alias("piece", "__s"))
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("__s")[2] + 1).cast("int"))
    return each.select(*kept, "piece", F.col("__s")[0].alias("first"), F.col("__s")[1].alias("n"), end.alias("ends"))


def slice_rows(docs: DataFrame, limit: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per slice: the columns `keep` (all unless given; without the text it stays in its scan), piece (from 0), first, n, ends."""
    return exploded(with_slices(docs, limit, text_col, [F.col(c) for c in (docs.columns if keep is None else keep)]))


def slice_text(text: Column, first: Column, n: Column) -> Column:
    """The words of a slice, joined by blanks."""
    return F.array_join(F.slice(words(text), (first + 1).cast("int"), n.cast("int")), " ")


def concatenated(docs: DataFrame, key: str, order: str, limit: int, text_col: str = "text") -> DataFrame:
    """A row per slice: key, order, piece, first, n, ends, part, win (from 0 in its part) and pos, the words before it in its window."""
    counted = with_slices(docs, limit, text_col, [F.col(key), F.col(order).cast("long").alias(order), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__tie")])
    counted = materialised(counted.where(F.size("__slices") > 0))  # numbers only, read three times
    counted = counted.withColumn("__words", F.aggregate("__slices", F.lit(0).cast("long"), lambda s, x: s + x[1]))
    placed = prefix_sum(counted, [key], order, "__words", "__off", ties="__tie").withColumn("part", F.floor(F.col("__off") / (PART * limit)))
    each = exploded(placed.select(key, order, "__off", "part", "__slices")).select(key, order, "piece", "first", "n", "ends", "part", "__off")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__off", "piece"], kind="stable")  # not more than PART windows' worth and one text
        win, fill, places = 0, 0, []
        for n in rows["n"].tolist():
            if fill + n > limit:
                win, fill = win + 1, 0
            places.append((win, fill))
            fill += n
        return rows.drop(columns="__off").assign(win=[w for w, _ in places], pos=[p for _, p in places])

    schema = ", ".join(f"`{n}` {t}" for n, t in each.drop("__off").dtypes)
    return each.groupBy(key, "part").applyInPandas(join, f"{schema}, win long, pos long")
