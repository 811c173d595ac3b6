"""Exact duplicates below the document: each unit (a line, a thread, whatever a separator bounds) stays where it occurs first.

A text is split into units in its scan; units meet by digest in one aggregate with partial minima, so a unit that stands in a
third of all texts is a few rows per task and not a group. The minimum names the place that keeps the unit, so nothing is joined
back to the units; places come together per text, and each text takes its kept units by their places, in order.

Defined cases: a null text has no units; blank units count for nothing and are left out; units are compared after spaces
around them are trimmed; of texts of one id the lesser digest comes first; repeated rows (same id and text) are one text and give
equal rows; a null id comes before all others; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_units(text: Column, separator: str = "\n") -> Column:
    """The units of a text in order; `separator` is a regular expression."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def first_occurrences(rows: DataFrame, id_col: str, text_col: str, separator: str = "\n") -> DataFrame:
    """All columns, and n_units long, n_kept long, kept_text string: the units that occur in no text before, line by line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    asked = rows.withColumns({"__id": F.col(id_col), "__text": F.md5(text)})
    each = asked.select("__id", "__text", F.posexplode(split_units(F.col(text_col), separator)).alias("__at", "unit"))
    first = each.groupBy(F.sha2("unit", 256).alias("key")).agg(F.min(F.struct("__id", "__text", "__at")).alias("first"))
    places = first.groupBy(F.col("first.__id").alias("__i"), F.col("first.__text").alias("__t")).agg(F.sort_array(F.collect_list("first.__at")).alias("__places"))
    out = asked.join(places, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left").withColumn("__units", split_units(F.col(text_col), separator))
    kept = F.array_join(F.transform("__places", lambda k: F.element_at("__units", k + 1)), "\n")
    out = out.withColumns({"n_units": F.size("__units").cast("long"), "n_kept": F.coalesce(F.size("__places"), F.lit(0)).cast("long"), "kept_text": F.coalesce(kept, F.lit(""))})
    return out.withColumn("n_kept", F.greatest("n_kept", F.lit(0).cast("long"))).drop("__id", "__text", "__i", "__t", "__places", "__units")
