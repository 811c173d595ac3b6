"""Similar vectors through an inverted file: cells fitted on a bounded sample, every vector in one cell, queries join by cell.

A query visits each cell whose radius lets it hold a vector within the angle of the threshold (triangle inequality of angles), so no
pair is lost; with `probes` it visits only that many nearest cells, which loses some. Cells are dealt out in parts of about
`block` rows, and so are their queries: each pair of parts is one group of bounded size, multiplied as matrices, and only hits
leave it. Cells, their radii and counts are the only things that reach the driver: at most MAX_CELLS rows.

Vectors that are null, of length zero, hold nulls, or differ in size from the others have no direction and are left out; repeated rows count each.
"""

from __future__ import annotations

from math import acos, ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.sources.shared import materialised

#: About how many vectors the cells are fitted on, and how many cells there are at most.
SAMPLE, MAX_CELLS = 50_000, 4096
BLOCK = 2048
#: Slack for rounding of angles.
SLACK = 1e-6


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: vectors of length one."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.where("norm > 0 and norm < double('infinity')").select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    return rows


def fit_cells(rows: DataFrame, n: int) -> np.ndarray:
    """Directions of about sqrt(n) cells from at most about SAMPLE of the n vectors, taken by the hash of the id."""
    sample = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    model = KMeans(k=max(2, min(MAX_CELLS, ceil(sqrt(n)))), maxIter=10, seed=1, distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("features")))
    centers = np.array(model.clusterCenters())
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


class VectorIndex:
    """Vectors with the cell of each, written to the shared folder."""

    def __init__(self, vectors: DataFrame) -> None:
        rows = materialised(unit_vectors(vectors))
        size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.rows, self.cells = rows.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}).where("false"), pd.DataFrame({"cell": [], "n": [], "radius": []})
        if not size:
            return
        rows = rows.where(F.size("v") == size["d"])
        self.centers = centers = fit_cells(rows, size["count"]) if size["count"] > 1 else np.array([rows.first()["v"]])

        @F.pandas_udf("cell int, angle double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            likeness = np.stack(v.to_numpy()) @ centers.T if len(v) else np.zeros((0, 1))
            cell = likeness.argmax(axis=1)
            return pd.DataFrame({"cell": cell, "angle": np.arccos(np.clip(likeness[np.arange(len(v)), cell], -1, 1))})

        self.rows = materialised(rows.withColumn("x", nearest("v")).select("vec_id", "v", "x.cell", "x.angle"))
        self.cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").toPandas()  # MAX_CELLS rows at most

    def within(self, queries: DataFrame, least: float, probes: int | None = None, block: int = BLOCK) -> DataFrame:
        """query_id, vec_id, similarity (6 digits) over `least` of the queries (vec_id, v as of unit_vectors) and other vectors."""
        schema = "query_id long, vec_id long, similarity double"
        if not len(self.cells):
            return queries.sparkSession.createDataFrame([], schema)
        numbers = self.cells["cell"].to_numpy()
        centers, radius, reach = self.centers[numbers], self.cells["radius"].to_numpy(), acos(least) + SLACK

        @F.pandas_udf("array<int>")
        def visited(v: pd.Series) -> pd.Series:
            far = np.arccos(np.clip(np.stack(v.to_numpy()) @ centers.T, -1, 1)) if len(v) else np.zeros((0, 1))
            if probes:
                return pd.Series([numbers[np.argsort(x, kind="stable")[:probes]] for x in far])
            return pd.Series([numbers[x - radius <= reach] for x in far])

        asked = queries.where(F.size("v") == centers.shape[1]).select(F.col("vec_id").alias("query_id"), "v", F.explode(visited("v")).alias("cell"))
        asked = materialised(asked)
        counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("query_parts"))
        own = queries.sparkSession.createDataFrame([(int(c), max(1, ceil(n / block))) for c, n in zip(numbers, self.cells["n"], strict=True)], "cell int, parts int")
        parts = F.broadcast(counts.join(F.broadcast(own), "cell"))  # a row a cell
        group = lambda a, b: F.concat_ws(":", "cell", a, b)
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.join(parts, "cell").withColumn("p", mine("vec_id", "parts")).withColumn("q", all_("query_parts")).select(group("p", "q").alias("g"), "vec_id", "v")
        right = asked.join(parts, "cell").withColumn("q", mine("query_id", "query_parts")).withColumn("p", all_("parts")).select(group("p", "q").alias("g"), "query_id", "v")

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
            likeness = np.round(np.stack(b["v"].to_numpy()) @ np.stack(a["v"].to_numpy()).T, 6)
            q, v = np.nonzero(likeness > least)
            out = pd.DataFrame({"query_id": b["query_id"].to_numpy()[q], "vec_id": a["vec_id"].to_numpy()[v], "similarity": likeness[q, v]})
            return out[out["query_id"] != out["vec_id"]]

        return left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(compare, schema)


def similar_vectors(vectors: DataFrame, every: int = 100, least: float = 0.85) -> DataFrame:
    """Queries (ids divisible by `every`) against all vectors: query_id, vec_id, similarity over the threshold."""
    index = VectorIndex(vectors)
    return index.within(index.rows.where(F.col("vec_id") % every == 0).select("vec_id", "v"), least)
