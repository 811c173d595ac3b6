"""Curriculum stages and the mixture sampler.

The sampler is a walk of bounded length (one row a step) whose state is one counter per lane, so it is a recursive query.
Randomness comes from a hash of seed and step: any step can be recomputed alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.sources.shared import materialised
from lanewright.plans.params import FLOORS, STAGES, TRAIN_LANES, P


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, lo, hi) for k, (s, lo, hi, _) in enumerate(STAGES)], "idx int, stage string, lo int, hi int")


def stage_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, lane, w) for s, _, _, ws in STAGES for lane, w in zip(TRAIN_LANES, ws, strict=True)], "stage string, lane string, weight double")


def steps(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("step"))


def staged(df: DataFrame) -> DataFrame:
    """Adds the stage whose interval holds the step; past the last interval, the last stage (a join with 3 rows)."""
    known = F.broadcast(stages(df.sparkSession))
    last = STAGES[-1][0]
    return df.join(known, (F.col("step") >= F.col("lo")) & (F.col("step") < F.col("hi")), "left").withColumn("stage", F.coalesce("stage", F.lit(last))).drop("idx", "lo", "hi")


def sampler_sql(n: int = P.steps, seed: int = P.seed, spark: bool = True, done: int = 0, counts: tuple[int, ...] | None = None) -> str:
    """The walk as SQL: step, stage, lane, share of each lane among the draws before (null at the first). It goes on after `done` draws with their counts."""
    text, rec = ("STRING", "RECURSIVE") if spark else ("VARCHAR", "RECURSIVE")
    u = f"CAST(conv(substr(sha2(concat('{seed}:', CAST(step + 1 AS STRING)), 256), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D" if spark else f"CAST(CAST('0x' || substr(sha256('{seed}:' || CAST(step + 1 AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    number = "D" if spark else "::DOUBLE"
    k = range(len(TRAIN_LANES))

    def weight(j: int) -> str:
        return "CASE " + " ".join(f"WHEN step + 1 < {hi} THEN {ws[j]}{number}" for _, _, hi, ws in STAGES[:-1]) + f" ELSE {STAGES[-1][3][j]}{number} END"

    def boosted(j: int) -> str:
        floor = FLOORS.get(TRAIN_LANES[j])
        if floor is None:
            return f"w{j}"
        share, f = f"(CAST(c{j} AS DOUBLE) / (step + 1))", f"{floor}{number}"
        return f"CASE WHEN step + 1 > 0 AND {share} < {f} THEN greatest(w{j}, {f} + ({f} - {share})) ELSE w{j} END"

    counters = ", ".join(f"c{j}" for j in k)
    cumulative = [" + ".join(f"b{i}" for i in range(j + 1)) for j in k]
    pick = "CASE " + " ".join(f"WHEN u * ({cumulative[-1]}) < {cumulative[j]} THEN {j}" for j in k[:-1]) + f" ELSE {k[-1]} END"
    names = "CASE pick " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(TRAIN_LANES)) + " END"
    stage = "CASE " + " ".join(f"WHEN step < {hi} THEN '{s}'" for s, _, hi, _ in STAGES[:-1]) + f" ELSE '{STAGES[-1][0]}' END"
    before = ", ".join(f"CASE WHEN step > 0 THEN CAST(c{j} - CASE WHEN lane = '{x}' THEN 1 ELSE 0 END AS DOUBLE) / step END AS before_{x.lower()}" for j, x in enumerate(TRAIN_LANES))
    return f"""
WITH {rec} walk(step, lane, {counters}) AS (
  SELECT {done - 1}, CAST('' AS {text}), {", ".join(str(c) for c in counts or [0] * len(k))}
  UNION ALL
  SELECT step + 1, CAST({names} AS {text}), {", ".join(f"c{j} + CASE WHEN pick = {j} THEN 1 ELSE 0 END" for j in k)}
  FROM (SELECT step, {counters}, {pick} AS pick
        FROM (SELECT step, {counters}, u, {", ".join(f"{boosted(j)} AS b{j}" for j in k)}
              FROM (SELECT step, {counters}, {u} AS u, {", ".join(f"{weight(j)} AS w{j}" for j in k)} FROM walk WHERE step < {n - 1}) AS s1) AS s2) AS s3
)
SELECT step, {stage} AS stage, lane, {before} FROM walk WHERE step >= {done}"""


def sampled(spark: SparkSession, n: int = P.steps, state: dict[str, int] | None = None) -> DataFrame:
    """The draws up to step n: all, or those after a saved state (draws of each lane so far). The session's settings stay as they were."""
    counts = tuple((state or {}).get(lane, 0) for lane in TRAIN_LANES)
    name = "spark.sql.cteRecursionLevelLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(max(100, n + 2)))
    try:
        return materialised(spark.sql(sampler_sql(n, done=sum(counts), counts=counts)))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def states(drawn: DataFrame, steps_: DataFrame) -> DataFrame:
    """For each step of `steps_` the sampler's state after it: counts (a map of the lanes), total, stage_idx and rng_position.

    Randomness is a hash of seed and step, so the generator's state is its position.
    """
    each = steps_.select("step").join(drawn.select(F.col("step").alias("draw"), "lane"), F.col("draw") <= F.col("step"))  # draws are a bounded list
    counts = each.groupBy("step", "lane").agg(F.count("*").alias("n")).groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("lane", "n"))).alias("drawn"), F.sum("n").alias("total"))
    names = F.array(*map(F.lit, TRAIN_LANES))
    all_ = F.map_from_arrays(names, F.transform(names, lambda x: F.coalesce(F.element_at("drawn", x), F.lit(0).cast("long"))))
    staged_ = staged(counts).join(F.broadcast(stages(drawn.sparkSession).select("stage", F.col("idx").alias("stage_idx"))), "stage")
    return staged_.select("step", all_.alias("counts"), "total", "stage_idx", F.col("total").alias("rng_position"))


def clamped(weights: DataFrame, group: str, lane: str, weight: str, floor: str, out: str = "clamped", rounds: int = 8) -> DataFrame:
    """Hard floors by water-filling: lanes at their floor keep it, the others share the rest in proportion.

    A round fixes the lanes that fall below their floor; with k lanes at most k rounds change anything. Groups whose floors
    exceed one cannot be met; there every lane with a floor gets it and the others nothing. Lanes of a group are few.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    df = weights.withColumns({"__f": F.coalesce(floor, F.lit(0.0)), "__fixed": F.lit(False)})
    for _ in range(rounds):
        rest = F.greatest(F.lit(1.0) - F.sum(F.when(F.col("__fixed"), F.col("__f")).otherwise(0.0)).over(w), F.lit(0.0))
        free = F.sum(F.when(F.col("__fixed"), 0.0).otherwise(F.col(weight))).over(w)
        df = df.withColumn("__value", F.when(F.col("__fixed"), F.col("__f")).otherwise(F.when(free > 0, F.col(weight) * rest / free).otherwise(0.0)))
        df = df.withColumn("__fixed", F.col("__fixed") | (F.col("__value") < F.col("__f")))
    return df.withColumn(out, F.greatest("__value", "__f")).drop("__f", "__fixed", "__value")
