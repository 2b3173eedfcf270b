"""Cost models over access traces.

A trace is (slice, step, array, block): what one step of a slice touches.  Steps are numbered inside their
slice; a step's new blocks are those that the step before lacks.  Slices are independent, so a trace of any
length is processed by many tasks, and nothing is ordered globally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Locality weights: gamma away from home, alpha within beta blocks, else 1."""

    alpha: float = 0.012
    beta: int = 1
    gamma: float = 1.8


def steps(trace: DataFrame, pooled: bool = False) -> DataFrame:
    """(slice, t, array, blocks, before): blocks of a step and of the step before, per array or pooled."""
    touched = trace.select("slice", "step", (F.lit("all") if pooled else F.col("array")).alias("array"), "block").distinct()
    sets = touched.groupBy("slice", "step", "array").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    numbered = trace.select("slice", "step").distinct().withColumn("t", F.row_number().over(Window.partitionBy("slice").orderBy("step")))
    now = sets.join(numbered, ["slice", "step"]).drop("step")
    before = now.select("slice", (F.col("t") + 1).alias("t"), "array", F.col("blocks").alias("before"))
    return now.join(before, ["slice", "t", "array"], "left")


def metrics(trace: DataFrame, home: Column | None = None, weights: Weights = Weights(), pooled: bool = False) -> DataFrame:  # noqa: B008  frozen
    """Per slice: steps, mu (mean number of new blocks), delta and delta_max (mean nearest and farthest distance
    of new blocks to the step before), delta_numa (weighted), sigma (weighted distances summed, then averaged)
    and mu_delta.  In the first step all blocks are new at distance 1; so are blocks without any before them in
    their array; steps without new blocks count 0.  ``home`` says of a block (column ``b``) whether it is local."""
    fresh = F.array_except("blocks", F.coalesce("before", F.array().cast("array<long>")))
    local = home if home is not None else F.lit(True)
    rows = steps(trace, pooled).select("slice", "t", "before", F.explode(fresh).alias("b"))
    gaps = F.transform("before", lambda p: F.abs(F.col("b") - p))
    known = F.col("before").isNotNull() & (F.size("before") > 0)
    near, far = F.when(known, F.array_min(gaps)).otherwise(1).cast("double"), F.when(known, F.array_max(gaps)).otherwise(1).cast("double")
    weight = F.when(~local, weights.gamma).when(known & (F.array_min(gaps) < weights.beta), weights.alpha).otherwise(1.0)
    per_step = rows.groupBy("slice", "t").agg(F.count("*").alias("n"), F.avg(near).alias("near"), F.avg(far).alias("far"), F.avg(weight * near).alias("numa"), F.sum(weight * near).alias("sigma"))
    total = trace.groupBy("slice").agg(F.countDistinct("step").alias("steps"))
    summed = per_step.groupBy("slice").agg(*(F.sum(c).alias(c) for c in ("n", "near", "far", "numa", "sigma")))
    mean = lambda c: F.col(c) / F.col("steps")
    return total.join(summed, "slice").select("slice", "steps", mean("n").alias("mu"), mean("near").alias("delta"), mean("far").alias("delta_max"), mean("numa").alias("delta_numa"), mean("sigma").alias("sigma"), (mean("n") * mean("near")).alias("mu_delta"))


def averaged(per_slice: DataFrame) -> DataFrame:
    """Products of averages, averaged over slices: not the product of the overall averages."""
    return per_slice.agg(*(F.avg(c).alias(c) for c in ("mu", "delta", "delta_max", "delta_numa", "mu_delta")), F.sum("steps").alias("steps"))


def vector_steps(pos: Column, width: int, length: int) -> Column:
    """Step of a position under vectors of ``width``; null in the tail that fills no vector."""
    step = F.floor(pos / width)
    return F.when(step < length // width, step)


def scheduled(je: Column, jk: Column, n: Column, levels: int, collapse: bool, edges_first: bool, width: int, parts: int) -> tuple[Column, Column]:
    """(owner, step) of an iteration of a nest over n edges and levels.

    The inner loop goes by vectors of ``width`` along edges or levels; step is null in a tail that fills no vector.  With
    ``collapse`` owners share out the whole iteration space, edges first, else the outer loop.
    """
    share = lambda x, total: F.least(F.floor(x / F.ceil(total / F.lit(parts))), F.lit(parts - 1))
    if edges_first:
        owner = share(jk * n + je, n * levels) if collapse else share(jk, F.lit(levels))
        vector, whole, outer = F.floor(je / width), F.floor(n / width), jk
    else:
        owner = share(jk * n + je, n * levels) if collapse else share(je, n)
        vector, whole, outer = F.floor(jk / width), F.lit(levels // width), je
    return owner, F.when(vector < whole, outer * whole + vector)
