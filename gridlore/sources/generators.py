"""Reproducible inputs: 64-bit generators as vectorised functions, ramps and index distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def xorshift64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(7))
    return x ^ (x << np.uint64(17))


def hashed(column: Column, kind: str = "splitmix64") -> Column:
    """The generator's output for each counter, as a signed 64-bit number."""
    step = {"splitmix64": splitmix64, "xorshift64": xorshift64}[kind]

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(step(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return run(column)


def unit_interval(h: Column) -> Column:
    """The upper 53 bits of a 64-bit number as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def ramp(i: Column, period: int = 997, step: float = 0.001) -> Column:
    return (i % period) * F.lit(step)


def targets(spark: SparkSession, n: int, kind: str, sigma: float = 1.0, seed: int = 42) -> DataFrame:
    """(je, target): sequential, uniform, or normally spread around the own index, wrapped into 0..n-1."""
    je = spark.range(n).withColumnRenamed("id", "je")
    if kind == "sequential":
        target = F.col("je")
    elif kind == "uniform":
        target = F.floor(F.rand(seed) * n)
    elif kind == "normal":
        target = F.pmod(F.col("je") + F.rint(F.randn(seed) * sigma).cast("long"), F.lit(n))
    else:
        raise ValueError(f"no distribution {kind}")
    return je.withColumn("target", target.cast("long"))
