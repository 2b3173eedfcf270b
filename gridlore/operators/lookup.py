"""Lookup joins as measurement analysis uses them.  Lookup tables are far smaller than the observations, but
their size isn't known here: Spark broadcasts them by its own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order; file order must be a column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def cascading_lookup(left: DataFrame, costs: DataFrame, full: list[str], reduced: list[str], values: list[str], order: list, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Looks ``values`` up by all keys, else by fewer keys, else null or a default; the first cost row counts."""
    exact = first_per_key(costs, full, order).select(*full, F.struct(*values).alias("_exact"))
    loose = first_per_key(costs, reduced, order).select(*reduced, F.struct(*values).alias("_loose"))
    hit = F.coalesce("_exact", "_loose")
    joined = left.join(exact, full, "left").join(loose, reduced, "left")
    fill = defaults or {}
    picked = [F.coalesce(hit[v], fill[v]).alias(v) if v in fill else hit[v].alias(v) for v in values]
    return joined.select(*(F.col(c) for c in left.columns), *picked)


def preferred_lookup(left: DataFrame, costs: DataFrame, keys: list[str], preferred: Column, values: list[str], order: list) -> DataFrame:
    """Inner lookup: of a key's cost rows a preferred one, else the first; rows without any are dropped."""
    best = first_per_key(costs.withColumn("_preferred", preferred.cast("int")), keys, [F.desc("_preferred"), *order])
    return left.join(best.select(*keys, *values), keys)


def single_match_lookup(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Inner lookup of keys that have exactly one row on the right."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(v).alias(v) for v in values)).filter("_n = 1").drop("_n")
    return left.join(single, keys)


def aligned(df: DataFrame, keys: list[str], label: str, labels: list, value: str) -> DataFrame:
    """One row per key with a column per source; null where a source lacks the key."""
    return df.groupBy(*keys).pivot(label, labels).agg(F.max(value))


def best_per_group(df: DataFrame, keys: list[str], value: str, tie: list, largest: bool = True) -> DataFrame:
    """The row of largest (smallest) value per group; ties by a total order."""
    return first_per_key(df, keys, [F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), *tie])


def mapped(column: Column, pairs: dict, keep: bool = True) -> Column:
    """A dictionary as a column: unknown values stay themselves, or become null."""
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    found = F.try_element_at(table, column)
    return F.coalesce(found, column) if keep else found


def edge_bytes(n: Column, levels: Column, full: int, half: int, flat: int, indices: int) -> Column:
    """Bytes that a kernel over n edges moves: reals at all levels, at half levels and without levels, and 32-bit indices."""
    return n * levels * (8 * full) + n * (levels + 1) * (8 * half) + n * (8 * flat + 4 * indices)
