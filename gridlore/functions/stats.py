"""Statistics as column expressions and small aggregations.

Not-a-number is turned to null first, as it is a value in Spark; every ratio guards its divisor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null instead of not-a-number and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def average_rank(value: Column, by: list, descending: bool = False) -> Column:
    """Rank with ties at their mean; null for null."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), rank + (ties - 1) / F.lit(2.0))


def truncated_rank(value: Column, by: list, descending: bool = False) -> Column:
    """Average rank cut to a whole number (2.5 becomes 2)."""
    return F.floor(average_rank(value, by, descending)).cast("int")


def ranked(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the average rank among all rows.  Only distinct values are ordered in one place, after they have been counted."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(F.col(value).alias("_v"), (before + 1 + (F.col("_n") - 1) / 2).alias(out))
    return rows.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r over a group's finite pairs; null for fewer than three or for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n, sa, sb = F.count(a), F.sum(a), F.sum(b)
    va, vb = n * F.sum(a * a) - sa * sa, n * F.sum(b * b) - sb * sb
    varies = (n >= 3) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, (n * F.sum(a * b) - sa * sb) / F.when(varies, F.sqrt(va) * F.sqrt(vb)))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: rho, the correlation of average ranks, over rows where both are present."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*by, average_rank(F.col(x), by).alias("_rx"), average_rank(F.col(y), by).alias("_ry"))
    return ranked.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def spearman_by_differences(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)); differs from rho under ties."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*by, (average_rank(F.col(x), by) - average_rank(F.col(y), by)).alias("_d"))
    n = F.count("*").cast("double")
    return ranked.groupBy(*by).agg(F.when(n >= 3, 1 - 6 * F.sum(F.col("_d") * F.col("_d")) / (n * (n * n - 1))).alias("rho_d"))


def kendall(df: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """Per group: tau-b.  Pairs are made within a group, so groups are configurations, not raw rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key, x, y)
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    on = F.col(f"a.{key}") < F.col(f"b.{key}")
    for c in same:
        on = on & c
    dx, dy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    pairs = a.join(b, on).select(*(F.col(f"a.{c}") for c in by), dx.alias("dx"), dy.alias("dy"))
    nx, ny = F.sum(F.abs("dx")), F.sum(F.abs("dy"))
    return pairs.groupBy(*by).agg(F.when((nx > 0) & (ny > 0), F.sum(F.col("dx") * F.col("dy")) / F.when((nx > 0) & (ny > 0), F.sqrt(nx * ny))).alias("tau"))


def rank_errors(df: DataFrame, by: list[str], rx: str, ry: str) -> DataFrame:
    """Mean absolute and root mean square rank error, and exact matches."""
    d = (F.col(rx) - F.col(ry)).cast("double")
    return df.groupBy(*by).agg(F.avg(F.abs(d)).alias("mare"), F.sqrt(F.avg(d * d)).alias("rmsre"), F.sum((F.col(rx) == F.col(ry)).cast("long")).alias("exact"))


def without_outliers(df: DataFrame, by: list[str], value: str, k: float = 3.0) -> DataFrame:
    """Drops values beyond k interquartile ranges, in groups of four and more that keep more than two."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    bounds = df.groupBy(*by).agg(q.alias("_q"), F.count(value).alias("_n"))
    marked = df.join(bounds, by).withColumn("_w", k * (F.col("_q")[1] - F.col("_q")[0]))
    inside = F.col(value).between(F.col("_q")[0] - F.col("_w"), F.col("_q")[1] + F.col("_w"))
    kept = F.sum(inside.cast("int")).over(Window.partitionBy(*by))
    marked = marked.withColumn("_in", inside).withColumn("_kept", kept)
    return marked.filter(F.col("_in") | (F.col("_n") < 4) | (F.col("_kept") <= 2)).drop("_q", "_n", "_w", "_in", "_kept")


def mann_whitney(df: DataFrame, by: list[str], group: str, baseline, value: str) -> DataFrame:
    """U of each group against the baseline group and the rank-biserial r = 1 - 2U / (n1 n2)."""
    base = df.filter(F.col(group) == baseline).select(*by, F.col(value).alias("_v"), F.lit(1).alias("_base"))
    others = df.filter(F.col(group) != baseline).select(*by, group, F.col(value).alias("_v"))
    names = others.select(*by, group).distinct()
    pooled = others.withColumn("_base", F.lit(0)).unionByName((base.join(names, by) if by else base.join(F.broadcast(names))).select(*by, group, "_v", "_base"))
    ranked = pooled.withColumn("_r", average_rank(F.col("_v"), [*by, group]))
    n1, n2 = F.sum(1 - F.col("_base")), F.sum("_base")
    u = F.sum(F.when(F.col("_base") == 0, F.col("_r"))) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by, group).agg(u.alias("u"), (1 - 2 * u / (n1 * n2)).alias("r"))


def bootstrap_median(df: DataFrame, by: list[str], value: str, rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the median under resampling; a group is a configuration's repetitions."""
    schema = ", ".join([*(f"{c} {t}" for c, t in df.dtypes if c in by), "median double, low double, high double"])

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v = np.sort(pdf[value].dropna().to_numpy(float))
        out = {c: [pdf[c].iloc[0]] for c in by}
        if not len(v):
            return pd.DataFrame(out | {"median": [None], "low": [None], "high": [None]})
        rng, medians = np.random.default_rng(seed), []
        for lo in range(0, rounds, 500):
            medians.append(np.median(v[rng.integers(len(v), size=(min(500, rounds - lo), len(v)))], axis=1))
        low, high = np.quantile(np.concatenate(medians), [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame(out | {"median": [float(np.median(v))], "low": [low], "high": [high]})

    return df.groupBy(*by).applyInPandas(resample, schema)


def t_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation, through the regularised incomplete beta function."""
    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([_student(x, m) for x, m in zip(rs, ns, strict=True)])

    return p(r.cast("double"), n.cast("double"))


def _student(r: float, n: float) -> float | None:
    if r is None or n is None or r != r or n != n or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, 1 - r * r)  # df / (df + t^2) is 1 - r^2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated from the front."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, value, up, down = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            m = k // 2
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            m = k // 2
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / ((1 + term * down) or tiny)
        up = (1 + term / up) or tiny
        change = up * down
        value *= change
        if k and abs(change - 1) < 1e-14:
            break
    return front * (value - 1)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
