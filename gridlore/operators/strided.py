"""Closed-form locality metrics of strided and tiled matrix traversals (C = (A + B) * scale), as conditions
over kernel (0 rows, 1 columns, 2 tiled, 3 tiled with copies), layouts (0 row-major, 1 column-major) and tile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N, LINE, PAGE, CACHE = 2048, 8, 512, 32 * 1024


def _weighted(a: Column, b: Column) -> Column:
    """A is read and written, B only read."""
    return (2 * a + b) / 3.0


def _unit(layout: str, kernel: int) -> Column:
    """Whether the inner loop runs along the layout."""
    return F.col(layout) == kernel


def _by_kernel(rows: Column, columns: Column, tiled: Column, copied: Column, other: Column) -> Column:
    k = F.col("kernel")
    return F.when(k == 0, rows).when(k == 1, columns).when(k == 2, tiled).when(k == 3, copied).otherwise(other)


def _line(kernel: int, far: float) -> Column:
    cost = lambda layout: F.when(_unit(layout, kernel), 1.0).otherwise(far)
    return _weighted(cost("a_layout"), cost("b_layout"))


def tile_reuse() -> Column:
    t = F.col("tile").cast("double")
    jump = (N + LINE) // LINE
    extra = F.when(t < LINE, 2.0).otherwise(0.0)
    return ((t - 1) * jump + (t * t - t) + extra) / (t * t)


def reuse_distance() -> Column:
    far = N / 8 - 1
    return _by_kernel(_line(0, far), _line(1, far), tile_reuse(), tile_reuse(), F.lit(float(N * N)))


def memory_efficiency() -> Column:
    """A distance: smaller is better; prefetching halves far accesses."""
    far, tiled = (N / 8 - 1) * 0.5, tile_reuse() * (0.5 + 1.0 / F.col("tile"))
    return _by_kernel(_line(0, far), _line(1, far), tiled, tiled, F.lit(float(N * N)))


def reuse_with_penalty() -> Column:
    """Tiles beyond a third of the cache cost as many times more."""
    t = F.col("tile").cast("double")
    share = F.when(t < LINE, 32 * 1024 / 24).otherwise(16 * 1024 / 24)
    tiled = F.greatest(F.lit(1.0), F.floor(t * t / share).cast("double")) * tile_reuse()
    far = N / 8 - 1
    return _by_kernel(_line(0, far), _line(1, far), tiled, tiled, F.lit(float(N * N)))


def _small_closeness(rows: Column, columns: Column, s0: Column, s1: Column) -> Column:
    """Mean over all ordered pairs of a tile of the distance that their difference in traversal order spans.

    A difference d occurs 2 (n - d) times and spans (d div columns) s0 + (d % columns) s1.
    """
    n = rows * columns
    total = F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), F.lit(0.0), lambda a, d: a + 2.0 * (n - d) * (F.floor(d / columns) * s0 + d % columns * s1))
    return total / (n * n)


def closeness() -> Column:
    tiled, t = F.col("kernel").isin(2, 3), F.col("tile").cast("double")
    rows, columns = F.when(tiled, t).otherwise(1.0), F.when(tiled, t).otherwise(8.0)

    def of(layout: str) -> Column:
        flip = F.when(F.col("kernel") == 1, 1 - F.col(layout)).otherwise(F.col(layout)) == 0
        s0, s1 = F.when(flip, float(N)).otherwise(1.0), F.when(flip, 1.0).otherwise(float(N))
        large = (rows - 1) / 3.0 * s0 + (columns - 1) / 3.0 * s1
        return F.when(rows * columns > 1024, large).otherwise(_small_closeness(rows, columns, s0, s1))

    return F.when(F.col("kernel").isin(0, 1, 2, 3), _weighted(of("a_layout"), of("b_layout"))).otherwise(float(N * N))


def address_span() -> Column:
    tiled, t = F.col("kernel").isin(2, 3), F.col("tile").cast("double")
    run = lambda k: _weighted(*(F.when(F.col(x) == k, 7.0).otherwise(7.0 * N) for x in ("a_layout", "b_layout")))
    return F.when(tiled, (t - 1) * (N + 1)).when(F.col("kernel") == 0, run(0)).when(F.col("kernel") == 1, run(1)).otherwise(float(N * N))


def average_stride() -> Column:
    t = F.greatest(F.col("tile"), F.lit(2)).cast("double")
    tiled = (t * t - t + t * N) / ((t - 1) * (t - 1))
    return _by_kernel(_line(0, float(N)), _line(1, float(N)), tiled, tiled, F.lit(float(N * N)))


def line_utilisation() -> Column:
    t = F.col("tile").cast("double")
    inside, across = t * (t - 1), t - 1

    def of(layout: str) -> Column:
        good = F.when(F.col(layout) == 0, inside + across / LINE).otherwise(inside / LINE + across)
        return F.when(t > 1, F.try_divide(good, inside + across)).otherwise(1.0 / LINE)

    return _by_kernel(_line(0, 1.0 / LINE), _line(1, 1.0 / LINE), _weighted(of("a_layout"), of("b_layout")), F.lit(1.0), F.lit(1.0 / LINE))


def page_utilisation() -> Column:
    needed = -(-N // PAGE)
    far = needed / ((N - 1) * N // PAGE + 1)
    t = F.col("tile").cast("double")
    tiled = F.ceil(t * t / PAGE) / F.ceil(((t - 1) * N + t) / PAGE)
    return _by_kernel(_line(0, far), _line(1, far), tiled, F.lit(1.0), F.lit(1.0 / N))


def effective_locality() -> Column:
    t = F.col("tile").cast("double")
    sets = F.when(F.col("kernel").isin(0, 1), 1.0).otherwise(F.ceil(3 * t * t * 8 / CACHE).cast("double"))
    return average_stride() * sets


METRICS = {"reuse": reuse_distance, "efficiency": memory_efficiency, "penalised": reuse_with_penalty, "closeness": closeness, "span": address_span, "stride": average_stride, "line_use": line_utilisation, "page_use": page_utilisation, "locality": effective_locality}
