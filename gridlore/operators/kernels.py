"""Dense, sparse and neighbour kernels over matrices and fields in long form.

A matrix is (i, j, v).  Reductions are ordinary aggregations, so that Spark sums inside partitions first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_matrix(rows: DataFrame, key: str, values: str) -> DataFrame:
    return rows.select(F.col(key).alias("i"), F.posexplode(values).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("v"))


def both_products(matrix: DataFrame, x1: Column, x2: Column) -> DataFrame:
    """A x1 and A^T x2 in one scan; x1 is an expression of j, x2 of i.  (axis, k, y)."""
    terms = matrix.select("i", "j", (F.col("v") * x1).alias("a"), (F.col("v") * x2).alias("b"))
    sums = terms.groupingSets([[F.col("i")], [F.col("j")]], "i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.grouping("i").alias("g"))
    return sums.select(F.when(F.col("g") == 0, "row").otherwise("col").alias("axis"), F.coalesce("i", "j").alias("k"), F.when(F.col("g") == 0, F.col("a")).otherwise(F.col("b")).alias("y"))


def gram(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, v) of A^T B for row vectors a and b: each batch is one block product, blocks are added up.

    Only as many numbers leave a batch as the result has, however many rows go in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack([np.asarray(v, float) for v in batch.column(k).to_numpy(zero_copy_only=False)]) for k in (0, 1))
            total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    part = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, F.col(b).alias("_b")).mapInArrow(run, "i long, j long, v double")
    return part.groupBy("i", "j").agg(F.sum("v").alias("v"))


def rank_2k(rows: DataFrame, a: str, b: str, alpha: float = 1.5, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """Lower triangle of beta C + alpha (A^T B + B^T A)."""
    ab = gram(rows, a, b)
    swapped = ab.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    both = ab.unionByName(swapped).filter("j <= i").groupBy("i", "j").agg((F.sum("v") * alpha).alias("v"))
    if c is None or beta == 0:
        return both
    old = c.filter("j <= i").select("i", "j", (F.col("v") * beta).alias("v"))
    return both.unionByName(old).groupBy("i", "j").agg(F.sum("v").alias("v"))


def times_small(matrix: DataFrame, small: DataFrame) -> DataFrame:
    """C = A B by a join on the inner index; a small B is broadcast by Spark's own size check."""
    b = small.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    return matrix.withColumnRenamed("j", "k").join(b, "k").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("c", "j")


def blocks(matrix: DataFrame, high: int, wide: int) -> DataFrame:
    """(bi, bj, at, v): a matrix (i, j, v) in blocks of high x wide cells; ``at`` is a cell's place in its block, row by row."""
    i, j = F.col("i"), F.col("j")
    cell = F.struct((i % high * wide + j % wide).cast("int").alias("at"), F.col("v"))
    dealt = matrix.groupBy(F.floor(i / high).alias("bi"), F.floor(j / wide).alias("bj")).agg(F.collect_list(cell).alias("x"))
    return dealt.select("bi", "bj", F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def schedule(how: str, bi: Column, bj: Column, bk: Column, p: int, rows: int, inner: int) -> tuple[Column, Column]:
    """Who makes a block product, and when.

    ``summa``: a p x p grid owns C's blocks in turns and takes the inner blocks in order, as they are broadcast along rows
    and columns.  ``cannon``: the same owners, each of which starts at its own skewed inner block and shifts by one.
    ``static``: p owners of equal stripes of rows.  ``goto``: an inner panel of B is packed once and meets all blocks of A
    before the next one; owners share out A's blocks.
    """
    turn = (bi % p) * p + bj % p
    if how == "summa":
        return turn, bk
    if how == "cannon":
        return turn, F.pmod(bk - bi - bj, F.lit(inner))
    if how == "static":
        return F.least(F.floor(bi / -(-rows // p)), F.lit(p - 1)), bk
    if how == "goto":
        return bi % p, (bj * inner + bk) * rows + bi
    raise ValueError(f"no schedule {how}")


def block_product(a: DataFrame, b: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], how: str = "summa", p: int = 2) -> DataFrame:
    """C = A B as block products: (i, j, v).

    ``shape`` is (rows, inner, columns) of the product and ``size`` that of a block.  Blocks meet by an equi-join on the
    inner block; each owner adds up its products in the order of its schedule, and C's blocks of an owner are all that it
    holds.  Missing cells are zero; cells of C without any product are left out.
    """
    high, deep, wide = size
    rows, inner = -(-shape[0] // high), -(-shape[1] // deep)
    left = blocks(a, high, deep).select("bi", F.col("bj").alias("bk"), F.col("at").alias("a_at"), F.col("v").alias("a"))
    right = blocks(b, deep, wide).select(F.col("bi").alias("bk"), "bj", F.col("at").alias("b_at"), F.col("v").alias("b"))
    owner, step = schedule(how, F.col("bi"), F.col("bj"), F.col("bk"), p, rows, inner)
    met = left.join(right, "bk").withColumns({"owner": owner.cast("long"), "step": step.cast("long")})
    dealt = met.repartition("owner").sortWithinPartitions("owner", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def full(cells, values, m: int, n: int) -> np.ndarray:
            out = np.zeros(m * n)
            out[cells.values.to_numpy()] = values.values.to_numpy()
            return out.reshape(m, n)

        for batch in batches:
            bi, bj = (batch.column(c).to_pylist() for c in ("bi", "bj"))
            for k, key in enumerate(zip(bi, bj, strict=True)):
                x = full(batch.column("a_at")[k], batch.column("a")[k], high, deep)
                y = full(batch.column("b_at")[k], batch.column("b")[k], deep, wide)
                sums[key] = sums[key] + x @ y if key in sums else x @ y
        for (r, c), block in sums.items():
            i, j = np.indices(block.shape)
            i, j, v = i.ravel() + r * high, j.ravel() + c * wide, block.ravel()
            there = (i < shape[0]) & (j < shape[2])
            yield pa.RecordBatch.from_arrays([pa.array(i[there]), pa.array(j[there]), pa.array(v[there])], names=["i", "j", "v"])

    return dealt.select("bi", "bj", "a_at", "a", "b_at", "b").mapInArrow(run, "i long, j long, v double")


def narrow(values: Column, scale: float, kind: str = "int8") -> Column:
    """Numbers of a narrow type in an array: whole ones from -128 to 127 of the scaled value, or bfloat16 by cutting."""
    if kind == "int8":
        return F.transform(values, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(127)), F.lit(-128)).cast("tinyint"))
    if kind == "bf16":  # the upper half of a 32-bit float: eight bits of fraction are left, the last one cut
        size = lambda v: F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - 7)
        return F.transform(values, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v.cast("double")) * F.floor(F.abs(v.cast("double")) / size(v.cast("double"))) * size(v.cast("double"))))
    raise ValueError(f"no type {kind}")


def add_transposed(a: DataFrame, b: DataFrame) -> DataFrame:
    """A + B^T cell by cell."""
    return a.join(b.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") + F.col("w")).alias("v"))


def box_stencil(grid: DataFrame, offsets: list[tuple[int, int]], weight: float) -> DataFrame:
    """Sum of shifted copies times a weight, at cells that have all neighbours; shifts are explicit, sums are grouped."""
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))
    moved = grid.select("i", "j", "v", F.explode(shifts).alias("o")).select((F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), "v")
    return moved.groupBy("i", "j").agg((F.sum("v") * weight).alias("v"), F.count("*").alias("_n")).filter(F.col("_n") == len(offsets)).drop("_n")


FIVE = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
NINE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
SIXTEEN = [(a, b) for a in (-1, 0, 1, 2) for b in (-1, 0, 1, 2)]


def jacobi(grid: DataFrame, steps: int, weight: float = 0.2, cut=None) -> DataFrame:
    """Repeated five-point averaging with fixed borders.  ``cut`` writes a step's grid away to end its lineage."""
    for _ in range(steps):
        inner = box_stencil(grid, FIVE, weight).withColumnRenamed("v", "new")
        grid = grid.join(inner, ["i", "j"], "left").select("i", "j", F.coalesce("new", "v").alias("v"))
        if cut is not None:
            grid = cut(grid)
    return grid


def gathered(edges: DataFrame, fields: DataFrame, targets: list[str], level: str, values: list[str]) -> DataFrame:
    """Adds, for each target column, the target's field values: an equi-join per neighbour."""
    out = edges
    for t in targets:
        side = fields.select(F.col("id").alias(t), F.col(level), *(F.col(v).alias(f"{v}_{t}") for v in values))
        out = out.join(side, [t, level])
    return out


def weighted_gather(edges: DataFrame, fields: DataFrame, key: str, level: str, value: str) -> DataFrame:
    """Sum over an edge's neighbours of weight times field: edges are (key, target, weight)."""
    return edges.join(fields.withColumnRenamed("id", "target"), "target").groupBy(key, level).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def accelerations(bodies: DataFrame, soft: float) -> DataFrame:
    """Gravity of all bodies on each (id, m, x, y, z); all pairs are the operator's definition."""
    other = bodies.select(*(F.col(c).alias(f"o_{c}") for c in ("m", "x", "y", "z")))
    pairs = bodies.join(other)
    d = {c: F.col(c) - F.col(f"o_{c}") for c in "xyz"}
    inverse = 1 / F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] + soft)
    pull = {c: -F.col("o_m") * d[c] * inverse * inverse * inverse for c in "xyz"}
    return pairs.groupBy("id").agg(*(F.sum(pull[c]).alias(f"a{c}") for c in "xyz"))


def leapfrog(bodies: DataFrame, dt: float, soft: float) -> DataFrame:
    """One kick, drift, kick step of (id, m, x, y, z, vx, vy, vz)."""
    def kick(b: DataFrame) -> DataFrame:
        a = accelerations(b.select("id", "m", "x", "y", "z"), soft)
        return b.join(a, "id").select("id", "m", "x", "y", "z", *((F.col(f"v{c}") + F.col(f"a{c}") * (dt / 2)).alias(f"v{c}") for c in "xyz"))

    half = kick(bodies)
    moved = half.select("id", "m", *((F.col(c) + F.col(f"v{c}") * dt).alias(c) for c in "xyz"), "vx", "vy", "vz")
    return kick(moved)
