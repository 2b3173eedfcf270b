"""Velocity tendencies on an unstructured grid of edges, cells and vertices.

An element is a row and its levels are an array, so that a neighbour is met by one join whatever the number of levels and
what happens along a column stays inside a row.  Sums over neighbours are weighted gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(x: Column, y: Column, f) -> Column:
    return F.zip_with(x, y, f)


def plus(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = _both(out, c, lambda a, b: a + b)
    return out


def times(x: Column, y: Column) -> Column:
    return _both(x, y, lambda a, b: a * b)


def scaled(x: Column, s: Column) -> Column:
    return F.transform(x, lambda v: v * s)


def below(x: Column) -> Column:
    """Each level's value of the level before it; the first one's own."""
    return F.transform(x, lambda v, k: F.get(x, F.greatest(k - 1, F.lit(0))))


def at_half_levels(x: Column, weight: Column) -> Column:
    """Weighted means of neighbouring levels; the first level's own value."""
    return _both(_both(x, weight, lambda a, w: a * w), _both(below(x), weight, lambda a, w: a * (1 - w)), lambda a, b: a + b)


def from_level(x: Column, first: int) -> Column:
    """Zero before the level numbered ``first`` (from 1)."""
    return F.transform(x, lambda v, k: F.when(k + 1 >= first, v).otherwise(0.0))


def neighbour_sums(rows: DataFrame, near: Column, source: DataFrame, wanted: dict[str, tuple[Column, str]]) -> DataFrame:
    """(id, outs): for each out the sum over the neighbours in the array ``near`` of weight times the source's field, level
    by level.  All fields travel in one join.  An element without any known neighbour is left out."""
    each = rows.select("id", F.posexplode(near).alias("_k", "_near"), *(w.alias(f"_w_{o}") for o, (w, _) in wanted.items()))
    met = each.join(source.select(F.col("id").alias("_near"), *(F.col(f).alias(f"_x_{o}") for o, (_, f) in wanted.items())), "_near")
    terms = met.select("id", "_k", *(scaled(F.col(f"_x_{o}"), F.get(f"_w_{o}", F.col("_k"))).alias(o) for o in wanted))
    one = terms.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_k", *wanted))).alias("_t"))  # a few neighbours
    total = lambda o: F.aggregate(F.slice("_t", 2, 64), F.get("_t", F.lit(0))[o], lambda a, t: plus(a, t[o]))
    return one.select("id", *(total(o).alias(o) for o in wanted))


def tendencies(edges: DataFrame, cells: DataFrame, verts: DataFrame, flat: int) -> tuple[DataFrame, DataFrame]:
    """(id, ddt) of edges and of cells: the advective tendencies of normal and of vertical wind.

    edges: id; arrays by level vn, weight, ddxn, ddxt, ddqz; arrays by neighbour quad and rbf (4), cell, gradekin, lin (2)
    and vert (2), outer (3); numbers inv_dual, inv_primal, orient, f.  cells: id; w (a level more than the others), weight,
    d1, d2; edge, bln (3).  verts: id; cell, aw, edge, rot.  Terrain counts from the level ``flat`` on.  Of cells the first
    level's tendency is zero.
    """
    c = F.col
    e = edges.join(neighbour_sums(edges, c("quad"), edges, {"vt": (c("rbf"), "vn")}), "id")
    last = lambda k: F.element_at("vn", -k) * F.get("outer", F.lit(k - 1))
    inside = at_half_levels(c("vn"), c("weight"))
    e = e.withColumns({
        "kin": _both(c("vn"), c("vt"), lambda a, b: 0.5 * (a * a + b * b)),
        "vn_half": F.concat(inside, F.array(last(1) + last(2) + last(3))),
        "vt_half": at_half_levels(c("vt"), c("weight")),
        "terrain": from_level(plus(times(c("vn"), c("ddxn")), times(c("vt"), c("ddxt"))), flat),
    })
    v = neighbour_sums(verts, c("cell"), cells, {"wv": (c("aw"), "w")}).join(neighbour_sums(verts, c("edge"), edges, {"zeta": (c("rot"), "vn")}), "id")

    # wind along the gradient of w at edges
    one = lambda a, b: F.array(F.lit(a), F.lit(b))
    at_cells = neighbour_sums(e, c("cell"), cells, {"dw": (one(1.0, -1.0), "w")})
    at_verts = neighbour_sums(e, c("vert"), v, {"dwv": (one(1.0, -1.0), "wv"), "spin": (one(0.5, 0.5), "zeta")})
    e = e.join(at_cells, "id").join(at_verts, "id")
    levels = F.size("vn")
    along = plus(scaled(times(F.slice(c("vn_half"), F.lit(1), levels), F.slice(c("dw"), F.lit(1), levels)), c("inv_dual")), scaled(times(c("vt_half"), F.slice(c("dwv"), F.lit(1), levels)), c("inv_primal") * c("orient")))
    e = e.withColumn("v_grad_w", along)

    # kinetic energy and contravariant vertical wind at cells
    m = cells.join(neighbour_sums(cells, c("edge"), e, {"ekin": (c("bln"), "kin"), "slope": (c("bln"), "terrain"), "carried": (c("bln"), "v_grad_w")}), "id")
    m = m.withColumn("w_con", F.concat(_both(F.slice(c("w"), F.lit(1), F.size("ekin")), from_level(at_half_levels(c("slope"), c("weight")), flat + 1), lambda a, b: a - b), F.array(F.lit(0.0))))
    m = m.withColumn("w_con_full", F.transform("ekin", lambda x, k: 0.5 * (F.get("w_con", k) + F.get("w_con", k + 1))))

    def rise(x, k):
        d1, d2 = F.get("d1", k), F.get("d2", k)
        stencil = F.get("w", k - 1) * d1 - F.get("w", k + 1) * d2 + F.get("w", k) * (d2 - d1)
        return F.when(k > 0, x - F.get("w_con", k) * stencil).otherwise(0.0)

    g = lambda k: F.get("gradekin", F.lit(k))
    e = e.join(neighbour_sums(e, c("cell"), m, {"grad": (F.array(-g(0), g(1)), "ekin"), "lift": (c("lin"), "w_con_full")}), "id")

    def push(x, k):
        shear = (F.get("vn_half", k) - F.get("vn_half", k + 1)) / F.get("ddqz", k)
        return -(F.get("kin", k) * (g(0) - g(1)) + F.get("grad", k) + F.get("vt", k) * (c("f") + F.get("spin", k)) + F.get("lift", k) * shear)

    return e.select("id", F.transform("vn", push).alias("ddt")), m.select("id", F.transform("carried", rise).alias("ddt"))
