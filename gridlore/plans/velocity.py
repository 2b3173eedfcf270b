"""Velocity tendencies over a grid made of the tables: customers are edges, suppliers cells, nations vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.operators.velocity import tendencies
from gridlore.plans.arrays import table
from gridlore.plans.registry import register

LEVELS, FLAT = 8, 3


def by_level(f, levels: int = LEVELS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(levels)), f)


def near(n: Column, *places: Column) -> Column:
    return F.array(*(F.pmod(p, n).cast("long") for p in places))


def numbers(*values: float) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def grid(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    i, ne, nc = F.col("id"), F.lit(customer.count()), F.lit(supplier.count())
    edges = customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x")).select(
        "id",
        by_level(lambda k: F.col("x") + k * 0.1).alias("vn"), by_level(lambda k: 0.4 + k * 0.02).alias("weight"),
        by_level(lambda k: (k + i % 3) * 0.01).alias("ddxn"), by_level(lambda k: (k - i % 5) * 0.02).alias("ddxt"), by_level(lambda k: k + 100.0).alias("ddqz"),
        near(ne, *(i * 3 + m + 1 for m in range(4))).alias("quad"), numbers(-0.25, 0, 0.25, 0.5).alias("rbf"),
        near(nc, i, i + 1).alias("cell"), F.array((i % 4 + 1) * 0.001, F.lit(0.002)).alias("gradekin"), numbers(0.4, 0.6).alias("lin"),
        near(F.lit(25), i, i + 7).alias("vert"), numbers(1.5, -0.75, 0.25).alias("outer"),
        F.lit(0.01).alias("inv_dual"), F.lit(0.02).alias("inv_primal"), (1 - i % 2 * 2).cast("double").alias("orient"), (i % 10 * 0.0001).alias("f"),
    )
    cells = supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 5000).alias("x")).select(
        "id",
        by_level(lambda k: F.col("x") + k * 0.01, LEVELS + 1).alias("w"), by_level(lambda k: 0.45 + k * 0.01).alias("weight"),
        by_level(lambda k: k * 0.001).alias("d1"), by_level(lambda k: k * 0.002).alias("d2"),
        near(ne, *(i * 5 + m for m in range(3))).alias("edge"), numbers(0.2, 0.3, 0.5).alias("bln"),
    )
    verts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).select(
        "id",
        near(nc, *(i * 3 + m for m in range(6))).alias("cell"), numbers(*(0.15 + 0.01 * m for m in range(6))).alias("aw"),
        near(ne, *(i * 11 + m for m in range(6))).alias("edge"), numbers(*(0.1 * (m - 2) for m in range(6))).alias("rot"),
    )
    return edges, cells, verts


@register(
    "k13_velocity_tendencies",
    f"""WITH n AS (SELECT (SELECT count(*) FROM customer) AS ne, (SELECT count(*) FROM supplier) AS nc), lev AS (SELECT unnest(range(1, {LEVELS + 1})) AS jk),
    e AS (SELECT c_custkey AS id, jk, c_acctbal / 1000 + jk * 0.1 AS vn, 0.4 + jk * 0.02 AS wt, (jk + c_custkey % 3) * 0.01 AS dn, (jk - c_custkey % 5) * 0.02 AS dt, jk + 100.0 AS dq FROM customer, lev),
    vt AS (SELECT a.id, e.jk, sum(a.b * e.vn) AS vt FROM (SELECT c_custkey AS id, unnest(range(4)) AS m, unnest([-0.25, 0, 0.25, 0.5]) AS b FROM customer) a CROSS JOIN n JOIN e ON e.id = (a.id * 3 + a.m + 1) % ne GROUP BY ALL),
    x AS (SELECT e.*, vt, 0.5 * (vn * vn + vt * vt) AS kin, CASE WHEN jk = 1 THEN vn ELSE wt * vn + (1 - wt) * lag(vn) OVER w END AS vh, CASE WHEN jk = 1 THEN vt ELSE wt * vt + (1 - wt) * lag(vt) OVER w END AS th,
        CASE WHEN jk >= {FLAT} THEN vn * dn + vt * dt ELSE 0 END AS terr, 1.5 * vn - 0.75 * lag(vn) OVER w + 0.25 * lag(vn, 2) OVER w AS bottom FROM e JOIN vt USING (id, jk) WINDOW w AS (PARTITION BY id ORDER BY jk)),
    y AS (SELECT *, CASE WHEN jk = {LEVELS} THEN bottom ELSE lead(vh) OVER (PARTITION BY id ORDER BY jk) END AS vh1 FROM x),
    c AS (SELECT s_suppkey AS id, jk, s_acctbal / 5000 + jk * 0.01 AS w FROM supplier, (SELECT unnest(range(1, {LEVELS + 2})) AS jk)),
    wv AS (SELECT v.id, c.jk, sum((0.15 + 0.01 * m) * c.w) AS wv FROM (SELECT n_nationkey AS id, unnest(range(6)) AS m FROM nation) v CROSS JOIN n JOIN c ON c.id = (v.id * 3 + m) % nc GROUP BY ALL),
    ze AS (SELECT v.id, e.jk, sum(0.1 * (m - 2) * e.vn) AS z FROM (SELECT n_nationkey AS id, unnest(range(6)) AS m FROM nation) v CROSS JOIN n JOIN e ON e.id = (v.id * 11 + m) % ne GROUP BY ALL),
    g AS (SELECT y.*, y.vh * 0.01 * (c1.w - c2.w) + y.th * 0.02 * (1 - 2 * (y.id % 2)) * (v1.wv - v2.wv) AS vg, 0.5 * (z1.z + z2.z) AS spin FROM y CROSS JOIN n
        JOIN c c1 ON c1.id = y.id % nc AND c1.jk = y.jk JOIN c c2 ON c2.id = (y.id + 1) % nc AND c2.jk = y.jk JOIN wv v1 ON v1.id = y.id % 25 AND v1.jk = y.jk JOIN wv v2 ON v2.id = (y.id + 7) % 25 AND v2.jk = y.jk
        JOIN ze z1 ON z1.id = y.id % 25 AND z1.jk = y.jk JOIN ze z2 ON z2.id = (y.id + 7) % 25 AND z2.jk = y.jk),
    cm AS (SELECT s.id, g.jk, sum(b * kin) AS ekin, sum(b * terr) AS mc, sum(b * vg) AS carried FROM (SELECT s_suppkey AS id, unnest(range(3)) AS m, unnest([0.2, 0.3, 0.5]) AS b FROM supplier) s CROSS JOIN n JOIN g ON g.id = (s.id * 5 + m) % ne GROUP BY ALL),
    wc AS (SELECT c.id, c.jk, c.w, ekin, carried, CASE WHEN c.jk = {LEVELS + 1} THEN 0 WHEN c.jk > {FLAT} THEN c.w - ((0.45 + 0.01 * c.jk) * mc + (0.55 - 0.01 * c.jk) * lag(mc) OVER o) ELSE c.w END AS wcon FROM c LEFT JOIN cm ON cm.id = c.id AND cm.jk = c.jk WINDOW o AS (PARTITION BY c.id ORDER BY c.jk)),
    wf AS (SELECT *, 0.5 * (wcon + lead(wcon) OVER o) AS whole, lag(w) OVER o AS up, lead(w) OVER o AS down FROM wc WINDOW o AS (PARTITION BY id ORDER BY jk))
    SELECT 'edge' AS element, g.id, g.jk, round(-(kin * ((g.id % 4 + 1) * 0.001 - 0.002) + 0.002 * f2.ekin - (g.id % 4 + 1) * 0.001 * f1.ekin + vt * (g.id % 10 * 0.0001 + spin) + (0.4 * f1.whole + 0.6 * f2.whole) * (vh - vh1) / dq), 8) AS ddt
    FROM g CROSS JOIN n JOIN wf f1 ON f1.id = g.id % nc AND f1.jk = g.jk JOIN wf f2 ON f2.id = (g.id + 1) % nc AND f2.jk = g.jk
    UNION ALL SELECT 'cell', id, jk, CASE WHEN jk = 1 THEN 0 ELSE round(carried - wcon * (up * 0.001 * jk - down * 0.002 * jk + w * 0.001 * jk), 8) END FROM wf WHERE jk <= {LEVELS}""",
)
def k13(spark, sf_dir):
    edge, cell = tendencies(*grid(spark, sf_dir), FLAT)
    rows = [df.select(F.lit(name).alias("element"), "id", F.posexplode("ddt").alias("k", "v")) for name, df in (("edge", edge), ("cell", cell))]
    return rows[0].unionByName(rows[1]).select("element", "id", (F.col("k") + 1).cast("long").alias("jk"), (F.round("v", 8) + 0.0).alias("ddt"))
