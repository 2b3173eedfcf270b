"""Cost models, closed-form strided metrics and co-access.  ``lineitem`` is the trace (slices of orders, an order is
a step, the return flag is the array, eight parts are a block) and the membership relation (supplier, month)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import layout as L
from gridlore.operators import coaccess as G
from gridlore.operators import cost, lookup, strided
from gridlore.plans.arrays import GRID, closed_grid, table
from gridlore.plans.experiments import rounded
from gridlore.plans.registry import register as _register


def register(name: str, sql: str | None = None):
    """As in the registry; ``array`` is a reserved word of the other dialect."""
    return _register(name, re.sub(r"\barray\b", '"array"', sql) if sql else None)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(L.div(F.col("l_orderkey"), 1000).alias("slice"), F.col("l_orderkey").alias("step"), F.col("l_returnflag").alias("array"), L.div(F.col("l_partkey"), 8).alias("block"))


def _trace_sql(array: str, alpha: float, beta: int, gamma: float) -> str:
    return f"""tr AS (SELECT DISTINCT l_orderkey // 1000 AS slice, l_orderkey AS step, {array} AS arr, l_partkey // 8 AS b FROM lineitem),
    st AS (SELECT slice, step, row_number() OVER (PARTITION BY slice ORDER BY step) AS t FROM (SELECT DISTINCT slice, step FROM tr)),
    c AS (SELECT tr.slice, t, arr, b FROM tr JOIN st USING (slice, step)),
    d AS (SELECT c.slice, c.t, c.arr, c.b, min(abs(c.b - p.b)) AS near, max(abs(c.b - p.b)) AS far FROM c LEFT JOIN c p ON p.slice = c.slice AND p.t = c.t - 1 AND p.arr = c.arr GROUP BY ALL),
    f AS (SELECT slice, t, b, coalesce(near, 1) AS near, coalesce(far, 1) AS far, CASE WHEN b % 4 = 3 THEN {gamma} WHEN near < {beta} THEN {alpha} ELSE 1 END::DOUBLE AS w FROM d WHERE near IS NULL OR near > 0),
    s AS (SELECT slice, t, count(*) AS n, avg(near) AS near, avg(far) AS far, avg(w * near) AS numa, sum(w * near) AS sigma FROM f GROUP BY ALL),
    m AS (SELECT st.slice, count(*) AS steps, sum(coalesce(n, 0)) / count(*) AS mu, sum(coalesce(near, 0)) / count(*) AS delta, sum(coalesce(far, 0)) / count(*) AS delta_max, sum(coalesce(numa, 0)) / count(*) AS delta_numa, sum(coalesce(sigma, 0)) / count(*) AS sigma FROM st LEFT JOIN s USING (slice, t) GROUP BY st.slice)"""


_PER_SLICE = "SELECT slice, steps, round(mu, 6) AS mu, round(delta, 6) AS delta, round(delta_max, 6) AS delta_max, round(delta_numa, 6) AS delta_numa, round(sigma, 6) AS sigma, round(mu * delta, 6) AS mu_delta FROM m"


@register("c1_c4_c8_metrics_per_slice", "WITH " + _trace_sql("l_returnflag", 0.012, 64, 1.8) + " " + _PER_SLICE)
def c1(spark, sf_dir):
    w = cost.Weights(0.012, 64, 1.8)
    return rounded(cost.metrics(trace(spark, sf_dir), F.col("b") % 4 != 3, w))


@register("c5_product_of_averages", "WITH " + _trace_sql("l_returnflag", 0.012, 64, 1.8) + " SELECT round(avg(mu), 6) AS mu, round(avg(delta), 6) AS delta, round(avg(delta_max), 6) AS delta_max, round(avg(delta_numa), 6) AS delta_numa, round(avg(mu * delta), 6) AS mu_delta, CAST(sum(steps) AS BIGINT) AS steps FROM m")
def c5(spark, sf_dir):
    return rounded(cost.averaged(cost.metrics(trace(spark, sf_dir), F.col("b") % 4 != 3, cost.Weights(0.012, 64, 1.8))))


@register("c7_metrics_per_array", "WITH " + _trace_sql("l_returnflag", 0.012, 64, 1.8) + ", a AS (SELECT c.arr AS array, c.slice, c.t, count(*) FILTER (WHERE d.near IS NULL OR d.near > 0) AS n FROM c JOIN d USING (slice, t, arr, b) GROUP BY ALL) SELECT array, round(sum(n) / (SELECT count(*) FROM st), 6) AS mu FROM a GROUP BY array")
def c7(spark, sf_dir):
    t = trace(spark, sf_dir)
    fresh = cost.steps(t).select("array", F.size(F.array_except("blocks", F.coalesce("before", F.array().cast("array<long>")))).alias("n"))
    total = t.agg(F.countDistinct("step").alias("steps"))  # one row
    return rounded(fresh.groupBy("array").agg(F.sum("n").alias("n")).join(F.broadcast(total)).select("array", (F.col("n") / F.col("steps")).alias("mu")))


@register("c10_c12_pooled_metrics", "WITH " + _trace_sql("'all'", 0.125, 4, 8.0) + " " + _PER_SLICE)
def c10(spark, sf_dir):
    return rounded(cost.metrics(trace(spark, sf_dir), F.col("b") % 4 != 3, cost.Weights(0.125, 4, 8.0), pooled=True))


@register(
    "c6_schedules",
    """WITH n AS (SELECT count(*) AS n FROM orders), it AS (SELECT o_orderkey AS je, jk, o_custkey // 8 AS block, n FROM orders, n, (SELECT unnest(range(7)) AS jk)),
    s AS (SELECT 'for' AS schedule, 'edges' AS inner_, least(jk // 2, 3) AS owner, CASE WHEN je // 4 < n // 4 THEN jk * (n // 4) + je // 4 END AS step, block FROM it
        UNION ALL SELECT 'for', 'levels', least(je // ((n + 3) // 4), 3), CASE WHEN jk < 4 THEN je END, block FROM it
        UNION ALL SELECT 'collapse2', 'edges', least((jk * n + je) // ((n * 7 + 3) // 4), 3), CASE WHEN je // 4 < n // 4 THEN jk * (n // 4) + je // 4 END, block FROM it),
    t AS (SELECT schedule, inner_, owner, step, count(DISTINCT block) AS blocks FROM s WHERE step IS NOT NULL GROUP BY ALL)
    SELECT schedule, inner_, CAST(owner AS BIGINT) AS owner, count(*) AS steps, CAST(sum(blocks) AS BIGINT) AS blocks FROM t GROUP BY ALL""",
)
def c6_schedules(spark, sf_dir):
    """What each owner's vector steps touch: loops over levels or edges shared out, or both collapsed."""
    o = table(spark, sf_dir, "orders")
    it = o.select(F.col("o_orderkey").alias("je"), L.div(F.col("o_custkey"), 8).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("jk"))
    out = None
    for schedule, inner in (("for", "edges"), ("for", "levels"), ("collapse2", "edges")):
        owner, step = cost.scheduled(F.col("je"), F.col("jk"), F.lit(o.count()), 7, schedule == "collapse2", inner == "edges", 4, 4)
        rows = it.select(F.lit(schedule).alias("schedule"), F.lit(inner).alias("inner_"), owner.cast("long").alias("owner"), step.alias("step"), "block").filter("step is not null")
        out = rows if out is None else out.unionByName(rows)
    steps = out.groupBy("schedule", "inner_", "owner", "step").agg(F.countDistinct("block").alias("blocks"))
    return steps.groupBy("schedule", "inner_", "owner").agg(F.count("*").alias("steps"), F.sum("blocks").alias("blocks"))


@register("c6_vector_schedule", "WITH p AS (SELECT l_orderkey // 1000 AS slice, l_partkey // 8 AS block, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey // 1000) AS n FROM lineitem) SELECT slice, pos // 16 AS step, count(DISTINCT block) AS blocks FROM p WHERE pos // 16 < n // 16 GROUP BY ALL")
def c6(spark, sf_dir):
    """Steps of sixteen accesses; the tail that fills no vector is left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("slice")
    t = table(spark, sf_dir, "lineitem").withColumn("slice", L.div(F.col("l_orderkey"), 1000))
    t = t.select("slice", L.div(F.col("l_partkey"), 8).alias("block"), (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    step = L.div(F.col("pos"), 16)
    return t.filter(step < L.div(F.col("n"), 16)).groupBy("slice", step.alias("step")).agg(F.countDistinct("block").alias("blocks"))


@register(
    "c9_calibration",
    "WITH l AS (SELECT user_id % 50 AS stride, avg(value) AS lat FROM events GROUP BY 1), s AS (SELECT max(lat) FILTER (WHERE stride = 0) AS stream, avg(lat) AS random FROM l) SELECT round(stream / random, 6) AS alpha, (SELECT min(stride) FROM l, s WHERE stride > 0 AND lat > 1.1 * stream) AS beta FROM s",
)
def c9(spark, sf_dir):
    """alpha from streaming against mean latency; beta is the first stride beyond 1.1 times the streaming latency."""
    lat = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("stride")).agg(F.avg("value").alias("lat"))
    s = lat.agg(F.max(F.when(F.col("stride") == 0, F.col("lat"))).alias("stream"), F.avg("lat").alias("random"))
    beta = F.min(F.when((F.col("stride") > 0) & (F.col("lat") > F.lit(1.1) * F.col("stream")), F.col("stride")))
    return lat.join(F.broadcast(s)).agg(F.round(F.max("stream") / F.max("random"), 6).alias("alpha"), beta.alias("beta"))  # s is one row


@register("c11_lines_per_load", "SELECT l_suppkey, count(*) AS loads, round(avg(lines), 6) AS lines_per_load FROM (SELECT l_suppkey, l_orderkey, count(DISTINCT l_partkey // 16) AS lines FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def c11(spark, sf_dir):
    loads = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.countDistinct(L.div(F.col("l_partkey"), 16)).alias("lines"))
    return loads.groupBy("l_suppkey").agg(F.count("*").alias("loads"), F.round(F.avg("lines"), 6).alias("lines_per_load"))


@register("c14_pairwise_distance", "WITH t AS (SELECT r // 8 AS i, r % 8 AS j FROM range(64) x(r)) SELECT round(avg(abs(a.i - b.i) * 2048 + abs(a.j - b.j)), 6) AS mean FROM t a, t b")
def c14(spark, sf_dir):
    t = spark.range(64).select(L.div(F.col("id"), 8).alias("i"), (F.col("id") % 8).alias("j"))
    o = t.withColumnsRenamed({"i": "k", "j": "l"})  # a tile of 64 elements, whatever the data
    return t.join(F.broadcast(o)).agg(F.round(F.avg(F.abs(F.col("i") - F.col("k")) * 2048 + F.abs(F.col("j") - F.col("l"))), 6).alias("mean"))


@register("c15_c16_lines_per_warp", "SELECT l_orderkey // 32 AS warp, count(DISTINCT l_partkey * 4 // 128) AS lines, CASE WHEN count(DISTINCT l_partkey * 4 // 128) > 4 THEN 10 ELSE 3 END AS cost FROM lineitem GROUP BY 1")
def c15(spark, sf_dir):
    warps = table(spark, sf_dir, "lineitem").groupBy(L.div(F.col("l_orderkey"), 32).alias("warp")).agg(F.countDistinct(L.div(F.col("l_partkey") * 4, 128)).alias("lines"))
    return warps.withColumn("cost", F.when(F.col("lines") > 4, 10).otherwise(3))


def strided_grid(spark: SparkSession) -> DataFrame:
    """Every kernel, layout pair and tile; unknown kernels give the worst value.  A fixed table."""
    rows = [(k, a, b, t) for k in range(5) for a in (0, 1) for b in (0, 1) for t in (4, 8, 16, 32, 64, 128)]
    return spark.createDataFrame(rows, "kernel int, a_layout int, b_layout int, tile int")


_LINE = "((2 * CASE WHEN a_layout = kernel THEN {u} ELSE {f} END + CASE WHEN b_layout = kernel THEN {u} ELSE {f} END) / 3.0)::DOUBLE"
_SG = "g AS (SELECT CAST(k AS INT) AS kernel, CAST(a AS INT) AS a_layout, CAST(b AS INT) AS b_layout, CAST(t AS INT) AS tile, CAST(t AS DOUBLE) AS t FROM range(5) x(k), range(2) y(a), range(2) z(b), (SELECT unnest([4, 8, 16, 32, 64, 128]) AS t))"
_REUSE = "(((t - 1) * 257 + (t * t - t) + CASE WHEN t < 8 THEN 2 ELSE 0 END) / (t * t))"


@register(
    "c13_strided_metrics",
    f"""WITH {_SG} SELECT kernel, a_layout, b_layout, tile,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=255)} WHEN kernel < 4 THEN {_REUSE} ELSE 4194304 END, 6) AS reuse,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=127.5)} WHEN kernel < 4 THEN {_REUSE} * (0.5 + 1 / t) ELSE 4194304 END, 6) AS efficiency,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=255)} WHEN kernel < 4 THEN {_REUSE} * greatest(1, floor(t * t / CASE WHEN t < 8 THEN 32768 / 24 ELSE 16384 / 24 END)) ELSE 4194304 END, 6) AS penalised,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=7, f=14336)} WHEN kernel < 4 THEN (t - 1) * 2049 ELSE 4194304 END, 6) AS span,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=2048)} WHEN kernel < 4 THEN (t * t - t + t * 2048) / ((t - 1) * (t - 1)) ELSE 4194304 END, 6) AS stride,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=0.125)} WHEN kernel = 2 THEN (2 * CASE a_layout WHEN 0 THEN t * (t - 1) + (t - 1) / 8 ELSE t * (t - 1) / 8 + t - 1 END + CASE b_layout WHEN 0 THEN t * (t - 1) + (t - 1) / 8 ELSE t * (t - 1) / 8 + t - 1 END) / 3 / (t * (t - 1) + t - 1) WHEN kernel = 3 THEN 1 ELSE 0.125 END, 6) AS line_use,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f="4 / 8189.0::DOUBLE")} WHEN kernel = 2 THEN ceil(t * t / 512) / ceil(((t - 1) * 2048 + t) / 512) WHEN kernel = 3 THEN 1 ELSE 1 / 2048.0::DOUBLE END, 6) AS page_use,
    round(CASE WHEN kernel < 2 THEN {_LINE.format(u=1, f=2048)} WHEN kernel < 4 THEN (t * t - t + t * 2048) / ((t - 1) * (t - 1)) * ceil(24 * t * t / 32768) ELSE 4194304 * ceil(24 * t * t / 32768) END, 6) AS locality FROM g""",
)
def c13(spark, sf_dir):
    wanted = [k for k in strided.METRICS if k != "closeness"]
    return strided_grid(spark).select("kernel", "a_layout", "b_layout", "tile", *(F.round(strided.METRICS[k](), 6).alias(k) for k in wanted))


@register(
    "c13_tile_closeness",
    f"""WITH {_SG}, m AS (SELECT *, CASE WHEN kernel IN (2, 3) THEN tile ELSE 1 END AS r, CASE WHEN kernel IN (2, 3) THEN tile ELSE 8 END AS c FROM g WHERE kernel < 4),
    l AS (SELECT kernel, a_layout, b_layout, tile, r, c, w, CASE WHEN (CASE WHEN kernel = 1 THEN 1 - lay ELSE lay END) = 0 THEN 2048 ELSE 1 END AS s0, CASE WHEN (CASE WHEN kernel = 1 THEN 1 - lay ELSE lay END) = 0 THEN 1 ELSE 2048 END AS s1 FROM (SELECT *, a_layout AS lay, 2 AS w FROM m UNION ALL SELECT *, b_layout, 1 FROM m)),
    e AS (SELECT kernel, a_layout, b_layout, tile, r, c, w, s0, s1, sum(2 * (r * c - d) * (d // c * s0 + d % c * s1) / (r * c * r * c)::DOUBLE) AS v FROM l, range(1024) x(d) WHERE r * c <= 1024 AND d < r * c GROUP BY kernel, a_layout, b_layout, tile, r, c, w, s0, s1
        UNION ALL SELECT kernel, a_layout, b_layout, tile, r, c, w, s0, s1, (r - 1) / 3::DOUBLE * s0 + (c - 1) / 3::DOUBLE * s1 FROM l WHERE r * c > 1024)
    SELECT kernel, a_layout, b_layout, tile, round(sum(w * v) / 3, 5) AS closeness FROM e GROUP BY kernel, a_layout, b_layout, tile""",
)
def c13_closeness(spark, sf_dir):
    return strided_grid(spark).filter("kernel < 4").select("kernel", "a_layout", "b_layout", "tile", F.round(strided.closeness(), 5).alias("closeness"))


@register("s14_parameter_grid", "SELECT CAST(b AS INT) AS block, CAST(t AS INT) AS tile, CAST(row_number() OVER (ORDER BY b, t) - 1 AS INT) % 4 AS part FROM (SELECT unnest([16, 32, 64, 128]) AS b), (SELECT unnest([2, 4, 8, 16, 32, 64]) AS t) WHERE b % t = 0 AND b / t <= 16")
def s14(spark, sf_dir):
    from pyspark.sql import Window

    # a sweep's parameters: two short fixed lists
    b = spark.createDataFrame([(x,) for x in (16, 32, 64, 128)], "block int")
    t = spark.createDataFrame([(x,) for x in (2, 4, 8, 16, 32, 64)], "tile int")
    valid = b.join(F.broadcast(t)).filter("block % tile = 0 and block / tile <= 16")
    return valid.withColumn("part", (F.row_number().over(Window.orderBy("block", "tile")) - 1) % 4)


REL = "rel AS (SELECT DISTINCT user_id AS array, CAST(minute(ts) AS INTEGER) AS nest, value > 50 AS indirect, event_type = 'purchase' AS writes FROM events)"
SETS = REL + ", r AS (SELECT DISTINCT array, nest FROM rel), sz AS (SELECT array, count(*) AS n FROM r GROUP BY array), co AS (SELECT a.array AS a, b.array AS b, count(*) AS shared FROM r a JOIN r b ON a.nest = b.nest AND a.array < b.array GROUP BY ALL)"


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are arrays, the minutes of their events nests."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("array"), F.minute("ts").alias("nest"), (F.col("value") > 50).alias("indirect"), (F.col("event_type") == "purchase").alias("writes")).distinct()


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are arrays, the months of their items nests: few enough, and like enough, to be bundled."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("array"), F.month("l_shipdate").alias("nest")).distinct()


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("nests", F.concat_ws(",", F.col("nests").cast("array<string>")))


@register("g1_nests_of_arrays", f"WITH {SETS} SELECT array, string_agg(CAST(nest AS VARCHAR), ',' ORDER BY nest) AS nests FROM r GROUP BY array")
def g1(spark, sf_dir):
    return _joined(G.nests_of(relation(spark, sf_dir)))


@register("g2_co_occurrence", f"WITH {SETS} SELECT a, b, shared FROM co")
def g2(spark, sf_dir):
    return G.co_occurrence(relation(spark, sf_dir))


@register("g3_g12_equivalence_classes", f"WITH {SETS}, k AS (SELECT array, string_agg(CAST(nest AS VARCHAR), ',' ORDER BY nest) AS nests FROM r GROUP BY array) SELECT nests, count(*) AS size, min(array) AS first FROM k GROUP BY nests")
def g3(spark, sf_dir):
    return _joined(G.equivalence_classes(relation(spark, sf_dir)))


@register("g4_jaccard", f"WITH {SETS} SELECT a, b, shared, round(shared / (x.n + y.n - shared), 9) AS j FROM co JOIN sz x ON a = x.array JOIN sz y ON b = y.array")
def g4(spark, sf_dir):
    return rounded(G.jaccard(relation(spark, sf_dir)), 9)


@register("g5_nest_jaccard", f"WITH {REL}, r AS (SELECT DISTINCT nest AS a, array AS k FROM rel), sz AS (SELECT a, count(*) AS n FROM r GROUP BY a), co AS (SELECT x.a, y.a AS b, count(*) AS shared FROM r x JOIN r y ON x.k = y.k AND x.a < y.a GROUP BY ALL) SELECT co.a, co.b, shared, round(shared / (x.n + y.n - shared), 9) AS j FROM co JOIN sz x ON co.a = x.a JOIN sz y ON co.b = y.a")
def g5(spark, sf_dir):
    flipped = relation(spark, sf_dir).select(F.col("nest").alias("array"), F.col("array").alias("nest"))
    return rounded(G.jaccard(flipped), 9)


@register("u3_member_set_algebra", f"WITH {SETS}, k AS (SELECT array, list(nest ORDER BY nest) AS s FROM r GROUP BY array) SELECT x.array, len(list_intersect(x.s, [1, 2, 3, 4])) AS both, len(list_distinct(x.s || [1, 2, 3, 4])) AS either, len(list_filter(x.s, lambda v: v > 4 OR v < 1)) AS rest FROM k x")
def u3(spark, sf_dir):
    s, few = F.col("nests"), F.array(*(F.lit(k) for k in (1, 2, 3, 4)))
    return G.nests_of(relation(spark, sf_dir)).select("array", F.size(F.array_intersect(s, few)).cast("long").alias("both"), F.size(F.array_union(s, few)).cast("long").alias("either"), F.size(F.array_except(s, few)).cast("long").alias("rest"))


@register("g6_greedy_bundles")
def g6(spark, sf_dir):
    return G.bundled(spark, months(spark, sf_dir), "greedy", 0.6)


@register("g7_constrained_bundles")
def g7(spark, sf_dir):
    return G.bundled(spark, months(spark, sf_dir), "constrained", 0.6)


@register("g9_strict_bundles")
def g9(spark, sf_dir):
    return G.bundled(spark, months(spark, sf_dir), "strict", 0.6)


@register(
    "g8_bundle_utilisation",
    f"WITH {SETS}, m AS (SELECT DISTINCT array, array % 7 AS bundle FROM r), n AS (SELECT bundle, count(*) AS n FROM m GROUP BY bundle), u AS (SELECT bundle, nest, count(*) AS u FROM m JOIN r USING (array) GROUP BY ALL), s AS (SELECT bundle, nest, u / n AS share, n FROM u JOIN n USING (bundle)) SELECT bundle, n, min(share) AS util, CASE WHEN min(share) < 1 THEN arg_min(nest, (share, nest)) END AS worst_nest FROM s GROUP BY ALL",
)
def g8(spark, sf_dir):
    rel = relation(spark, sf_dir)
    return G.utilisation(rel.select("array", (F.col("array") % 7).alias("bundle")), rel)


@register(
    "g10_access_classes",
    f"WITH {REL}, k AS (SELECT nest, bool_or(indirect AND nest > 6) AS u FROM rel GROUP BY nest), f AS (SELECT array, bool_or(indirect AND nest > 6) AS own, bool_or(u) AS u, bool_or(NOT u) AS s FROM rel JOIN k USING (nest) GROUP BY array) SELECT array, CASE WHEN own THEN 'bridge-U' WHEN u AND s THEN 'bridge-S' WHEN u THEN 'U-only' ELSE 'S-only' END AS class FROM f",
)
def g10(spark, sf_dir):
    return G.access_classes(relation(spark, sf_dir).withColumn("indirect", F.col("indirect") & (F.col("nest") > 6)))


@register("g11_producer_consumer", f"WITH {REL}, w AS (SELECT DISTINCT nest, array FROM rel WHERE writes), d AS (SELECT DISTINCT nest, array FROM rel WHERE NOT writes) SELECT w.nest AS producer, d.nest AS consumer, count(*) AS arrays FROM w JOIN d USING (array) WHERE w.nest <> d.nest GROUP BY ALL")
def g11(spark, sf_dir):
    return G.producer_edges(relation(spark, sf_dir))


@register("g14_dependency_edges", f"WITH {GRID} SELECT i, j, i AS from_i, j - 1 AS from_j FROM g0 WHERE j > 0 UNION ALL SELECT i, j, i - 1, j FROM g0 WHERE i > 0")
def g14(spark, sf_dir):
    before = F.explode(F.array(F.struct(F.col("i").alias("a"), (F.col("j") - 1).alias("b")), F.struct((F.col("i") - 1).alias("a"), F.col("j").alias("b"))))
    return closed_grid(spark).select("i", "j", before.alias("p")).select("i", "j", F.col("p.a").alias("from_i"), F.col("p.b").alias("from_j")).filter("from_i >= 0 and from_j >= 0")


@register("g15_intra_bundle_jaccard", f"WITH {SETS}, p AS (SELECT x.array % 7 AS bundle, coalesce(shared / (x.n + y.n - shared), 0) AS j FROM sz x JOIN sz y ON x.array % 7 = y.array % 7 AND x.array < y.array LEFT JOIN co ON a = x.array AND b = y.array) SELECT bundle, count(*) AS pairs, round(min(j), 9) AS lo, round(avg(j), 9) AS mean, round(max(j), 9) AS hi FROM p GROUP BY bundle")
def g15(spark, sf_dir):
    """Pairs that share nothing are 0: they are counted, not made."""
    rel = relation(spark, sf_dir)
    similar = G.similar_within(rel, F.col("array") % 7).withColumnRenamed("grp", "bundle")
    size = rel.select("array").distinct().groupBy((F.col("array") % 7).alias("bundle")).agg(F.count("*").alias("n"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    both = size.filter("n > 1").join(similar, "bundle", "left").withColumn("pairs", pairs)
    lo = F.when(F.coalesce("k", F.lit(0)) < F.col("pairs"), 0.0).otherwise(F.col("lo"))
    return both.select("bundle", "pairs", F.round(lo, 9).alias("lo"), F.round(F.coalesce("total", F.lit(0.0)) / F.col("pairs"), 9).alias("mean"), F.round(F.coalesce("hi", F.lit(0.0)), 9).alias("hi"))


@register("e2_strided_ranking")
def e2(spark, sf_dir):
    """Ranks every configuration by each metric and correlates the ranks with a made-up runtime."""
    from gridlore.functions import stats

    g = strided_grid(spark).filter("kernel <> 3").select("kernel", "a_layout", "b_layout", "tile", *(strided.METRICS[k]().alias(k) for k in strided.METRICS))
    g = g.withColumns({"time": F.col("stride") * 2 + F.col("reuse"), "set": F.lit("plain")})
    long = g.unpivot(["set", "kernel", "a_layout", "b_layout", "tile", "time"], list(strided.METRICS), "metric", "value")
    rho = stats.spearman(long, ["metric"], "time", "value")
    return lookup.best_per_group(rho, ["metric"], "rho", ["n"]).orderBy(F.desc("rho"), "metric")
