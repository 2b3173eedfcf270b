"""Experiment analytics over ``lineitem`` as observations: variant (return flag), dist (line status), schedule
(line number), bandwidth (price by quantity); its orders give the costs that runtimes are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import stats
from gridlore.operators import lookup
from gridlore.plans.registry import register

# The same relations for DuckDB.
OBS = """obs AS (SELECT l_returnflag AS variant, l_linestatus AS dist, l_linenumber AS schedule,
    l_extendedprice / (l_quantity * 1e-3) / 1e6 AS bw, l_extendedprice AS price, l_quantity AS qty, l_discount AS disc, l_orderkey AS ok FROM lineitem WHERE l_quantity > 0)"""
MED = OBS + ", med AS (SELECT variant, dist, schedule, median(bw) AS m, stddev_samp(bw) AS s, count(*) AS n FROM obs GROUP BY ALL)"
COST = """cost AS (SELECT l_returnflag AS variant, l_linestatus AS dist, l_linenumber AS schedule, avg(l_discount) * 10 AS mu, avg(l_tax) * 100 AS delta, min(l_orderkey) AS ord
    FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0")
    bw = F.col("l_extendedprice") / (F.col("l_quantity") * F.lit(1e-3)) / F.lit(1e6)
    return rows.select(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("dist"), F.col("l_linenumber").alias("schedule"), bw.alias("bw"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_orderkey").alias("ok"))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("variant", "dist", "schedule").agg(F.median("bw").alias("m"), F.stddev_samp("bw").alias("s"), F.count("*").alias("n"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber <= 5")
    keys = [F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("dist"), F.col("l_linenumber").alias("schedule")]
    return rows.groupBy(*keys).agg((F.avg("l_discount") * 10).alias("mu"), (F.avg("l_tax") * 100).alias("delta"), F.min("l_orderkey").alias("ord"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@register(
    "e1_best_schedule_rank",
    f"""WITH {MED}, best AS (SELECT *, row_number() OVER (PARTITION BY variant, dist ORDER BY m DESC, schedule) AS rn FROM med)
    SELECT variant, dist, schedule, round(m, 6) AS bw_median, round(s, 6) AS bw_std, n, CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS bw_rank FROM best WHERE rn = 1""",
)
def best_schedule_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lookup.best_per_group(medians(spark, sf_dir), ["variant", "dist"], "m", ["schedule"])
    # one row per (variant, dist) is left, so one task can rank them
    return best.select("variant", "dist", "schedule", F.round("m", 6).alias("bw_median"), F.round("s", 6).alias("bw_std"), "n", F.rank().over(Window.orderBy(F.desc("m"))).alias("bw_rank"))


@register("a1_median_std_count", f"WITH {MED} SELECT variant, dist, schedule, round(m, 6) AS m, round(s, 6) AS s, n FROM med")
def a1(spark, sf_dir):
    return rounded(medians(spark, sf_dir))


@register(
    "a2_two_measures",
    f"WITH {OBS} SELECT variant, schedule, round(median(bw), 6) AS bw_median, round(avg(bw), 6) AS bw_mean, min(bw) AS bw_min, max(bw) AS bw_max, round(stddev_samp(bw), 6) AS bw_std, count(*) AS n, round(median(price), 4) AS price_median, round(avg(price), 4) AS price_mean FROM obs GROUP BY ALL",
)
def a2(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("variant", "schedule").agg(
        F.round(F.median("bw"), 6).alias("bw_median"), F.round(F.avg("bw"), 6).alias("bw_mean"), F.min("bw").alias("bw_min"), F.max("bw").alias("bw_max"), F.round(F.stddev_samp("bw"), 6).alias("bw_std"), F.count("*").alias("n"), F.round(F.median("price"), 4).alias("price_median"), F.round(F.avg("price"), 4).alias("price_mean")
    )


@register(
    "a3_a16_percentile_spread",
    f"WITH {OBS} SELECT variant, round(quantile_cont(bw, 0.05), 6) AS p5, round(quantile_cont(bw, 0.1), 6) AS p10, round(quantile_cont(bw, 0.5), 6) AS p50, round(quantile_cont(bw, 0.9), 6) AS p90, round(quantile_cont(bw, 0.95), 6) AS p95, round(100 * (quantile_cont(bw, 0.95) - quantile_cont(bw, 0.05)) / quantile_cont(bw, 0.5), 4) AS spread_pct FROM obs GROUP BY variant",
)
def a3(spark, sf_dir):
    p = F.percentile("bw", F.array(*(F.lit(x) for x in (0.05, 0.1, 0.5, 0.9, 0.95)))).alias("p")
    got = observations(spark, sf_dir).groupBy("variant").agg(p)
    named = [F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p5", "p10", "p50", "p90", "p95"))]
    return got.select("variant", *named, F.round(100 * (F.col("p")[4] - F.col("p")[0]) / F.col("p")[2], 4).alias("spread_pct"))


@register(
    "a4_population_summary",
    f"WITH {OBS} SELECT variant, dist, round(median(bw), 6) AS med, round(stddev_pop(bw), 6) AS std, round(quantile_cont(bw, 0.05), 6) AS p5, round(quantile_cont(bw, 0.95), 6) AS p95, min(bw) AS lo, max(bw) AS hi, round(100 * median(bw) / 3.5, 4) AS pct_peak, min_by(schedule, (ok, schedule)) AS first_schedule FROM obs GROUP BY ALL",
)
def a4(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("variant", "dist").agg(
        F.round(F.median("bw"), 6).alias("med"), F.round(F.stddev_pop("bw"), 6).alias("std"), F.round(F.percentile("bw", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("bw", F.lit(0.95)), 6).alias("p95"), F.min("bw").alias("lo"), F.max("bw").alias("hi"), F.round(100 * F.median("bw") / 3.5, 4).alias("pct_peak"), F.min_by("schedule", F.struct("ok", "schedule")).alias("first_schedule")
    )


@register("a6_upper_median", f"WITH {OBS} SELECT variant, min(bw) AS best, max(bw) AS worst, round(avg(bw), 6) AS mean, list_sort(list(bw))[count(*) // 2 + 1] AS upper_median, round(stddev_pop(bw), 6) AS sd FROM obs GROUP BY variant")
def a6(spark, sf_dir):
    """The median as the upper of the two middle elements, by rank: no group's values are gathered."""
    w = Window.partitionBy("variant")
    rows = observations(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("bw"))).withColumn("n", F.count("*").over(w))
    upper = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("bw")))
    return rows.groupBy("variant").agg(F.min("bw").alias("best"), F.max("bw").alias("worst"), F.round(F.avg("bw"), 6).alias("mean"), upper.alias("upper_median"), F.round(F.stddev_pop("bw"), 6).alias("sd"))


@register("a8_checksum", "SELECT round(sum(l_extendedprice), 2) AS checksum, count(*) AS n FROM lineitem")
def a8(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.round(F.sum("l_extendedprice"), 2).alias("checksum"), F.count("*").alias("n"))


@register(
    "a10_a18_speedup_vs_best",
    f"WITH {MED}, best AS (SELECT variant, dist, max(m) AS m FROM med GROUP BY ALL) SELECT variant, dist, round(m, 6) AS m, round(m / max(m) OVER (PARTITION BY dist), 6) AS ratio FROM best",
)
def a10(spark, sf_dir):
    best = medians(spark, sf_dir).groupBy("variant", "dist").agg(F.max("m").alias("m"))
    return best.select("variant", "dist", F.round("m", 6).alias("m"), F.round(F.col("m") / F.max("m").over(Window.partitionBy("dist")), 6).alias("ratio"))


@register("a11_pivot_grid", f"WITH {MED} SELECT variant, " + ", ".join(f"round(max(m) FILTER (WHERE schedule = {k} AND dist = 'O'), 6) AS s{k}" for k in range(1, 8)) + " FROM med GROUP BY variant")
def a11(spark, sf_dir):
    rows = medians(spark, sf_dir).filter("dist = 'O'").select("variant", F.concat(F.lit("s"), "schedule").alias("s"), "m")
    every = medians(spark, sf_dir).select("variant").distinct()
    return every.join(rounded(lookup.aligned(rows, ["variant"], "s", [f"s{k}" for k in range(1, 8)], "m")), "variant", "left")


@register(
    "a12_worst_row_per_group",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def a12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return lookup.best_per_group(rows, ["o_orderpriority"], "o_totalprice", ["o_orderkey"], largest=False)


@register(
    "a13_nested_group_ranks",
    f"WITH {MED} SELECT variant, dist, schedule, CAST(rank() OVER (PARTITION BY variant, dist ORDER BY m DESC) AS INTEGER) AS r, round(m / first_value(m) OVER (PARTITION BY variant, dist ORDER BY schedule), 6) AS ratio FROM med",
)
def a13_w7(spark, sf_dir):
    w = Window.partitionBy("variant", "dist")
    return medians(spark, sf_dir).select("variant", "dist", "schedule", F.rank().over(w.orderBy(F.desc("m"))).alias("r"), F.round(F.col("m") / F.first("m").over(w.orderBy("schedule")), 6).alias("ratio"))


@register("a14_distinct_summary", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def a14(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_returnflag").alias("flags"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@register(
    "a15_counter_ratio_to_baseline",
    "WITH c AS (SELECT event_type, user_id % 5 AS p, sum(value) / count(*) AS per FROM events GROUP BY ALL) SELECT event_type, p, round(per, 6) AS per, round(per / first_value(per) OVER (PARTITION BY p ORDER BY event_type), 6) AS ratio FROM c",
)
def a15(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", (F.col("user_id") % 5).alias("p")).agg((F.sum("value") / F.count("*")).alias("per"))
    return c.select("event_type", "p", F.round("per", 6).alias("per"), F.round(F.col("per") / F.first("per").over(Window.partitionBy("p").orderBy("event_type")), 6).alias("ratio"))


@register(
    "a17_best_in_family",
    f"WITH {MED}, f AS (SELECT regexp_replace(variant || '_nf', '_nf$', '') || '/' || (schedule % 2) AS family, variant || schedule AS config, dist, m FROM med), r AS (SELECT *, row_number() OVER (PARTITION BY family, dist ORDER BY m DESC, config) AS rn FROM f) SELECT family, dist, config, round(m, 6) AS m FROM r WHERE rn = 1",
)
def a17(spark, sf_dir):
    family = F.concat(F.regexp_replace(F.concat("variant", F.lit("_nf")), "_nf$", ""), F.lit("/"), (F.col("schedule") % 2).cast("string"))
    rows = medians(spark, sf_dir).select(family.alias("family"), F.concat("variant", F.col("schedule").cast("string")).alias("config"), "dist", "m")
    return rounded(lookup.best_per_group(rows, ["family", "dist"], "m", ["config"])).select("family", "dist", "config", "m")


@register("a19_sorted_medians", f"WITH {MED}, c AS (SELECT variant || '/' || dist AS config, median(m) AS m FROM med GROUP BY ALL) SELECT config, round(m, 6) AS m, CAST(row_number() OVER (ORDER BY m DESC, config) AS INTEGER) AS place FROM c")
def a19_w4(spark, sf_dir):
    rows = medians(spark, sf_dir).groupBy(F.concat_ws("/", "variant", "dist").alias("config")).agg(F.median("m").alias("m"))
    return rows.select("config", F.round("m", 6).alias("m"), F.row_number().over(Window.orderBy(F.desc("m"), "config")).alias("place"))


@register(
    "p1_p3_p4_p5_projection",
    "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'aos' WHEN 'N' THEN 'soa' ELSE l_returnflag END AS layout, round((2 * l_quantity * 8 + 5 * l_quantity * l_linenumber * 8 + 3 * l_quantity * 8) / (l_extendedprice * 1e-3) / 1e12, 18) AS tbs FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 12 AND l_extendedprice > 0",
)
def p1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 12) & (F.col("l_extendedprice") > 0))
    q = F.col("l_quantity")
    moved = 2 * q * 8 + 5 * q * F.col("l_linenumber") * 8 + 3 * q * 8
    return rows.select("l_orderkey", "l_linenumber", lookup.mapped(F.col("l_returnflag"), {"A": "aos", "N": "soa"}).alias("layout"), F.round(moved / (F.col("l_extendedprice") * F.lit(1e-3)) / F.lit(1e12), 18).alias("tbs"))


@register("p11_second_byte_model", "SELECT l_orderkey, l_linenumber, round((n * lev * 56 + n * (lev + 1) * 8 + n * 56) / (l_extendedprice * 1e-3) / 1e12, 18) AS tbs FROM (SELECT *, l_quantity * 1024 AS n, l_linenumber AS lev FROM lineitem WHERE l_extendedprice > 0)")
def p11(spark, sf_dir):
    """Terabytes a second of an edge kernel: seven fields of all levels, one at half levels, five of reals and four of indices without levels."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_extendedprice > 0")
    n, levels = F.col("l_quantity") * 1024, F.col("l_linenumber")
    moved = lookup.edge_bytes(n, levels, full=7, half=1, flat=5, indices=4)
    return rows.select("l_orderkey", "l_linenumber", F.round(moved / (F.col("l_extendedprice") * F.lit(1e-3)) / F.lit(1e12), 18).alias("tbs"))


@register(
    "p2_p9_p12_optional_columns",
    "SELECT o_orderkey AS orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'",
)
def p2(spark, sf_dir):
    """Filters only by columns that exist; names are normalised and projected."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = rows.toDF(*(c.strip().lower().removeprefix("o_") for c in rows.columns))
    for column, wanted in {"orderstatus": "F", "nproma": 32, "blocking": 0}.items():
        if column in rows.columns:
            rows = rows.filter(F.col(column) == wanted)
    return rows.withColumnRenamed("orderstatus", "status").select("orderkey", "status")


@register(
    "p6_variant_classifier",
    "SELECT DISTINCT p_type || '_' || p_size AS variant, CASE WHEN p_type LIKE 'ECO%' THEN 'naive' WHEN p_type LIKE '%RD' THEN 'blocked' ELSE lower(p_type) END AS kind, CAST(regexp_extract(p_type || '_' || p_size, '_(\\d+)$', 1) AS INTEGER) AS tile FROM part",
)
def p6(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    variant = F.concat_ws("_", "p_type", "p_size")
    kind = F.when(F.col("p_type").startswith("ECO"), "naive").when(F.col("p_type").endswith("RD"), "blocked").otherwise(F.lower("p_type"))
    return rows.select(variant.alias("variant"), kind.alias("kind"), F.regexp_extract(variant, r"_(\d+)$", 1).cast("int").alias("tile")).distinct()


@register("p7_finite_pairs", "SELECT o_orderkey, o_totalprice / (o_custkey % 3) AS x FROM orders WHERE o_custkey % 3 <> 0")
def p7(spark, sf_dir):
    x = F.when(F.col("o_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("o_totalprice"), F.col("o_custkey") % 3))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", stats.finite(x).alias("x")).dropna(subset=["x"])


@register(
    "p8_iqr_filter",
    f"""WITH {OBS}, q AS (SELECT variant, dist, quantile_cont(bw, 0.25) AS a, quantile_cont(bw, 0.75) AS b, count(*) AS n FROM obs GROUP BY ALL),
    m AS (SELECT obs.*, n, bw BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) AS inside FROM obs JOIN q USING (variant, dist)),
    k AS (SELECT *, sum(inside::INT) OVER (PARTITION BY variant, dist) AS kept FROM m)
    SELECT variant, dist, count(*) AS n, round(avg(bw), 6) AS bw FROM k WHERE inside OR n < 4 OR kept <= 2 GROUP BY ALL""",
)
def p8(spark, sf_dir):
    rows = stats.without_outliers(observations(spark, sf_dir), ["variant", "dist"], "bw", 0.5)
    return rows.groupBy("variant", "dist").agg(F.count("*").alias("n"), F.round(F.avg("bw"), 6).alias("bw"))


@register(
    "p10_p13_mode_parameter",
    "WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_size) AS rn FROM c) SELECT p.p_type, r.p_size AS mode, count(*) AS n FROM part p JOIN r ON p.p_type = r.p_type AND p.p_size = r.p_size AND rn = 1 GROUP BY ALL",
)
def p10(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type", "p_size")
    counted = parts.groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    return lookup.best_per_group(counted, ["p_type"], "n", ["p_size"]).select("p_type", F.col("p_size").alias("mode"), "n")


JOINED = f"{MED}, {COST}"


@register("j1_inner_join", f"WITH {JOINED} SELECT variant, dist, schedule, round(m, 6) AS m, round(mu, 6) AS mu FROM med JOIN cost USING (variant, dist, schedule)")
def j1(spark, sf_dir):
    return rounded(medians(spark, sf_dir).join(costs(spark, sf_dir), ["variant", "dist", "schedule"]).select("variant", "dist", "schedule", "m", "mu"))


@register(
    "j2_j3_cascading_lookup",
    f"""WITH {JOINED}, loose AS (SELECT variant, dist, arg_min(mu, (ord, schedule)) AS mu, arg_min(delta, (ord, schedule)) AS delta FROM cost WHERE variant <> 'R' GROUP BY ALL),
    kept AS (SELECT * FROM cost WHERE variant <> 'R')
    SELECT med.variant, med.dist, med.schedule, round(coalesce(kept.mu, loose.mu), 6) AS mu, round(coalesce(kept.delta, loose.delta), 6) AS delta, round(coalesce(kept.mu, loose.mu) * coalesce(kept.delta, loose.delta), 6) AS sigma
    FROM med LEFT JOIN kept USING (variant, dist, schedule) LEFT JOIN loose ON med.variant = loose.variant AND med.dist = loose.dist""",
)
def j2(spark, sf_dir):
    known = costs(spark, sf_dir).filter("variant <> 'R'")
    got = lookup.cascading_lookup(medians(spark, sf_dir).select("variant", "dist", "schedule"), known, ["variant", "dist", "schedule"], ["variant", "dist"], ["mu", "delta"], ["ord", "schedule"])
    return rounded(got.withColumn("sigma", F.col("mu") * F.col("delta")))


@register(
    "j4_preferred_lookup",
    f"""WITH {JOINED}, best AS (SELECT *, row_number() OVER (PARTITION BY variant, dist ORDER BY (schedule = 3) DESC, ord, schedule) AS rn FROM cost WHERE variant <> 'N')
    SELECT med.variant, med.dist, med.schedule, round(best.mu, 6) AS mu FROM med JOIN best ON med.variant = best.variant AND med.dist = best.dist AND rn = 1""",
)
def j4(spark, sf_dir):
    known = costs(spark, sf_dir).filter("variant <> 'N'")
    left = medians(spark, sf_dir).select("variant", "dist", "schedule")
    return rounded(lookup.preferred_lookup(left, known, ["variant", "dist"], F.col("schedule") == 3, ["mu"], ["ord", "schedule"])).select("variant", "dist", "schedule", "mu")


@register(
    "j5_u4_aligned_sources",
    f"WITH {MED} SELECT variant, schedule, round(max(m) FILTER (WHERE dist = 'F'), 6) AS f, round(max(m) FILTER (WHERE dist = 'O'), 6) AS o FROM med GROUP BY ALL",
)
def j5(spark, sf_dir):
    return rounded(lookup.aligned(medians(spark, sf_dir).withColumn("dist", F.lower("dist")), ["variant", "schedule"], "dist", ["f", "o"], "m"))


@register(
    "j6_j13_single_match",
    "WITH one AS (SELECT c_custkey, any_value(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) = 1) SELECT c.c_custkey, one.o_orderkey FROM customer c JOIN one USING (c_custkey)",
)
def j6(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return lookup.single_match_lookup(customers, orders, ["c_custkey"], ["o_orderkey"])


@register("j7_first_match", f"WITH {JOINED}, f AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ord, dist, schedule) AS rn FROM cost) SELECT m.variant, m.dist, m.schedule, round(f.delta, 6) AS delta FROM med m JOIN f ON m.variant = f.variant AND rn = 1")
def j7(spark, sf_dir):
    first = lookup.first_per_key(costs(spark, sf_dir), ["variant"], ["ord", "dist", "schedule"]).select("variant", "delta")
    return rounded(medians(spark, sf_dir).select("variant", "dist", "schedule").join(first, "variant"))


@register("j11_u2_common_keys", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def j11(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("k"))
    return left.intersect(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k")))


@register("j12_dimension_lookup", "SELECT l.variant, l.dist, count(*) AS n, CASE (l.variant, l.dist) WHEN ('A', 'F') THEN 'AF' WHEN ('N', 'O') THEN 'NO' WHEN ('R', 'F') THEN 'RF' ELSE l.variant || l.dist END AS label FROM (SELECT l_returnflag AS variant, l_linestatus AS dist FROM lineitem) l GROUP BY ALL")
def j12(spark, sf_dir):
    obs = observations(spark, sf_dir)
    pairs = [(a, b, a + b) for a in "ANR" for b in "FO"]
    names = spark.createDataFrame(pairs, "variant string, dist string, label string")  # fixed: six rows
    return obs.groupBy("variant", "dist").agg(F.count("*").alias("n")).join(F.broadcast(names), ["variant", "dist"])


@register("u1_union_by_name", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u1(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


RANKED = f"""{MED}, r AS (SELECT variant, dist, schedule, m, s,
    rank() OVER (PARTITION BY variant, dist ORDER BY m) + (count(*) OVER (PARTITION BY variant, dist, m) - 1) / 2.0 AS rm,
    rank() OVER (PARTITION BY variant, dist ORDER BY s) + (count(*) OVER (PARTITION BY variant, dist, s) - 1) / 2.0 AS rs FROM med)"""


@register("w1_min_rank", f"WITH {MED} SELECT variant, dist, schedule, CAST(rank() OVER (PARTITION BY dist ORDER BY m) AS INTEGER) AS up, CAST(rank() OVER (PARTITION BY dist ORDER BY m DESC) AS INTEGER) AS down FROM med")
def w1(spark, sf_dir):
    w = Window.partitionBy("dist")
    return medians(spark, sf_dir).select("variant", "dist", "schedule", F.rank().over(w.orderBy("m")).alias("up"), F.rank().over(w.orderBy(F.desc("m"))).alias("down"))


@register("w3_truncated_average_rank", "SELECT p_partkey, CAST(floor(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) AS INTEGER) AS r FROM part")
def w3(spark, sf_dir):
    return stats.ranked(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", F.floor("r").cast("int").alias("r"))


@register(
    "w6_average_stride",
    "WITH d AS (SELECT l_suppkey, abs(l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice)) AS d FROM lineitem) SELECT l_suppkey, round(avg(d), 6) AS stride, count(d) AS n FROM d GROUP BY l_suppkey",
)
def w6(spark, sf_dir):
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.abs(F.col("l_partkey") - F.lag("l_partkey").over(w)).alias("d"))
    return rows.groupBy("l_suppkey").agg(F.round(F.avg("d"), 6).alias("stride"), F.count("d").alias("n"))


@register(
    "w8_running_median",
    "SELECT user_id, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events",
)
def w8(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.round(F.percentile("value", F.lit(0.5)).over(w), 6).alias("running"))


@register("o1_o2_sorted_nulls_last", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS INTEGER) AS place FROM customer")
def o1(spark, sf_dir):
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.row_number().over(Window.orderBy(v.desc_nulls_last(), "c_custkey")).alias("place"))


@register("o3_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o3(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register(
    "o4_topk_overlap",
    f"WITH {MED}, a AS (SELECT variant, dist, schedule FROM med ORDER BY m, variant, dist, schedule LIMIT 10), b AS (SELECT variant, dist, schedule FROM med ORDER BY s, variant, dist, schedule LIMIT 10) SELECT count(*) AS shared FROM a JOIN b USING (variant, dist, schedule)",
)
def o4(spark, sf_dir):
    keys = ["variant", "dist", "schedule"]
    med = medians(spark, sf_dir)
    return med.orderBy("m", *keys).limit(10).join(med.orderBy("s", *keys).limit(10), keys).agg(F.count("*").alias("shared"))


@register("o5_custom_ordinal", "SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END AS ordinal FROM orders ORDER BY ordinal, o_orderpriority")
def o5(spark, sf_dir):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(2)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", order.alias("ordinal")).distinct().orderBy("ordinal", "o_orderpriority")


@register("t1_spearman", f"WITH {RANKED} SELECT variant, dist, round(corr(rm, rs), 6) AS rho, count(*) AS n FROM r GROUP BY ALL")
def t1(spark, sf_dir):
    return rounded(stats.spearman(medians(spark, sf_dir), ["variant", "dist"], "m", "s"))


@register("t2_spearman_differences", f"WITH {RANKED} SELECT variant, dist, round(1 - 6 * sum((rm - rs) ** 2) / (count(*) * (count(*) ** 2 - 1)), 6) AS rho_d FROM r GROUP BY ALL")
def t2(spark, sf_dir):
    return rounded(stats.spearman_by_differences(medians(spark, sf_dir), ["variant", "dist"], "m", "s"))


@register(
    "t3_kendall",
    f"WITH {MED}, p AS (SELECT a.variant, a.dist, sign(a.m - b.m) AS x, sign(a.s - b.s) AS y FROM med a JOIN med b ON a.variant = b.variant AND a.dist = b.dist AND a.schedule < b.schedule) SELECT variant, dist, round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 6) AS tau FROM p GROUP BY ALL",
)
def t3(spark, sf_dir):
    return rounded(stats.kendall(medians(spark, sf_dir), ["variant", "dist"], "m", "s", "schedule"))


@register("t4_pearson", f"WITH {OBS} SELECT variant, dist, round(corr(price, qty), 5) AS r, round(corr(price, qty) ** 2, 5) AS r2 FROM obs GROUP BY ALL")
def t4(spark, sf_dir):
    r = stats.safe_corr("price", "qty")
    got = observations(spark, sf_dir).groupBy("variant", "dist").agg(r.alias("r"))
    return rounded(got.withColumn("r2", F.col("r") * F.col("r")), 5)


@register("t5_pvalue_stars")
def t5(spark, sf_dir):
    got = stats.spearman(medians(spark, sf_dir), ["variant", "dist"], "m", "s")
    p = stats.t_pvalue(F.col("rho"), F.col("n"))
    return got.withColumn("p", p).withColumn("stars", stats.stars(F.col("p")))


@register("t6_t7_rank_errors", f"WITH {RANKED} SELECT variant, dist, round(avg(abs(rm - rs)), 6) AS mare, round(sqrt(avg((rm - rs) ** 2)), 6) AS rmsre, CAST(sum((rm = rs)::INT) AS BIGINT) AS exact FROM r GROUP BY ALL")
def t6(spark, sf_dir):
    keys = ["variant", "dist"]
    ranked = medians(spark, sf_dir).select(*keys, stats.average_rank(F.col("m"), keys).alias("rm"), stats.average_rank(F.col("s"), keys).alias("rs"))
    return rounded(stats.rank_errors(ranked, keys, "rm", "rs"))


@register("t8_bootstrap_median_ci")
def t8(spark, sf_dir):
    return stats.bootstrap_median(medians(spark, sf_dir).select("variant", "m"), ["variant"], "m")


@register(
    "t9_mann_whitney",
    f"""WITH {MED}, g AS (SELECT DISTINCT variant FROM med WHERE variant <> 'A'),
    pool AS (SELECT variant, m, 0 AS base FROM med WHERE variant <> 'A' UNION ALL SELECT g.variant, m, 1 FROM med, g WHERE med.variant = 'A'),
    k AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY m) + (count(*) OVER (PARTITION BY variant, m) - 1) / 2.0 AS r FROM pool),
    u AS (SELECT variant, sum(r) FILTER (WHERE base = 0) - sum(1 - base) * (sum(1 - base) + 1) / 2 AS u, sum(1 - base) AS a, sum(base) AS b FROM k GROUP BY variant)
    SELECT variant, CAST(u AS DOUBLE) AS u, round(1 - 2 * u / (a * b), 6) AS r FROM u""",
)
def t9(spark, sf_dir):
    return rounded(stats.mann_whitney(medians(spark, sf_dir), [], "variant", "A", "m"))


@register(
    "t10_correlation_matrix",
    f"WITH {MED}, l AS (UNPIVOT (SELECT variant, dist, schedule, m, s, CAST(n AS DOUBLE) AS n FROM med) ON m, s, n INTO NAME k VALUE v) SELECT a.k AS a, b.k AS b, round(corr(a.v, b.v), 6) AS r FROM l a JOIN l b USING (variant, dist, schedule) WHERE a.k < b.k GROUP BY ALL",
)
def t10(spark, sf_dir):
    keys = ["variant", "dist", "schedule"]
    long = medians(spark, sf_dir).withColumn("n", F.col("n").cast("double")).unpivot(keys, ["m", "s", "n"], "k", "v")
    pairs = long.withColumnsRenamed({"k": "a", "v": "x"}).join(long.withColumnsRenamed({"k": "b", "v": "y"}), keys).filter("a < b")
    return rounded(pairs.groupBy("a", "b").agg(stats.safe_corr("x", "y").alias("r")))


@register(
    "t11_field_errors",
    """WITH d AS (SELECT o_orderpriority AS field, o_totalprice AS ref, round(o_totalprice, 0) AS got FROM orders),
    e AS (SELECT field, sqrt(avg((ref - got) ** 2)) AS rms, max(abs(ref - got)) AS max_abs, max(abs(ref - got) / (abs(ref) + 1e-15)) AS max_rel, sqrt(sum((ref - got) ** 2)) AS l2, sum(ref * ref) AS sig, sum((ref - got) ** 2) AS noise FROM d GROUP BY field)
    SELECT field, round(rms, 6) AS rms, round(max_abs, 6) AS max_abs, round(max_rel, 9) AS max_rel, round(l2, 4) AS l2, CASE WHEN noise = 0 THEN 'inf' WHEN sig = 0 THEN '0' ELSE CAST(CAST(round(10 * log10(sig / noise), 3) * 1000 AS BIGINT) AS VARCHAR) END AS snr_mdb FROM e""",
)
def t11(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("ref"), F.round("o_totalprice", 0).alias("got"))
    return field_errors(d)


def field_errors(d: DataFrame) -> DataFrame:
    """Errors of (field, ref, got): root mean square, largest absolute and relative, L2, signal to noise in milli-decibels."""
    e = F.col("ref") - F.col("got")
    agg = d.groupBy("field").agg(F.sqrt(F.avg(e * e)).alias("rms"), F.max(F.abs(e)).alias("max_abs"), F.max(F.abs(e) / (F.abs("ref") + 1e-15)).alias("max_rel"), F.sqrt(F.sum(e * e)).alias("l2"), F.sum(F.col("ref") * F.col("ref")).alias("sig"), F.sum(e * e).alias("noise"))
    ratio = F.try_divide(F.col("sig"), F.col("noise"))
    snr = F.when(F.col("noise") == 0, "inf").when(F.col("sig") == 0, "0").otherwise((F.round(10 * F.log10(ratio), 3) * 1000).cast("long").cast("string"))
    return agg.select("field", F.round("rms", 6).alias("rms"), F.round("max_abs", 6).alias("max_abs"), F.round("max_rel", 9).alias("max_rel"), F.round("l2", 4).alias("l2"), snr.alias("snr_mdb"))


@register(
    "t12_sensitivity_rank",
    f"WITH {OBS}, s AS (SELECT schedule, variant, avg(disc) AS mean, stddev_pop(disc) / sqrt(count(*)) AS stderr FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY mean, schedule) AS rn FROM s) SELECT variant, schedule AS worst, round(mean, 8) AS mean, round(stderr, 8) AS stderr FROM r WHERE rn = 1",
)
def t12(spark, sf_dir):
    s = observations(spark, sf_dir).groupBy("schedule", "variant").agg(F.avg("disc").alias("mean"), (F.stddev_pop("disc") / F.sqrt(F.count("*"))).alias("stderr"))
    return rounded(lookup.best_per_group(s, ["variant"], "mean", ["schedule"], largest=False), 8).select("variant", F.col("schedule").alias("worst"), "mean", "stderr")


@register(
    "e1_cost_vs_runtime",
    f"""WITH {JOINED}, best AS (SELECT *, row_number() OVER (PARTITION BY variant, dist ORDER BY m DESC, schedule) AS rn FROM med),
    loose AS (SELECT variant, dist, arg_min(mu, (ord, schedule)) AS mu, arg_min(delta, (ord, schedule)) AS delta FROM cost GROUP BY ALL),
    j AS (SELECT b.variant, b.dist, b.schedule, b.m, coalesce(c.mu, l.mu) * coalesce(c.delta, l.delta) AS mu_delta FROM best b LEFT JOIN cost c USING (variant, dist, schedule) LEFT JOIN loose l ON b.variant = l.variant AND b.dist = l.dist WHERE rn = 1)
    SELECT variant, dist, schedule, round(m, 6) AS m, round(mu_delta, 6) AS mu_delta, CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS bw_rank, CAST(rank() OVER (ORDER BY mu_delta) AS INTEGER) AS cost_rank FROM j""",
)
def e1_full(spark, sf_dir):
    best = lookup.best_per_group(medians(spark, sf_dir), ["variant", "dist"], "m", ["schedule"]).select("variant", "dist", "schedule", "m")
    got = lookup.cascading_lookup(best, costs(spark, sf_dir), ["variant", "dist", "schedule"], ["variant", "dist"], ["mu", "delta"], ["ord", "schedule"])
    got = got.withColumn("mu_delta", F.col("mu") * F.col("delta"))
    return got.select("variant", "dist", "schedule", F.round("m", 6).alias("m"), F.round("mu_delta", 6).alias("mu_delta"), F.rank().over(Window.orderBy(F.desc("m"))).alias("bw_rank"), F.rank().over(Window.orderBy("mu_delta")).alias("cost_rank"))
