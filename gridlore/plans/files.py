"""Files: tables are written as result files and dumps and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.plans.arrays import table
from gridlore.plans.registry import register
from gridlore.sources import readers


@register("s1_s11_csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, round(o_totalprice / 3, 2) AS third FROM orders")
def s1(spark, sf_dir):
    """Fixed decimals out, types and names in; appended in two writes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.round(F.col("o_totalprice") / 3, 2).alias("third"))
    path = readers.scratch(spark, "orders")
    readers.write_csv(o.filter("o_orderstatus = 'F'"), path, digits=2)
    readers.write_csv(o.filter("o_orderstatus <> 'F'"), path, append=True, digits=2)
    return readers.csv(spark, path, o.schema)


@register("s2_safe_scan", "SELECT 'missing' AS source, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS last UNION ALL SELECT 'present', count(*), max(n_name) FROM nation")
def s2(spark, sf_dir):
    """A file that isn't there is an empty table of the same schema."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = readers.scratch(spark, "nation")
    readers.write_csv(n, path)
    found = {name: readers.csv_if_there(spark, p, n.schema).agg(F.count("*").alias("n"), F.max("n_name").alias("last")) for name, p in (("missing", path + "-none"), ("present", path))}
    both = [df.select(F.lit(name).alias("source"), "n", "last") for name, df in found.items()]
    return both[0].unionByName(both[1])


@register("s3_folder_scan", "SELECT l_returnflag, count(*) AS n, true AS named, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag")
def s3(spark, sf_dir):
    """All files of a folder with their names; runs that failed (here: no discount) are left out."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    path = readers.scratch(spark, "runs")
    readers.write_csv(rows, path)
    read = readers.csv_folder(spark, path, rows.schema, skip="merged.csv", valid=F.col("l_discount") > 0)
    named = F.bool_and(F.col("source").endswith(".csv"))
    return read.groupBy("l_returnflag").agg(F.count("*").alias("n"), named.alias("named"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("s8_array_dumps", "SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) + 2 AS cells, round(sum(s_acctbal), 2) AS total, round(arg_min(s_acctbal, s_suppkey), 2) AS head, CAST(0 AS DOUBLE) AS tail FROM supplier GROUP BY s_nationkey")
def s8(spark, sf_dir):
    """A dump for each nation, with two entries fewer than its size says: they are read as zeros."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("x"))
    entries = F.array_join(F.transform("x", lambda v: v["s_acctbal"].cast("string")), "\n")
    text = F.concat(F.lit("# rank\n1\n# size\n"), F.size("x") + 2, F.lit("\n# lbound\n"), F.col("s_nationkey").cast("string"), F.lit("\n# entries\n"), entries)
    path = readers.scratch(spark, "dumps")
    s.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = readers.array_dumps(spark, path)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return read.select(F.col("lbound")[0].cast("long").alias("nation"), F.size("data").cast("long").alias("cells"), F.round(total, 2).alias("total"), F.round(F.col("data")[0], 2).alias("head"), F.element_at("data", -1).alias("tail"))


@register("s9_patch_loader", "SELECT c_custkey AS edge, k, (c_custkey * 7 + k) % n AS target FROM customer, (SELECT unnest([1, 2]) AS k), (SELECT count(*) AS n FROM customer)")
def s9(spark, sf_dir):
    """Indices and blocks of two neighbours of every edge, one dump for each array, become zero-based neighbours."""
    c = table(spark, sf_dir, "customer")
    target = F.pmod(F.col("c_custkey") * 7 + F.col("k"), F.lit(c.count()))
    cells = c.select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("c_custkey", "k", (target % 32 + 1).alias("idx"), (F.floor(target / 32) + 1).alias("blk"))
    each = cells.unpivot(["c_custkey", "k"], ["idx", "blk"], "kind", "v").groupBy("kind", "k").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "v"))).alias("x"))
    entries = F.array_join(F.transform("x", lambda v: v["v"].cast("string")), "\n")
    text = F.concat(F.lit("# rank\n1\n# size\n"), F.size("x"), F.lit("\n# lbound\n1\n# entries\n"), entries)
    path = readers.scratch(spark, "patch")
    each.select(F.concat_ws("_", F.lit("cell"), "kind", "k").alias("array"), text.alias("value")).write.partitionBy("array").option("maxRecordsPerFile", 1).text(path)
    return readers.patch(spark, path, "cell", 2, 32)


@register(
    "s12_rendered_table",
    "SELECT 1 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 2, '| --- | --- |' UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
)
def s12(spark, sf_dir):
    """A small table as the lines of its Markdown."""
    text = readers.rendered(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")
