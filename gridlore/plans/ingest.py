"""Parsing and generating: text made from the tables is read back the way result files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.plans.arrays import table
from gridlore.plans.registry import register
from gridlore.sources import generators, readers
from gridlore.streaming.observations import windowed


@register(
    "s4_ragged_lines",
    "SELECT CASE WHEN l_returnflag = 'A' THEN 4 ELSE 3 END AS fields, l_returnflag AS variant, count(*) AS n, count(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS tiles, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL",
)
def s4(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("string")
    line = F.when(F.col("l_returnflag") == "A", F.concat_ws(",", "l_returnflag", F.col("l_linenumber").cast("string"), F.lit("32"), q)).when(F.col("l_returnflag") == "N", F.concat_ws(",", "l_returnflag", F.lit("x1"), q)).otherwise(F.lit("noise"))
    shapes = {4: [("variant", "string"), ("tile", "int"), ("width", "int"), ("value", "double")], 3: [("variant", "string"), ("tile", "int"), ("value", "double")]}
    rows = readers.ragged(t.select(line.alias("value")), shapes)
    return rows.groupBy("fields", "variant").agg(F.count("*").alias("n"), F.count("tile").alias("tiles"), F.round(F.sum("value"), 2).alias("total"))


@register("s5_log_lines", "SELECT event_id, value AS time, CAST(user_id AS DOUBLE) AS checksum FROM events")
def s5(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("run done  Time: "), F.col("value").cast("string"), F.lit(" s, Checksum: "), F.col("user_id").cast("string"))
    return readers.labelled_numbers(e.select("event_id", line.alias("value")), ["Time", "Checksum"]).drop("value")


@register("s6_multi_match", "SELECT event_id, CAST(place AS INTEGER) AS place, m[1] AS k, m[2] AS v FROM (SELECT event_id, unnest([[event_type, CAST(user_id AS VARCHAR)], ['k', regexp_extract(props, '(\\d+)', 1)]]) AS m, unnest([0, 1]) AS place FROM events)")
def s6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("["), "event_type", F.lit("="), F.col("user_id").cast("string"), F.lit("] [k="), F.regexp_extract("props", r"(\d+)", 1), F.lit("]"))
    return readers.all_matches(e.select("event_id", line.alias("value")), r"\[(\w+)=(\d+)\]", ["k", "v"])


@register("s7_f10_suffix_numbers", "SELECT o_orderkey, CAST(floor(o_totalprice / 1000) * 1000 AS DOUBLE) AS value FROM orders")
def s7(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.format_number(F.floor(F.col("o_totalprice") / 1000), 0), F.lit("K"))
    return o.select("o_orderkey", readers.suffixed_number(text).alias("value"))


@register("f8_permissive_parse", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey END AS whole, CASE p_partkey % 3 WHEN 1 THEN p_partkey + 0.5 END::DOUBLE AS real, CASE p_partkey % 3 WHEN 2 THEN p_name END AS text FROM part")
def f8(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, (k + 0.5).cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", readers.permissive(text).alias("x")).select("p_partkey", "x.*")


@register("f6_f7_f9_index_arithmetic", "SELECT o_orderkey, ((o_custkey - 700) % 13 + 13) % 13 AS wrapped, o_custkey // 7 AS cut, greatest((o_custkey % 5 - 1) * 32 + o_orderkey % 32 - 1, 0) AS linear FROM orders")
def f6(spark, sf_dir):
    from gridlore.functions import layout

    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(c - 700, F.lit(13)).alias("wrapped"), layout.div(c, 7).alias("cut"), layout.linearised(k % 32, c % 5, 32).cast("long").alias("linear"))


@register("s13_ramp", "SELECT o_orderkey, o_orderkey % 997 * CAST(0.001 AS DOUBLE) AS re, o_orderkey % 991 * CAST(0.001 AS DOUBLE) AS im FROM orders")
def s13_ramp(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", generators.ramp(i).alias("re"), generators.ramp(i, 991).alias("im"))


_W = "18446744073709551616"  # 2^64
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END AS BIGINT)"


@register(
    "s13_generators",
    f"""WITH a AS (SELECT o_orderkey, CAST((o_orderkey::UHUGEINT + {0x9E3779B97F4A7C15}) % {_W} AS UBIGINT) AS z, CAST(o_orderkey + 1 AS UBIGINT) AS y FROM orders),
    b AS (SELECT o_orderkey, CAST(xor(z, z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9} % {_W} AS UBIGINT) AS z, xor(y, CAST(y::UHUGEINT * 8192 % {_W} AS UBIGINT)) AS y FROM a),
    c AS (SELECT o_orderkey, CAST(xor(z, z >> 27)::UHUGEINT * {0x94D049BB133111EB} % {_W} AS UBIGINT) AS z, xor(y, y >> 7) AS y FROM b),
    d AS (SELECT o_orderkey, xor(z, z >> 31) AS z, xor(y, CAST(y::UHUGEINT * 131072 % {_W} AS UBIGINT)) AS y FROM c)
    SELECT o_orderkey, {_SIGNED.format("z")} AS splitmix, {_SIGNED.format("y")} AS xorshift, CAST(z >> 11 AS DOUBLE) / 9007199254740992 AS unit FROM d""",
)
def s13(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select("o_orderkey", generators.hashed(F.col("o_orderkey")).alias("splitmix"), generators.hashed(F.col("o_orderkey") + 1, "xorshift64").alias("xorshift"))
    return h.withColumn("unit", generators.unit_interval(F.col("splitmix")))


@register("x_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY ALL")
def x_windows(spark, sf_dir):
    w = windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return w.select("start", "event_type", "n", F.round("mean", 6).alias("mean"), "top")
