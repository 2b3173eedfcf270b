import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pytest import approx

from gridlore.functions import layout as L
from gridlore.functions import stats
from gridlore.functions.thermo import Constants, Thermo
from gridlore.operators import coaccess as G
from gridlore.operators import cost, kernels, lookup
from gridlore.sources import generators, readers


@pytest.mark.parametrize("order", ["RR", "RC", "CR", "CC"])
def test_blocked_layouts_are_bijections_with_inverses(spark, order):
    rows, cols, br, bc = 24, 20, 8, 4
    df = spark.range(rows * cols).select(L.div(F.col("id"), cols).alias("i"), (F.col("id") % cols).alias("j"))
    df = df.withColumn("pos", L.blocked(F.col("i"), F.col("j"), rows, cols, br, bc, order))
    back = L.from_blocked(F.col("pos"), rows, cols, br, bc, order)
    df = df.withColumns({"bi": back[0], "bj": back[1]})
    assert df.filter("bi <> i or bj <> j").count() == 0
    assert df.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (rows * cols, 0, rows * cols - 1)


@pytest.mark.parametrize("make", [
    lambda je, jk: L.field(1, je, jk, 48, 6), lambda je, jk: L.field(4, je, jk, 48, 6), lambda je, jk: L.stencil_blocked(je, jk, 16, 6),
    lambda je, jk: L.tile_levels_first(je, jk, 16, 6), lambda je, jk: L.aosoa(0, je, jk, 48, 1, 16), lambda je, jk: L.aosoa_levels_first(0, je, jk, 6, 1, 16),
])
def test_field_layouts_are_bijections(spark, make):
    df = spark.range(48 * 6).select(make(F.col("id") % 48, L.div(F.col("id"), 48)).alias("pos"))
    assert df.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (288, 0, 287)


def test_layout_mistakes_show_in_cells_not_in_sums(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0), (1, 1, 7.0)], "i long, j long, v double")
    right = {(r.i, r.j): r.v for r in kernels.add_transposed(a, a).collect()}
    assert right == {(0, 0): 2.0, (0, 1): 7.0, (1, 0): 7.0, (1, 1): 14.0} and sum(right.values()) == 2 * 15.0


def test_owner_and_linearise(spark):
    row = spark.range(1).select(L.owner("block", 9, 10, 4), L.owner("shift1", 9, 10, 4), L.owner("interleave", 9, 10, 4, 2), L.linearised(3, 2, 8), L.linearised(0, 0, 8)).first()
    assert tuple(row) == (3, 0, 0, 10, 0)
    with pytest.raises(ValueError):
        L.owner("none", 1, 2, 3)


def test_trace_by_hand(spark):
    trace = spark.createDataFrame([(0, 1, "A", 0), (0, 2, "A", 0), (0, 3, "A", 3), (0, 4, "A", 3), (0, 4, "A", 4)], "slice long, step long, array string, block long")
    r = cost.metrics(trace).first()
    assert (r.steps, r.mu, r.delta) == (4, 0.75, 1.25)


def test_cold_array_counts_one_unless_pooled(spark):
    trace = spark.createDataFrame([(0, 1, "A", 0), (0, 2, "A", 0), (0, 2, "B", 9)], "slice long, step long, array string, block long")
    assert cost.metrics(trace).first().delta == 1.0
    assert cost.metrics(trace, pooled=True).first().delta == 5.0


def test_vector_tail_is_dropped(spark):
    got = spark.range(10).select(cost.vector_steps(F.col("id"), 4, 10).alias("s")).collect()
    assert [r.s for r in got] == [0] * 4 + [1] * 4 + [None] * 2


def test_kernels_against_numpy(spark):
    rng = np.random.default_rng(0)
    m, b = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    rows = spark.createDataFrame([(k, m[k].tolist(), b[k].tolist()) for k in range(6)], "id long, a array<double>, b array<double>")
    dense = lambda df, shape: np.array([[{(r.i, r.j): r.v for r in df.collect()}.get((i, j), 0.0) for j in range(shape[1])] for i in range(shape[0])])
    assert np.allclose(dense(kernels.gram(rows, "a", "b"), (4, 4)), m.T @ b)
    assert np.allclose(dense(kernels.rank_2k(rows, "a", "b"), (4, 4)), np.tril(1.5 * (m.T @ b + b.T @ m)))
    c = kernels.gram(rows, "a", "a")
    assert np.allclose(dense(kernels.rank_2k(rows, "a", "b", 1.0, 1.2, c), (4, 4)), np.tril(1.2 * m.T @ m + m.T @ b + b.T @ m))
    long = kernels.long_matrix(rows, "id", "a")
    y = {(r.axis, r.k): r.y for r in kernels.both_products(long, F.col("j") + 1, F.col("i") + 1).collect()}
    assert np.allclose([y["row", k] for k in range(6)], m @ np.arange(1, 5)) and np.allclose([y["col", k] for k in range(4)], m.T @ np.arange(1, 7))
    g = m
    for _ in range(2):
        g = np.where(np.pad(np.ones((4, 2), bool), 1), 0.2 * (g + np.roll(g, 1, 0) + np.roll(g, -1, 0) + np.roll(g, 1, 1) + np.roll(g, -1, 1)), g)
    assert np.allclose(dense(kernels.jacobi(long, 2), (6, 4)), g)


def test_leapfrog_conserves_momentum(spark):
    bodies = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.0), (1, 1.0, 1.0, 0.0, 0.0, 0.0, -0.1, 0.0)], "id long, m double, x double, y double, z double, vx double, vy double, vz double")
    got = kernels.leapfrog(bodies, 0.1, 0.01).collect()
    assert abs(sum(r.vx for r in got)) < 1e-12 and got[0].vx * got[1].vx < 0


def test_thermodynamics_against_plain_python(spark):
    c, th = Constants(), Thermo()
    for t in (220.0, 255.0, 273.16, 290.0):
        r = spark.range(1).select(th.liquid_share(F.lit(t)).alias("a"), th.over_water(F.lit(t)).alias("w"), th.slope_mixed(F.lit(t)).alias("s"), th.condensed(F.lit(0.5), F.lit(-0.001), F.lit(0.01), F.lit(0.02), F.lit(t)).alias("lc")).first()
        a = min(1.0, ((max(c.rtice, min(c.rtwat, t)) - c.rtice) / (c.rtwat - c.rtice)) ** 2)
        assert math.isclose(r.a, a, abs_tol=1e-12) and math.isclose(r.w, c.r2es * math.exp(c.r3les * (t - c.rtt) / (t - c.r4les)))
        assert math.isclose(r.lc, 0.5 * min(0.001, (0.02 - 0.005) / 0.5))


def test_lookups(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "k string, s int")
    costs = spark.createDataFrame([("a", 1, 10.0, 0), ("a", 1, 11.0, 1), ("b", 9, 20.0, 2)], "k string, s int, v double, ord int")
    got = {(r.k, r.s): (r.v, r.w) for r in lookup.cascading_lookup(left, costs.withColumn("w", F.lit("x")), ["k", "s"], ["k"], ["v", "w"], ["ord"], {"w": F.lit("?")}).collect()}
    assert got == {("a", 1): (10.0, "x"), ("a", 2): (10.0, "x"), ("b", 1): (20.0, "x"), ("c", 1): (None, "?")}
    assert {(r.k, r.s) for r in lookup.single_match_lookup(left, costs, ["k"], ["v"]).collect()} == {("b", 1)}
    assert {(r.k, r.s, r.v) for r in lookup.preferred_lookup(left, costs, ["k"], F.col("v") == 11, ["v"], ["ord"]).collect()} == {("a", 1, 11.0), ("a", 2, 11.0), ("b", 1, 20.0)}


def test_statistics_guard_ties_constants_and_nan(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("x", 2.0, 5.0), ("x", 2.0, 5.0), ("y", 1.0, 2.0), ("y", 3.0, 4.0)], "g string, a double, b double")
    assert [r.rho for r in stats.spearman(df, ["g"], "a", "b").orderBy("g").collect()] == [None, None]
    ranks = df.select(stats.average_rank(F.col("a"), ["g"]).alias("r"), stats.truncated_rank(F.col("a"), ["g"]).alias("t")).collect()
    assert sorted((r.r, r.t) for r in ranks) == [(1.0, 1), (1.0, 1), (2.0, 2), (2.5, 2), (2.5, 2)]
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double").select(stats.finite(F.col("v")).alias("v"))
    assert [r.v for r in nan.collect()] == [None, None, 1.0]


@pytest.mark.parametrize(("r", "n", "p"), [(0.5, 10, 0.141113), (0.9, 5, 0.037386), (0.0, 8, 1.0), (1.0, 4, 0.0), (-0.7, 20, 0.00059)])
def test_p_values(r, n, p):
    assert math.isclose(stats._student(r, n), p, abs_tol=2e-6)


def test_p_values_by_integration():
    df, r = 7, 0.4
    t = r * math.sqrt(df / (1 - r * r))
    x = np.linspace(-t, t, 200_001)
    density = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    inside = float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())
    assert math.isclose(stats._student(r, df + 2), 1 - inside, abs_tol=1e-8)


def test_bootstrap_covers_the_median(spark):
    r = random.Random(2)
    df = spark.createDataFrame([("a", r.gauss(5, 1)) for _ in range(200)], "g string, v double")
    got = stats.bootstrap_median(df, ["g"], "v", 1000).first()
    assert got.low <= got["median"] <= got.high and 4.6 < got.low < got.high < 5.4


def test_bundles(spark):
    sets = {"a": frozenset({1, 2}), "b": frozenset({1, 2}), "c": frozenset({1, 2, 3}), "d": frozenset({9}), "e": frozenset({9}), "f": frozenset({7})}
    assert G.greedy_bundles(sets, 0.6) == [["c", "a", "b"], ["d", "e"], ["f"]]
    made = G.constrained_bundles(G.greedy_bundles(sets, 0.6), sets)
    assert sorted(x for b in made for x in b) == sorted(sets) and all(G.valid_size(len(b)) for b in made)
    assert [sorted(b) for b in G.strict_bundles(sets, 1.0)] == [["a", "b"], ["d", "e"], ["c"], ["f"]]
    r = random.Random(3)
    many = {k: frozenset(r.sample(range(8), r.randint(1, 5))) for k in range(40)}
    for b in G.greedy_bundles(many, 0.5):
        assert all(G._j(many[x], many[y]) >= 0.5 for x in b for y in b)


def test_empty_sets_are_not_similar(spark):
    row = spark.range(1).select(G.array_jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j"), G.array_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("k")).first()
    assert tuple(row) == (0.0, 0.5)


def test_generators():
    assert int(generators.splitmix64(np.array([0]))[0]) == 0xE220A8397B1DCDAF
    x = 1
    for shift in (13, -7, 17):
        x ^= (x << shift) & (1 << 64) - 1 if shift > 0 else x >> -shift
    assert int(generators.xorshift64(np.array([1]))[0]) == x


def test_index_distributions(spark):
    for kind in ("sequential", "uniform", "normal"):
        t = generators.targets(spark, 100, kind, 4.0)
        assert t.filter("target < 0 or target >= 100").count() == 0 and t.count() == 100


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.25, 3), ("b", float("nan"), -1)], "name string, v double, t int")
    readers.write_csv(df, f"{tmp_path}/out", digits=2)
    readers.write_csv(df, f"{tmp_path}/out", append=True, digits=2)
    schema = "name string, v double, t int"
    back = readers.csv(spark, f"{tmp_path}/out", schema)
    assert sorted(map(tuple, back.collect()), key=str) == [("a", 1.25, 3)] * 2 + [("b", None, -1)] * 2
    assert readers.csv_if_there(spark, f"{tmp_path}/nothing", schema).collect() == []
    kept = readers.csv_folder(spark, f"{tmp_path}/out", schema, valid=F.col("t") > 0)
    assert kept.count() == 2 and all(r.source.startswith("part-") for r in kept.collect())
    (tmp_path / "vt.dat").write_text("# rank\n2\n# size\n2 2\n# lbound\n1 1\n# entries\n1.0D0 2.5\n3\n")
    dump = readers.array_dumps(spark, f"{tmp_path}/vt.dat").first()
    assert (dump.name, dump["rank"], dump["size"], dump.lbound, dump.data) == ("vt", 2, [2, 2], [1, 1], [1.0, 2.5, 3.0, 0.0])
    text = readers.rendered(spark.createDataFrame([("x", 1.0)], "k string, v double"))
    assert text.splitlines() == ["| k | v |", "| --- | --- |", "| x | 1.000 |"]
    assert r"x & 1.000 \\" in readers.rendered(spark.createDataFrame([("x", 1.0)], "k string, v double"), "latex")


def test_preamble_and_suffixes(spark):
    lines = spark.createDataFrame([(0, "== junk"), (1, "ID,Value"), (2, "a,1.5K"), (3, "b,20%"), (4, "c,oops")], "n int, value string")
    rows = readers.after_preamble(lines, "n", "ID").select(readers.suffixed_number(F.get(F.split("value", ","), F.lit(1))).alias("v")).collect()
    assert [r.v for r in rows] == [1500.0, 0.2, None]


def test_stream_equals_batch(spark, tmp_path):
    from gridlore.streaming.observations import windowed

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed(stream, "ts", ["k"], "v").writeStream.format("memory").queryName("got").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("got").collect()) == sorted(windowed(rows, "ts", ["k"], "v").collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_column_scheme_conserves_water_and_heat():
    from gridlore.operators.column import ICE, LIQUID, RAIN, SNOW, Scheme

    r = np.random.default_rng(4)
    shape = 7, 50
    q = np.stack([r.uniform(0, s, shape) for s in (5e-4, 2e-4, 1e-4, 1e-4, 1e-2)])
    t, cover, dp, rho = r.uniform(225, 290, shape), r.uniform(0, 1, shape), r.uniform(2e3, 8e3, shape), r.uniform(0.3, 1.2, shape)
    s = Scheme()
    new, heat, flux = s.run(q, t, cover, dp, rho, r.uniform(1e-3, 9e-3, shape), r.uniform(-2e-4, 1e-4, shape))
    assert new.min() >= 0 and not np.allclose(new, q)
    column = lambda x: (x.sum(0) * dp / s.gravity).sum(0)
    assert np.allclose(column(q), column(new) + flux[:, -1].sum(0) * s.dt, rtol=1e-10)
    # what condenses or melts warms or cools, wherever it falls afterwards
    c = s.thermo
    latent = lambda x: c.ralvdcp * (x[LIQUID] + x[RAIN]) + c.ralsdcp * (x[ICE] + x[SNOW])
    out = latent(flux[:, -1]) * s.dt
    assert np.allclose(((heat - t) * dp / s.gravity).sum(0), ((latent(new) - latent(q)) * dp / s.gravity).sum(0) + out, rtol=1e-8)


def test_column_scheme_solves_each_level_as_one_system():
    from gridlore.operators.column import Scheme

    rates, sink, right = np.zeros((5, 5, 1)), np.array([[0.0], [0.5], [2.0], [1.0], [0.0]]), np.arange(1.0, 6)[:, None]
    rates[0, 2] = 0.3
    got = Scheme._solve(right, rates, sink)[:, 0]
    assert np.allclose(got, [1 / 1.3, 2 / 1.5, (3 + 0.3 / 1.3) / 3, 4 / 2, 5])


def test_column_processes_one_by_one():
    """Each process on a single cell against its formula in plain numbers."""
    from math import exp, pi, sqrt

    from gridlore.operators.column import ICE, LIQUID, RAIN, SNOW, VAPOUR, Scheme

    s, one = Scheme(), np.ones(1)
    c = s.thermo

    def done(method, amounts, *rest):
        now, moves = np.zeros((5, 1)), np.zeros((5, 5, 1))
        for k, v in amounts.items():
            now[k] = v
        out = getattr(s, method)(moves, now, *(one * x for x in rest))
        return {(i, j): moves[i, j, 0] for i in range(5) for j in range(5) if moves[i, j, 0]}, now[:, 0], out

    raw = c.r2es * exp(c.r3les * (290 - c.rtt) / (290 - c.r4les)) / 90_000
    q = raw / (1 - c.retv * raw)
    more = 1 + c.ralsdcp * c.r5ies / (290 - c.r4ies) ** 2 / (1 - c.retv * raw) * q
    moves, now, _ = done("_supersaturate", {VAPOUR: 1.2 * q}, 290, 0, 90_000)
    assert moves == {(VAPOUR, LIQUID): approx(0.2 * q / more)} and now[LIQUID] == approx(0.2 * q / more)
    raw = c.r2es * exp(c.r3ies * (230 - c.rtt) / (230 - c.r4ies)) / 30_000
    q, limit = raw / (1 - c.retv * raw), 0.5 + 0.5 * (c.rkoop1 - c.rkoop2 * 230)
    more = 1 + c.ralsdcp * c.r5ies / (230 - c.r4ies) ** 2 / (1 - c.retv * raw) * q
    moves, _, _ = done("_supersaturate", {VAPOUR: 2 * q}, 230, 0.5, 30_000)
    assert moves == {(VAPOUR, ICE): approx(0.5 * (3 * q - limit * q) / more)}
    assert done("_supersaturate", {VAPOUR: 0.5 * q}, 230, 0.5, 30_000)[0] == {}

    moves, _, _ = done("_erode", {LIQUID: 3e-4, ICE: 1e-4, VAPOUR: 4e-3}, 270, 0.6, 6e-3)
    lost = 0.6 * s.erosion * s.dt * 2e-3
    assert moves == {(LIQUID, VAPOUR): approx(lost * 0.75), (ICE, VAPOUR): approx(lost * 0.25)}
    assert done("_erode", {LIQUID: 3e-4, VAPOUR: 7e-3}, 270, 0.6, 6e-3)[0] == {}

    ice = c.r2es * exp(c.r3ies * (260 - c.rtt) / (260 - c.r4ies)) / s.gas_ratio
    water = ice * min(c.rkoop1 - c.rkoop2 * 260, exp(c.r3les * (260 - c.rtt) / (260 - c.r4les) - c.r3ies * (260 - c.rtt) / (260 - c.r4ies)))
    nuclei = 1000 * exp(12.96 * (water - ice) / water - 0.639)
    slow = c.rlstt * (c.rlstt / (461.5 * 260) - 1) / (2.4e-2 * 260) + 461.5 * 260 * 60_000 / (2.21 * ice)
    first = 1e-5 / 0.5
    grown = (0.666 * 7.8 * (nuclei / 0.8) ** 0.666 * (water - ice) / (8.87 * slow * ice) * s.dt + first**0.666) ** 1.5
    many = min(nuclei / 15000, 1)
    want = min(0.5 * (grown - first), 4e-4) * min(many + (1 - many) * (0.1 + 100 / 500), 1)
    moves, now, _ = done("_deposit", {LIQUID: 4e-4, ICE: 1e-5}, 260, 0.5, 60_000, 0.8, 100)
    assert moves == {(LIQUID, ICE): approx(want)} and now[ICE] == approx(1e-5 + want) and now[LIQUID] == approx(4e-4 - want)
    assert done("_deposit", {LIQUID: 4e-4}, 275, 0.5, 60_000, 0.8, 100)[0] == {}

    slope = (pi * 1000 * s.drops / (0.9 * 1e-4)) ** 0.25
    whole = s.dt * 20 * pi**2 * 100 * s.drops * (1000 / 0.9) * (exp(0.66 * 5) - 1) / slope**7
    assert done("_freeze", {RAIN: 1e-4, SNOW: 1e-5}, c.rtt - 5, 0.9)[0] == {(RAIN, SNOW): approx(min(whole, 1e-4))}
    half = 5 * s.dt * 3.5 / s.melting_time / (c.ralsdcp - c.ralvdcp)
    assert done("_freeze", {RAIN: 1e-2, SNOW: 1e-2}, c.rtt - 5, 0.9)[0] == {(RAIN, SNOW): approx(min(half, 1e-2))}
    assert done("_freeze", {LIQUID: 1e-3}, c.rthomo - 0.01, 0.9)[0] == {(LIQUID, ICE): approx(0.01 / (c.ralsdcp - c.ralvdcp))}
    assert done("_freeze", {RAIN: 1e-3, LIQUID: 1e-3}, 280, 0.9)[0] == {}

    raw = c.r2es * exp(c.r3les * (285 - c.rtt) / (285 - c.r4les)) / 80_000
    q = raw / (1 - c.retv * raw)
    more = 1 + c.ralvdcp * c.r5les / (285 - c.r4les) ** 2 / (1 - c.retv * raw) * q
    beta = 5.44e-4 * 0.5 * (sqrt(0.8) / 5.09e-3 * 1e-4 * 5000 / (s.gravity * s.dt) / 0.5) ** 0.5777
    want = 0.5 * beta * s.dt * 0.5 * q / (1 + beta * s.dt * more)
    moves, now, wet = done("_evaporate", {RAIN: 1e-4, VAPOUR: 0.5 * q}, 285, 0, 80_000, 100_000, 5000, 0.5)
    assert moves == {(RAIN, VAPOUR): approx(min(want, 1e-4))} and now[RAIN] == approx(1e-4 - min(want, 1e-4))
    assert wet[0] == approx(max(0.1, 0.5 - 0.5 * min(want, 1e-4) / 1e-4))
    assert done("_evaporate", {RAIN: 1e-4, VAPOUR: q}, 285, 0, 80_000, 100_000, 5000, 0.5)[0] == {}


def test_column_blocks_do_not_matter(spark):
    from gridlore.operators.column import microphysics

    rows = [(jl, jk, 230.0 + 9 * jk + jl, 0.5, 5000.0, 0.7, 0.002, -1e-4, 2e-4, 1e-4, 0.0, 1e-5, 0.004) for jl in range(10) for jk in range(5)]
    df = spark.createDataFrame(rows, "jl long, jk int, t double, cover double, dp double, rho double, saturated double, change double, liquid double, ice double, rain double, snow double, vapour double")
    assert np.allclose(*(np.array(sorted(map(tuple, microphysics(df, block=b).collect()))) for b in (3, 256)), rtol=1e-12)


def test_bundles_take_all_arrays(spark, tmp_path):
    from gridlore.plans import models

    # 32 suppliers in two classes of months, none of which g1's filter selects
    rows = [(k, f"1995-{m:02d}-15", 1, 0.0, 0.0, "N") for k in range(1, 33) for m in ((1, 2, 3) if k % 2 else (7, 8, 9))]
    df = spark.createDataFrame(rows, "l_suppkey long, day string, l_quantity int, l_discount double, l_tax double, l_returnflag string")
    df.selectExpr("*", "cast(day as date) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {tuple(range(1, 33, 2)), tuple(range(2, 33, 2))}
    for query in (models.g6, models.g7, models.g9):
        found = {}
        for r in query(spark, str(tmp_path)).collect():
            found.setdefault(r["bundle"], []).append(r["array"])
        assert {tuple(sorted(x)) for x in found.values()} == want


def test_block_products_agree(spark):
    """All schedules give the same product, whatever the blocks' shapes; edges of the blocks are padded."""
    import numpy as np

    from gridlore.operators import kernels as K

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(37, 21)), rng.normal(size=(21, 18))
    frame = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    for how in ("summa", "cannon", "static", "goto"):
        got = np.zeros((37, 18))
        for r in K.block_product(frame(a), frame(b), (37, 21, 18), (8, 5, 7), how, p=3).collect():
            got[r.i, r.j] = r.v
        assert np.allclose(got, a @ b), how


def test_schedules(spark):
    """Cannon's owners begin with different inner blocks; SUMMA's all take them in order; stripes are whole rows of blocks."""
    from pyspark.sql import functions as F

    from gridlore.operators import kernels as K

    rows = spark.range(64).select((F.col("id") / 16).cast("int").alias("bi"), (F.col("id") / 4 % 4).cast("int").alias("bj"), (F.col("id") % 4).cast("int").alias("bk"))
    def of(how):
        o, s = K.schedule(how, F.col("bi"), F.col("bj"), F.col("bk"), 4, 4, 4)
        return {(r.bi, r.bj, r.bk): (int(r.o), int(r.s)) for r in rows.select("*", o.alias("o"), s.alias("s")).collect()}

    assert all(s == k for (_, _, k), (_, s) in of("summa").items())
    cannon = of("cannon")
    for step in range(4):  # in a step every owner has another inner block of its row of A
        for bi in range(4):
            assert len({k for (i, j, k), (_, s) in cannon.items() if i == bi and s == step}) == 4
    assert all(o == i for (i, _, _), (o, _) in of("static").items())
    goto = of("goto")
    assert all(goto[i, j, k][1] < goto[x, j, k + 1][1] for i in range(4) for x in range(4) for j in range(4) for k in range(3))


def test_narrow_types(spark):
    from pyspark.sql import functions as F

    from gridlore.operators import kernels as K

    (r,) = spark.createDataFrame([([0.5, -3.0, 3.0, 0.0, 1.00390625, -0.1],)], "x array<float>").select(K.narrow(F.col("x"), 64.0).alias("q"), K.narrow(F.col("x"), 1.0, "bf16").alias("b")).collect()
    assert r.q == [32, -128, 127, 0, 64, -7]
    assert r.b[:5] == [0.5, -3.0, 3.0, 0.0, 1.0] and r.b[5] == -0.099609375


def test_ranks_of_counted_values(spark):
    from gridlore.functions import stats

    df = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, None), (5, 9)], "id int, x int")
    assert {r.id: r.r for r in stats.ranked(df, "x", "r").collect()} == {4: 1.0, 2: 2.0, 1: 3.5, 3: 3.5, 5: 5.0}


def test_velocity_tendencies_by_loops(spark):
    """The array form against plain loops over elements and levels."""
    import numpy as np

    from gridlore.operators.velocity import tendencies

    rng = np.random.default_rng(5)
    ne, nc, nv, n, flat = 14, 6, 5, 6, 3
    f = lambda *shape: rng.normal(size=shape)
    pick = lambda size, *shape: rng.integers(0, size, shape)
    E = {"vn": f(ne, n), "weight": f(ne, n), "ddxn": f(ne, n), "ddxt": f(ne, n), "ddqz": 2 + rng.random((ne, n)), "quad": pick(ne, ne, 4), "rbf": f(ne, 4), "cell": pick(nc, ne, 2), "gradekin": f(ne, 2), "lin": f(ne, 2), "vert": pick(nv, ne, 2), "outer": f(ne, 3), "inv_dual": f(ne), "inv_primal": f(ne), "orient": f(ne), "f": f(ne)}
    C = {"w": f(nc, n + 1), "weight": f(nc, n), "d1": f(nc, n), "d2": f(nc, n), "edge": pick(ne, nc, 3), "bln": f(nc, 3)}
    V = {"cell": pick(nc, nv, 6), "aw": f(nv, 6), "edge": pick(ne, nv, 6), "rot": f(nv, 6)}

    def frame(d, size):
        kind = lambda x: ("array<" if x.ndim == 2 else "") + ("long" if x.dtype.kind == "i" else "double") + (">" if x.ndim == 2 else "")
        return spark.createDataFrame([(i, *(x[i].tolist() for x in d.values())) for i in range(size)], "id long, " + ", ".join(f"{k} {kind(x)}" for k, x in d.items()))

    vn, w = E["vn"], C["w"]
    vt, kin, terrain, vg = (np.zeros((ne, n)) for _ in range(4))
    vh, th = np.zeros((ne, n + 1)), np.zeros((ne, n))
    for e in range(ne):
        for k in range(n):
            vt[e, k] = sum(E["rbf"][e, m] * vn[E["quad"][e, m], k] for m in range(4))
            kin[e, k] = (vn[e, k] ** 2 + vt[e, k] ** 2) / 2
            a = E["weight"][e, k]
            vh[e, k] = a * vn[e, k] + (1 - a) * vn[e, k - 1] if k else vn[e, 0] * a + (1 - a) * vn[e, 0]
            th[e, k] = a * vt[e, k] + (1 - a) * vt[e, k - 1] if k else vt[e, 0]
            terrain[e, k] = vn[e, k] * E["ddxn"][e, k] + vt[e, k] * E["ddxt"][e, k] if k + 1 >= flat else 0
        vh[e, n] = sum(E["outer"][e, m] * vn[e, n - 1 - m] for m in range(3))
    wv = np.array([[sum(V["aw"][v, m] * w[V["cell"][v, m], k] for m in range(6)) for k in range(n)] for v in range(nv)])
    zeta = np.array([[sum(V["rot"][v, m] * vn[V["edge"][v, m], k] for m in range(6)) for k in range(n)] for v in range(nv)])
    for e in range(ne):
        (c1, c2), (v1, v2) = E["cell"][e], E["vert"][e]
        vg[e] = vh[e, :n] * E["inv_dual"][e] * (w[c1, :n] - w[c2, :n]) + th[e] * E["inv_primal"][e] * E["orient"][e] * (wv[v1] - wv[v2])
    at = lambda x: np.array([[sum(C["bln"][c, m] * x[C["edge"][c, m], k] for m in range(3)) for k in range(n)] for c in range(nc)])
    ekin, mc, carried = at(kin), at(terrain), at(vg)
    con = np.zeros((nc, n + 1))
    con[:, :n] = w[:, :n]
    for k in range(flat, n):
        con[:, k] -= C["weight"][:, k] * mc[:, k] + (1 - C["weight"][:, k]) * mc[:, k - 1]
    whole = (con[:, :-1] + con[:, 1:]) / 2
    rise = np.zeros((nc, n))
    for k in range(1, n):
        rise[:, k] = carried[:, k] - con[:, k] * (w[:, k - 1] * C["d1"][:, k] - w[:, k + 1] * C["d2"][:, k] + w[:, k] * (C["d2"][:, k] - C["d1"][:, k]))
    push = np.zeros((ne, n))
    for e in range(ne):
        (c1, c2), (v1, v2), (g1, g2) = E["cell"][e], E["vert"][e], E["gradekin"][e]
        lift = E["lin"][e, 0] * whole[c1] + E["lin"][e, 1] * whole[c2]
        push[e] = -(kin[e] * (g1 - g2) + g2 * ekin[c2] - g1 * ekin[c1] + vt[e] * (E["f"][e] + (zeta[v1] + zeta[v2]) / 2) + lift * (vh[e, :-1] - vh[e, 1:]) / E["ddqz"][e])
    edges, cells = tendencies(frame(E, ne), frame(C, nc), frame(V, nv), flat)
    for got, want in ((edges, push), (cells, rise)):
        assert np.allclose([r.ddt for r in got.orderBy("id").collect()], want)


def test_way_back_of_blocks_beyond_4096_rows(spark, tmp_path):
    from gridlore.plans import arrays

    spark.createDataFrame([(3, [1.0] * 64), (4096, [2.0] * 64), (70_001, [3.0] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = arrays.l3(spark, str(tmp_path)).collect()
    assert len(rows) == 192 and all((r.back_i, r.back_j) == (r.i, r.j) for r in rows)


def test_ways_back_beyond_a_million_edges(spark, tmp_path):
    from gridlore.plans import arrays

    spark.createDataFrame([(5, 1), (999_999, 7), (1_000_000, 7), (8_999_999, 9)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = arrays.l_back(spark, str(tmp_path)).collect()
    edges, levels = ("f1", "f3", "n1", "n2", "bj", "tj", "aj", "lj", "vi", "ti"), ("k1", "k3", "bk", "tk", "ak", "lk", "vj", "tc")
    assert len(rows) == 4 and all({r[c] for c in edges} == {r.je} and {r[c] for c in levels} == {r.jk} and r.af == r.lf == 2 for r in rows)


@pytest.mark.parametrize("how", ["greedy", "constrained", "strict"])
def test_bundles_of_many_arrays(spark, how):
    # more than 20,000 arrays of three sets; 20,007 and 5 are no valid sizes
    two, three = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))
    nests = F.when(F.col("id") < 5, F.array(F.lit(8), F.lit(9))).when(F.col("id") % 2 == 0, three).otherwise(two)
    relation = spark.range(20_012).select(F.col("id").alias("array"), F.explode(nests).alias("nest"))
    found = {}
    for r in G.bundled(spark, relation, how, 0.6).collect():
        found.setdefault(r["bundle"], []).append(r["array"])
    assert sorted(x for b in found.values() for x in b) == list(range(20_012))
    few = next(b for b in found.values() if 0 in b)
    if how == "constrained":
        assert all(G.valid_size(len(b)) or len(found) == 1 for b in found.values()) and set(range(5)) <= set(few)
    else:
        assert len(found) == (2 if how == "greedy" else 3) and sorted(few) == list(range(5))


def test_bundles_of_classes_are_those_of_arrays():
    # by hand: of members as near the first one moves; strict mergers go on while every nest is used enough
    sets = {k: frozenset(v) for k, v in {"a": {1, 2}, "b": {1, 2}, "c": {1, 3}, "d": {2, 3}, "e": {7}}.items()}
    assert G.constrained_bundles([["a", "b", "c", "d"], ["e"]], sets) == [["e", "a", "b", "c", "d"]]
    assert G.strict_bundles(sets, 0.6) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert G.strict_bundles(sets, 0.3) == [["a", "b", "c", "d"], ["e"]] and G.strict_bundles({}, 0.5) == []


def test_pairs_by_blocks_and_by_nests_agree(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"x{a}", n) for a in range(60) for n in r.choices([*range(9), None], k=r.randint(1, 8))] + [(None, 1)]
    relation = spark.createDataFrame(rows, "array string, nest int")
    held = {}
    for a, n in rows:
        held.setdefault(a, set()).add(n)
    want = sorted((a, b, k, k / (len(held[a]) + len(held[b]) - k)) for a in held for b in held if a and b and a < b and (k := len((held[a] & held[b]) - {None})))
    group = F.length("array")
    for block, slab, most in ((2048, 128, 4096), (16, 5, 4096), (16, 5, 0)):
        monkeypatch.setattr(G, "BLOCK", block)
        monkeypatch.setattr(G, "SLAB", slab)
        monkeypatch.setattr(G, "MATRIX_NESTS", most)
        assert sorted(map(tuple, G.jaccard(relation).collect())) == want
        assert sorted(map(tuple, G.co_occurrence(relation).collect())) == [x[:3] for x in want]
        found = {x.grp: x for x in G.similar_within(relation, group).collect()}
        for n in (2, 3):
            j = [x[3] for x in want if len(x[0]) == len(x[1]) == n]
            assert (found[n].k, found[n].lo, found[n].total, found[n].hi) == (len(j), min(j), approx(sum(j)), max(j))
    assert G.jaccard(relation.limit(0)).count() == 0


def test_pairs_of_few_nests_are_not_made_nest_by_nest(spark):
    relation = spark.range(300).select(F.col("id").alias("array"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("nest"))
    for df in (G.co_occurrence(relation), G.jaccard(relation)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")
        assert df.filter("shared = 40").count() == 300 * 299 // 2
