import numpy as np
import pytest

from gridlore.llm.topk import _Best, topk


def brute(rows, asked, k):
    q = {i: np.floor(np.array(v, float) * 1024).astype(object) for i, v in rows}
    out = []
    for i in asked:
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(q[i], w, strict=False))), j) for j, w in q.items() if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1e8])
def test_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    m = np.float32(rng.normal(size=(700, 8)) * (1 + rng.integers(3, size=(700, 1)))) * np.float32(1e-2 if scale > 1 else 1)
    m[100:140] = m[100]  # ties
    rows = [(i, [float(x) * (scale if scale > 1 else 1) / (scale if scale > 1 else 1) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk(df, df.filter("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, range(0, 700, 50), 5)


def test_chunks_of_queries_and_repeated_ones(spark, monkeypatch):
    """Queries that fill many chunks; of query rows with one id the smallest vector is asked, and only that."""
    import gridlore.llm.topk as m

    monkeypatch.setattr(m, "CHUNK_BYTES", 256)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    twice = df.filter("vec_id % 10 = 0").unionByName(spark.createDataFrame([(10, [9.0] * 6)], "vec_id long, embedding array<float>"))
    got = topk(df, twice, 4).collect()
    asked = {**dict(rows), 10: min(dict(rows)[10], [9.0] * 6)}
    assert sorted(tuple(r) for r in got if r.query_id != 10) == brute(rows, [i for i in range(0, 300, 10) if i != 10], 4)
    assert asked[10] == dict(rows)[10] and sorted(tuple(r) for r in got if r.query_id == 10) == brute(rows, [10], 4)


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(50):
        f = np.floor(rng.normal(size=(64, 4)) * 10 + 1000 * (b == 7))
        blocks.append((np.arange(b * 64, b * 64 + 64), f, f.max(0), f.min(0)))
    best = _Best(np.array([-1]), np.ones((1, 4)), 10)
    assert best.visit(blocks) == 1 and (best.vec[0] // 64 == 7).all()


def test_huge_values_stay_exact():
    f = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    best = _Best(np.array([9]), np.array([[2.0**30, 1.0]]), 2)
    best.visit([(np.array([0, 1]), f, f.max(0), f.min(0))])
    assert best.vec.tolist() == [[1, 0]] and int(best.score[0, 0]) == 2**70 + 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk(df.selectExpr("*", "vec_id as rank", "'x' as score"), df.filter("vec_id = 0"), 10).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 6, 2 << 20), (0, 2, 6, 2 << 20), (0, 3, 5, 1 << 20), (0, 4, 7, 0)]
    assert topk(df.limit(0), df.limit(0)).collect() == []
