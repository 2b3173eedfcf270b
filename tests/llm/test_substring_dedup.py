import hashlib
import random
import re

import pytest

from gridlore.llm import substring_dedup as module
from gridlore.llm.substring_dedup import SubstringIndex, remove, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, docs=120):
    r = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 70))] for _ in range(6)]
    rows = []
    for k in range(docs):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 10)
            at = r.randint(0, len(w))
            w[at:at] = p[cut : len(p) - r.randint(0, 10)]
        if r.random() < 0.1:
            w = ["same"] * r.randint(10, 90)
        if rows and r.random() < 0.1:
            w = WORD.findall(r.choice(rows)[1])
        rows.append((k * 2, r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize(("window", "gram", "batches"), [(20, 8, 2), (20, 8, 1), (6, 3, 3), (5, 5, 2)])
def test_against_brute_force(spark, window, gram, batches):
    rows = corpus(window + batches)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as kept").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window, gram, batches).collect()}
    want = brute(rows, window)
    assert got == want and sum(v[1] for v in want.values()) > 100


@pytest.mark.parametrize(("records", "heads"), [(2, 1 << 16), (3, 1 << 16), (2, 2)])
def test_entries_of_one_gram_straddle_arrow_batches(records, heads, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "HEADS", heads)
    # n-gram 1: three old classes, then a new one; n-gram 2: old classes only; n-gram 3: new ones only
    rows = [(1, s, 0, 0, s, 0, 1, False) for s in (10, 20, 30)] + [(1, 40, 0, 1, 90, 0, 1, False)]
    rows += [(2, s, 0, 0, s, 5, 1, False) for s in (10, 20, 30)] + [(3, s, 0, 1, 90 + s, 5, 1, False) for s in (10, 20)] + [(4, 10, 0, 1, 95, 7, 1, False)]
    names = ("anchor", "span", "off", "seq", "doc_id", "start", "n", "gone")
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + records]]) for k in range(0, len(rows), records)]
    out = [r for b in module._merge(1)(iter(batches)) for r in b.to_pylist()]
    got = sorted((r["anchor"], r["span"], r["ask"]) for r in out if heads > 2 or r["anchor"] != 2)
    assert got == [(1, 10, True), (1, 20, True), (1, 30, True), (1, 40, True), (3, 10, True), (3, 20, True), (4, 10, False)]


@pytest.mark.parametrize("records", [2, 3])
def test_small_arrow_batches_against_brute_force(spark, records):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        rows = corpus(17)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 8, 4, 2).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == brute(rows, 8)


def test_many_batches_compact(spark):
    rows = corpus(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, repeats = SubstringIndex(spark, 8, 4, fan=2), None
    for low in range(0, 120, 30):
        found = index.add(df.filter(f"doc_id >= {low} and doc_id < {low + 30}"), df.filter(f"doc_id < {low + 30}"))
        repeats = found if repeats is None else repeats.unionByName(found)
    assert [level for level, _ in index.runs] == [2]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove(df, repeats, 8).collect()}
    assert got == brute(rows, 8)


def test_odd_tables(spark):
    long = " ".join(map(str, range(5000)))
    rows = [(3, None), (4, ""), (5, " \n"), (6, "a b"), (None, long), (7, long), (7, long), (8, long + " z")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 2, 0), (None, 5000, 0), (7, 5000, 0), (7, 5000, 0), (8, 5001, 5000)], key=str)
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_words_of_cancelling_patterns_stay_apart(spark):
    """Words that collide under any polynomial with an odd base modulo a power of two are different words."""
    bits = [0]
    for _ in range(10):
        bits += [1 - x for x in bits]
    frame = lambda pair: " ".join([f"w{k}" for k in range(12)] + ["".join(pair[b] for b in bits)] + [f"v{k}" for k in range(12)])
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame([(1, frame("ab")), (2, frame("ba")), (3, frame("ab"))], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 25}
