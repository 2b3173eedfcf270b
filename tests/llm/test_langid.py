import math
import random

import numpy as np
import pytest

import gridlore.llm.langid as m
from gridlore.llm.langid import count_grams, identify, train


def brute_bits(training: list[str], text: str) -> float:
    """Code length by walking down from the longest context, byte by byte."""
    counts: dict[tuple, dict[int, int]] = {}
    seq = lambda t: [0] * 3 + list(t.encode())
    for t in training:
        s = seq(t)
        for i in range(3, len(s)):
            for k in range(4):
                counts.setdefault(tuple(s[i - k : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - k : i])][s[i]] += 1
    s, bits = seq(text), 0.0
    for i in range(3, len(s)):
        for k in (3, 2, 1, 0):
            if c := counts.get(tuple(s[i - k : i])):
                total = sum(c.values()) + len(c)
                if s[i] in c:
                    bits += math.log2(total / c[s[i]])
                    break
                bits += math.log2(total / len(c))
        else:
            bits += 8
    return bits


def words(seed, letters, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(30)) for _ in range(n)]


def test_code_lengths_against_brute_force(spark):
    a, b = words(1, "abcdéß", 20), words(2, "cdefñ", 20)
    trees = train(spark.createDataFrame([("A", t) for t in a] + [("B", t) for t in b] + [(None, "zz"), ("C", None)], "lang string, text string"))
    assert trees.langs == ["A", "B"]
    texts = ["", "abc", "zz top é", a[0], b[3] + "\0?", "x" * 7]
    got = trees.code_lengths([t.encode() for t in texts])
    want = np.array([[brute_bits(a, t), brute_bits(b, t)] for t in texts])
    assert np.allclose(got, want, rtol=1e-5)


def test_stretches_of_long_texts(spark, monkeypatch):
    trees = train(spark.createDataFrame([("A", "abc abd")], "lang string, text string"))
    texts = [b"abc", b"", b"ab d" * 50, b"q"]
    want = trees.code_lengths(texts)
    whole = m.grams
    monkeypatch.setattr(m, "grams", lambda texts, stretch=7: whole(texts, 7))
    assert np.allclose(trees.code_lengths(texts), want, rtol=1e-5)


def test_held_out_accuracy(spark):
    rows = [("x", t) for t in words(1, "abcdeé", 60)] + [("y", t) for t in words(2, "defghñ", 60)]
    trees = train(spark.createDataFrame(rows[::2], "lang string, text string"))
    names, scores, _ = trees.predict([t for _, t in rows[1::2]])
    assert names == [x for x, _ in rows[1::2]] and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("learn", [True, False])
def test_odd_rows(spark, learn):
    trees = train(spark.createDataFrame([("A", "hello there")] if learn else [], "lang string, text string"))
    rows = [(1, None), (2, ""), (3, "123 !?_ \u00bd \u00b2 \u2460 \u2167"), (4, "hello"), (4, "hello"), (None, "日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang_pred", "1 as score")
    got = {r.doc_id: r.lang_pred for r in identify(df, trees).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "A" if learn else "und", None: "A" if learn else "und"}
    assert identify(df, trees).count() == 6 and identify(df.limit(0), trees).count() == 0


def test_pruned_trees_escape_to_shorter_contexts(spark, monkeypatch):
    rows = [("A", t) for t in words(1, "abcdé", 40)] + [("B", t) for t in words(2, "defñ", 40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    full = train(df)
    monkeypatch.setattr(m, "CELLS", 100)
    small = train(df)
    assert len(full.levels[3][0]) > 300 and all(len(level[0]) <= 50 for level in small.levels)
    assert small.predict([t for _, t in rows])[0] == [x for x, _ in rows]


def test_very_long_text(spark):
    trees = train(spark.createDataFrame([("A", "abc abd"), ("B", "xyz yzx")], "lang string, text string"))
    df = spark.createDataFrame([(1, "abc " * 1_000_000), (2, " " * 3_000_000), (3, "zyx" * 700_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(df, trees).collect()} == {1: "A", 2: "und", 3: "B"}


def test_counts_cover_all_rows(spark):
    df = spark.createDataFrame([("A", "ab")] * 500, "lang string, text string").repartition(3)
    assert {r.n for r in count_grams(df, "lang", "text").collect()} == {500}


def test_pages_hold_all_strings(spark, monkeypatch):
    rows = [(k, x, t) for k, (x, t) in enumerate([("A", t) for t in words(1, "abcdé", 40)] + [("B", t) for t in words(2, "defñ", 40)])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    full = train(df)
    texts = [t.encode() for _, _, t in rows] + ["fade éa zzz ñab".encode(), b""]
    want, found = full.code_lengths(texts), identify(df, full, more=True).collect()
    monkeypatch.setattr(m, "CELLS", 100)
    small = train(df)
    assert len(small.levels) > len(full.levels) == 4
    assert sum(len(page[0]) for page in small.levels) == sum(len(page[0]) for page in full.levels)
    assert np.allclose(small.code_lengths(texts), want, rtol=1e-6)
    assert sorted(identify(df, small, more=True).collect()) == [approx_row(r) for r in sorted(found)]


def approx_row(r):
    return r.doc_id, r.lang_pred, pytest.approx(r.score), pytest.approx(r.bits_per_byte)
