import random
import re

import pytest

import gridlore.llm.jaccard as m
from gridlore.llm.components import components
from gridlore.llm.jaccard import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, docs=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    line = [r.choice(vocabulary) for _ in range(12)]
    out = []
    for _ in range(docs):
        if out and r.random() < 0.6:
            w = r.choice(out[-20:])[:]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = line + [r.choice(vocabulary) for _ in range(r.randint(1, 80))]
        out.append(w)
    return [(k * 3 + 1, r.choice([" ", "\n", "\t "]).join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("n", "num", "den", "cut"), [(3, 90, 100, 2048), (5, 8, 10, 2048), (3, 90, 100, 4)])
def test_against_brute_force(spark, monkeypatch, n, num, den, cut):
    monkeypatch.setattr(m, "LIST", cut)
    monkeypatch.setattr(m, "CELL", cut * 40)
    rows = corpus(n + cut) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, "é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "0 as size", "1 as component_id").repartition(4)
    want = brute(rows, n, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, n, num, den).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 20


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert near_duplicates(df.limit(0)).collect() == []


def thue_morse(k):
    out = [0]
    for _ in range(k):
        out += [1 - x for x in out]
    return out


def test_long_words_of_cancelling_patterns_stay_apart(spark):
    """Words of 64 to 1,024 letters that collide under any polynomial with an odd base modulo a power of two."""
    rows = []
    for k in (6, 8, 10):
        for pair in ("ab", "ba"):
            words = [f"w{x}" for x in range(12)] + ["".join(pair[b] for b in thue_morse(k))] + [f"v{x}" for x in range(12)]
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {i: i for i, _ in rows}


def test_large_group_of_near_copies_is_tied(spark, monkeypatch):
    """One group far beyond a list's part: the same components as by brute force."""
    monkeypatch.setattr(m, "LIST", 16)
    monkeypatch.setattr(m, "CELL", 2000)
    r = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(100)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)


def test_chain_components(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
