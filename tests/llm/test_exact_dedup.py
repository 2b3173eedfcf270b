import hashlib
import random

import pytest

from gridlore.llm.exact_dedup import exact_dedup


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        known = [x for x in ids if x is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out.append((i, best, len(ids), i == best, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, keep):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, keep=keep).collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    r = random.Random(4)
    rows = [(k, r.choice(["", "a", "A", "É", "é", "same start " * 10 + str(k % 7), "İstanbul", "ẞ"]) + r.choice(["", " x", "\n"])) for k in range(400)]
    rows += [(500, None), (None, "a"), (None, None), (None, "alone"), (None, "alone"), (7, "a"), (7, "a"), (7, "other")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as keep_id", "0 as _h", "1 as best").repartition(5)
    assert found(df, keep) == brute(rows, keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_a_group_over_many_partitions(spark, keep):
    """Two thirds of the rows are one text, so that every splitter lies inside its stretch; its neighbours share 64 characters."""
    text = "z" * 64
    rows = [(k, text if k % 3 else text + str(k % 5)) for k in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), keep) == brute(rows, keep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_hashes_do_not_make_equal_texts(spark, monkeypatch):
    """Texts that agree in their first 64 characters and (here made to) in their hash are compared in full."""
    import gridlore.llm.exact_dedup as m

    monkeypatch.setattr(m.F, "xxhash64", lambda *c: m.F.lit(1).cast("long"))
    rows = [(k, "p" * 64 + str(k % 11)) for k in range(200)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "smallest") == brute(rows, "smallest")


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "x" * 2_000_000), (2, "X" * 2_000_000), (3, "x" * 1_999_999), (4, " " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, "largest") == brute(rows, "largest")
    assert exact_dedup(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="smallest"):
        exact_dedup(df, keep="first")
