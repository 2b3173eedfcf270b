import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridlore.llm.context_mixing as m
from gridlore.llm.context_mixing import gram_counts, keyed, packed_lots, score_corpus, train


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(40)]
    return [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(n)]


def test_keys_by_stretches(monkeypatch):
    raw = [b"", b"abc", b"hello there", b"\0\0z"]
    whole = list(keyed(raw))
    monkeypatch.setattr(m, "STRETCH", 3)
    parts = list(keyed(raw))
    for k in (0, 1):
        assert np.concatenate([x[k] for x in parts]).tolist() == whole[0][k].tolist()
    assert len(whole[0][0]) == sum(len(t) + 1 for t in raw)
    assert whole[0][0][1:5].tolist() == [int.from_bytes(x, "big") for x in (b"\0\0\0\0\0a", b"\0\0\0\0ab", b"\0\0\0abc", b"\0\0abc\xff")]


def lots_of(spark, rows, parts=3):
    return packed_lots(spark.createDataFrame(rows, "doc_id long, training boolean, text string").repartition(parts))


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_counts_cover_all_training_texts(spark, monkeypatch, held):
    monkeypatch.setattr(m, "LOT", 300)
    monkeypatch.setattr(m, "HELD", held)
    rows = [(k, k % 4 > 0, t) for k, t in enumerate(texts(1, 50))] + [(50, True, None), (None, True, "")]
    got, rows_of = Counter(), Counter()
    for r in gram_counts(lots_of(spark, rows), 7).collect():
        rows_of[r["bucket"]] += 1
        got.update(dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.uint64).tolist(), strict=True)))
    want = Counter(np.concatenate([k for k, _ in keyed([(t or "").encode() for _, x, t in rows if x])]).tolist())
    assert got == want and set(rows_of.values()) == {1}


def scalar_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def brute_score(mixer, training, text):
    """Bit by bit, with dictionaries instead of tables: bits that the text takes."""
    occurrences = Counter()
    for t in training:
        raw = bytes(5) + t.lower().encode() + b"\xff"
        occurrences.update((raw[k - 5 : k], raw[k]) for k in range(5, len(raw)))
    bucket = lambda c: scalar_mix(int.from_bytes(c[2:], "big")) % mixer.buckets
    sizes = Counter(bucket(c) for c, _ in occurrences)

    def slot(order, context, byte, bit):
        bits = m.SLOT_BITS if order <= m.LOW else max(8, (2 * sizes[bucket(context)]).bit_length())
        h = int.from_bytes(context[5 - order :], "big") * 0x9E3779B97F4A7C15 + ((byte | 256) >> 8 - bit) * 0xC2B2AE3D27D4EB4F + order
        return order, None if order <= m.LOW else bucket(context), bit, scalar_mix(h % 2**64) >> 64 - bits

    counts = {}
    for (context, byte), n in occurrences.items():
        for order in range(1, 6):
            for bit in range(8):
                counts.setdefault(slot(order, context, byte, bit), [0, 0])[byte >> 7 - bit & 1] += n
    raw, total = bytes(5) + text.lower().encode() + b"\xff", 0.0
    for k in range(5, len(raw)):
        for bit in range(8):
            inputs, gate = [1.0], 0
            for order in range(1, 6):
                zeros, ones = counts.get(slot(order, raw[k - 5 : k], raw[k], bit), (0, 0))
                inputs.append(max(-2040, min(2040, round(math.log((ones + 0.4) / (zeros + 0.4)) * 128))) / 128)
                gate = 2 * order + (zeros + ones > 3) if zeros + ones else gate
            odds = sum(x * float(w) for x, w in zip(inputs, mixer.weights[gate + 12 * bit], strict=True))
            odds = max(-12, min(12, odds))
            if abs(odds) < 8:
                at = min(max((odds + 8) * 2, 0), 32 - 1e-4)
                row = mixer.map[(raw[k] | 256) >> 8 - bit]
                odds = (odds + float(row[int(at)]) * (1 - at % 1) + float(row[int(at) + 1]) * (at % 1)) / 2
            total += math.log2(1 + math.exp(-odds if raw[k] >> 7 - bit & 1 else odds))
    return total


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "LOT", 400)
    monkeypatch.setattr(m, "BUCKET", 700)
    kept = {}
    monkeypatch.setattr(m, "train", lambda lots, buckets, own=m.train: kept.setdefault("model", own(lots, buckets)))
    rows = [(k, t) for k, t in enumerate(texts(3, 40))] + [(40, None), (41, "NEW words é"), (None, "abc abd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.score, r.bits_per_byte) for r in score_corpus(df, F.coalesce(F.col("doc_id") % 5, F.lit(1)) == 0).collect()}
    mixer = kept["model"][0]
    assert mixer.buckets > 3 and np.abs(mixer.weights[:, 1:] - 0.35).max() > 0.01
    training = [t or "" for i, t in rows if i is None or i % 5]
    for i, t in rows[::4] + rows[-3:]:
        bits = brute_score(mixer, training, t or "")
        assert got[i][0] == pytest.approx(-bits * math.log10(2), rel=1e-4)
        assert got[i][1] == pytest.approx(bits / (len((t or "").encode()) + 1), rel=1e-4)


def test_probabilities_sum_to_one_and_beat_uniform(spark):
    mixer, grams = train(lots_of(spark, [(k, True, t) for k, t in enumerate(texts(1, 200))]), 5)
    known = {r["bucket"]: (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.uint64).astype(float)) for r in grams.collect()}
    for context in (b"\0\0\0\0\0", b"abcde", b" abc ", b"zzzzz"):
        keys = np.uint64(int.from_bytes(context, "big") << 8) | np.arange(256, dtype=np.uint64)
        tables = mixer.tables(*known.get(int(m._dealt(keys, 5)[1][0]), (keys[:0], np.zeros(0))))
        assert math.isclose(float(np.exp2(-mixer.bits(tables, keys)).sum()), 1, rel_tol=1e-6)
    same = spark.createDataFrame([(k, t) for k, t in enumerate(texts(1, 230))], "doc_id long, text string")
    got = score_corpus(same, F.col("doc_id") >= 200).filter("held_out").collect()
    assert len(got) == 30 and sum(r.bits_per_byte for r in got) / 30 < 2.6


def test_numbers_in_planes():
    x = np.array([0, 1, 255, 256, 2**47 + 3], np.uint64)
    assert m._from_planes(m._planes(x, 6), 6).tolist() == x.tolist() and m._from_ascending(m._ascending(x)).tolist() == x.tolist()
    assert m._from_planes(m._planes(x[:0], 6), 6).tolist() == []


@pytest.mark.parametrize("records", [10_000, 3])
def test_very_long_and_common_words(spark, monkeypatch, records):
    """A word whose rows straddle batches is counted once."""
    monkeypatch.setattr(m, "LOT", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    rows = [(1, "word " * 300_000), (2, "x" * 500_000), (3, " " * 500_000), (4, "word x")]
    try:
        got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.col("doc_id") == 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: (300_001, 300_001, 300_004), 2: (2, 2, 300_004), 3: (1, 1, 300_004), 4: (3, 2, 300_004)}


def test_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "LOT", 500)
    rows = [(k, t.upper() if k % 3 else t) for k, t in enumerate(texts(5, 60))] + [(60, None), (61, ""), (62, "new\x1cword É"), (None, "abc"), (5, "dup"), (5, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as n_tokens").repartition(3)
    got = score_corpus(df, F.coalesce(F.col("doc_id") % 4, F.lit(0)) == 1).collect()
    split = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), None]
    c = Counter(w for i, t in rows if i is None or i % 4 != 1 for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), i is not None and i % 4 == 1, len(split(t)), sum(w in c for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert score_corpus(df.limit(0), F.lit(False)).collect() == []
    (r,) = score_corpus(df, F.lit(True)).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.bits_per_byte == pytest.approx(8, abs=1e-6) and r.held_out


def test_batches_are_bounded_at_every_step(spark, monkeypatch, tmp_path):
    """Many buckets and lots in one task come in batches of a few rows, whatever the caller does with the result."""
    from gridlore.llm import common

    def noted(run):
        name = run.__name__

        def outer(batches):
            def seen():
                for b in batches:
                    with open(f"{tmp_path}/sizes", "a") as f:
                        f.write(f"{name} {b.num_rows} {b.nbytes}\n")
                    yield b

            yield from run(seen())

        return outer

    monkeypatch.setattr(m, "tidy", noted)
    monkeypatch.setattr(m, "LOT", 2000)
    monkeypatch.setattr(m, "BUCKET", 1000)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 14)
    rows = [(k, t) for k, t in enumerate(texts(7, 400))]
    assert score_corpus(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.col("doc_id") % 5 == 0).count() == 400
    sizes = [x.split() for x in (tmp_path / "sizes").read_text().splitlines()]
    assert {"weights", "outcomes", "reply", "run"} <= {x[0] for x in sizes}
    assert max(int(n) for name, _, n in sizes) < 6 << 14, max(sizes, key=lambda x: int(x[2]))


def test_rows_of_lots_lie_in_small_row_groups(spark):
    """Lots of megabytes from one task neither wait in its writer nor come to a reader together."""
    import pyarrow.parquet as pq

    rows = spark.range(24, numPartitions=1).selectExpr("id as doc_id", "true as training", "repeat(sha2(string(id), 512), 50000) as text")
    files = [f.removeprefix("file://") for f in packed_lots(rows).inputFiles()]
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(x.num_rows for x in meta) == 24
    assert max(x.row_group(k).num_rows for x in meta for k in range(x.num_row_groups)) <= 2
