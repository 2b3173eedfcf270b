import random

import corpus_pipeline
from gridlore.llm import queries


def table(spark, path):
    r = random.Random(5)
    words = {"en": "the of and thing other reading story house river stone".split(), "de": "der die und schön straße haus über nicht wald stein".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "er", "en", "ing"]) for _ in range(n))
    rows = [(k, text(lang := ("en", "de")[k % 2], r.randint(30, 200)), lang, "src0") for k in range(60)]
    near = rows[3][1].split()
    near[10] = "changed"
    long = rows[4][1] + " " + text("en", 300)
    rows += [(100, rows[6][1], "en", "src1"), (101, rows[6][1].upper(), "en", "src1"), (102, " ".join(near), "de", "src2"), (103, None, "en", "src1"), (104, "12 34 !!", "en", "src1")]
    rows += [(105, "password=b7db7aa4a5fcc78305 " + text("en", 60), "en", None), (106, long, None, "src3"), (106, long, None, "src3"), (107, "short", "en", "src4")]
    rows = [(i, t, lang, s, len(t) if t else None, "extra") for i, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = table(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "secrets", "sequences"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    ids = {i for i, *_ in rows}
    assert set(seen[0]) == ids - {103, 104}
    assert set(seen[1]) == set(seen[0]) - {100, 101} and docs.filter("doc_id = 106").count() == 1
    assert set(seen[2]) == set(seen[1]) - {102}
    assert set(seen[3]) == set(seen[2]) and "b7db7aa4" not in seen[3][105]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])


def test_run_and_registration(spark, tmp_path):
    table(spark, str(tmp_path))
    assert queries.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 60
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries() if k.startswith("op")}


def test_null_and_repeated_ids_lose_only_their_own_rows(spark, tmp_path):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("the of and thing other reading story house river stone".split()) + r.choice(["", "er", "en", "ing"]) for _ in range(n))
    known, other, third, unique = text(60), text(60), text(60), text(60)
    near = lambda t: " ".join(["changed" if k == 10 else w for k, w in enumerate(t.split())])
    rows = [(k, text(60)) for k in range(20, 40)] + [(1, known), (None, known.upper()), (None, unique), (None, "12 34 !!")]
    rows += [(2, known), (2, other), (3, third), (3, third), (3, near(other)), (4, near(third)), (4, text(60)), (5, "99 !!"), (5, text(60)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted([x for x in rows if x[1] and any(c.isalpha() for c in x[1])], key=str)
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(sorted([(x.doc_id, x.text) for x in docs.collect()], key=str))
    assert seen[0] == want
    for x in [(None, known.upper()), (2, known), (3, third)]:
        want.remove(x)
    assert seen[1] == want
    for x in [(3, near(other)), (4, near(third))]:
        want.remove(x)
    assert seen[2] == want


def test_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.collect() == [], name
        docs = out if name != "sequences" else docs


def test_long_texts_extra_columns_and_none_missing(spark):
    """Very long texts, columns named like those that operators make, no source and no n_chars, rows without a lang."""
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice("the of and thing other reading story house river stone".split()) + r.choice(["", "er", "en", "ing"]) for _ in range(n))
    rows = [(k, prose(80), "en" if k % 2 else None, k) for k in range(20)] + [(100, prose(60_000), "en", 1), (101, " " * 900_000 + prose(50), "en", 2), (102, "\n" * 300_000, "en", 3), (103, "the " * 200_000, "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, piece long").selectExpr("*", "'c' as component_id", "1 as keep_id", "'t' as _h0x", "0 as score").repartition(3)
    texts = {i: t for i, t, _, _ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()} == {i: t for i, t in texts.items() if i != 102}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {x.doc_id for x in packed} == set(texts) - {102}


def test_the_drivers_heap_is_collected_when_half_full():
    from types import SimpleNamespace

    from gridlore.llm.common import shrink_heap

    for total, want in ((400, 0), (501, 1)):
        calls = []
        heap = SimpleNamespace(totalMemory=lambda total=total: total, maxMemory=lambda: 1000)
        system = SimpleNamespace(gc=lambda calls=calls: calls.append(1))
        shrink_heap(SimpleNamespace(_jvm=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda heap=heap: heap), System=system)))
        assert len(calls) == want


def test_the_drivers_native_memory_is_trimmed(spark, monkeypatch):
    """After each step and after the forest's fit; the JVM of the tests knows the command."""
    from gridlore.llm import common
    from gridlore.llm.secrets import Scanner

    said, own = [], common.trim_native
    monkeypatch.setattr(common, "trim_native", lambda s: said.append(own(s)))
    common.materialise(spark.range(3))
    assert len(said) == 1 and "rim native heap" in said[0]
    Scanner.fitted(spark.createDataFrame([(1, "some words here", "a")], "doc_id long, text string, source string"))
    assert len(said) == 3
