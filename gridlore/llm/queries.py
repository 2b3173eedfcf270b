"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.bpe import encode_decode
from gridlore.llm.context_mixing import score_corpus
from gridlore.llm.exact_dedup import exact_dedup
from gridlore.llm.jaccard import near_duplicates
from gridlore.llm.langid import identify, train
from gridlore.llm.packing import pack
from gridlore.llm.secrets import Scanner
from gridlore.llm.substring_dedup import substring_dedup
from gridlore.llm.suffix_array import suffix_dedup
from gridlore.llm.topk import topk

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(_documents(spark, sf_dir), _remainder(7) == 2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return Scanner.fitted(docs).scan(docs)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify(docs, train(docs.filter(_remainder(5) != 0)))
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir), match=50).drop("kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_text=False)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), window=20).drop("kept")


def queries() -> dict[str, Query]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_secret_scan": op2_secret_scan,
        "op3_language_id": op3_language_id,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_exact_topk": op8_exact_topk,
        "op9_bpe": op9_bpe,
        "op10_substring_dedup": op10_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return {
        "op7_ngram_jaccard": f"""
            WITH RECURSIVE w AS (SELECT doc_id, {words.format(lower)} AS ws FROM documents),
            g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE
                WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
            r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.doc_id)
            SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
        "op10_substring_dedup": f"""
            WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS ws FROM documents),
            w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
            k AS (SELECT doc_id, pos, string_agg(w, ' ') OVER f AS key, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
            o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS rn FROM k WHERE n = 20),
            c AS (SELECT DISTINCT doc_id, pos + t.r AS pos FROM o, range(20) t(r) WHERE rn > 1),
            x AS (SELECT w.doc_id, w.w, w.pos, c.pos IS NOT NULL AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.pos = c.pos),
            y AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY doc_id)
            SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
        "op6_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, {lower} AS norm FROM documents)
            WINDOW g AS (PARTITION BY norm)""",
        "op8_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
                  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY rank <= 10""",
    }
