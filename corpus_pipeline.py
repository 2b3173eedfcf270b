"""Cleans documents and packs them: language, exact copies, near copies, secrets, sequences.

All stages but the last keep the columns of their input, whatever they are, and decide row by row: rows that share an
id, or have none, never stand for each other.  An empty table stays empty.  Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import ascii_lower, clears_steps, materialise
from gridlore.llm.exact_dedup import exact_dedup
from gridlore.llm.jaccard import SENT_IDS, near_duplicates
from gridlore.llm.langid import explained, train
from gridlore.llm.packing import pack
from gridlore.llm.secrets import Scanner

#: Bits a byte under the best language from which no learnt language explains a text: a uniform guess takes eight.
UNEXPLAINED = 7.0


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that agree with no row of ``gone`` in all its columns; few are sent around, many are joined by a shuffle."""
    gone = materialise(gone.distinct(), "gone")
    keys = gone.select(*(F.col(c).alias(f"_gone{c}") for c in gone.columns))
    same = F.lit(True)
    for c in gone.columns:
        same = same & docs[c].eqNullSafe(F.col(f"_gone{c}"))
    return docs.join(F.broadcast(keys) if gone.count() <= SENT_IDS else keys, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows in a language, as they are: neither without letters nor unexplained by every learnt language.

    Languages are learnt from the rows that have a text and a lang.  Null, empty and letterless texts go; so do all rows
    if no row has a lang, since nothing was learnt that could explain them.  Repeated rows share their fate.
    """
    return explained(docs, train(docs), UNEXPLAINED)


def _halves(sha: Column) -> dict[str, Column]:
    """120 bits of a hash as two numbers."""
    return {f"_h{k}": F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(2)}


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts that are equal but for the case of A-Z; of rows with one id and text,
    one.  Null texts equal empty ones.  Rows without an id stay only in groups where no row has one, and then one of
    each text.  Which of the rows with one id and text stays, where other columns differ, is left open.
    """
    found = materialise(exact_dedup(docs, keep="smallest").select("doc_id", "kept", *(c.alias(k) for k, c in _halves(F.col("text_sha256")).items())), "exact")
    keyed = docs.withColumns(_halves(F.sha2(ascii_lower(F.col("text")), 256)))
    kept = _without(keyed, found.filter("not kept").select("doc_id", "_h0", "_h1"))
    again = found.filter("kept").groupBy("doc_id", "_h0", "_h1").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "_h0", "_h1"]) if again else kept).drop("_h0", "_h1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that near-duplicate links (five words, 0.8) connect.

    Texts without words link with nothing and stay, and so do rows without an id.  Where an id is repeated, its rows are
    linked one by one and the first row of a group, by id and then by text, stays.
    """
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _without(docs, near_duplicates(docs, n=5, num=8, den=10).filter("doc_id <> component_id").select("doc_id"))
    # rows of one id with different texts are linked apart, under numbers of their own
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    known = rows.filter("doc_id is not null")
    linked = near_duplicates(known, n=5, num=8, den=10, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    linked = materialise(linked.join(known.select("_row", "doc_id", F.xxhash64("text").alias("_h")), "_row"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "_h", "_row")).alias("_first"))
    gone = linked.join(first, "component_id").filter("_row <> _first._row").select("_row")
    return _without(rows, gone).drop("_row")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and puts a mark in place of every secret in their texts; n_chars, where there is one, follows.

    Null and empty texts stay as they are.  Without a source column findings have no path.  A secret is replaced wherever
    the same characters stand in its text.
    """
    scanner = Scanner.fitted(docs)
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    clean = docs.withColumn("text", scanner.redacted(F.col("text"), path))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: the columns of ``pack``.  Null and empty texts are one end token;
    repeated rows are documents of their own.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("sequences", sequences),
]

#: SQL can express neither the language models nor the forest.
ORACLE_SQL = None


@clears_steps
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
