"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first 64 characters, 64-bit hash, id) of the
normalised text, so that a group of equal texts is one stretch of the order however many partitions it
fills, and so that no whole text is ever a splitter on the driver.  Inside a partition Spark's external
sort orders by the full text, equal texts are neighbours, and neighbours are compared in full.  A stretch
that touches a partition's edge is joined with its continuation in the next partition through a summary of
at most a few rows per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import ascii_lower, clears_steps, materialise, tidy

_OUT = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("best", pa.int64()), ("size", pa.int64()), ("edge", pa.bool_()), ("part", pa.string())])


def _runs(keep: str):
    choose = max if keep == "largest" else min

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        part = uuid.uuid4().hex  # names this partition's stretches; a retried task names all of its own anew
        out: list[tuple] = []
        open_runs: list[tuple[str, list]] = []  # runs under the current splitter key
        key, text, first = None, None, True

        def close(edge: bool):
            for sha, ids in open_runs:
                known = [i for i in ids if i is not None]
                best = choose(known) if known else None
                out.extend((i, sha, best, len(ids), edge, part) for i in ids)
            open_runs.clear()

        def flush():
            cols = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
            out.clear()
            return batch

        for b in batches:
            for i, t, p, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "norm", "_p", "_h")), strict=True):
                if (p, h) != key:
                    close(first and key is not None)
                    first = key is None
                    key, text = (p, h), None
                if text is None or t != text:
                    text = t
                    open_runs.append((hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), []))
                open_runs[-1][1].append(i)
                if len(out) >= 20_000:
                    yield flush()
        close(True)
        if out:
            yield flush()

    return scan


@clears_steps
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups texts that are identical after lower-casing A-Z; one row per input row.

    Returns doc_id, keep_id (the id that stays: smallest or largest of the group), group_size, kept,
    text_sha256 (of the normalised UTF-8 text).  Null text counts as empty.  Repeated rows are rows of
    their own: a repeated (id, text) row is kept once for every time its id is the one that stays.  A null
    id counts in the size and never stays unless all are null (keep_id is then null, kept true).  An empty
    table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({"_p": F.substring("norm", 1, 64), "_h": F.xxhash64("norm")})
    ordered = rows.repartitionByRange("_p", "_h", "doc_id").sortWithinPartitions("_p", "_h", "norm", "doc_id")
    found = materialise(ordered.mapInArrow(tidy(_runs(keep)), "doc_id long, text_sha256 string, best long, size long, edge boolean, part string"), "content-sort")
    # stretches at a partition's edge: at most those of two splitter keys per partition
    edges = found.filter("edge").groupBy("text_sha256", "part").agg(F.first("best").alias("best"), F.first("size").alias("size"))
    best = F.max("best") if keep == "largest" else F.min("best")
    edges = edges.groupBy("text_sha256").agg(best.alias("_best"), F.sum("size").alias("_size"), F.count("*").alias("_parts")).filter("_parts > 1").drop("_parts")
    whole = found.join(F.broadcast(edges), "text_sha256", "left")
    whole = whole.withColumns({"keep_id": F.when(F.col("_size").isNull(), F.col("best")).otherwise(F.col("_best")), "group_size": F.coalesce("_size", "size")})
    return whole.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
