"""Exact top-k inner-product search by block-at-a-time pruning.

Rows in id order are cut into blocks of a fixed number of vectors; a block keeps its vectors as whole
numbers (the forward index) and, per term (component), the largest and smallest value.  The sum over terms
of query value times the extreme that helps it bounds every score in the block.  A query visits blocks by
falling bound and stops when the next bound lies below its k-th best score so far; a bound equal to it is
still visited, since a smaller id wins a tie.  Queries come in chunks of bounded size; one at a time is sent to
all blocks and its hits are written, so that neither queries nor vectors need fit one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import clears_steps, materialise, materialised_all, tidy

#: Vectors of a block, and bytes of a chunk of queries as it is broadcast.
BLOCK, CHUNK_BYTES = 128, 16 << 20
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id and q, the components scaled (their floor is taken when they are read); rows without an id or with unusable components are left out."""
    x = F.col(vec_col)
    unusable = F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~unusable)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double") * F.lit(float(scale))).alias("q"))


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of whole numbers; missing components of shorter vectors are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    dim = max([dim or 0, *sizes.tolist()])
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def block_index(rows: DataFrame) -> DataFrame:
    """One row per block of at most BLOCK vectors: ids, forward index, largest and smallest value per term."""
    schema = pa.schema([(c, pa.binary()) for c in ("ids", "forward", "most", "least")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0).to_numpy(), b.column(1)
            out = []
            for lo in range(0, len(ids), BLOCK):
                m = _matrix(column.slice(lo, BLOCK))
                out.append((ids[lo : lo + BLOCK].astype("<i8").tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)

    ordered = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ordered.mapInArrow(tidy(cut), "ids binary, forward binary, most binary, least binary")


class _Best:
    """The k best of each query so far, and the search over one lot of blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def visit(self, blocks: list[tuple[np.ndarray, ...]]) -> int:
        """Returns how many (query, block) pairs were scored."""
        dim = max([self.q.shape[1], *(f.shape[1] for _, f, _, _ in blocks)])
        pad = lambda a: np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, dim - a.shape[-1])])
        q = pad(self.q)
        most, least = np.array([pad(m) for _, _, m, _ in blocks]), np.array([pad(m) for _, _, _, m in blocks])
        reach = np.abs(q).max(initial=0) * max(np.abs(most).max(initial=0), np.abs(least).max(initial=0)) * max(dim, 1)
        if reach >= _EXACT:
            return self._exactly(q, [(i, pad(f)) for i, f, _, _ in blocks])
        bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
        order = np.argsort(-bound, axis=1, kind="stable")
        going, scored = np.arange(len(q)), 0
        for turn in range(len(blocks)):
            at = order[going, turn]
            going = going[keep := bound[going, at] >= self.score[going, -1]]
            at = at[keep]
            if not len(going):
                break
            for b in np.unique(at):
                rows = going[at == b]
                self._offer(rows, q[rows] @ pad(blocks[b][1]).T, blocks[b][0])
                scored += len(rows)
        return scored

    def _offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.where(ids[None, :] == self.ids[rows, None], -np.inf, score)
        better = score.max(1, initial=-np.inf) >= self.score[rows, -1]
        rows, score = rows[better], score[better]
        score = np.concatenate([self.score[rows], score], 1)
        vec = np.concatenate([self.vec[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        vec = np.where(np.isneginf(score.astype(float)), np.iinfo(np.int64).max, vec)
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)

    def _exactly(self, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Values too large for doubles: whole numbers of any size, without bounds."""
        whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
        self.score, q = self.score.astype(object), whole(q)
        for ids, f in blocks:
            self._offer(np.arange(len(q)), q @ whole(f).T, ids)
        return len(q) * len(blocks)


@clears_steps
def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k vectors of highest whole-number inner product for each query, its own id left out.

    Components become floor(scale * x).  Returns query_id, rank (from 1), vec_id, score (long); ties go to
    the smaller vec_id; fewer rows if there are fewer candidates.  Rows with null id, null vector or null or
    non-finite components take no part; shorter vectors count as padded with 0.  Repeated rows are candidates
    of their own; of several queries with one id the smallest vector is asked.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    blocks = materialise(block_index(quantised(vectors, id_col, vec_col, scale)), "blocks")
    asked = materialise(quantised(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    n, dim = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    chunks = max(1, -(-n * max(dim or 1, 1) * 8 // CHUNK_BYTES))

    def search(asked_ids, asked_q):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(asked_ids.value, asked_q.value, k)
            if not len(best.ids):
                return
            for b in batches:
                lot = []
                for ids, forward, most, least in zip(*(b.column(c).to_pylist() for c in ("ids", "forward", "most", "least")), strict=True):
                    ids = np.frombuffer(ids, "<i8")
                    lot.append((ids, np.frombuffer(forward).reshape(len(ids), -1), np.frombuffer(most), np.frombuffer(least)))
                best.visit(lot)
            rows, cols = np.nonzero(best.vec != np.iinfo(np.int64).max)
            score = [int(x) for x in best.score[rows, cols]]
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[rows]), pa.array(best.vec[rows, cols]), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        return run

    def hits() -> Iterator[DataFrame]:
        for c in range(chunks):
            part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow()
            ids, q = part.column("vec_id").to_numpy(), _matrix(part.column("q").combine_chunks()) if part.num_rows else np.zeros((0, 0))
            sent = spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(q)
            yield blocks.mapInArrow(tidy(search(*sent)), "query_id long, vec_id long, score long")
            for x in sent:  # its hits are written by now
                x.destroy()

    found = materialised_all(hits(), "hits")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
