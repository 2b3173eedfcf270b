"""Best-fit packing of token sequences.

The lengths' histogram (at most one bin per length up to the capacity, however many documents there are)
is all that the driver sees.  A configuration is a multiset of lengths that fits one sequence.  The
configuration linear program is solved by multiplicative weights: lengths whose demand lags are priced up,
a knapsack dynamic program finds the best configuration at these prices, and whole multiples of it are taken
until it runs out of one of its lengths, so that there are hardly more rounds than lengths.  What cannot fill a
sequence any more goes by best fit, longest first, over groups of equal sequences.  Every piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.bpe import byte_letters
from gridlore.llm.common import clears_steps, materialise, process_cache, tidy

#: Rounds of multiplicative weights at most, the weights' rate, what the longest piece is worth more by token than the
#: shortest, and the part of a sequence that a configuration may leave empty.
ROUNDS, RATE, LONG, SLACK = 3000, 0.1, 0.2, 32

#: Long runs of white space, as the vocabulary's splitter has it.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_encoding(path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary file as ranks: ids follow the order of merges."""
    store = process_cache("encodings")
    if path not in store:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(back.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
        # fixed pattern of this vocabulary family's splitter
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        store[path] = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return store[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.string()), ("rank", pa.int64())])


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text.  Its pattern goes back over a run of white space, whose depth is bounded: a long run's
    characters but the last, which belongs to what follows, are one piece and are merged by themselves."""
    out, at = [], 0
    for run in _WHITE.finditer(text):
        end = run.end() - (run.end() < len(text) and not text.startswith(tuple(enc.special_tokens_set), run.end()))
        out.append(enc.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        out.append(np.array(enc._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    out.append(enc.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out) if len(out) > 1 else out[0]


def cut(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, part, seen = byte_encoding(vocabulary), uuid.uuid4().hex, np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(enc, text).astype("<u4"), np.uint32(0))
                at, piece = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % capacity + 1
                    rows.append((i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    at, piece = at + n, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    texts = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return texts.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part string, rank long")


def best_configuration(price: np.ndarray, capacity: int) -> list[int]:
    """Unbounded knapsack: the lengths of the most valuable multiset that fits."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = value[::-1]  # back[capacity - c + l] is value[c - l]
    for c in range(1, capacity + 1):
        total = price[1 : c + 1] + back[capacity - c + 1 :]
        k = int(total.argmax())
        if total[k] > value[c - 1]:
            value[c], last[c] = total[k], k + 1
        else:
            value[c] = value[c - 1]
    out, c = [], capacity
    while c:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that place every piece of the histogram once.

    The work depends on the number of different lengths and of rounds, not on the number of pieces.
    """
    want = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        want[length] = n
    plan: list[tuple[list[int], int]] = []
    if want[capacity]:
        plan.append(([capacity], int(want[capacity])))
        want[capacity] = 0
    size = np.arange(capacity + 1)
    value = size * (1 + LONG * size / capacity)
    left, need = want.copy(), np.maximum(want, 1)
    for _ in range(rounds):
        weight = np.exp(RATE * (left / need - left.sum() / max(1, want.sum())))  # lagging lengths weigh more
        plenty = left * size > capacity - size  # what is rarer than that fills up below
        take = np.bincount(best_configuration(np.where(plenty, value * weight, 0.0), capacity), minlength=capacity + 1)
        room = capacity - int((take * size).sum())
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] > take[: room + 1])
            if not len(fits):
                break
            take[fits[-1]] += 1
            room -= int(fits[-1])
        if room > capacity // SLACK:
            break  # too little is left to fill a sequence with
        used = np.flatnonzero(take)
        times = int((left[used] // take[used]).min())
        plan.append(([int(x) for x in np.repeat(used, take[used])], times))
        left -= take * times
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, of ``left[length]`` pieces each, over groups of sequences with the same content: a
    length changes groups as wholes and parts one of them at most, however many pieces there are."""
    groups: dict[int, list[tuple[list[int], int]]] = {}  # by room left
    closed: list[tuple[list[int], int]] = []

    def put(room: int, content: list[int], n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((content, n))
        elif n:
            closed.append((content, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in sorted(r for r in groups if r >= length):
            copies, open_ = room // length, groups.pop(room)
            while open_ and n:
                content, m = open_.pop()
                whole = min(m, n // copies)
                put(room - copies * length, content + [length] * copies, whole)
                n, m = n - whole * copies, m - whole
                if m and n:  # fewer than a sequence takes
                    put(room - n * length, content + [length] * n, 1)
                    n, m = 0, m - 1
                if m:
                    open_.append((content, m))
            for content, m in open_:
                put(room, content, m)
            if not n:
                break
        copies = capacity // length
        put(capacity - copies * length, [length] * copies, n // copies)
        put(capacity - n % copies * length, [length] * (n % copies), 1 if n % copies else 0)
    return closed + [g for room in groups.values() for g in room]


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: slots before each use of a configuration, its first sequence, copies in it, first offset."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, times in plan:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            copies = lengths.count(x)
            by.setdefault(x, []).append((copies * times, first, copies, offset))
            offset += copies * x
        first += times
    out = {}
    for x, uses in by.items():
        slots, seq, copies, offset = np.array(uses, np.int64).T
        out[x] = (np.concatenate([[0], np.cumsum(slots)[:-1]]), seq, copies, offset)
    return out


@clears_steps
def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's tokens, followed by id 0, into sequences of at most ``capacity`` tokens.

    Only longer documents are cut, the remainder first.  Returns per piece: doc_id, piece (from 0), start
    (ids of its document before it), length, ids_crc32, sequence_id, offset (gapless from 0 in a sequence).
    Null and empty texts are one piece of the single id 0; texts are taken whole, however long they or their
    runs of white space are.  Pieces of equal length may change places in ties.  Repeated rows and null ids are documents of
    their own; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, vocabulary, capacity, id_col, text_col), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(solve(histogram, capacity)))  # bounded by the capacity and ROUNDS
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(at):
                    continue
                length = int(lengths[at[0]])
                slots, first, copies, offset = plan.value[length]
                k = np.searchsorted(slots, rank[at], side="right") - 1
                q, copy = np.divmod(rank[at] - slots[k], copies[k])
                seq[at], off[at] = first[k] + q, offset[k] + copy * length
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
