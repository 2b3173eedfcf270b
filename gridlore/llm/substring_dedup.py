"""Incremental substring deduplication with a log-structured fingerprint index.

A window is ``window`` consecutive words.  Every window elects one of its short n-grams, the one of least
fingerprint; neighbouring windows that elect the same n-gram form one entry: the n-gram's fingerprint, the
fingerprint of all words that the entry's windows cover, and its place.  So equal windows always meet under
one n-gram, with a seventh of the entries that windows would take.

The index is a list of immutable runs, sorted by fingerprint.  A new batch's entries are brought into the
same order and merged with the runs.  Entries that agree in n-gram, covered words and position of the
n-gram hold the same windows: all but the earliest go.  Where entries under one n-gram differ, their
windows are verified from the texts: two independent 64-bit fingerprints of their words' bytes, and only those
that agree in both count as equal.  What remains of the batch is a new run; runs of like size are compacted into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import clears_steps, materialise, tidy
from gridlore.llm.words import Words, joined, lots, mix, sequences

#: Bytes of per-document lists that are sent to all executors at once; more are joined by a shuffle.
SENT_BYTES = 128 << 20
#: First rows of one n-gram's classes that wait for a row of the batch.
HEADS = 1 << 16
#: Seed of the second fingerprint of words, which shares nothing with the first but the bytes.
OTHER = np.uint64(0x5851F42D4C957F2D)
_KINDS = {"anchor": pa.int64(), "span": pa.int64(), "off": pa.int32(), "n": pa.int32(), "doc_id": pa.int64(), "start": pa.int64(), "gone": pa.bool_()}
_DDL = "anchor long, span long, off int, n int, doc_id long, start long, gone boolean"


def _batch(kinds: dict, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in kinds.items()], names=list(kinds))


def entries(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For all texts: text number, n-gram and covering fingerprint, n-gram's offset, number of windows, first window."""
    w = Words(texts)
    reach = window - gram + 1
    grams = sequences(w.hash, gram)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    last = w.first[1:][owner] - window  # the last window of the word's own text
    at = np.flatnonzero(np.arange(len(owner)) <= last)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    least, have = grams, 1
    while 2 * have <= reach:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    least = np.minimum(least[: len(grams) - reach + 1], least[reach - have :][: len(grams) - reach + 1])[at]
    place = at.copy()
    for k in range(reach - 1, -1, -1):  # the leftmost of equal ones
        place = np.where(grams[at + k] == least, at + k, place)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[at[1:]] != owner[at[:-1]])]))
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    text = owner[first]
    # at most ``reach`` windows share an n-gram's place: the first and the last one cover all words between them
    whole = sequences(w.hashed(OTHER), window)
    span = joined(whole[first], whole[first + count - 1]) + count.astype(np.uint64)
    return text, grams[place[head]], span, place[head] - first, count, first - w.first[text]


def _tell_apart(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Marks as gone what repeats an earlier entry of this lot: only the earliest need meet the others."""
    order = np.lexsort((cols["start"], cols["doc_id"], cols["off"], cols["span"], cols["anchor"]))
    cols = {c: v[order] for c, v in cols.items()}
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in ("anchor", "span", "off"):
        same[1:] &= cols[c][1:] == cols[c][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    own = (cols["doc_id"] == cols["doc_id"][head]) & (cols["start"] == cols["start"][head])
    gone = same & ~own
    keep = gone | ~same  # a repeated row of the same id adds nothing
    # what is gone needs no partner: it is spread by its place instead of its fingerprint
    spread = mix(cols["doc_id"].astype(np.uint64) * np.uint64(31) + cols["start"].astype(np.uint64)).view(np.int64)
    return {c: v[keep] for c, v in (cols | {"anchor": np.where(gone, spread, cols["anchor"]), "gone": gone}).items()}


def _map_entries(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            for ids, raw in lots(b.column(0), b.column(1)):
                text, anchor, span, off, n, start = entries(raw, window, gram)
                held.append({"anchor": anchor.view(np.int64), "span": span.view(np.int64), "off": off.astype(np.int32), "n": n.astype(np.int32), "doc_id": np.array(ids, np.int64)[text], "start": start})
            if sum(len(x["n"]) for x in held) > 1 << 20:
                yield _batch(_KINDS, _tell_apart({c: np.concatenate([x[c] for x in held]) for c in held[0]}))
                held = []
        if held:
            yield _batch(_KINDS, _tell_apart({c: np.concatenate([x[c] for x in held]) for c in held[0]}))

    return run


def _merge(batch: int):
    """Walks entries sorted by (anchor, span, off, seq, doc_id, start).  Keeps back the first rows of the last n-gram's
    classes while it has one class only or no row of the batch: whether they are asked is open until then.  Beyond
    HEADS of them they are asked at once, which adds work but no result."""
    names = ("anchor", "span", "off", "seq", "doc_id", "start", "n", "gone")
    kinds = {"anchor": pa.int64(), "span": pa.int64(), "off": pa.int32(), "n": pa.int32(), "doc_id": pa.int64(), "start": pa.int64(), "gone": pa.bool_(), "ask": pa.bool_(), "seq": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, sent = None, False  # sent: only the last class's first row is kept, and all before it were asked

        def out(x, keep):
            keep = keep & ((x["seq"] == batch) | x["ask"])
            return _batch(kinds, {c: x[c][keep] for c in kinds})

        for b in batches:
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            through = x["gone"]  # told apart before; only passes through
            if through.any():
                yield out({c: v[through] for c, v in x.items()} | {"ask": np.zeros(int(through.sum()), bool)}, np.ones(int(through.sum()), bool))
                x = {c: v[~through] for c, v in x.items()}
            if not len(x["n"]):
                continue
            if back is not None:
                x = {c: np.concatenate([back[c], x[c]]) for c in names}
            rows = len(x["n"])
            new_anchor = np.concatenate([[True], x["anchor"][1:] != x["anchor"][:-1]])
            new_class = new_anchor | np.concatenate([[True], (x["span"][1:] != x["span"][:-1]) | (x["off"][1:] != x["off"][:-1])])
            group = np.cumsum(new_anchor) - 1
            mixed = np.bincount(group, new_class) > 1
            touched = np.bincount(group, x["seq"] == batch) > 0
            if sent:
                mixed[0] = touched[0] = True
            asked = mixed & touched
            last = np.flatnonzero(new_class & (group == group[-1]))
            asked[-1] |= len(last) > HEADS
            head = np.maximum.accumulate(np.where(new_class, np.arange(rows), 0))
            same = (x["seq"] == x["seq"][head]) & (x["doc_id"] == x["doc_id"][head]) & (x["start"] == x["start"][head])
            gone = ~same
            x["gone"], x["ask"] = gone, asked[group] & ~gone
            keep = new_class | gone
            if sent:
                keep[0] = False
            sent = bool(asked[-1])
            if sent:
                last = last[-1:]
            else:
                keep[last] = False
            yield out(x, keep)
            back = {c: x[c][last] for c in names}
        if back is not None and not sent:
            yield out(back | {"ask": np.zeros(len(back["n"]), bool)}, np.ones(len(back["n"]), bool))

    return run


def _merged(rows: DataFrame, batch: int) -> DataFrame:
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "span", "off", "seq", "doc_id", "start")
    return ordered.select("anchor", "span", "off", "seq", "doc_id", "start", "n", "gone").mapInArrow(tidy(_merge(batch)), _DDL + ", ask boolean, seq int")


def per_document(rows: DataFrame) -> DataFrame:
    """(doc_id, starts, ns): the runs of windows that each document's (start, n) make together."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = [], []
            for starts, ns in zip(b.column("starts").to_pylist(), b.column("ns").to_pylist(), strict=True):
                lo, hi = [], []
                for s, n in sorted(zip(starts, ns, strict=True)):
                    if lo and s <= hi[-1]:
                        hi[-1] = max(hi[-1], s + n)
                    else:
                        lo.append(s)
                        hi.append(s + n)
                first.append(lo)
                last.append([y - x for x, y in zip(lo, hi, strict=True)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(first, kind), pa.array(last, kind)], names=["doc_id", "starts", "ns"])

    listed = rows.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    return listed.mapInArrow(tidy(join), "doc_id long, starts array<long>, ns array<long>")


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Joins per-document lists to texts: sent to all executors if their counted size allows, else by a shuffle."""
    lists = [F.size(c) for c, t in places.dtypes if t.startswith("array")]
    size = places.select(F.sum(32 + 8 * sum(lists[1:], lists[0]))).first()[0] or 0
    return docs.join(F.broadcast(places) if size <= SENT_BYTES else places, "doc_id", how)


class SubstringIndex:
    """Runs of entries.  ``add`` takes batches in their order of precedence."""

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 8, fan: int = 4):
        if not 1 <= gram <= window or fan < 2:
            raise ValueError("1 <= gram <= window and fan >= 2 are asked for")
        self.spark, self.window, self.gram, self.fan = spark, window, gram, fan
        self.runs: list[tuple[int, DataFrame]] = []  # (level, sorted entries)
        self.batches = 0

    def add(self, batch: DataFrame, known: DataFrame) -> DataFrame:
        """Indexes a batch (doc_id, text) and returns the words that its windows repeat: doc_id, start, n windows.

        Of equal windows the earliest stays: earlier batch, then smaller doc_id, then earlier start.
        ``known`` has the texts of all batches, this one included.
        """
        seq, self.batches = self.batches, self.batches + 1
        new = batch.filter("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(_map_entries(self.window, self.gram)), _DDL).withColumn("seq", F.lit(seq))
        rows = new
        for _, run in self.runs:
            rows = rows.unionByName(run)
        merged = materialise(_merged(rows, seq), "merged")
        own = merged.filter(F.col("seq") == seq)
        repeats = own.filter("gone").select("doc_id", "start", "n").unionByName(self._by_window(merged.filter("ask"), known, seq))
        # the merge's output is the new run as it lies: sorted, and read with a filter
        self.runs.append((0, own.filter("not gone").select(*_KINDS, "seq")))
        self._compact()
        return repeats

    def _by_window(self, asked: DataFrame, known: DataFrame, seq: int) -> DataFrame:
        """The single windows, of entries that differ under one n-gram, which an earlier one equals."""
        window = self.window
        lists = materialise(per_document(asked.select("doc_id", "start", "n")).join(asked.groupBy("doc_id").agg(F.min("seq").alias("seq")), "doc_id"), "asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict[str, np.ndarray]] = []

            def flush():
                x = {c: np.concatenate([y[c] for y in held]) for c in held[0]}
                held.clear()
                for q in np.unique(x["seq"]):  # the offset is free here, and one for all
                    one = {c: v[x["seq"] == q] for c, v in x.items() if c != "seq"}
                    told = _tell_apart(one | {"off": np.zeros(len(one["n"]), np.int32)})
                    yield _batch(_KINDS | {"seq": pa.int32()}, told | {"seq": np.full(len(told["n"]), q, np.int32)})

            for b in batches:
                ids, starts, ns, seqs = (b.column(c).to_pylist() for c in ("doc_id", "starts", "ns", "seq"))
                at = 0
                for lot, raw in lots(ids, b.column("text")):
                    w = Words(raw)
                    one, two = sequences(w.hash, window), sequences(w.hashed(OTHER), window)
                    for k, i in enumerate(lot):
                        s, n = np.array(starts[at + k], np.int64), np.array(ns[at + k], np.int64)
                        here = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                        here = here[w.first[k] + here + window <= w.first[k + 1]]  # only if an id's text changed
                        f = w.first[k] + here
                        held.append({"anchor": one[f].view(np.int64), "span": two[f].view(np.int64), "seq": np.full(len(f), seqs[at + k], np.int32), "n": np.ones(len(f), np.int32), "doc_id": np.full(len(f), i, np.int64), "start": here})
                    at += len(lot)
                if sum(len(x["n"]) for x in held) > 1 << 20:
                    yield from flush()
            if held:
                yield from flush()

        texts = with_places(known.select("doc_id", "text"), lists, "inner").select("doc_id", "text", "starts", "ns", "seq")
        windows = texts.mapInArrow(tidy(run), _DDL + ", seq int")
        return _merged(windows, seq).filter((F.col("seq") == seq) & F.col("gone")).select("doc_id", "start", "n")

    def _compact(self) -> None:
        """``fan`` runs of a level become one sorted run of the next; of equal entries the earliest stays."""
        while self.runs and sum(level == self.runs[-1][0] for level, _ in self.runs) >= self.fan:
            level = self.runs[-1][0]
            rows = None
            for _, run in [x for x in self.runs if x[0] == level]:
                rows = run if rows is None else rows.unionByName(run)
            rows = rows.repartition("anchor").sortWithinPartitions("anchor", "span", "off")
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, materialise(rows, "run"))]


def remove(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """Takes the repeated windows' words out: doc_id, n_words, n_removed, kept (words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, out, digest, kept = [], [], [], []
            for text, starts, ns in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
                words = (text or "").encode().split()
                total.append(len(words))
                if starts:
                    cover = np.zeros(len(words) + 1, np.int64)
                    s = np.array(starts, np.int64)
                    e = np.minimum(s + np.array(ns, np.int64) + window - 1, len(words))
                    np.add.at(cover, s, 1)
                    np.add.at(cover, e, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    out.append(int(gone.sum()))
                    words = [words[k] for k in np.flatnonzero(~gone)]
                else:
                    out.append(0)
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(out, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    lists = materialise(per_document(repeats), "repeats")
    texts = with_places(docs.select("doc_id", "text"), lists, "left").select("doc_id", "text", "starts", "ns")
    return texts.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


@clears_steps
def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word covered by a window that starts earlier too (smaller id, or same text, earlier start).

    Returns per row doc_id, n_words, n_removed, kept_sha256 and kept, the remaining words joined by one
    space.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input.  The table goes
    into the index in ``batches`` batches by id.  Null and empty texts have no words.  Rows that repeat an
    id are one document and get one result each; a null id takes no part and keeps its words.  An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = SubstringIndex(docs.sparkSession, window, gram)
    cuts = rows.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    repeats = None
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        found = index.add(part, rows if high is None else rows.filter(F.col("doc_id") <= high))
        repeats = found if repeats is None else repeats.unionByName(found)
    return remove(rows, repeats, window)
