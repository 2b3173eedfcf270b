"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased (A-Z) UTF-8 bytes and one end mark.  Each byte is coded bit by bit.  For every
order from one to five the preceding bytes and the bits so far hash to a slot whose counts predict the next
bit.  The predictions are combined in the logistic domain by weights that a gate selects (bit position,
deepest order that has been seen, and how often), learnt online by gradient steps; an adaptive map then
refines the mixed probability.  Counts, weights and map come from all training texts: what is gathered are
the distinct (five bytes, next byte) keys with their numbers, which grow with the corpus.  While the
weights and the map are learnt, the counts leave out the occurrence at hand.

Keys that share three bytes of context lie in one bucket, and with them all that orders three to five know
about them: a bucket's slots are as many as its keys ask for, so that contexts collide alike at every size of
the corpus, and no table of a high order leaves its task.  Texts lie in lots; a lot asks the buckets for the
cost of its distinct keys.  Orders one and two have few contexts and are sent to all.

Beside it stands a word model: the number of each word in all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import LARGE_ROWS, clears_steps, materialise, partitions_for, revived, small_batches, tidy
from gridlore.llm.words import distinct, mix

ORDERS, LOW, END = 5, 2, b"\xff"
#: Slots for each bit position of an order up to LOW, as a power of two; there are 2^24 keys of such orders at most.
SLOT_BITS = 19
#: Bytes of a lot of texts; of training text for each bucket, and the most buckets that lots are dealt to.
LOT, BUCKET, BUCKETS = 6 << 20, 16 << 20, 1 << 16
#: Bytes that are keyed at once; keys that wait to be summed or answered; keys of a gradient step.
STRETCH, HELD, STEP = 1 << 21, 1 << 20, 1024
#: Every task learns from the mean of the tasks' weights, ROUNDS times, passing EPOCHS times over its keys.
ROUNDS, EPOCHS, RATE = 2, 2, 0.2
_ADD, _UNIT, _TOP = 0.4, 128.0, 2040
_LEAST = np.array([0, 1, 2, 3, 4, 6, 10, 18, 34, 66, 130, 260, 600, 2000, 8000, 100_000])  # counts from which a level begins
_TYPICAL = np.array([0, 1, 2, 3, 4.5, 7.5, 13, 25, 48, 95, 190, 400, 1200, 4500, 30_000, 300_000])
_GATES = 8 * (ORDERS + 1) * 2
_U = np.uint64


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()


def keyed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (five bytes of context, next byte) of all texts with their end marks, by stretches, and the text of each key."""
    lead = bytes(ORDERS)
    buffer = np.frombuffer(b"".join(lead + t + END for t in texts) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDERS + 1
    begins = np.cumsum(sizes) - sizes
    eight = np.ndarray(len(buffer) - 7, ">u8", buffer, strides=(1,))  # eight bytes from every place on, the first one highest
    for lo in range(ORDERS, len(buffer) - 8, STRETCH):
        hi = min(lo + STRETCH, len(buffer) - 8)
        key = eight[lo - ORDERS : hi - ORDERS].astype(_U) >> _U(16)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.clip(begins + sizes, lo, hi) - np.clip(begins, lo, hi))
        real = np.ones(hi - lo, bool)
        for k in range(ORDERS):
            at = begins + k - lo
            real[at[(at >= 0) & (at < hi - lo)]] = False
        yield key[real], owner[real]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


def _packed(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


_LOTS = {"lot": pa.int64(), "ids": pa.binary(), "known": pa.binary(), "training": pa.binary(), "sizes": pa.binary(), "raw": pa.binary()}


def packed_lots(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, training, text) as lots of texts with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int | None, bool, bytes]] = []
        size, number = 0, TaskContext.get().partitionId() << 33

        def out() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, training, texts = zip(*held, strict=True)
            known = np.array([i is not None for i in ids])
            row = [number, np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), np.array(training, bool).tobytes(), np.array([*map(len, texts)], np.int64).tobytes(), b"".join(texts)]
            held.clear()
            return _packed(_LOTS, [tuple(row)])

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for i, training, text in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns), strict=True):
                    held.append((i, training, text_bytes(text)))
                    size += len(held[-1][2])
                    if size >= LOT:
                        yield out()
                        size = 0
        if held:
            yield out()

    return materialise(rows.select("doc_id", "training", "text").mapInArrow(tidy(run), "lot long, ids binary, known binary, training binary, sizes binary, raw binary"), "lots", LARGE_ROWS)


def _texts(sizes: bytes, raw: bytes) -> list[bytes]:
    cut = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).tolist()
    return [raw[a:z] for a, z in zip(cut, cut[1:], strict=False)]


def _distinct(texts: list[bytes]) -> np.ndarray:
    parts = [distinct(k) for k, _ in keyed(texts)]
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, _U)


def _short_orders(keys: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """For every 2^16 keys: the distinct ones, the number among them of each, in the order of their places, and the owners
    counted from the first.  A key and its place are one number, so that they are sorted together."""
    for lo in range(0, len(keys), 1 << 16):
        some = keys[lo : lo + (1 << 16)]
        both = np.sort((some << _U(16)) | np.arange(len(some), dtype=_U))
        key = both >> _U(16)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        back = np.empty(len(key), np.uint16)
        back[(both & _U(0xFFFF)).astype(np.uint16)] = np.cumsum(new) - 1
        here = owner[lo : lo + (1 << 16)]
        yield key[new], back, int(here[0]), here - here[0]


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys by bucket: their order, the buckets that have any, and where each begins."""
    to = (mix((keys >> _U(8)) & _U(0xFFFFFF)) % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0])) if len(keys) else np.zeros(0, np.int64)
    return order, to[order][head], head


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, the lowest of all first: like bytes lie together."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(_U).ravel()


def _ascending(keys: np.ndarray) -> bytes:
    """Sorted keys as steps."""
    return _planes(np.diff(keys, prepend=_U(0)), 6)


def _from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, 6))


_GRAMS = {"bucket": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}


def gram_counts(lots: DataFrame, buckets: int) -> DataFrame:
    """All distinct keys of the training texts with their counts: one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for training, sizes, raw in zip(*(b.column(c).to_pylist() for c in ("training", "sizes", "raw")), strict=True):
                texts = [t for t, x in zip(_texts(sizes, raw), np.frombuffer(training, bool).tolist(), strict=True) if x]
                parts = [np.unique(k, return_counts=True) for k, _ in keyed(texts)]
                if not parts:
                    continue
                keys, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                order, to, head = _dealt(keys, buckets)
                yield _packed(_GRAMS, [(int(k), _ascending(keys[part]), _planes(n[part], 4)) for k, part in zip(to, np.split(order, head[1:]), strict=True)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, waiting = None, [], 0

        def merge() -> None:
            keys, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held[:] = [(keys, n)]

        def out() -> pa.RecordBatch:
            merge()
            ((keys, n),) = held
            held.clear()
            return _packed(_GRAMS, [(bucket, keys.tobytes(), n.tobytes())])

        for b in batches:
            for k, keys, n in zip(*(b.column(c).to_pylist() for c in _GRAMS), strict=True):
                if k != bucket and held:
                    yield out()
                    waiting = 0
                bucket = k
                held.append((_from_ascending(keys), _from_planes(n, 4)))
                waiting += len(held[-1][0])
                if waiting > HELD:
                    merge()
                    waiting = 0
        if held:
            yield out()

    ddl = "bucket long, keys binary, counts binary"
    dealt = lots.select("training", "sizes", "raw").mapInArrow(tidy(count), ddl)
    return materialise(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), ddl), "grams", LARGE_ROWS)


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for keys, n in zip(b.column("keys"), b.column("counts"), strict=True):  # not copied: a bucket's row may be large
        yield np.frombuffer(keys.as_buffer(), _U), np.frombuffer(n.as_buffer(), np.uint64).astype(np.float64)


def slots(keys: np.ndarray, order: int, bit: int, bits: int) -> np.ndarray:
    """The slot, among 2^bits of its bit position, of each key's context and first ``bit`` bits."""
    context = (keys >> _U(8)) & _U((1 << 8 * order) - 1)
    node = ((keys & _U(255)) | _U(256)) >> _U(8 - bit)
    return (mix(context * _U(0x9E3779B97F4A7C15) + node * _U(0xC2B2AE3D27D4EB4F) + _U(order)) >> _U(64 - bits)).astype(np.int64)


def _bit(keys: np.ndarray, bit: int) -> np.ndarray:
    return ((keys >> _U(7 - bit)) & _U(1)).astype(np.float32)


def encoded(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds in 12 bits and the count's level in 4."""
    odds = np.clip(np.rint(np.log((n1 + _ADD) / (n0 + _ADD)) * _UNIT), -_TOP, _TOP).astype(np.int32)
    return ((odds << 4) | (np.searchsorted(_LEAST, n0 + n1, side="right") - 1)).astype(np.int16)


def slot_tables(keys: np.ndarray, counts: np.ndarray, orders: range, bits: int | None = None) -> dict[int, np.ndarray]:
    """For each order a row of slots for each bit position; by default there are at least twice as many as keys."""
    bits = max(8, (2 * len(keys)).bit_length()) if bits is None else bits
    out = {}
    for order in orders:
        out[order] = np.zeros((8, 1 << bits), np.int16)
        for bit in range(8):
            at, one = slots(keys, order, bit, bits), _bit(keys, bit)
            ones, total = np.bincount(at, counts * one, 1 << bits), np.bincount(at, counts, 1 << bits)
            used = np.flatnonzero(total)
            out[order][bit, used] = encoded(total[used] - ones[used], ones[used])
    return out


def _collected(rows: DataFrame) -> pa.Table:
    """A bounded result, made from bounded batches: a task's files hold more buckets the larger the corpus is."""
    with small_batches(rows.sparkSession):
        return rows.toArrow()


def low_tables(grams: DataFrame) -> dict[int, np.ndarray]:
    """The tables of the orders up to LOW, from the counts of at most 2^24 strings of three bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in _unpacked(b):
                low, n = _summed(keys & _U(0xFFFFFF), n)
                yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), pa.array(n)], names=["low", "n"])

    rows = _collected(grams.mapInArrow(tidy(run), "low long, n double").groupBy("low").agg(F.sum("n").alias("n")))
    return slot_tables(rows.column("low").to_numpy().astype(_U), rows.column("n").to_numpy(), range(1, LOW + 1), SLOT_BITS)


class Mixer:
    """Weights and map, the tables of low orders, and the training texts' keys by bucket."""

    def __init__(self, low: dict[int, np.ndarray], buckets: int):
        self.low, self.buckets = low, buckets
        self.weights = np.full((_GATES, ORDERS + 1), 0.35, np.float32)
        self.weights[:, 0] = 0  # a constant input
        grid = np.arange(-8, 8.5, 0.5)
        self.map = np.tile(grid, (256, 1)).astype(np.float32)  # refined log odds for each bit node and mixed log odds

    def tables(self, keys: np.ndarray, counts: np.ndarray) -> dict[int, np.ndarray]:
        """All orders' tables for a bucket, from its training keys."""
        return self.low | slot_tables(keys, counts, range(LOW + 1, ORDERS + 1))

    def inputs(self, tables: dict[int, np.ndarray], keys: np.ndarray, bit: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each order's slot, and the gate."""
        x = np.ones((ORDERS + 1, len(keys)), np.float32)
        gate = np.zeros(len(keys), np.int64)
        one = _bit(keys, bit) if leave_out else None
        for order in range(1, ORDERS + 1):
            row = tables[order][bit]
            code = row[slots(keys, order, bit, len(row).bit_length() - 1)]
            odds, level = (code >> 4).astype(np.float32) / np.float32(_UNIT), (code & 15).astype(np.int64)
            if leave_out:
                n = _TYPICAL[level]
                ones = (n + 2 * _ADD) / (1 + np.exp(-odds.astype(np.float64))) - _ADD
                ones, zeros = np.maximum(ones - one, 0), np.maximum(n - ones - (1 - one), 0)
                odds = np.log((ones + _ADD) / (zeros + _ADD)).astype(np.float32)
                level = np.maximum(np.searchsorted(_LEAST, n - 1, side="right") - 1, 0)
                odds = np.where(level == 0, np.float32(0), odds)
            x[order] = odds
            gate = np.where(level > 0, 2 * order + (level > 3), gate)
        return x, gate + bit * 2 * (ORDERS + 1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kn,nk->n", x, self.weights[gate]), -12, 12)

    def refined(self, keys: np.ndarray, bit: int, odds: np.ndarray) -> np.ndarray:
        node = ((keys & _U(255)) | _U(256)) >> _U(8 - bit)
        at = np.clip((odds + 8) * 2, 0, 32 - 1e-4)
        k = at.astype(np.int64)
        part = (at - k).astype(np.float32)
        row = node.astype(np.int64)
        refined = self.map[row, k] * (1 - part) + self.map[row, k + 1] * part
        return np.where(np.abs(odds) >= 8, odds, (odds + refined) / 2)

    def learn(self, keys: np.ndarray, counts: np.ndarray, seed: int, rate: float) -> np.ndarray:
        """Online gradient steps over a bucket's keys in a random order; returns how much each gate has seen."""
        tables = self.tables(keys, counts)
        rng, seen = np.random.default_rng(seed), np.zeros(_GATES)
        for lo in range(0, len(keys), 1 << 16):
            k, n = keys[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
            given = [(*self.inputs(tables, k, bit, True), _bit(k, bit)) for bit in range(8)]
            for epoch in range(EPOCHS):
                order = rng.permutation(len(k))
                for at in range(0, len(order), STEP):
                    rows = order[at : at + STEP]
                    some = n[rows]
                    for x, gate, one in given:
                        self.step(x[:, rows], gate[rows], one[rows], some, rate / (1 + epoch))
            for _, gate, _ in given:
                seen += np.bincount(gate, n, _GATES)
        return seen

    def step(self, x: np.ndarray, gate: np.ndarray, one: np.ndarray, n: np.ndarray, rate: float) -> None:
        error = (one - 1 / (1 + np.exp(-self.mixed(x, gate)))) * n
        mass = np.maximum(np.bincount(gate, n, _GATES), 1e-9)
        for j in range(ORDERS + 1):
            self.weights[:, j] += rate * np.bincount(gate, error * x[j], _GATES) / mass / (1 + 2 * (j > 0))

    def outcomes(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per bit node and mixed log odds: zeros and ones that came."""
        out, tables = np.zeros((2, 256 * 33)), self.tables(keys, counts)
        for bit in range(8):
            odds = self.mixed(*self.inputs(tables, keys, bit, True))
            node = (((keys & _U(255)) | _U(256)) >> _U(8 - bit)).astype(np.int64)
            at = node * 33 + np.rint((np.clip(odds, -8, 8) + 8) * 2).astype(np.int64)
            one = _bit(keys, bit)
            out[0] += np.bincount(at, counts * (1 - one), 256 * 33)
            out[1] += np.bincount(at, counts * one, 256 * 33)
        return out

    def bits(self, tables: dict[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Bits that each key's byte costs after its context, by its bucket's tables."""
        cost = np.zeros(len(keys))
        for bit in range(8):
            odds = self.refined(keys, bit, self.mixed(*self.inputs(tables, keys, bit, False))).astype(np.float64)
            cost += np.logaddexp(0, np.where(_bit(keys, bit) > 0, -odds, odds))
        return cost / np.log(2)


def train(lots: DataFrame, buckets: int) -> tuple[Mixer, DataFrame]:
    """Weights and map from all training texts of the lots, and their keys by bucket."""
    grams = gram_counts(lots, buckets)
    mixer = Mixer(low_tables(grams), buckets)
    sc = lots.sparkSession.sparkContext
    size = _GATES * (ORDERS + 1)
    for turn in range(ROUNDS):
        sent = sc.broadcast(vars(mixer))  # tables of a fixed size

        def weights(batches: Iterator[pa.RecordBatch], turn=turn, sent=sent) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((_GATES, ORDERS + 1)), np.zeros(_GATES)
            for b in batches:
                for keys, n in _unpacked(b):
                    own = revived(Mixer, sent.value)
                    own.weights = own.weights.copy()
                    by = own.learn(keys, n, 7 + turn, RATE / (1 + turn * EPOCHS))
                    total += own.weights * by[:, None]
                    seen += by
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel()), pa.array(np.repeat(seen, ORDERS + 1))], names=["at", "total", "seen"])

        rows = _collected(grams.mapInArrow(tidy(weights), "at int, total double, seen double").groupBy("at").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).filter("seen > 0"))
        at, total, seen = (c.to_numpy() for c in rows.columns)  # a row for each weight
        flat = mixer.weights.ravel().copy()
        flat[at] = (total / seen).astype(np.float32)
        mixer.weights = flat.reshape(mixer.weights.shape)
        sent.destroy()
    learnt = sc.broadcast(vars(mixer))

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = revived(Mixer, learnt.value), np.zeros((2, 256 * 33))
        for b in batches:
            for keys, n in _unpacked(b):
                out += own.outcomes(keys, n)
        some = np.flatnonzero(out.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[0, some]), pa.array(out[1, some])], names=["at", "zeros", "ones"])

    rows = _collected(grams.mapInArrow(tidy(outcomes), "at int, zeros double, ones double").groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")))
    at, zeros, ones = (c.to_numpy() for c in rows.columns)
    start = np.tile(np.arange(-8, 8.5, 0.5), 256)[at]
    share = 1 / (1 + np.exp(-start))
    odds = np.log((ones + 20 * share) / (zeros + 20 * (1 - share)))
    mixer.map = mixer.map.ravel()
    mixer.map[at] = np.clip(odds, -12, 12)
    mixer.map = mixer.map.reshape(256, 33).astype(np.float32)
    learnt.destroy()
    return mixer, grams


def key_costs(lots: DataFrame, mixer: Mixer, grams: DataFrame) -> DataFrame:
    """(lot, at, costs): the bits of each lot's distinct keys, bucket by bucket."""
    model = lots.sparkSession.sparkContext.broadcast(vars(mixer))  # tables of a fixed size
    kinds = {"bucket": pa.int64(), "lot": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lot, sizes, raw in zip(*(b.column(c).to_pylist() for c in ("lot", "sizes", "raw")), strict=True):
                keys = _distinct(_texts(sizes, raw))
                order, to, head = _dealt(keys, model.value["buckets"])
                yield _packed(kinds, [(int(k), lot, _ascending(keys[part]), None) for k, part in zip(to, np.split(order, head[1:]), strict=True)])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bucket, tables = revived(Mixer, model.value), None, None
        known, cost = np.zeros(0, _U), np.zeros(0, np.float32)  # what has been computed for the bucket
        asked: list[tuple[str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal known, cost
            used = distinct(np.concatenate([k for _, k in asked]))
            new = used[known.take(np.searchsorted(known, used), mode="clip") != used] if len(known) else used
            if len(known) + len(new) > 2 * HELD:
                known, cost, new = known[:0], cost[:0], used
            known, cost = np.concatenate([known, new]), np.concatenate([cost, own.bits(tables, new).astype(np.float32)])
            order = np.argsort(known)
            known, cost = known[order], cost[order]
            rows = [(lot, bucket, cost[np.searchsorted(known, k)].tobytes()) for lot, k in asked]
            asked.clear()
            return _packed({"lot": pa.int64(), "at": pa.int64(), "costs": pa.binary()}, rows)

        for b in batches:
            for k, lot, keys, counts in zip(*(b.column(c).to_pylist() for c in kinds), strict=True):
                if k != bucket:
                    if asked:
                        yield out()
                    bucket, known, cost = k, known[:0], cost[:0]
                    tables = own.tables(np.zeros(0, _U), np.zeros(0))  # of a bucket that training texts don't know
                if lot is None:
                    tables = own.tables(np.frombuffer(keys, _U), np.frombuffer(counts, np.uint64).astype(np.float64))
                    continue
                asked.append((lot, _from_ascending(keys)))
                if sum(len(x) for _, x in asked) > HELD // 2:
                    yield out()
        if asked:
            yield out()

    asks = lots.select("lot", "sizes", "raw").mapInArrow(tidy(ask), "bucket long, lot long, keys binary, counts binary")
    met = asks.unionByName(grams.select("bucket", F.lit(None).cast("long").alias("lot"), "keys", "counts"))
    met = met.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("lot"))  # a bucket's training keys first
    return met.mapInArrow(tidy(reply), "lot long, at long, costs binary")


def _numbers(texts: list[bytes]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """All words and ends of the texts, numbered as they come, and each text as numbers."""
    numbers: dict[bytes, int] = {}
    parts = []
    for t in texts:
        words = t.split()
        words.append(END)  # no word holds this byte
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
    return numbers, parts


def word_counts(lots: DataFrame) -> tuple[DataFrame, int, int]:
    """(lot, ats, counts): how often the training texts have distinct words of a lot, by their numbers there, packed in
    several rows; how many words and ends the training texts have, and how many distinct ones.

    A word stands once in a lot, so that it has no more rows than there are lots.
    """
    kinds = {"lot": pa.int64(), "at": pa.int32(), "word": pa.binary(), "n": pa.int32()}
    out_kinds = {"lot": pa.int64(), "ats": pa.binary(), "counts": pa.binary(), "total": pa.int64(), "known": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lot, training, sizes, raw in zip(*(b.column(c).to_pylist() for c in ("lot", "training", "sizes", "raw")), strict=True):
                numbers, parts = _numbers(_texts(sizes, raw))
                trained = np.repeat(np.frombuffer(training, bool), [len(p) for p in parts])
                n = np.bincount(np.concatenate(parts)[trained], minlength=len(numbers)).astype(np.int32)
                words = list(numbers)
                for lo in range(0, len(words), 1 << 16):
                    some = words[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lot)), pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), pa.array(some, pa.binary()), pa.array(n[lo : lo + len(some)])], names=list(kinds))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows in the order of words: the last word waits for its other rows."""
        word, held, waiting = None, [], []
        total = known = 0

        def settled() -> None:
            nonlocal total, known
            lot, at, n = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            c = int(n.sum())
            total, known = total + c, known + (c > 0)
            waiting.append((lot, at, np.full(len(lot), c, np.int64)))

        def out() -> pa.RecordBatch:
            lot, at, c = map(np.concatenate, zip(*waiting, strict=True))
            waiting.clear()
            order = np.lexsort((at, lot))
            lot, at, c = lot[order], at[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]]))
            cut = zip(head.tolist(), [*head[1:].tolist(), len(lot)], strict=True)
            return _packed(out_kinds, [(int(lot[x]), _planes(np.diff(at[x:y].astype(np.int64), prepend=0), 4), _planes(c[x:y], 6), None, None) for x, y in cut])

        for b in batches:
            if not b.num_rows:
                continue
            words = b.column("word")
            lot, at, n = (b.column(c).to_numpy() for c in ("lot", "at", "n"))
            new = np.flatnonzero(np.concatenate([[words[0].as_py() != word], pc.not_equal(words.slice(1), words.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)]))
            word = words[b.num_rows - 1].as_py()
            if not len(new):
                held.append((lot, at, n))
                continue
            if new[0]:
                held.append((lot[: new[0]], at[: new[0]], n[: new[0]]))
            if held:
                settled()
            last = new[-1]
            if len(new) > 1:
                c = np.add.reduceat(n[: last].astype(np.int64), new[:-1])
                total, known = total + int(c.sum()), known + int((c > 0).sum())
                waiting.append((lot[new[0] : last], at[new[0] : last], np.repeat(c, np.diff(new))))
            held.append((lot[last:], at[last:], n[last:]))
            if sum(len(x[0]) for x in waiting) > HELD:
                yield out()
        if held:
            settled()
            yield out()
        yield _packed(out_kinds, [(None, None, None, total, known)])

    found = lots.select("lot", "training", "sizes", "raw").mapInArrow(tidy(run), "lot long, at int, word binary, n int").repartition("word").sortWithinPartitions("word")
    counted = materialise(found.mapInArrow(tidy(tally), "lot long, ats binary, counts binary, total long, known long"), "counted")
    total, different = counted.filter("lot is null").agg(F.sum("total"), F.sum("known")).first()
    return counted.filter("lot is not null").select("lot", "ats", "counts"), total or 0, different or 0


def scores(lots: DataFrame, costs: DataFrame, buckets: int, counts: DataFrame, total: int, different: int) -> DataFrame:
    """A row for each text of the lots, from the costs of its keys and the counts of its words."""
    heads = [c for c in _LOTS if c != "lot"]
    names = ("lot", "kind", "at", "x", "y", *heads)
    void = lambda *cs: [F.lit(None).cast("binary").alias(c) for c in cs]
    number = lambda k: F.lit(k).cast("long")
    whole = lots.select("lot", F.lit(0).alias("kind"), number(0).alias("at"), *void("x", "y"), *heads)
    whole = whole.unionByName(counts.select("lot", F.lit(1).alias("kind"), number(0).alias("at"), F.col("ats").alias("x"), F.col("counts").alias("y"), *void(*heads)))
    whole = whole.unionByName(costs.select("lot", F.lit(2).alias("kind"), "at", F.col("costs").alias("x"), *void("y", *heads)))
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "bits_per_byte": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, head, words, bits = None, None, [], []

        def out() -> pa.RecordBatch:
            ids, known, training, sizes, raw = head
            texts = _texts(sizes, raw)
            ordered = [x for keys, owner in keyed(texts) for x in _short_orders(keys, owner)]
            keys = distinct(np.concatenate([used for used, _, _, _ in ordered]))
            cost, sums = np.zeros(len(keys)), np.zeros(len(texts))
            cost[_dealt(keys, buckets)[0]] = np.concatenate([np.frombuffer(x, np.float32) for x in bits])
            for used, back, first, owner in ordered:
                sums[first : first + int(owner[-1]) + 1] += np.bincount(owner, cost[np.searchsorted(keys, used)][back])
            numbers, parts = _numbers(texts)
            c = np.zeros(len(numbers), np.int64)
            for x, y in words:
                c[np.cumsum(_from_planes(x, 4)).astype(np.int64)] = _from_planes(y, 6).astype(np.int64)
            logs = np.log10((c + 1.0) / (total + different + 1.0))
            flat, length = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            at = np.cumsum(length) - length  # every text has its end mark at least
            ids = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
            seen, base = np.add.reduceat((c[flat] > 0).astype(np.int64), at), np.add.reduceat(logs[flat], at)
            cols = [ids, pa.array(~np.frombuffer(training, bool)), length, seen, np.full(len(texts), total), base, -sums * np.log10(2), sums / (np.frombuffer(sizes, np.int64) + 1)]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[1] == 0:
                    if lot is not None:
                        yield out()
                    lot, head, words, bits = row[0], row[5:], [], []
                elif row[1] == 1:
                    words.append(row[3:5])
                else:
                    bits.append(row[3])
        if lot is not None:
            yield out()

    ordered = whole.select(*names).repartition("lot").sortWithinPartitions("lot", "kind", "at")
    return ordered.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


@clears_steps
def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows that are not held out, and scores all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words and one end, add-one
    smoothed over the training words), score (log10 probability of the bytes), bits_per_byte.  Words are
    ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Null text is empty; repeated rows and null
    ids are rows of their own; without training rows every byte costs about eight bits; an empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~held_out).alias("training"), F.col(text_col).alias("text"))
    buckets = min(BUCKETS, partitions_for(rows, "text", BUCKET))
    lots = packed_lots(rows)
    mixer, grams = train(lots, buckets)
    counts, total, different = word_counts(lots)
    # written here, where batches are bounded: buckets and lots of one task would come in one
    return materialise(scores(lots, key_costs(lots, mixer, grams), buckets, counts, total, different), "scores")
