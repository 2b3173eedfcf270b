import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlore.llm.packing import best_configuration, best_fit, byte_encoding, encode, pack, solve

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", "Hello  world!\n\n x", "a<|endoftext|>b", "éàü 日本 😀", "x " * 3000, "word " * 2047, "word " * 2046 + "word", None]


def test_same_ids_as_library():
    for t in TEXTS[:-1]:
        assert byte_encoding(PATH).encode(t, allowed_special="all") == LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("white", [" ", "\n", "\t\n", "\u3000", " \xa0"])
def test_long_white_runs_are_the_librarys(white):
    run = white * 10_000
    for t in [run, "a" + run, run + "b", "a b" + run + "c  d" + run, run + "<|endoftext|>" + run + "x", "<|endoftext|>" + run + "<|endoftext|>", run + "\x1c" + run]:
        assert encode(byte_encoding(PATH), t).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_very_long_texts(spark):
    texts = [" " * 1_200_000, "\n" * 1_200_000 + "end", "x" * 300_000, "word " * 200_000]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).groupBy("doc_id").sum("length").collect()
    assert dict(got) == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_of_groups_is_best_fit_of_pieces(seed):
    rng = np.random.default_rng(seed)
    left = np.zeros(101, np.int64)
    left[rng.integers(1, 101, 25)] = rng.integers(1, 40, 25)
    got = [100 - sum(s) for s, n in best_fit(left, 100) for _ in range(n)]
    assert sorted(got) == one_by_one(np.repeat(np.arange(101), left).tolist(), 100)


def test_driver_work_does_not_grow_with_pieces():
    rng = np.random.default_rng(1)
    lengths = np.minimum(512, rng.lognormal(4.5, 1, 3000).astype(int) + 1)
    once = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    plans = [solve({x: n * k for x, n in once.items()}, 512) for k in (1, 10**6)]
    assert len(plans[1]) < 4 * len(plans[0]) and sum(n for _, n in plans[1]) <= math.ceil(lengths.sum() * 10**6 / 512 * 1.001)


def test_knapsack_against_brute_force():
    price = np.array([0, 1, 5, 8, 9, 10, 17, 17, 20.0])
    assert sum(price[x] for x in best_configuration(price, 8)) == 22  # 5 + 17


@pytest.mark.parametrize("seed", range(4))
def test_solve_places_everything_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1, 4000).astype(int) + 1)
    want = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    plan, got = solve(want, 2048, rounds=200), {}
    for s, n in plan:
        assert sum(s) <= 2048 and n > 0
        for x in s:
            got[x] = got.get(x, 0) + n
    assert got == want
    assert sum(n for _, n in plan) <= math.ceil(lengths.sum() / 2048) * 1.01 + 1


def test_solve_long_pieces_pair_up():
    assert sum(n for _, n in solve({1024: 10, 1025: 4, 1023: 4, 7: 0}, 2048, 50)) == 9
    assert solve({}, 2048) == []


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "y"), (None, "n", "z")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).collect()
    ids = {i: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in rows}
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _, _ in rows)
    assert sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 5) == [(0, 0, len(ids[5]) - 2048), (1, len(ids[5]) - 2048, 2048)] if len(ids[5]) > 2048 else True
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
