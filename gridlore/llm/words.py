"""Vectorised words and word-sequence fingerprints of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Fixed odd multipliers of the fingerprints.
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
#: Bytes up to which words are hashed together; longer ones go one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, sorted."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x2545F4914F6CDD1D))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest k bytes of a number, for k from 0 to 8.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The fingerprint of what two fingerprints stand for, one after the other.  Neither addition nor multiplication
    carries through ``mix``, so that no arrangement of parts cancels out as it can in a polynomial."""
    return mix(left * _BASE + right)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts: their bytes' bounds, texts and fingerprints."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
        begins = np.cumsum(sizes) - sizes
        space = _SPACE[self.raw[:-8]]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self.hashed(_U(0))
        self.first = np.searchsorted(self.start, begins)  # of each text, and one more
        self.first = np.append(self.first, len(self.start))
        self.begins = begins

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self, seed: np.uint64) -> np.ndarray:
        """Each word's fingerprint; another seed gives an independent one."""
        return stretches(self.raw, self.start, self.end, seed)


def stretches(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The fingerprint of each stretch of bytes start..end, eight bytes at a time; ``raw`` has eight bytes more."""
    eight = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), strides=(1,))
    size = end - start
    out = mix(size.astype(_U) + _U(int(seed) * int(_STEP) & (1 << 64) - 1))
    here, k = np.flatnonzero(size <= LONG_WORD), 0
    here = here[size[here] > 0]
    while len(here):
        part = eight[start[here] + k].astype(_U) & _LOW[np.minimum(size[here] - k, 8)]
        out[here] = joined(out[here], mix(part ^ seed))
        k += 8
        here = here[size[here] > k]
    for j in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[start[j] : end[j]].tobytes(), digest_size=8, salt=int(seed).to_bytes(8, "little")).digest()
        out[j] = int.from_bytes(digest, "little")
    return out


def sequences(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of the n words from each word on, as far as there are n."""
    count = max(0, len(word_hash) - n + 1)
    if not count:
        return np.zeros(0, _U)
    out, done, part, size = None, 0, word_hash, 1  # part: of ``size`` words, twice as many in each round
    while True:
        if n & size:
            out = part[:count] if out is None else joined(out, part[done : done + count])
            done += size
        if 2 * size > n:
            return mix(out + _U(n))
        part = joined(part[:-size], part[size:])
        size *= 2


def lots(ids, texts, most: int = 1 << 19):
    """Cuts rows (lists or columns of a batch) into lots of about ``most`` bytes; a longer text is a lot of its own.
    Columns are turned into Python's texts a few rows at a time."""
    names, raw, size = [], [], 0
    for lo in range(0, len(ids), 256):
        some = [x[lo : lo + 256] if isinstance(x, list) else x.slice(lo, 256).to_pylist() for x in (ids, texts)]
        for i, text in zip(*some, strict=True):
            t = (text or "").encode()
            if raw and size + len(t) > most:
                yield names, raw
                names, raw, size = [], [], 0
            names.append(i)
            raw.append(t)
            size += len(t)
    if raw:
        yield names, raw
