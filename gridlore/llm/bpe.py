"""Byte-pair encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each new word.  Vectorised checks then test every adjacent
pair of proposed tokens: a pair holds if no merge across its seam could have come before the merges that
built its two sides.  A sequence whose pairs all hold is the one exact merging gives; only words with a
failing pair are merged exactly.  Words repeat, so each process keeps the encodings of recent words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import process_cache, tidy

END = "\0"  # stands for the end-of-word mark; no mapped byte is a NUL
#: The rank of a pair that is no merge; symbols beyond which a word is merged by a heap.
NEVER, LONG_WORD = 1 << 40, 128
#: Words whose encodings a process keeps; beyond it only those of the last batch stay.
KEPT_WORDS = 300_000


def byte_letters() -> str:
    """The printable letter of each byte in byte-level vocabularies: itself if visible Latin-1, else 256 and up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(spare)) for b in range(256))


class WordBpe:
    """The merges of a vocabulary with an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        shorten = lambda s: s[: -len(self.suffix)] + END if self.suffix and s.endswith(self.suffix) else s
        self.ids = {shorten(s): i for s, i in model["vocab"].items()}
        n = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.names = np.array([""] * n, dtype=object)
        for s, i in model["vocab"].items():
            self.names[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.names[i] = s
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ranks: dict[tuple[str, str], int] = {}
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        keys, key_ranks = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = map(shorten, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks.setdefault((a, b), r)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            keys.append((i << 32) | j)
            key_ranks.append(r)
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, r
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = np.array(keys)[order], np.array(key_ranks)[order]
        # a token that its own string does not merge into can't be proposed
        self.proposable = {s: i for s, i in self.ids.items() if len(s.rstrip(END)) <= 1 or self.merge(s) == [i]}
        self.reach: dict[str, int] = {}  # the longest that begins with these two letters
        for s in self.proposable:
            self.reach[s[:2]] = max(self.reach.get(s[:2], 1), len(s))

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest-ranked pair first, leftmost first."""
        parts = [*word[:-2], word[-2:]] if word[-1:] == END else list(word)
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        get = self.ranks.get
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), NEVER)
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), NEVER)
        ids = self.ids
        return [ids[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same over a linked list with a heap: a word of n symbols takes n log n steps."""
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[k], parts[j] = a + b, ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p in parts if p]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last letter and the end mark are one symbol."""
        out, i, n = [], 0, len(word)
        get, reach, inner = self.proposable.get, self.reach.get, n - 1 if word[-1:] == END else -1
        while i < n:
            for j in range(min(n, i + reach(word[i : i + 2], 1)), i, -1):
                if j != inner and (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token begins {word[i:]!r}")
        return out

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging its joined string gives the pair back."""
        holds = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 40, np.int64)
        while len(at):
            key = (a << 32) | b
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[k] == key, self.key_ranks[k], 1 << 41)
            bad = across < limit  # the merge over the seam would have come first
            holds[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            from_a = ra > rb  # undo the later of the two sides' last merges; of equal ones the right one
            limit = np.where(from_a, ra, rb + 1)
            a, b = np.where(from_a, self.right[a], a), np.where(from_a, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return holds

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each mapped word (with its end mark)."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        seam = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique((flat[seam] << 32) | flat[seam + 1], return_inverse=True)
        holds = self.pairs_hold(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        for w in np.unique(owner[seam[~holds]]):
            proposed[w] = self.merge(words[w])
        return proposed


class Codec:
    """Whole texts to ids and back, as the vocabulary's own normaliser, splitter and joiner do."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or not split["invert"] or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("only vocabularies with NFC, lower case, kept matches, word ends and joining by spaces are known here")
        self.bpe = WordBpe(spec)
        # white space never reaches a token, so that it need not be squeezed first
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.letters = dict(enumerate(byte_letters()))
        self.names = self.bpe.names.tolist()
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.known: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself: no final sigma
        return self.words.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            held = [w for w in words if w in self.known]
            self.known, self.shown = {w: self.known[w] for w in held}, {w: self.shown[w] for w in held}
        raw, names = self.raw, self.names
        mapped = [w.encode("utf-8").decode("latin-1").translate(self.letters) + END for w in new]
        for w, ids in zip(new, self.bpe.encode_words(mapped), strict=True):
            self.known[w], self.shown[w] = b"".join([raw[i] for i in ids]), " ".join([names[i] for i in ids])

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """Runs of words and, by themselves, the special tokens that stand in the text."""
        if self.bpe.split_special is None or not any(s in text for s in self.bpe.special):
            return [(False, self.split(text))]
        parts = self.bpe.split_special.split(text)
        return [(True, [p]) if k % 2 else (False, self.split(p)) for k, p in enumerate(parts)]

    def code(self, texts: list[str]) -> Iterator[tuple[bytes, str, int]]:
        """(ids as little-endian unsigned 32-bit, decoded text, number of ids) of each text."""
        split = [self.pieces(t) for t in texts]
        words: set[str] = set()
        for pieces in split:
            for special, found in pieces:
                if not special:
                    words.update(found)
        self.learn(words)
        raw, shown = self.known.__getitem__, self.shown.__getitem__
        for pieces in split:
            ids, text = [], []
            for special, found in pieces:
                if special:
                    ids.append(self.raw[self.bpe.special[found[0]]])
                    text.append(found[0])
                elif found:
                    ids.append(b"".join(map(raw, found)))
                    text.append(" ".join(map(shown, found)))
            joined = b"".join(ids)
            yield joined, " ".join(text), len(joined) // 4


def codec(path: str) -> Codec:
    store = process_cache("bpe")
    if path not in store:
        store[path] = Codec(path)
    return store[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_text, ids (array of long) and
    decoded.  Null text counts as empty: no tokens, digests of nothing.  Ties, repeated rows and null ids
    are rows of their own; an empty table gives no rows; other columns are not read.  vocabulary is a path
    that every executor can read.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    more = [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if keep_text else []
    schema = pa.schema(fields + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 1000):
                rows = []
                for i, (raw, decoded, n) in zip(ids[lo : lo + 1000], c.code(texts[lo : lo + 1000]), strict=True):
                    row = (i, n, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, np.frombuffer(raw, "<u4").tolist(), decoded) if keep_text else row)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(run), ddl)
