"""Language identification by prediction by partial matching.

Every language gets a context tree over bytes: contexts of three bytes down to none, with escape probabilities
(method C), and below that a uniform guess over 256 bytes.  The trees are learnt from all labelled rows and then
frozen; the code length of a whole text under each is exact, and the shortest code names the language.  All
strings are kept: where those of an order fill more than CELLS code lengths, they lie in pages of that size, and
an executor takes one page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import clears_steps, materialise, revived, tidy
from gridlore.llm.words import lots

ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Code lengths (strings times languages) of a page, bytes that are counted and code lengths that are summed at once,
#: and counts that a task holds before it passes them on.
CELLS, STRETCH, SUMMED, HELD = 1 << 22, 1 << 19, 1 << 20, 1 << 18


def grams(texts: list[bytes], stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The last ORDER + 1 bytes at every byte as one number, by stretches, and the text of each; NULs stand before a text."""
    lead = bytes(ORDER)
    buffer = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
    begins = np.cumsum(sizes) - sizes
    for lo in range(ORDER, len(buffer), stretch):
        hi = min(lo + stretch, len(buffer))
        code = np.zeros(hi - lo, np.uint32)
        for k in range(ORDER, -1, -1):
            code = (code << np.uint32(8)) | buffer[lo - k : hi - k]
        owner = np.repeat(np.arange(len(texts)), np.clip(begins + sizes, lo, hi) - np.clip(begins, lo, hi))
        real = np.arange(lo, hi) - begins[owner] >= ORDER
        yield code[real], owner[real]


def count_grams(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, tuple[list[bytes], int]] = {}

        def add(lang: str) -> None:
            for code, _ in grams(held.pop(lang)[0]):
                code, n = np.unique(code, return_counts=True)
                if lang in total:
                    code, back = np.unique(np.concatenate([total[lang][0], code]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([total[lang][1], n])).astype(np.int64)
                total[lang] = code, n

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            total.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts, size = held.get(lang, ([], 0))
                texts.append(text.encode())
                held[lang] = texts, size + len(texts[-1])
                if held[lang][1] > STRETCH:
                    add(lang)
            if sum(len(code) for code, _ in total.values()) > HELD:
                yield from out()
        for lang in list(held):
            add(lang)
        yield from out()

    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen code lengths in bits of each byte after each context, for all languages at once."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.levels: list = []  # pages of strings, their bits; contexts, their escapes' bits: by order, then by string
        self.begins: list[tuple[int, int]] = []  # each page's order and the number from which its strings begin

    def page(self, number: int) -> tuple[np.ndarray, ...]:
        """A page, which an executor does not keep where there are several for an order."""
        held = self.levels[number]
        if isinstance(held, tuple):
            return held
        out = held.value
        if len(self.levels) > ORDER + 1:
            vars(held).pop("_value", None)
        return out

    def add(self, k: int, begin: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        """A page of order k, when all of lower orders are there: the languages' numbers, strings (context and next byte)
        and counts.  A context's strings lie in one page."""
        codes = np.unique(gram).astype(np.uint32)
        c = np.zeros((len(codes), len(self.langs)))
        np.add.at(c, (np.searchsorted(codes, gram), lang), n)
        context = codes >> np.uint32(8)
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, np.int64)
        total, distinct = (np.add.reduceat(x, heads, axis=0) if len(heads) else x[:0] for x in (c, (c > 0).astype(float)))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(codes))))
        below = self.bits(k - 1, codes & np.uint32((1 << 8 * k) - 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log2(total + distinct)[of] - np.log2(c)
            escape = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0)
        self.levels.append((codes, np.where(c > 0, known, escape[of] + below).astype(np.float32), context[heads], escape.astype(np.float32)))
        self.begins.append((k, begin))

    def bits(self, k: int, gram: np.ndarray) -> np.ndarray:
        """What the last byte of each string of k + 1 bytes costs after the others, in each language."""
        if k < 0:
            return np.full((len(gram), len(self.langs)), 8, np.float32)
        out, found = np.zeros((len(gram), len(self.langs)), np.float32), np.zeros(len(gram), bool)
        pages = [(number, begin) for number, (order, begin) in enumerate(self.begins) if order == k]
        for (number, begin), (_, end) in zip(pages, [*pages[1:], (0, 1 << 32)], strict=True):
            here = slice(None) if len(pages) == 1 else np.flatnonzero((gram >= begin) & (gram < end))
            some = gram[here]
            codes, bits, contexts, escapes = self.page(number) if len(some) else (gram[:0],) * 4
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(codes, some), len(codes) - 1)
            there = codes[at] == some
            j = np.minimum(np.searchsorted(contexts, some >> np.uint32(8)), len(contexts) - 1)
            escaped = np.where((contexts[j] == some >> np.uint32(8))[:, None], escapes[j], np.float32(0))
            out[here], found[here] = np.where(there[:, None], bits[at], escaped), there
        rest = ~found
        if rest.any():
            out[rest] += self.bits(k - 1, gram[rest] & np.uint32((1 << 8 * k) - 1))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for code, owner in grams(texts, max(1 << 12, SUMMED // max(1, len(self.langs)))):
            if len(code):
                used, back = np.unique(code, return_inverse=True)
                heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[heads]] += np.add.reduceat(self.bits(ORDER, used)[back], heads, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Each text's language, its posterior probability when all languages are as likely before, and the bits a
        byte that it takes under that language."""
        names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        for lot, raw in lots(known, [texts[k] for k in known], STRETCH):
            at, bits = lot, self.code_lengths(raw)
            least = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for k, best, p, total in zip(at, least, share, bits.min(1), strict=True):
                names[k], scores[k], rates[k] = self.langs[best], float(p), float(total) / len(texts[k].encode())
        return names, scores, rates


@clears_steps
def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Trees:
    """Learns from every row with a language and a text; equal code lengths go to the first language by name."""
    counted = materialise(count_grams(labelled, lang_col, text_col), "strings")
    trees = Trees(sorted(r["lang"] for r in counted.select("lang").distinct().collect()))
    for k in range(ORDER + 1):
        rows = counted.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        most = CELLS // max(1, len(trees.langs))
        begins = [0]
        if 1 << 8 * (k + 1) > most:  # else all strings of the length fit
            rows = materialise(rows, "level")
            sizes = rows.select("gram").distinct().groupBy(F.shiftright("gram", 8).alias("context")).agg(F.count("*").alias("n")).toArrow()
            begins += _cuts(sizes.column("context").to_numpy(), sizes.column("n").to_numpy(), most)
        for begin, end in zip(begins, [*begins[1:], 1 << 32], strict=True):
            page = rows.filter((F.col("gram") >= begin) & (F.col("gram") < end)).toArrow()  # at most CELLS rows, or one context's
            names = page.column("lang").combine_chunks().dictionary_encode()
            number = np.array([trees.langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
            lang = number[names.indices.to_numpy()] if page.num_rows else np.zeros(0, np.int64)
            trees.add(k, begin, lang, page.column("gram").to_numpy().astype(np.uint32), page.column("n").to_numpy().astype(np.float64))
    return trees


def _cuts(contexts: np.ndarray, sizes: np.ndarray, most: int) -> list[int]:
    """The strings from which further pages begin, so that each holds whole contexts and no more than ``most`` strings."""
    order = np.argsort(contexts)
    contexts, total = contexts[order], np.cumsum(sizes[order])
    out, lo = [], 0
    while lo < len(total):
        lo = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        if lo < len(total):
            out.append(int(contexts[lo]) << 8)
    return out


def _sent(docs: DataFrame, trees: Trees) -> dict:
    """What executors make the trees from: each page is broadcast by itself."""
    sc = docs.sparkSession.sparkContext
    return vars(trees) | {"levels": [sc.broadcast(page) for page in trees.levels]}  # at most CELLS code lengths each


def explained(docs: DataFrame, trees: Trees, most: float, text_col: str = "text") -> DataFrame:
    """The rows, whole and as they are, whose text has a language that takes at most ``most`` bits a byte."""
    model = _sent(docs, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = revived(Trees, model)
        for b in batches:
            names, _, rates = own.predict(b.column(text_col).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and r <= most for x, r in zip(names, rates, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", more: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every row; with ``more`` also bits_per_byte.

    A text that is null or has no letter, or any text if nothing was learnt, is ``und`` with score 0 and 0 bits.
    Repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are not read.
    """
    model = _sent(docs, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = revived(Trees, model)
        for b in batches:
            names, *numbers = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, bits_per_byte double")
    return found if more else found.drop("bits_per_byte")
