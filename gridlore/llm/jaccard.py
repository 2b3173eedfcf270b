"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word n-grams, as 64-bit fingerprints.  Documents of equal sets are one class, and
only classes are joined.  All sets are ordered alike, n-grams that are rare by estimate first.  Two sets
that link share at least l n-grams within their first n - o + l, where o is the least overlap a set of n
can link with, for any l: each document picks the l whose prefix promises the least work (postings read
plus candidates verified, by estimated frequencies), and a pair needs as many shared prefix n-grams as the
smaller l of the two.  Candidates of fitting size and parity sketches are verified on the whole sets: first
a few of each class, from a few elected lists only and by a thin sketch, which tie groups of near copies
together in a number of rows that grows with the classes; then all pairs between the components so found.
Estimates, elections and thin sketches move work only, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import clears_steps, materialise, tidy
from gridlore.llm.components import components
from gridlore.llm.words import Words, distinct, lots, mix, sequences

#: Entries of the table of frequent n-grams (a hint for the order), the longest l, and what verifying a
#: candidate costs in postings.
FREQUENT, MOST_MATCHES, VERIFY = 1 << 18, 8, 20.0
#: Members of a posting list that one task compares; longer lists are dealt over pairs of their parts.  Shorter ones lie
#: with the other lists that their smallest class leads, so that a pair which shares many n-grams is counted in one
#: place; PAIRS that wait to be counted.
LIST, PAIRS = 2048, 1 << 18
#: Before components are known, each class meets partners in so many of its lists, elected alike by all, and in each
#: of them the first and so many next to it whose thin sketches differ in at most so many of 128 bits.
FIRST, NEAREST, ALIKE = 4, 2, 28
#: N-grams whose texts meet in one place for verification.
CELL = 1 << 20
#: Ids that are sent to all executors at once; more are joined by a shuffle.
SENT_IDS = 1 << 20
#: Columns of the parity sketch of a whole set and of the thin one.
_WHOLE, _THIN = ("s0", "s1", "s2", "s3"), ("t0", "t1")
_SKETCHES = _WHOLE + _THIN


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's word n-grams after lower-casing A-Z; a text with fewer
    words is one n-gram, one without words is empty."""
    w = Words([t.lower() for t in texts])
    grams = sequences(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(distinct(grams[a : b - n + 1]))
        elif b > a:
            out.append(sequences(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity_bits(s: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` classes (a power of two) whether an odd number of the set falls into it: two sets
    differ in at least as many elements as classes.  Halves combine by exclusive or into fewer classes."""
    return np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1


def thin_parity(s: np.ndarray) -> np.ndarray:
    """Parity in 128 classes of 32 to 64 of a set's elements, or of all of fewer: by its size it takes one in a power
    of two.  Near copies, however long, differ in few classes; unrelated sets do in about 45."""
    h = mix(s ^ np.uint64(0x6A09E667F3BCC909))
    some = s[(h & np.uint64((1 << max(0, len(s).bit_length() - 6)) - 1)) == 0]
    return np.packbits(parity_bits(some, 128)).view("<i8")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def frequent_ngrams(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT n-grams that repeat within partitions, with their counts: an estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, raw in lots(b.column(0), b.column(1)) for s in ngram_sets(raw, n)]
            if not sets:
                continue
            gram = np.sort(np.concatenate(sets))
            at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(gram)))
            keep = count > 2
            yield pa.RecordBatch.from_arrays([pa.array(gram[at[keep]].view(np.int64)), pa.array(count[keep])], names=["gram", "n"])

    counts = materialise(_texts(docs, id_col, text_col).mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "frequent")
    by_size = sorted(((r["size"], r["grams"]) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("size")).agg(F.count("*").alias("grams")).collect()), reverse=True)
    least, total = None, 0
    for size, grams in by_size:  # from the most frequent down, as long as the table stays small
        if (total := total + grams) > FREQUENT:
            break
        least = size
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.filter(F.floor(F.log2("n") * 4) >= least).toArrow()
    gram, n_of = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n_of[order]


def prefixes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, size, digest of the set, parity sketch, l and the prefix."""
    found = frequent_ngrams(docs, n, id_col, text_col)
    hint = docs.sparkSession.sparkContext.broadcast(found)  # at most FREQUENT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = hint.value
        for b in batches:
            for ids, raw in lots(b.column(0), b.column(1)):
                rows = []
                for i, s in zip(ids, ngram_sets(raw, n), strict=True):
                    size = len(s)
                    if not size:
                        rows.append((i, 0, b"", *[0] * len(_SKETCHES), b"", 0, b""))
                        continue
                    df = np.ones(size, np.int64)
                    if len(grams):
                        k = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                        df = np.where(grams[k] == s, counts[k], 1)
                    order = np.lexsort((s, df))
                    overlap = -(-num * size // den)
                    matches = np.arange(1, min(MOST_MATCHES, overlap) + 1)
                    reads = np.cumsum(df[order])[size - overlap + matches - 1]
                    cost = reads + VERIFY * (reads - (size - overlap + matches)) / matches
                    m = int(matches[cost.argmin()])
                    bits = parity_bits(s, max(256, 1 << (size - 1).bit_length()))
                    parity = np.packbits(np.bitwise_xor.reduce(bits.reshape(-1, 256), 0)).view("<i8")
                    prefix = s[order[: size - overlap + m]]
                    rows.append((i, size, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *parity.tolist(), *thin_parity(s).tolist(), np.packbits(bits).tobytes(), m, prefix.tobytes()))
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * len(_SKETCHES), pa.binary(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "size", "digest", *_SKETCHES, "sketch", "matches", "prefix"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), f"doc_id long, size int, digest binary, {', '.join(f'{c} long' for c in _SKETCHES)}, sketch binary, matches int, prefix binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prefix = b.column(1).to_pylist()
        sizes = np.fromiter(map(len, prefix), np.int64, len(prefix)) // 8
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefix), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sizes))], names=["gram", "a"])


_NAMES = ("key", "gram", "p", "q", "part", "a", "size", "matches", *_SKETCHES, "label")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists (gram, p, q), several at a time, of rows that come sorted by list."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = {c: b.column(c).to_numpy() for c in _NAMES}
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in _NAMES}
        last = (held["key"] == held["key"][-1]) & (held["gram"] == held["gram"][-1]) & (held["p"] == held["p"][-1]) & (held["q"] == held["q"][-1])
        if not last.all():
            cut = len(last) - int(last[::-1].argmin())
            yield {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
    if held is not None:
        yield held


def _pairs(num: int, den: int, ties: bool):
    """Candidate pairs of each list (gram, p, q), whose rows come sorted by list and size: all pairs of different
    labels, or with ``ties`` each row with the list's first and the NEAREST like ones that it meets going down in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def counted() -> pa.RecordBatch:
            a, b, need = map(np.concatenate, zip(*waiting, strict=True))
            waiting.clear()
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(need[head]), pa.array(np.diff(np.append(head, len(a))))], names=["a", "b", "need", "met"])

        for x in _whole_lists(batches):
            size = x["size"].astype(np.int64)
            begins = np.ones(len(size), bool)
            begins[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["p"][1:] != x["p"][:-1]) | (x["q"][1:] != x["q"][:-1])
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(size)), 0))
            # lists with one label have nothing to say
            heads = np.flatnonzero(begins)
            labels = (np.maximum.reduceat(x["label"], heads) != np.minimum.reduceat(x["label"], heads))[np.cumsum(begins) - 1]

            def differ(i, j, sketch):
                return sum(np.bitwise_count((x[c][i] ^ x[c][j]).view(np.uint64)).astype(np.int64) for c in sketch)

            def passing(i, j):
                apart = differ(i, j, _WHOLE)
                ok = (apart * (den + num) <= (size[i] + size[j]) * (den - num)) & (x["label"][i] != x["label"][j]) & (size[i] * den >= size[j] * num)
                if ties:
                    ok &= differ(i, j, _THIN) <= ALIKE
                return ok & ((x["part"][i] != x["part"][j]) | (x["p"][i] == x["q"][i]))  # a pair within a part is met in the part's own list

            def pairs(i, j):
                a, b, need = x["a"][i], x["a"][j], np.minimum(x["matches"][i], x["matches"][j])
                if len(a):
                    waiting.append((np.minimum(a, b), np.maximum(a, b), need))

            j, step, given = np.flatnonzero(labels), 0, np.zeros(len(size), np.int64)
            if ties:  # so that one chain's break parts nothing; rows next to the first one meet it below
                far = j[j - begin[j] > NEAREST]
                far = far[passing(begin[far], far)]
                pairs(begin[far], far)
            while len(j):
                step += 1
                j = j[j - step >= begin[j]]
                i = j - step
                go = size[i] * den >= size[j] * num  # sorted by size: a row that has come to too small ones is done
                i, j = i[go], j[go]
                ok = passing(i, j)
                if ok.any():
                    pairs(i[ok], j[ok])
                if sum(len(y[0]) for y in waiting) > PAIRS:
                    yield counted()
                if ties:
                    given[j[ok]] += 1
                    j = j[given[j] < NEAREST]
        if waiting:
            yield counted()

    return run


def posting_lists(sets: DataFrame) -> DataFrame:
    """Rows (key, gram, parts, part, a, first, size, matches, sketches) of all prefix n-grams that several classes share.
    A class lies in unrelated parts of different lists."""
    postings = sets.select("a", "prefix").mapInArrow(tidy(_postings), "gram long, a long")
    lengths = postings.groupBy("gram").agg(F.count("*").alias("n"), F.min("a").alias("leader")).filter("n > 1")
    shared = postings.join(lengths, "gram").withColumn("key", F.when(F.col("n") <= LIST, F.col("leader")).otherwise(F.col("gram"))).withColumn("parts", F.ceil(F.col("n") / F.lit(LIST)).cast("int"))
    part = F.pmod(F.xxhash64("a", "gram"), F.col("parts")).cast("int").alias("part")
    shared = shared.join(sets.select("a", "size", "matches", *_SKETCHES), "a")
    elected = F.row_number().over(Window.partitionBy("a").orderBy(F.col("parts") > 1, F.xxhash64("gram"), "gram"))
    return shared.withColumn("first", elected <= FIRST).select("key", "gram", "parts", part, "a", "first", "size", "matches", *_SKETCHES)


def candidates(lists: DataFrame, sets: DataFrame, num: int, den: int, ties: bool) -> DataFrame:
    """(a, b) of classes with different labels that share enough prefix n-grams; with ``ties`` a few for each class,
    and no count is asked for."""
    if ties:
        dealt = lists.withColumns({"p": F.col("part"), "q": F.col("part")})
    else:
        each = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = each.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    dealt = dealt.select(*_NAMES).repartition("key", "p", "q").sortWithinPartitions("key", "gram", "p", "q", "size", "a")
    pairs = dealt.mapInArrow(tidy(_pairs(num, den, ties)), "a long, b long, need int, met long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
    pairs = (pairs if ties else pairs.filter("met >= need")).select("a", "b")
    left = pairs.join(sets.select("a", F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a")), "a")
    both = left.join(sets.select(F.col("a").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(tidy(_sketched(num, den)), "a long, b long")


def _sketched(num: int, den: int):
    """Drops pairs whose parity sketches differ in more classes than linked sets can differ in n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                bytes_ = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, bytes_), 0) for z in (x, y))
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (n + m) * (den - num))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


@clears_steps
def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets link.

    Texts travel once: all that candidates connect meets in one place and is compared there.  What weighs
    more than CELL n-grams is dealt in parts, and two parts meet where a pair asks for it.
    """
    whole = components(pairs)
    weighed = materialise(whole.join(sets.select(F.col("a").alias("node"), "size"), "node"), "candidate-sizes")
    heavy = weighed.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(CELL)).cast("int").alias("parts"))
    total = weighed.agg(F.sum("size")).first()[0] or 0
    buckets = F.lit(max(1, -(-total // CELL)))
    node = weighed.join(heavy, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    node = materialise(node.select("node", "component", "parts", "part"), "candidate-parts")

    def cell(p, q):
        return F.when(F.col("parts") > 1, F.xxhash64("component", p, q)).otherwise(F.pmod(F.xxhash64("component"), buckets)).alias("cell")

    ends = pairs.join(node.select(F.col("node").alias("a"), "component", "parts", F.col("part").alias("part_a")), "a")
    ends = ends.join(node.select(F.col("node").alias("b"), F.col("part").alias("part_b")), "b")
    ends = materialise(ends.select(cell(F.least("part_a", "part_b"), F.greatest("part_a", "part_b")), "a", "b"), "candidate-ends")
    at = ends.select(F.col("a").alias("doc_id"), "cell").unionByName(ends.select(F.col("b").alias("doc_id"), "cell"))
    at = materialise(at.distinct(), "candidate-cells")
    asked = F.broadcast(at) if at.count() <= SENT_IDS else at
    texts = _texts(docs, id_col, text_col).join(asked, "doc_id").select("cell", "doc_id", "text")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for ids, raw in lots(left.column("doc_id"), left.column("text")):
            held.update(zip(ids, ngram_sets(raw, n), strict=True))
        keep = []
        for x, y in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True):
            x, y = held[x], held[y]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        return right.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return texts.groupBy("cell").cogroup(ends.groupBy("cell")).applyInArrow(compare, "a long, b long")


@clears_steps
def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose n-gram sets have den * |intersection| >= num * |union|.

    Returns per row: doc_id, n_shingles (the set's size), class_id (smallest id with the same set),
    component_id (smallest id that links reach, its own included).  Null, empty and white texts have no
    n-gram and link with nothing.  Repeated rows are rows of their own with one result; rows with a null id
    take no part in links and have a null component.  Rows that share an id but not a text are an error of
    the input, and only one of the texts is verified.  An empty table gives no rows; other columns are not
    read.
    """
    if not 0 < num <= den or n < 1:
        raise ValueError("0 < num <= den and n >= 1 are asked for")
    rows = materialise(prefixes(docs, n, num, den, id_col, text_col), "prefixes")
    usable = rows.filter("size > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    sets = usable.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    sets = materialise(sets.select(F.col("doc_id").alias("a"), "size", "matches", *_SKETCHES, "sketch", "prefix"), "sets")
    lists = materialise(posting_lists(sets), "lists")
    # a group of near copies is tied together by a few links each, in elected lists and, where that left like classes
    # apart, in all; other pairs are needed between components only
    links, met = None, None
    for ties, among in ((True, lists.filter("first")), (True, lists), (False, lists)):
        label = F.col("a").alias("label") if links is None else F.coalesce("component", "a").alias("label")
        if links is not None:
            among = among.join(components(links).withColumnRenamed("node", "a"), "a", "left")
        pairs = candidates(among.select(*lists.columns, label), sets, num, den, ties)
        pairs = materialise(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"), "candidates")
        found = materialise(verified(pairs, sets, docs, n, num, den, id_col, text_col), "links")
        links, met = (found, pairs) if links is None else (links.unionByName(found), met.unionByName(pairs))
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = rows.select("doc_id", "size", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"), own.otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
