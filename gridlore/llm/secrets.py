"""Secret scanning with a random forest that removes false positives.

Everything is a column expression: words are split, candidates are found, described and scored inside one
row's arrays, and the fitted forest is written out as nested conditions, so that a scan neither shuffles
nor leaves the JVM.  A candidate is a run of at least 16 letters, digits and ``+/_-`` with a digit in it or
a telling word before it, or else any value of at least eight characters that is assigned to a telling word
(``password=...``, ``token : "..."``).  It is described by its length, classes and transitions of its characters, how
well neighbouring letters follow each other in the corpus, how much of it frequent words cover, the path,
and the words around it.  The forest is fitted on labelled findings, a table of a bounded size.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import materialise, shrink_driver

#: Words of the dictionary, trees and their depth, labelled findings of each kind that are made up.
DICTIONARY, TREES, DEPTH, EXAMPLES = 4000, 16, 7, 300
RUN = "[A-Za-z0-9+/_\\-]{16,}"
VALUE = "([^\\s\"'`]{8,})"
WHITE = "[ \\t-\\r]+"
# fixed values: words that announce a secret, and words that announce a harmless number
TELLING = "(?i)(token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
HARMLESS = "(?i)(commit|checksum|digest|sha1|sha256|md5|uuid|guid|revision|isbn|integrity|fingerprint|build)"
#: A telling word, the rest of its name and an assignment; the value may follow at once or as a word of its own.
ASSIGNED = TELLING + "[A-Za-z0-9_.\\-]*[\"'`\\])]*\\s*[=:]+>?\\s*[\"'`(\\[]*"
SAMPLE_PATH = "(?i)(test|example|sample|fixture|doc|mock)"


def dictionary(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int]]:
    """The most frequent short words of all texts with their counts; at most DICTIONARY."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITE), lambda w: F.length(w).between(3, 8))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("w").rlike("^[a-z]+$"))
    return [(r["w"], r["n"]) for r in counted.orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()]


def _tables(words: list[tuple[str, int]]) -> tuple[str, str]:
    """How well each letter follows another, and which three letters stand in a word: as lists in text form."""
    letters = string.ascii_lowercase
    pairs = {a + b: 0.5 for a in letters for b in letters}
    threes = set()
    for w, n in words:
        for k in range(len(w) - 1):
            pairs[w[k : k + 2]] += math.sqrt(n)
        threes.update(w[k : k + 3] for k in range(len(w) - 2))
    after = {a: sum(pairs[a + b] for b in letters) for a in letters}
    follow = ",".join(f"{math.log2(pairs[a + b] / after[a]):.3f}" for a in letters for b in letters)
    return follow, ",".join("1" if a + b + c in threes else "0" for a in letters for b in letters for c in letters)


class Describer:
    """The features of a finding (candidate, word, before, before2, after, path) as columns."""

    NAMES = ("length", "digits", "upper", "lower", "hexadecimal", "changes", "lower_digit", "upper_digit", "distinct", "enclosed", "follows", "covered", "telling", "assigned", "quoted", "harmless", "sample_path", "path_depth")

    def __init__(self, words: list[tuple[str, int]]):
        follow, threes = _tables(words)
        # lists in text form fold into one constant each
        self.follow = F.split(F.lit(follow), ",").cast("array<double>")
        self.threes = F.split(F.lit(threes), ",").cast("array<int>")

    def columns(self, x: Column) -> list[Column]:
        c, n = x["candidate"], F.length(x["candidate"]).cast("double")
        kinds = F.translate(c, string.ascii_letters + string.digits, "l" * 26 + "u" * 26 + "d" * 10)
        share = lambda pattern: F.regexp_count(kinds, F.lit(pattern)) / n
        low = F.regexp_replace(F.lower(c), "[^a-z]", "")
        size = F.length(low)
        code = lambda k: F.ascii(F.substring(low, k, F.lit(1))) - 97
        steps = lambda last: F.when(size >= last, F.sequence(F.lit(1), size - (last - 1))).otherwise(F.array().cast("array<int>"))
        follows = F.aggregate(steps(2), F.lit(0.0), lambda a, k: a + F.get(self.follow, code(k) * 26 + code(k + 1)))
        covered = F.aggregate(steps(3), F.lit(0), lambda a, k: a + F.get(self.threes, code(k) * 676 + code(k + 1) * 26 + code(k + 2)))
        word, before, before2, after, path = (F.coalesce(x[k], F.lit("")) for k in ("word", "before", "before2", "after", "path"))
        lead = F.substring(word, F.lit(1), F.greatest(F.position(c, word) - 1, F.lit(0)))
        told = F.concat_ws(" ", before2, before, lead)
        number = lambda b: b.cast("int").cast("double")
        return [
            n,
            share("d"),
            share("u"),
            share("l"),
            number(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            share("(?=(ld|dl|lu|ul|ud|du))"),
            share("(?=ld)"),
            share("(?=ud)"),
            F.size(F.array_distinct(F.split(c, ""))) / n,
            number(c.rlike("^[<{(\\[$%]+\\w+[>})\\]%]*$")),
            F.when(size >= 2, follows / (size - 1)).otherwise(F.lit(0.0)),
            F.when(size >= 3, covered / (size - 2)).otherwise(F.lit(0.0)).cast("double"),
            number(told.rlike(TELLING)),
            number(F.concat(before, lead).rlike("[=:]\\W*$")),
            number(lead.rlike("[\"'`]$")),
            number(F.concat(told, F.lit(" "), after).rlike(HARMLESS)),
            number(path.rlike(SAMPLE_PATH)),
            F.regexp_count(path, F.lit("/")).cast("double"),
        ]

    def struct(self, x: Column) -> Column:
        return F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in zip(self.NAMES, self.columns(x), strict=True)))


def findings(text: Column, path: Column) -> Column:
    """All candidates of a text: array of (word_no, candidate, word, before, before2, after, path)."""
    # bound as a variable, so that a text is split once
    bound = F.transform(F.array(F.split(F.coalesce(text, F.lit("")), WHITE)), lambda words: _of_words(words, path))
    return F.flatten(F.flatten(bound))


def _of_words(words: Column, path: Column) -> Column:
    """For each word that may hold candidates, an array of these."""
    # words that may hold a candidate: a long run, an assignment, or what follows one
    at = lambda k, d: F.when(k + d >= 0, F.get(words, k + d))
    numbered = F.transform(words, lambda w, k: F.struct(k.alias("k"), w.alias("w")))

    def marked(x: Column) -> Column:
        w, n = x["w"], F.length(x["w"])
        assigns = lambda sign: F.locate(sign, w).between(1, n - 8)
        before = at(x["k"], -1)
        follows = F.coalesce(F.endswith(before, F.lit("=")) | F.endswith(before, F.lit(":")) | F.endswith(before, F.lit(">")), F.lit(False))
        return (n >= 8) & (((n >= 16) & w.rlike(RUN)) | assigns("=") | assigns(":") | follows)

    def of(x: Column) -> Column:
        before, before2 = at(x["k"], -1), at(x["k"], -2)
        told = F.concat_ws(" ", before2, before, x["w"]).rlike(TELLING)
        runs = F.filter(F.regexp_extract_all(x["w"], F.lit(f"({RUN})"), F.lit(1)), lambda c: told | c.rlike("[0-9]"))
        inside = F.regexp_extract(x["w"], ASSIGNED + VALUE, 2)
        alone = F.when(F.concat_ws(" ", before2, before, F.lit("")).rlike(ASSIGNED + "\\s*$"), F.regexp_extract(x["w"], VALUE, 1)).otherwise(F.lit(""))
        value = F.regexp_replace(F.when(inside != "", inside).otherwise(alone), "[,;.)\\]]+$", "")
        found = F.when(F.size(runs) > 0, runs).when(F.length(value) >= 8, F.array(value)).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda c: F.struct(x["k"].alias("word_no"), c.alias("candidate"), x["w"].alias("word"), before.alias("before"), before2.alias("before2"), at(x["k"], 1).alias("after"), path.cast("string").alias("path")))

    return F.transform(F.filter(numbered, marked), of)


def labelled_examples(spark: SparkSession, words: list[tuple[str, int]], each: int = EXAMPLES) -> DataFrame:
    """Made-up labelled findings by fixed rules: ``each`` of every kind, the same on every call."""
    some = F.array(*(F.lit(w) for w, _ in (words[:400] or [("word", 1)])))
    word = lambda salt: F.get(some, F.pmod(F.xxhash64("id", F.lit(salt)), F.size(some)).cast("int"))
    hexadecimal = lambda salt, n: F.substring(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512), 1, n)
    mixed = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512))), "[=]", ""), 1, n)
    upper = lambda salt, n: F.substring(F.translate(F.upper(mixed(salt, 86)), "+/0189", "QXTZKW"), 1, n)
    digits = lambda salt, n: F.substring(F.translate(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512), "abcdef", "314159"), 1, n)
    long_word = F.concat(*(word(f"l{k}") for k in range(6)))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lit = F.lit
    # letters, digits and signs, with signs at places of their own
    short = lambda salt, n: F.substring(F.concat(F.substring(mixed(salt, 86), 1, 3), F.lit("!"), F.translate(F.substring(mixed(salt, 86), 4, 60), "+/bQ", "#$%&")), 1, n)
    kinds = [  # label, candidate, word around it, the word before, the one before that
        (1, hexadecimal("a", 40), quoted(hexadecimal("a", 40)), lit("="), lit("token")),
        (1, hexadecimal("b", 32), F.concat(lit("secret:"), hexadecimal("b", 32)), word("b1"), word("b2")),
        (1, hexadecimal("c", 18), F.concat(lit("password="), hexadecimal("c", 18)), word("c1"), word("c2")),
        (1, F.concat(lit("AKIA"), upper("d", 16)), F.concat(lit("AKIA"), upper("d", 16)), word("d1"), word("d2")),
        (1, F.concat(lit("AKIA"), upper("e", 16)), quoted(F.concat(lit("AKIA"), upper("e", 16))), lit("="), lit("access_key")),
        (1, F.concat(lit("ghp_"), F.regexp_replace(mixed("f", 36), "[+/]", "x")), F.concat(lit("ghp_"), F.regexp_replace(mixed("f", 36), "[+/]", "x")), word("f1"), word("f2")),
        (1, mixed("g", 40), F.concat(lit("api_key="), mixed("g", 40)), word("g1"), word("g2")),
        (1, mixed("h", 24), quoted(mixed("h", 24)), lit(":"), lit("password")),
        (1, short("A", 8), F.concat(lit("password="), short("A", 8)), word("A1"), word("A2")),
        (1, short("B", 11), F.concat(lit("passwd:"), short("B", 11)), word("B1"), word("B2")),
        (1, short("C", 14), quoted(short("C", 14)), lit("="), lit("secret")),
        (1, mixed("D", 10), F.concat(lit("pwd="), mixed("D", 10)), word("D1"), word("D2")),
        (1, hexadecimal("E", 12), F.concat(lit("token="), hexadecimal("E", 12)), word("E1"), word("E2")),
        (0, F.concat(word("F1"), word("F2")), F.concat(lit("password="), F.concat(word("F1"), word("F2"))), word("F3"), word("F4")),
        (0, F.concat(word("G1"), word("G2"), word("G3")), F.concat(word("G1"), word("G2"), word("G3")), lit(":"), lit("secret")),
        (0, F.repeat(lit("*"), 10), F.concat(lit("password="), F.repeat(lit("*"), 10)), word("H1"), word("H2")),
        (0, F.concat(lit("<"), word("I1"), lit("_"), word("I2"), lit(">")), F.concat(lit("token=<"), word("I1"), lit("_"), word("I2"), lit(">")), word("I3"), word("I4")),
        (0, F.concat(lit("<"), word("J1"), word("J2"), lit(">")), F.concat(lit("secret=<"), word("J1"), word("J2"), lit(">")), word("J3"), word("J4")),
        (0, F.concat(lit("<"), upper("L", 9), lit(">")), F.concat(lit("token=<"), upper("L", 9), lit(">")), word("L1"), word("L2")),
        (0, F.concat(lit("<"), F.lower(upper("M", 11)), lit(">")), F.concat(lit("<"), F.lower(upper("M", 11)), lit(">")), lit("="), lit("password")),
        (0, F.concat(lit("${"), F.upper(word("K1")), lit("_"), F.upper(word("K2")), lit("}")), F.concat(lit("password=${"), F.upper(word("K1")), lit("_"), F.upper(word("K2")), lit("}")), word("K3"), word("K4")),
        (0, F.repeat(lit("x"), 9), quoted(F.repeat(lit("x"), 9)), lit(":"), lit("password")),
        (0, digits("i", 16), digits("i", 16), word("i1"), word("i2")),
        (0, digits("j", 20), F.concat(lit("id="), digits("j", 20)), word("j1"), word("j2")),
        (0, hexadecimal("k", 40), hexadecimal("k", 40), lit("commit"), word("k2")),
        (0, hexadecimal("l", 64), F.concat(lit("sha256:"), hexadecimal("l", 64)), word("l1"), lit("digest")),
        (0, hexadecimal("m", 32), hexadecimal("m", 32), lit("md5"), lit("checksum")),
        (0, long_word, long_word, lit("the"), lit("password")),
        (0, F.concat(long_word, digits("n", 2)), F.concat(long_word, digits("n", 2)), word("n1"), word("n2")),
        (0, F.concat_ws("_", word("o1"), word("o2"), word("o3"), digits("o", 1)), F.concat(lit("token="), F.concat_ws("_", word("o1"), word("o2"), word("o3"), digits("o", 1))), word("o4"), word("o5")),
        (0, F.concat_ws("/", word("p1"), word("p2"), word("p3"), digits("p", 4)), F.concat_ws("/", word("p1"), word("p2"), word("p3"), digits("p", 4)), word("p4"), word("p5")),
        (0, F.concat_ws("-", hexadecimal("q", 8), hexadecimal("r", 4), hexadecimal("s", 12)), F.concat_ws("-", hexadecimal("q", 8), hexadecimal("r", 4), hexadecimal("s", 12)), lit("uuid"), word("q2")),
        (0, F.concat(lit("2024-01-"), digits("t", 2), lit("T"), digits("u", 6)), F.concat(lit("2024-01-"), digits("t", 2), lit("T"), digits("u", 6)), word("t1"), word("t2")),
        (0, F.concat(lit("x"), F.repeat(lit("x1"), 12)), F.concat(lit("password="), lit("x"), F.repeat(lit("x1"), 12)), word("v1"), word("v2")),
    ]
    kind = F.col("id") % len(kinds)

    def pick(k: int) -> Column:
        out = F.when(kind == 0, kinds[0][k])
        for n, row in enumerate(kinds[1:], 1):
            out = out.when(kind == n, row[k])
        return out

    base = spark.range(0, each * len(kinds), 1, 1)
    label = F.element_at(F.array(*(lit(float(k[0])) for k in kinds)), (kind + 1).cast("int"))
    return base.select(label.alias("label"), pick(1).alias("candidate"), pick(2).alias("word"), pick(3).alias("before"), pick(4).alias("before2"), word("z").alias("after"), F.concat(lit("src"), F.col("id") % 20).alias("path"))


def train(labelled: DataFrame, describer: Describer, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Fits the forest on labelled findings (label, candidate, word, before, before2, after, path)."""
    rows = labelled.select("label", describer.struct(F.struct("candidate", "word", "before", "before2", "after", "path")).alias("f")).select("label", "f.*")
    # the forest reads its rows several times: they are described once
    vectors = VectorAssembler(inputCols=list(Describer.NAMES), outputCol="features").transform(materialise(rows.coalesce(1), "findings"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="onethird").fit(vectors.select("label", "features"))


def written_out(model: RandomForestClassificationModel, features: Column) -> Column:
    """The forest's mean probability as conditions over a struct of features."""

    def node(x) -> Column:
        if x.numDescendants() == 0:
            zero, one = x.impurityStats().stats()
            return F.lit(float(one / (zero + one)))
        split = x.split()
        return F.when(features[Describer.NAMES[split.featureIndex()]] <= float(split.threshold()), node(x.leftChild())).otherwise(node(x.rightChild()))

    roots = [t._call_java("rootNode") for t in model.trees]
    total = node(roots[0])
    for r in roots[1:]:
        total = total + node(r)
    return total / F.lit(float(len(roots)))


class Scanner:
    """Finds secrets in texts."""

    def __init__(self, describer: Describer, model: RandomForestClassificationModel):
        self.describer, self.model = describer, model

    @classmethod
    def fitted(cls, docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> Scanner:
        """The dictionary comes from all texts; the forest from ``labelled``, by default made-up findings."""
        words = dictionary(docs, text_col)
        describer = Describer(words)
        model = train(labelled if labelled is not None else labelled_examples(docs.sparkSession, words), describer)
        shrink_driver(docs.sparkSession)  # the fit's jobs and plans are done; the scan's plan is large itself
        return cls(describer, model)

    def scored(self, text: Column, path: Column) -> Column:
        """Array of (word_no, candidate, score) of a text's candidates; empty for null or empty texts."""
        described = F.transform(findings(text, path), lambda x: F.struct(x["word_no"].alias("word_no"), x["candidate"].alias("candidate"), self.describer.struct(x).alias("f")))
        return F.transform(described, lambda x: F.struct(x["word_no"].alias("word_no"), x["candidate"].alias("candidate"), written_out(self.model, x["f"]).alias("score")))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
        """One row per candidate: doc_id, word_no (from 0), candidate, score (0 to 1), secret (score over 0.5).

        Texts are scanned whole, however long.  Rows without candidates give none; repeated rows give theirs each;
        null ids, texts and paths are allowed; an empty table gives no rows; other columns are not read.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(self.scored(F.col(text_col), F.col(path_col))).alias("x"))
        return rows.select("doc_id", "x.word_no", "x.candidate", "x.score", (F.col("x.score") > 0.5).alias("secret"))

    def redacted(self, text: Column, path: Column, mark: str = "[secret]") -> Column:
        """The text with every secret replaced, wherever its characters stand, inside longer words too; null stays null."""
        secrets = F.filter(self.scored(text, path), lambda x: x["score"] > 0.5)
        return F.aggregate(secrets, text, lambda t, x: F.replace(t, x["candidate"], F.lit(mark)))
