import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridlore.llm.bpe import codec, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "don't We'll THE", "x́é Å", "ΑΣ ΟΔΟΣ Σ", "İI ıß", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "\x1c\x85\xa0 a b", "１２ ½ x²", "日本語 한국어", "😀👍🏽", "aaaaaaaaaaaaaaaaaaaa" * 20, "\x00\x01", "thththth ininin", "l'été où ça"]


def check(texts):
    for t, (raw, decoded, n) in zip(texts, codec(PATH).code(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want and n == len(want), t
        assert decoded == LIBRARY.decode(want, skip_special_tokens=False), t


def test_odd_texts():
    check(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeghinorstu'ABCÉéß 19.,-"), max_size=60), min_size=1, max_size=4))
def test_same_as_library(texts):
    check(texts)


def test_pair_checks_equal_exact_merging():
    bpe, rng = codec(PATH).bpe, np.random.default_rng(1)
    inner = [s for s in bpe.proposable if not s.endswith("\0")]
    every = list(bpe.proposable)
    a, b = ([x[k] for k in rng.integers(len(x), size=4000)] for x in (inner, every))
    got = bpe.pairs_hold(np.array([bpe.ids[x] for x in a]), np.array([bpe.ids[x] for x in b]))
    want = [bpe.merge(x + y) == [bpe.ids[x], bpe.ids[y]] for x, y in zip(a, b, strict=True)]
    assert got.tolist() == want and 0 < sum(want) < 4000


def test_long_words_merge_alike(monkeypatch):
    import gridlore.llm.bpe as m

    bpe, words = codec(PATH).bpe, ["thethethation" * 30 + m.END, "aaaaaaaaab" * 20 + m.END, "ing" + m.END]
    monkeypatch.setattr(m, "LONG_WORD", 10_000)
    want = [bpe.merge(w) for w in words]
    monkeypatch.setattr(m, "LONG_WORD", 1)
    assert [bpe.merge(w) for w in words] == want


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (None, "", "y"), (2, "Hello hello", None), (2, "Hello hello", None)]])
def test_frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(encode_decode(df, PATH).collect(), key=str)
    want = sorted((i, t, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows if i) + [x for x in rows if x[0] is None]
    assert len(got) == len(want)
    for r in got:
        if r.doc_id == 2:
            assert r.n_tokens == len(r.ids) == 2
        else:
            assert r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_very_long_texts(spark):
    """Whole texts: a long word, long white space, and many words, each as one row."""
    texts = ["ab" * 60_000, " " * 500_000 + "end", "the quick foxes " * 20_000, "é日" * 20_000]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, keep_text=False).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
