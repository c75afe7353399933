import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mensura.llm import codepoints, encode
from mensura.llm.queries import tokenizer_path

PATH = tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
HARD = [
    "", " ", "don't we'll they've I'm 'sabc'd ''s x's!'s  's \n's 'r 're 'v", "a  b   c\n\n d   e\t\tf ", "x   y\x1c z\x85q", "½²٣ ʼs’s", "a" * 500 + " " + "ab" * 300, "Ünïcode 你好世界 🙂🙂 ‍ zwj", "'", "''", "'s", "a'", "<|endoftext|>",
    "é ​ x﻿", "  leading", "trailing  ", "\r\n\r\n", "1234567 12,5", "ﬁ ﬀ ①", "0123456789abcdef" * 40, "'" * 60, "\x00\x01",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(PATH)


def ids(texts, encoder):
    return encode.encode_arrow(pa.array(texts, pa.string()), encoder)[0].to_pylist()


def test_hard_texts(reference, encoder):
    assert ids(HARD, encoder) == reference(HARD)
    assert ids([None, "", None], encoder) == [[], [], []]
    assert ids([], encoder) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stredmvl.,1a²　"), st.characters(blacklist_categories=("Cs", "Cn", "Co"))), max_size=40), max_size=6))
def test_any_texts(texts):
    enc = test_any_texts.__dict__.setdefault("encoder", encode.Encoder(PATH))
    got = ids(texts, enc)
    assert [encode.decode(g, PATH) for g in got] == texts
    tokenizers = pytest.importorskip("tokenizers")
    t = test_any_texts.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    known = [all(ord(c) < 0x3000 for c in x) for x in texts]  # newer letters may be classed by another Unicode version
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [g for g, k in zip(got, known) if k] == [w for w, k in zip(want, known) if k]


def test_scan_equals_a_walk():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 16, 5000).astype(np.uint8)
    state, want = encode._DONE, []
    for s in symbols.tolist():
        want.append(state)
        state = encode._step(state, s)[0]
    assert encode._states_before(symbols).tolist() == want


def test_very_long_texts_are_whole(reference, encoder, monkeypatch):
    monkeypatch.setattr(codepoints, "CHUNK", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "don't\n\n", "  x", "1.5 ", "é", "nospaceatall"]) for _ in range(n)) for n in (3, 400, 1, 90, 0, 700)] + ["b" * 500]
    assert ids(texts, encoder) == reference(texts)
    got, starts = encode.encode_arrow(pa.array(texts), encoder, offsets=True)
    for text, s in zip(texts, starts.to_pylist()):
        assert s == sorted(s) and (not s or (s[0] == 0 and s[-1] < len(text)))


def test_offsets_lead_back(encoder):
    text = "The café's 12 µm, don't"
    got, starts = (x.to_pylist()[0] for x in encode.encode_arrow(pa.array([text]), encoder, offsets=True))
    edges = sorted({*starts, len(text)})
    for a, b in zip(edges, edges[1:]):
        assert encode.decode([i for i, s in zip(got, starts) if s == a], PATH) == text[a:b]


def test_dropping_kept_pretokens_changes_nothing(reference):
    enc = encode.Encoder(PATH, most=5)
    for _ in range(3):
        assert ids(HARD, enc) == reference(HARD)


def test_frames(spark, reference):
    rows = [(1, "a b"), (2, None), (None, ""), (1, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode.encode(df.selectExpr("doc_id", "text", "'x' AS ids"), "doc_id", "text", PATH)
    assert sorted(((r.doc_id or 0, r.ids) for r in got.collect())) == sorted([(1, reference(["a b"])[0])] * 2 + [(2, []), (0, [])])
    assert encode.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert sorted(r.tokens for r in encode.count_tokens(df, ["doc_id"], "text", PATH).collect()) == [0, 0, 2, 2]


def test_slices_that_share_a_hash_are_told_apart(reference, monkeypatch):
    """Even if all pre-tokens had one hash, the ids would be right."""
    monkeypatch.setattr(encode.Encoder, "_hash", staticmethod(lambda chunk, start, end: np.full(len(start), 7, np.uint64)))
    enc = encode.Encoder(PATH)
    for _ in range(2):
        assert ids(HARD, enc) == reference(HARD)
