import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from mensura.llm import quality
from mensura.llm.quality import FIELDS, Words, describe, fit_texts, viterbi

COMMON = "the of and to in a is that it was for on with as by at this were which from be not but are or an".split()
NOUNS = "emulsion droplet panel sample texture viscosity protein cream layer phase cup week valve oven scale table".split()
VERBS = "was kept in the dark|was measured at the end|is not clear|was served with a spoon|did not change in this case|was higher than that of the control".split("|")


def prose(rng, n=8):
    return " ".join(f"{'The' if rng.random() < 0.6 else 'For this reason, the'} {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)}, and the {rng.choice(NOUNS)} {rng.choice(VERBS)}." for _ in range(n))


def table(rng):
    return "\n".join("\t".join(f"{rng.random() * 90:.2f}" for _ in range(5)) for _ in range(12))


def listing(rng):
    return "\n".join(f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(15))


def junk(rng):
    kind = rng.randint(0, 3)
    if kind == 0:
        return "".join(rng.choice("{}[]|\\/<>~^_;:") for _ in range(300))
    if kind == 1:
        return " ".join([rng.choice(NOUNS)] * 60)
    if kind == 2:
        return "\n".join("".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(64)) for _ in range(6))
    words = prose(rng).lower().replace(",", "").replace(".", "").split()
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    return fit_texts([prose(rng) for _ in range(200)] + [f(rng) for _ in range(40) for f in (table, listing, junk)], Words.of(COMMON))


def rows(texts, model):
    return [dict(zip(FIELDS, r)) for r in zip(*[c.to_pylist() for c in describe(pa.array(texts, pa.string()), model)])]


def test_held_out_kinds(model):
    rng = random.Random(5)
    right = 0
    for make, want in ((prose, "prose"), (table, "other"), (listing, "other"), (junk, "other")):
        got = rows([make(rng) for _ in range(40)], model)
        right += sum((r["prose_share"] > 0.5) == (want == "prose") for r in got)
    assert right >= 155  # of 160


def test_mixed_texts_count_by_their_larger_part(model):
    rng = random.Random(6)
    a, b = rows([prose(rng, 12) + "\n" + table(rng), prose(rng, 1) + "\n" + table(rng) + "\n" + table(rng)], model)
    assert a["prose_share"] > 0.5 > b["prose_share"]


def test_statistics(model):
    (r,) = rows(["The cat sat. On 2 mats!\n\n  — x\nend"], model)
    assert (r["n_chars"], r["n_lines"], r["n_words"]) == (34, 3, 7)
    assert r["mean_word_length"] == pytest.approx(19 / 7) and r["common_word_share"] == pytest.approx(2 / 7)
    assert r["punctuated_line_share"] == pytest.approx(1 / 3) and r["symbol_ratio"] == pytest.approx(3 / 23)


def test_null_empty_and_blank_texts(model):
    for r in rows([None, "", " \n\t　"], model):
        assert r["kind"] is None and r["prose_share"] is None and r["n_words"] == 0 and r["mean_word_length"] is None
    assert rows([], model) == []


def test_long_texts_and_chunks_agree(model, monkeypatch):
    from mensura.llm import codepoints

    rng = random.Random(7)
    texts = [prose(rng, 30), table(rng), "", prose(rng, 2), junk(rng), None, "x" * 5000]
    want = rows(texts, model)
    monkeypatch.setattr(codepoints, "CHUNK", 700)
    got = rows(texts, model)
    for a, b in zip(want, got):
        assert a["kind"] == b["kind"] and a["n_words"] == b["n_words"] and a["n_chars"] == b["n_chars"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    move, start = np.log(rng.dirichlet(np.ones(4), 4)), np.log(rng.dirichlet(np.ones(4)))
    lengths = [3, 1, 0, 5, 2]
    score = rng.normal(size=(sum(lengths), 4))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    got = viterbi(score, edges, move, start)
    for a, b in zip(edges, edges[1:]):
        if b > a:
            value = lambda p: start[p[0]] + sum(move[x, y] for x, y in zip(p, p[1:])) + sum(score[a + i, x] for i, x in enumerate(p))
            assert tuple(got[a:b]) == max(itertools.product(range(4), repeat=b - a), key=value)


def test_frame(spark):
    rng = random.Random(8)
    data = [(i, prose(rng)) for i in range(30)] + [(100 + i, table(rng)) for i in range(10)] + [(None, "x y"), (7, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS kind")
    got = quality.quality(df, "doc_id", "text", Words.of(COMMON)).collect()
    assert len(got) == 42 and sum((r.prose_share or 0) > 0.5 for r in got if r.doc_id is not None and r.doc_id < 30) == 30
    assert quality.quality(df.limit(0), "doc_id", "text", Words.of(COMMON)).count() == 0


def test_counts_cover_all_documents(spark):
    """Only the refitting rounds see the sample; pairs and clear lines are those of all texts."""
    rng = random.Random(9)
    texts = [prose(rng) for _ in range(60)] + [f(rng) for _ in range(10) for f in (table, listing, junk)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = Words.of(COMMON)
    want, got = fit_texts(texts, words), quality.fit_on(df, "doc_id", "text", words, documents=5)
    assert np.allclose(want.pairs, got.pairs) and np.allclose(want.letters, got.letters)
    seeds, none = fit_texts(texts, words, rounds=0), quality.fit_on(df, "doc_id", "text", words, documents=0)
    assert all(np.allclose(a, b, atol=0.3) for a, b in zip(seeds.emission, none.emission)) and np.allclose(seeds.transition, none.transition, atol=0.3)


def test_long_texts_go_in_blocks():
    """Texts of many lines are labelled by blocks; the ways are as good as those found line by line."""
    rng = np.random.default_rng(3)
    edges = np.array([0, 700, 703, 703, 2000, 2512])
    score, move, start = rng.normal(size=(2512, 4)) * 2, np.log(rng.dirichlet([4, 1, 1, 1], 4)), np.log(rng.dirichlet([1] * 4))
    blocks = quality.viterbi(score, edges, move, start)
    whole = quality._together(score, edges[:-1], np.diff(edges), np.broadcast_to(start, (5, 4)), np.full(5, -1), move)
    value = lambda p, a: start[p[0]] + move[p[:-1], p[1:]].sum() + score[a + np.arange(len(p)), p].sum()
    for a, b in zip(edges, edges[1:]):
        if b > a:
            assert value(blocks[a:b], a) == pytest.approx(value(whole[a:b], a))


def test_a_very_long_text_is_one_chain():
    rng = random.Random(4)
    words, text = Words.of(COMMON), "\n".join(prose(rng, 1) for _ in range(25_000))
    model = fit_texts([prose(rng) for _ in range(100)] + [table(rng) for _ in range(30)], words)
    assert len(text) > 2_300_000
    got = dict(zip(FIELDS, (x.to_pylist()[0] for x in describe(pa.array([text]), model))))
    assert got["n_chars"] == len(text) and got["n_lines"] == 25_000 and got["prose_share"] > 0.95
