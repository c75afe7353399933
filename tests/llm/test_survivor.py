import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import survivor
from mensura.llm.survivor import Groups, infer

SCHEMA = "row_id long, k string, m int, source string, at int, a string, b string, _v0 string"
TRUST = {"good": 3, "fair": 2, "poor": 1}


def groups(df):
    return Groups(df, {"k": F.col("k"), "m": F.col("m")}, F.col("row_id"), F.col("source"), TRUST, F.col("at"), {c: (F.col(c).isNotNull() & (F.col(c) != ""), F.col(c)) for c in ("a", "b")})


def whole_rows(rows):
    by = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1:3], []).append(r)
    out = {}
    for key, g in by.items():
        mask = lambda r: tuple(bool(v) for v in r[5:7])
        full, last, top = tuple(any(mask(r)[i] for r in g) for i in range(2)), max(-9 if r[4] is None else r[4] for r in g), max(TRUST.get(r[3], 0) for r in g)
        ok = [r[0] for r in g if mask(r) == full and (-9 if r[4] is None else r[4]) == last and TRUST.get(r[3], 0) == top]
        out[key] = (len(g), min(ok) if ok else None)
    return out


def data(seed, n=600):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, None]) if i % 3 else 1, rng.choice(["good", "fair", "poor", "odd", None]), rng.choice([1, 2, None]), rng.choice([None, "", "p", "q"]), rng.choice([None, "u"]), "clash") for i in range(n)]
    return rows + [(n + i, f"s{i}", 1, "good", 1, "p", None, None) for i in range(40)]


@pytest.mark.parametrize("seed", range(2))
def test_survivors_against_brute_force(spark, seed):
    rows = data(seed, 200)
    g = groups(spark.createDataFrame(rows, SCHEMA))
    want = whole_rows(rows)
    got = {(r.k, r.m): r for r in g.survivors(g.quality()).collect()}
    assert set(got) == set(want)
    for key, (n, row) in want.items():
        assert got[key].n_rows == n and got[key].whole == (row is not None)
        assert row is None or got[key].row_id == row


def test_hot_groups_change_nothing(spark, monkeypatch):
    g = groups(spark.createDataFrame(data(3), SCHEMA))
    usual, fused = g.quality(), sorted(map(str, g.fused(g.quality()).collect()))
    monkeypatch.setattr(survivor, "HOT", 0)
    monkeypatch.setattr(survivor, "SAMPLE", 1)
    assert g.hot() is not None and len(g.claims()) == 2
    assert g.quality().posterior == usual.posterior
    assert sorted(map(str, g.fused(g.quality()).collect())) == fused


def test_fused_keeps_several_true_values_and_loses_no_field(spark):
    rows = data(4)
    g = groups(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in g.fused(g.quality()).collect():
        got.setdefault((r.k, r.m, r.field), set()).add(r.value)
    want = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            for f, v in zip("ab", r[5:7]):
                if v:
                    want.setdefault((r[1], r[2], f), set()).add(v)
    assert set(got) == set(want) and all(got[k] <= want[k] for k in want)


def test_quality_tells_good_from_poor_sources():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):  # one true and one false value in a field, three sources
        truth = [rng.random() < p for p in (0.95, 0.9, 0.4)]
        false = [not t for t in truth]
        for gave in (truth, false):
            mask = sum(1 << i for i, x in enumerate(gave) if x)
            if mask:
                counts[0, mask, 7] = counts.get((0, mask, 7), 0) + 1
    q = infer([(*k, n) for k, n in counts.items()], ["f"], ["a", "b", "c"])
    assert q.sensitivity[0, 0] > q.sensitivity[0, 2] + 0.2 and q.specificity[0, 0] > q.specificity[0, 2] + 0.2
    assert q.posterior[0, 3, 7] > 0.9 > 0.5 > q.posterior[0, 4, 7]
    assert q.evidence(0, 1) > q.evidence(2, 1)


def test_nothing(spark):
    g = groups(spark.createDataFrame([], SCHEMA))
    assert g.survivors(g.quality()).count() == 0 and g.fused(g.quality()).count() == 0
    with pytest.raises(ValueError):
        Groups(spark.createDataFrame([], SCHEMA), {"k": F.col("k")}, F.col("row_id"), F.col("source"), {f"s{i}": i for i in range(9)}, F.col("at"), {})
