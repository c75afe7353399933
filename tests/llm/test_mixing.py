import random

import numpy as np
import pytest

from mensura.llm import mixing
from mensura.llm.mixing import budgets, fit_budget, mix


def best(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    return max(s for s in sums if s <= budget)


def test_fit_budget_is_exact_on_small_sets():
    rng = random.Random(0)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 5)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
        took = fit_budget(np.array(lengths), np.array(counts), budget)
        assert (took >= 0).all() and (took <= counts).all()
        total, top = int((took * lengths).sum()), best(lengths, counts, budget)
        assert total <= budget and top - total <= max(lengths)


def test_fit_budget_large():
    lengths, counts = np.arange(50, 2000), np.full(1950, 400)
    total = int((lengths * counts).sum())
    for share in (0.001, 0.37, 0.9):
        took = fit_budget(lengths, counts, int(total * share))
        assert int((took * lengths).sum()) == int(total * share)
    assert (fit_budget(lengths, counts, total) == counts).all() and fit_budget(lengths, counts, 0).sum() == 0
    assert fit_budget(np.array([10]), np.array([3]), 9).tolist() == [0]


def test_budgets():
    assert budgets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 20, "b": 20}
    assert budgets({"a": 100, "b": 0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 100, "b": 0}
    assert budgets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, total=100) == {"a": 80, "b": 20}
    assert budgets({}, {"a": 1.0}, {"a": 3}) == {"a": 0} and budgets({"a": 5}, {}, {}) == {}


@pytest.fixture
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_mix(spark, targets, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    rng = random.Random(1)
    rows = [(i, "a", 7 if i % 3 == 0 else rng.randint(1, 50)) for i in range(900)] + [(1000 + i, "b", rng.randint(1, 40)) for i in range(120)] + [(2000 + i, "c", 5) for i in range(200)]
    rows += [(3000, None, 5), (3001, "other", 5), (3002, "a", 0), (None, "b", 3), (1, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    chosen, figures = mix(df, "doc_id", targets)
    got, fig = chosen.collect(), {r.source: r for r in figures.collect()}
    assert {r.source for r in got} == {"a", "b", "c"} and fig["none"].mixed_tokens == 0
    for s, most in (("a", 1), ("b", 3), ("c", 2)):
        mine = [r for r in got if r.source == s]
        assert max(r.repeats for r in mine) <= most and sum(r.tokens * r.repeats for r in mine) == fig[s].mixed_tokens
        assert fig[s].budget_tokens - fig[s].mixed_tokens < 5 and abs(fig[s].actual_share - fig[s].target_share) < 0.01
    again = mix(df, "doc_id", targets)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mix(df, "doc_id", targets, seed=7)[0].collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_mix_of_nothing(spark, targets):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    chosen, figures = mix(none, "doc_id", targets)
    assert chosen.count() == 0 and {r.actual_share for r in figures.collect()} == {0.0}
    chosen, figures = mix(none, "doc_id", targets.limit(0))
    assert chosen.count() == 0 and figures.count() == 0


def test_repeats_of_nothing_and_null(spark):
    """max_repeats 0 keeps a source out of the mix; null is once."""
    targets = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, None)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(i, "ab"[i % 2], 5) for i in range(10)], "doc_id long, source string, tokens long")
    chosen, figures = mix(df, "doc_id", targets)
    assert {(r.source, r.repeats) for r in chosen.collect()} == {("b", 1)}
    assert {r.source: r.actual_share for r in figures.collect()} == {"a": 0.0, "b": 1.0}


def test_a_budget_that_needs_a_wider_knapsack():
    """Lengths whose sums leave gaps near the end: the last tokens alone can't settle the budget, more of them can."""
    lengths, counts = np.array([6, 10, 15]), np.array([400, 400, 400])
    for budget in (3001, 5333, 7777):
        took = fit_budget(lengths, counts, budget, span=16)
        assert int((took * lengths).sum()) == budget and (took <= counts).all()
