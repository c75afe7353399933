"""Mixing of sources to target shares of the total size, with capped repeats."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.session import cut

#: Remaining budget that the knapsack settles first, and at most; what is above is filled in proportion.
SPAN, MOST_SPAN = 1 << 16, 1 << 22
#: Documents of one source and length that are ranked together; larger groups are split by their seeded hash.
RANKED = 1000
#: Rows of the plan (source and length) up to which it is sent to every task. There are at most
#: sqrt(2 * tokens) lengths in a source, as different lengths add up.
MOST_SENT = 500_000


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take, at most counts, so that their sizes come as near below the budget as can be.

    The knapsack settles the last `span` tokens; where it can't reach the budget to the token, it is given eight times as
    many, until it does or settles the whole budget, which is exact. Only budgets above MOST_SPAN are settled over so many
    tokens at most.
    """
    best, missed, back = None, budget + 1, 0
    while True:
        took = _fit(lengths, counts, budget, span, back)
        rest = min(budget, int((lengths.astype(np.int64) * counts).sum())) - int((took * lengths).sum())
        if rest < missed:
            best, missed = took, rest
        if not missed or span >= min(budget, MOST_SPAN):
            return best
        span = back = min(span * 8, MOST_SPAN)


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int, back: int) -> np.ndarray:
    """fit_budget with one span; so many tokens are held back from the filling in proportion.

    First the same fraction of every length (rounded down), so that long and short documents keep their parts; then,
    by largest remainder, one more of a length at a time while the rest is above `span`; then a bounded knapsack
    (subset sums by dynamic programming over binary parts of the counts) over the rest.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros_like(counts)
    exact = counts * (max(0, budget - back) / total)
    taken = np.minimum(np.floor(exact).astype(np.int64), counts)
    rest = budget - int((taken * lengths).sum())
    while rest < 0:  # rounding of very large products
        at = int(np.argmax(taken))
        taken[at] -= 1
        rest += int(lengths[at])
    for at in np.argsort(-(exact - np.floor(exact)), kind="stable"):
        if rest <= span:
            break
        if taken[at] < counts[at] and lengths[at] <= rest:
            taken[at] += 1
            rest -= int(lengths[at])
    while rest > span:  # lengths of which several more are wanted
        open_ = np.flatnonzero((taken < counts) & (lengths <= rest))
        if not len(open_):
            break
        at = int(open_[np.argmax(lengths[open_])])
        more = min(int(counts[at] - taken[at]), max(1, (rest - span) // int(lengths[at])), rest // int(lengths[at]))
        taken[at] += more
        rest -= more * int(lengths[at])
    rest = min(rest, span)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    parent = np.full(rest + 1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for at in np.argsort(-lengths, kind="stable"):
        have, size, part = min(int(counts[at] - taken[at]), rest // int(lengths[at])), int(lengths[at]), 1
        while have > 0 and not reached[rest]:
            part = min(part, have)
            w = part * size
            if w <= rest:
                fresh = np.flatnonzero(reached[: rest + 1 - w] & ~reached[w:]) + w
                reached[fresh] = True
                parent[fresh] = len(parts)
                parts.append((int(at), part))
            have -= part
            part *= 2
        if reached[rest]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        at, part = parts[parent[s]]
        taken[at] += part
        s -= part * int(lengths[at])
    return taken


def budgets(tokens: Mapping[str, int], shares: Mapping[str, float], repeats: Mapping[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens that each source is to give.

    Sources with nothing to give leave their share to the others in proportion. Without a total, it is the largest one
    at which every other source can reach its share within its repeats, so that shares are met and no more is left
    out than they ask for. With a total, sources that can't reach their share give all they may, and the others
    share what is missing in proportion, as far as their repeats allow.
    """
    cap = {s: tokens.get(s, 0) * max(0, repeats[s]) for s in shares}
    live = {s: shares[s] for s in shares if cap[s] > 0 and shares[s] > 0}
    out = dict.fromkeys(shares, 0)
    if not live:
        return out
    weight = sum(live.values())
    if total is None:
        total = int(min(cap[s] * weight / live[s] for s in live))
    open_, rest = dict(live), float(total)
    while open_:
        weight = sum(open_.values())
        full = {s for s in open_ if rest * open_[s] / weight >= cap[s]}
        if not full:
            break
        for s in full:
            out[s] = cap[s]
            rest -= cap[s]
            del open_[s]
    weight = sum(open_.values())
    for s in open_:
        out[s] = min(cap[s], round(rest * open_[s] / weight))
    return out


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix's plan: (source, tokens, n, whole, extra) by source and exact length, and the sources' figures.

    whole: times that every document of the length is taken; extra: documents of it that are taken once more.
    sized: (source, tokens) of each document; targets: (source, target_share, max_repeats; null is once, 0 or less is never), a row per source (bounded
    by the sources that someone set targets for; more than 10,000 are an error).
    """
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("too many targets")
    spark = sized.sparkSession
    names = [r.source for r in wanted]
    counted = cut(sized.where(F.col("source").isin(names) & (F.col("tokens") > 0)).groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r.source: int(r.t) for r in counted.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()}
    repeats = {r.source: 1 if r.repeats is None else max(0, int(r.repeats)) for r in wanted}
    give = budgets(have, {r.source: r.share for r in wanted}, repeats, total)
    table = {s: (give[s], have.get(s, 0), repeats[s]) for s in names}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        budget, tokens, most = table[group.source.iloc[0]]
        group = group.sort_values("tokens")
        whole = min(budget // tokens, most) if tokens else 0
        rest = budget - whole * tokens if whole < most else 0
        return group.assign(whole=whole, extra=fit_budget(group.tokens.to_numpy(), group.n.to_numpy(), rest))

    fitted = cut(counted.groupBy("source").applyInPandas(fit, "source string, tokens bigint, n bigint, whole bigint, extra bigint"))
    got = fitted.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum(F.col("tokens") * (F.col("n") * F.col("whole") + F.col("extra"))).alias("mixed_tokens"))
    base = spark.createDataFrame([(r.source, float(r.share), repeats[r.source], give[r.source]) for r in wanted], "source string, target_share double, max_repeats int, budget_tokens bigint")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    figures = base.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("tokens"), "budget_tokens", zero("mixed_tokens"))
    figures = figures.withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0)))
    return fitted, figures


def mix(sized: DataFrame, key: str, targets: DataFrame, seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, source, tokens, repeats): how often each document stands in the mix; and the sources' figures.

    sized: key, source and size in tokens of each document. Documents of null or untargeted sources, of no tokens, and
    those that the budget leaves out aren't in the mix. Which documents of one source and length are taken is the
    order of a seeded hash of their keys (ties: the smaller key; rows that repeat a key are as many documents).
    Targets without documents have a share of 0 in the figures. Empty tables give an empty mix.

    A hot group of one source and length is split by the seeded hash into parts of about RANKED documents; only the
    part that the limit falls into is ranked.
    """
    sized = sized.select(F.col(key).alias("_key"), "source", "tokens")
    fitted, figures = plan(sized, targets, total)
    rows = fitted.select("source", "tokens", "n", "whole", "extra", (1 + (F.col("n") / RANKED).cast("int")).alias("_parts"))
    if fitted.count() <= MOST_SENT:
        rows = F.broadcast(rows)
    docs = sized.join(rows, ["source", "tokens"]).withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
    docs = docs.withColumn("_part", F.pmod(F.shiftrightunsigned("_h", 16), F.col("_parts")))
    sure = docs.where("extra = 0 or extra >= n").select("_key", "source", "tokens", (F.col("whole") + (F.col("extra") > 0).cast("int")).alias("repeats"))
    open_ = docs.where("extra > 0 and extra < n")
    parts = open_.groupBy("source", "tokens", "_part").agg(F.count("*").alias("_n"), F.first("extra").alias("_extra"))
    upto = Window.partitionBy("source", "tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not documents
    wanted = parts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).select("source", "tokens", "_part", "_n", F.greatest(F.lit(0), F.least("_n", F.col("_extra") - F.col("_before"))).alias("_take"))
    chosen = open_.join(wanted, ["source", "tokens", "_part"])
    clear = chosen.where("_take = 0 or _take = _n").select("_key", "source", "tokens", (F.col("whole") + (F.col("_take") > 0).cast("int")).alias("repeats"))
    order = Window.partitionBy("source", "tokens", "_part").orderBy("_h", "_key")
    ranked = chosen.where("_take > 0 and _take < _n").withColumn("_rank", F.row_number().over(order)).select("_key", "source", "tokens", (F.col("whole") + (F.col("_rank") <= F.col("_take")).cast("int")).alias("repeats"))
    out = sure.unionByName(clear).unionByName(ranked).where("repeats > 0")
    return out.select(F.col("_key").alias(key), "source", "tokens", "repeats"), figures
