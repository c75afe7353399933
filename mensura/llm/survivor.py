"""One surviving record for each group of duplicates, field by field, with the quality of sources inferred from the data."""

from __future__ import annotations

import copy
import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.session import cut

#: Sources are bits of a mask; observation patterns, at most 3 ** sources of each field, go to the driver.
MOST_SOURCES = 8
#: A group is hot from so many rows on, as one row in SAMPLE tells.
HOT, SAMPLE = 50_000, 64
ROUNDS = 50


@dataclass(frozen=True)
class Quality:
    """What expectation-maximisation found: by field, how often a true value is given by a source that speaks of the
    field (sensitivity), how often a false one is not (specificity), and the share of true values (prior)."""

    fields: tuple[str, ...]
    sources: tuple[str, ...]
    sensitivity: np.ndarray
    specificity: np.ndarray
    prior: np.ndarray
    posterior: dict[tuple[int, int, int], float] = field(default_factory=dict)

    def evidence(self, source: int, mask: int) -> float:
        """Log-odds that what one source says in the fields of a mask is true, summed over the fields."""
        gain = np.log(self.sensitivity[:, source] / (1 - self.specificity[:, source])) + np.log(self.prior / (1 - self.prior))
        return float(sum(g for i, g in enumerate(gain) if mask >> i & 1))


def infer(patterns: Sequence[tuple[int, int, int, int]], fields: Sequence[str], sources: Sequence[str], rounds: int = ROUNDS) -> Quality:
    """Sensitivity and specificity of each source by expectation-maximisation.

    patterns: (field, mask of the sources that give the value, mask of those that speak of the field, number of such
    values). Each value's truth is a hidden variable of its own, so that a field can have several true values. Beta
    priors keep what the data can't tell near the usual: sensitivity 8:2, and specificity 9:1 with the weight of a third
    of the field's values, since false ones are never seen as such. Values of fields of which one source alone speaks
    say nothing about it and are judged by what the others teach.
    """
    k, n = len(sources), len(fields)
    if not patterns:
        return Quality(tuple(fields), tuple(sources), np.full((n, k), 0.8), np.full((n, k), 0.9), np.full(n, 0.5))
    at, gave, spoke, count = (np.array(x) for x in zip(*patterns))
    bits = 1 << np.arange(k)
    positive, silent = (gave[:, None] & bits) > 0, ((spoke & ~gave)[:, None] & bits) > 0
    share = positive.sum(1) / np.maximum(positive.sum(1) + silent.sum(1), 1)
    true = np.clip(0.2 + 0.7 * share, 0.05, 0.95)  # start: the more of those who speak agree, the likelier
    one_hot = at[:, None] == np.arange(n)
    tells = count * (np.array([int(x).bit_count() for x in spoke]) > 1)
    weight = 10 + (one_hot * tells[:, None]).sum(0)[:, None] / 3
    for _ in range(rounds):
        w_true, w_false = (one_hot * (tells * true)[:, None]).T, (one_hot * (tells * (1 - true))[:, None]).T
        sensitivity = (w_true @ positive + 8) / (w_true @ (positive | silent) + 10)
        specificity = (w_false @ silent + 0.9 * weight) / (w_false @ (positive | silent) + weight)
        prior = (w_true.sum(1) + 1) / (w_true.sum(1) + w_false.sum(1) + 2)
        sensitivity, specificity, prior = (np.clip(x, 0.01, 0.99) for x in (sensitivity, specificity, prior))
        se, sp = sensitivity[at], specificity[at]
        odds = np.log(prior[at] / (1 - prior[at])) + (positive * np.log(se / (1 - sp)) + silent * np.log((1 - se) / sp)).sum(1)
        new = 1 / (1 + np.exp(-odds))
        done, true = np.abs(new - true).max() < 1e-6, new
        if done:
            break
    posterior = {(int(a), int(g), int(s)): float(t) for a, g, s, t in zip(at, gave, spoke, true)}
    return Quality(tuple(fields), tuple(sources), sensitivity, specificity, prior, posterior)


class Groups:
    """Duplicate groups of a table, ready for resolution.

    keys: expressions of the group's key (a row with a null key is in no group). row_id: unique row number. source:
    expression of the row's source, one of sources (other or null sources count as a further source 'other').
    trust: source -> number, higher is more trusted (others: below all). at: time of the row (null: before all).
    fields: name -> (true if the field is filled, comparable text of its value). Extra columns, nulls in any of
    these and repeated rows are allowed.
    """

    def __init__(self, df: DataFrame, keys: Mapping[str, Column], row_id: Column, source: Column, trust: Mapping[str, int], at: Column, fields: Mapping[str, tuple[Column, Column]]) -> None:
        self.sources = (*sorted(trust), "other")
        if len(self.sources) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES - 1} sources")
        self.keys, self.fields = list(keys), tuple(fields)
        number = F.lit(len(self.sources) - 1)
        level = F.lit(min(trust.values(), default=0) - 1)
        for i, s in enumerate(self.sources[:-1]):
            number, level = F.when(source == s, i).otherwise(number), F.when(source == s, trust[s]).otherwise(level)
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        self.rows = df.select(
            *[v.alias(k) for k, v in keys.items()], row_id.cast("long").alias("_row"), number.cast("int").alias("_source"), level.cast("int").alias("_trust"), at.alias("_at"), *[f.alias(f"_f{i}") for i, (f, _) in enumerate(fields.values())], *[v.alias(f"_v{i}") for i, (_, v) in enumerate(fields.values())]
        ).where(known)

    def compact(self) -> Groups:
        """The same groups with their rows written once, values as 64-bit hashes: for quality and survivors, which each read them."""
        out = copy.copy(self)
        numbers = range(len(self.fields))
        out.rows = cut(self.rows.select(*self.keys, "_row", "_source", "_trust", "_at", *[f"_f{i}" for i in numbers], *[F.when(F.col(f"_f{i}"), F.xxhash64(f"_v{i}")).alias(f"_v{i}") for i in numbers]))
        return out

    def hot(self) -> DataFrame | None:
        """Keys of groups that seem to hold more than HOT rows, by one row in SAMPLE; None if there are none.

        This only decides how the work is spread. There are as many such groups as rows / HOT at most; they are joined as any
        table, by broadcast only if they are small.
        """
        sample = self.rows.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLE)) == 0).groupBy(*self.keys).agg(F.count("*").alias("_n"))
        found = cut(sample.where(F.col("_n") * SAMPLE > HOT).select(*self.keys))
        return None if found.isEmpty() else found

    def claims(self, hashed: bool = True) -> list[DataFrame]:
        """(keys, _field, _value, _gave) in parts that share no group: each distinct value of each field of each group,
        with the sources that give it.

        Usual groups are moved once, as whole rows, by group; nothing after that moves them again. Hot groups, if there
        are any, are spread by value.
        """
        numbers = range(len(self.fields))
        value = (lambda i: F.xxhash64(f"_v{i}")) if hashed else (lambda i: F.col(f"_v{i}"))
        bit = F.get(F.lit([1 << i for i in range(len(self.sources))]), F.col("_source"))
        rows = self.rows.select(*self.keys, bit.alias("_bit"), *[F.when(F.col(f"_f{i}"), value(i)).alias(f"_v{i}") for i in numbers])
        each = F.explode_outer(F.array_compact(F.array(*[F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(i).cast("tinyint").alias("f"), F.col(f"_v{i}").alias("v"))) for i in numbers])))

        def said(part: DataFrame) -> DataFrame:
            return part.select(*self.keys, "_bit", each.alias("_c")).where("_c is not null").groupBy(*self.keys, F.col("_c.f").alias("_field"), F.col("_c.v").alias("_value")).agg(F.bit_or("_bit").alias("_gave"))

        hot = self.hot()
        if hot is None:
            return [said(rows.repartition(*self.keys))]
        return [said(rows.join(hot, self.keys, "left_anti").repartition(*self.keys)), said(rows.join(hot, self.keys, "left_semi"))]

    def _patterns(self, claims: DataFrame) -> DataFrame:
        """(keys, _field, _gave, _spoke, _n): a group's values that the same sources give are taken together first, so that a group is at most 2 ** sources rows."""
        same = claims.groupBy(*self.keys, "_field", "_gave").agg(F.count("*").alias("_n"))
        packed = same.groupBy(*self.keys, "_field").agg(F.bit_or("_gave").alias("_spoke"), F.collect_list(F.struct("_gave", "_n")).alias("_g"))
        return packed.select(*self.keys, "_field", "_spoke", F.inline("_g"))

    def quality(self) -> Quality:
        """The sources' quality, inferred from every row. At most fields * 3 ** sources counts come to the driver."""
        parts = [self._patterns(c) for c in self.claims()]
        counts = functools.reduce(DataFrame.unionByName, parts).groupBy("_field", "_gave", "_spoke").agg(F.sum("_n").alias("n"))
        return infer([tuple(r) for r in counts.collect()], self.fields, self.sources)

    def survivors(self, quality: Quality) -> DataFrame:
        """(keys, n_rows, row_id, whole): the row to keep of each group.

        whole: the row has every field filled that any row of the group has filled, the group's latest time and its
        highest trust; of several such rows the one of smallest row_id is kept. Where a group has no such row, the
        row with the strongest evidence is kept: the sum over its filled fields of the log-odds that its source, by
        its inferred quality, says something true; then the latest, then the smallest row_id. One aggregation with
        map-side reduction: a hot group costs a row per task.
        """
        mask = F.lit(0)
        for i in range(len(self.fields)):
            mask = mask + F.when(F.col(f"_f{i}"), 1 << i).otherwise(0)
        table = F.array(*[F.lit([quality.evidence(s, m) for m in range(1 << len(self.fields))]) for s in range(len(self.sources))])
        rows = self.rows.select(*self.keys, "_row", "_source", "_trust", "_at", mask.alias("_mask"))
        rows = rows.withColumn("_weight", F.get(F.get(table, F.col("_source")), F.col("_mask")))
        full = F.struct("_at", "_trust", F.bit_count("_mask").alias("_c"), (-F.col("_row")).alias("_r"), "_mask")
        best = F.struct("_weight", "_at", (-F.col("_row")).alias("_r"))
        groups = rows.groupBy(*self.keys).agg(F.count("*").alias("n_rows"), F.max(full).alias("_full"), F.max(best).alias("_best"), F.bit_or("_mask").alias("_all"), F.max("_trust").alias("_top"))
        whole = (F.col("_full._mask") == F.col("_all")) & (F.col("_full._trust") == F.col("_top"))
        return groups.select(*self.keys, "n_rows", (-F.when(whole, F.col("_full._r")).otherwise(F.col("_best._r"))).alias("row_id"), whole.alias("whole"))

    def fused(self, quality: Quality, threshold: float = 0.5) -> DataFrame:
        """(keys, field, value, probability): every value of every field that is judged true.

        A value is judged true if its posterior probability is at least the threshold; a field may keep several
        values. If no value of a group's field reaches it, the most probable (of several the smallest) is kept, so
        that no filled field is lost. Values are the comparable texts.
        """
        rows = [(f, g, s, p) for (f, g, s), p in quality.posterior.items()]
        known = F.broadcast(self.rows.sparkSession.createDataFrame(rows, "_field tinyint, _gave int, _spoke int, probability double"))  # at most fields * 3 ** sources rows
        group = [*self.keys, "_field"]

        def judge(claims: DataFrame) -> DataFrame:
            judged = self._patterns(claims).join(known, ["_field", "_gave", "_spoke"])
            top = judged.groupBy(*group).agg(F.max(F.struct("probability", "_gave")).alias("top"))
            kept = judged.join(top, group).where((F.col("probability") >= threshold) | (F.col("_gave") == F.col("top._gave")))
            full = claims.join(kept.select(*group, "_gave", "probability"), [*group, "_gave"])
            best = full.where(F.col("probability") < threshold).groupBy(*group).agg(F.min("_value").alias("_value"), F.first("probability").alias("probability"))
            return full.where(F.col("probability") >= threshold).select(*group, "_value", "probability").unionByName(best)

        true = functools.reduce(DataFrame.unionByName, [judge(c) for c in self.claims(hashed=False)])
        return true.select(*self.keys, F.get(F.lit(list(self.fields)), F.col("_field").cast("int")).alias("field"), F.col("_value").alias("value"), "probability")
