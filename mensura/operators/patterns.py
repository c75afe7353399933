"""Extraction of values by a prioritised pattern library, and simpler pattern features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.quantiles import medians
from mensura.schema import IMAGE_PATTERNS, TEXT_PATTERNS

#: Case-insensitive, with Unicode's letters, digits and blanks.
FLAGS = "(?iU)"


def _lengths(strings: Column) -> Column:
    return F.aggregate(strings, F.lit(0), lambda total, s: total + F.length(s))


def _matches(text: Column, variable: str, pattern: str, unit: str | None) -> Column:
    """One pattern's matches from left to right, as structs; starts count from 0."""
    rx = FLAGS + pattern
    whole, values, between = F.regexp_extract_all(text, F.lit(rx), 0), F.regexp_extract_all(text, F.lit(rx), 1), F.split(text, rx, -1)
    units = F.regexp_extract_all(text, F.lit(rx), 2) if unit is None else None

    def one(k: Column) -> Column:
        start = _lengths(F.slice(between, F.lit(1), k + 1)) + _lengths(F.slice(whole, F.lit(1), k))
        return F.struct(
            start.alias("start"), F.length(F.get(whole, k)).alias("length"), F.lit(variable).alias("variable"), F.get(whole, k).alias("entity"), F.get(values, k).alias("value"),
            (F.get(units, k) if unit is None else F.lit(unit)).alias("unit"),
        )

    # one cheap pass tells the patterns that occur; only those are taken apart
    none = F.array().cast("array<struct<start:int,length:int,variable:string,entity:string,value:string,unit:string>>")
    return F.when(text.rlike(rx), F.transform(whole, lambda _, k: one(k))).otherwise(none)


def _free(accepted: Column, match: Column) -> Column:
    """True if a match overlaps none of the accepted ones."""
    return ~F.exists(accepted, lambda y: (match["start"] < y["start"] + y["length"]) & (y["start"] < match["start"] + match["length"]))


@dataclass(frozen=True)
class PatternLibrary:
    """(variable, pattern, unit) of falling priority; a unit of None is read from the pattern's second group."""

    patterns: tuple[tuple[str, str, str | None], ...]

    def candidates(self, text: Column) -> Column:
        """All matches of all patterns in order of priority and position, overlapping ones included. Null gives null."""
        return F.flatten(F.array(*[_matches(text, *p) for p in self.patterns]))

    def extract(self, df: DataFrame, text: str) -> DataFrame:
        """df with a row for each accepted match: start, length, variable, entity, value (text), unit.

        Patterns have priority in their order, and each pattern's matches from left to right: a match is accepted if it
        overlaps none that was accepted before it. Texts without a match and null texts give no row. Columns of df that
        are named like the match's are replaced. Narrow: no shuffle, no Python.
        """
        taken = ("start", "length", "variable", "entity", "value", "unit")
        found = df.where(F.col(text).rlike("(?U)\\d")).withColumn("_all", self.candidates(F.col(text)))
        kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(_free(acc, x), F.array_append(acc, x)).otherwise(acc))
        keep = [c for c in df.columns if c not in taken]
        # an outer explode, as for a plain one the optimizer computes the array once more to filter the rows
        return found.withColumn("_kept", kept).select(*keep, F.explode_outer("_kept").alias("_m")).where("_m is not null").select(*keep, "_m.*")


TEXT = PatternLibrary(TEXT_PATTERNS)
IMAGE = PatternLibrary(IMAGE_PATTERNS)


def distinct_hits(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches (or groups) of a pattern in a text, sorted; null for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FLAGS + pattern), group)))


def contained(text: Column, names: Sequence[str]) -> Column:
    """Names that a text contains, letter case aside, in the names' order; null for null."""
    low = F.lower(text)
    return F.when(text.isNotNull(), F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in names])))


def flag(text: Column, words: Sequence[str]) -> Column:
    """1.0 if the lower-case text contains any of the words as they are written, else 0.0."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.when(text.isNotNull(), out.cast("double"))


def feature_medians(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[tuple[str, str]], names: Mapping[str, str]) -> DataFrame:
    """keys and the median of all values that each feature's pattern finds in the group's texts (thousands marks removed); null without any."""
    each = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(FLAGS + p), 1), _feature(n)) for n, p in patterns]))
    rows = df.select(*keys, F.explode_outer(each).alias("_f"))
    middle = medians(rows.select(*keys, F.col("_f.name").alias("_name"), F.col("_f.value").alias("_value")), [*keys, "_name"], {"_median": F.col("_value")})
    return middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(names[n]) for n, _ in patterns])


def _feature(name: str):  # noqa: ANN202
    return lambda v: F.struct(F.lit(name).alias("name"), F.replace(v, F.lit(","), F.lit("")).try_cast("double").alias("value"))
