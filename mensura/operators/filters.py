"""Filters of observations: noise, words for numbers, ranges, repeated axis values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.keys import trim_spaces
from mensura.schema import MORE_NOISE, NOISE, RANGES


def is_noise(entity: Column) -> Column:
    """True for entities that name nothing: under three letters, figure and table references, plain numbers, capital abbreviations, noise words. Null is noise."""
    bare = trim_spaces(entity)
    e = F.lower(bare)
    hit = (F.length(e) < 3) | e.rlike(r"^(fig\.?|figure|table|eq\.?)\s*\d*$") | e.rlike(r"^\d+\.?\d*$") | bare.rlike("^[A-Z]{2,6}$") | e.isin(*NOISE)
    return F.coalesce(hit, F.lit(True))


def without_noise(df: DataFrame, entity: str = "entity", method: str = "relation_method") -> DataFrame:
    """Rows whose entity is no noise; rows that a pattern found are kept, but for the further noise words. Null methods count as no pattern."""
    found = F.coalesce(F.col(method) == "pattern", F.lit(False))
    return df.where((found | ~is_noise(F.col(entity))) & ~F.coalesce(F.lower(F.col(entity)).isin(*MORE_NOISE), F.lit(False)))


def in_range(variable: Column, value: Column, ranges: Mapping[str, tuple[float, float]] = RANGES) -> Column:
    """True if the value lies in its variable's range, both ends included; variables without one and values that are no number pass."""
    number = F.replace(value.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    out = F.lit(True)
    for name, (low, high) in ranges.items():
        out = F.when(variable == name, number.between(low, high)).otherwise(out)
    return F.coalesce(out, F.lit(True))


def nullify(df: DataFrame, variable: str = "normalized_variable", value: str = "value", unit: str = "unit", method: str = "relation_method", ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """df with value, unit and method taken back (null, null, 'none') where there is a value that holds no digit or is out of range.

    Rows without a value stay as they are.
    """
    good = F.coalesce(F.col(value).rlike(r"(?U)\d"), F.lit(True)) & in_range(F.col(variable), F.col(value), ranges)
    return df.withColumns({value: F.when(good, F.col(value)), unit: F.when(good, F.col(unit)), method: F.when(good, F.col(method)).otherwise(F.lit("none"))})


def without_ticks(df: DataFrame, keys: Sequence[str], value: str, most: int = 3) -> DataFrame:
    """Rows whose value doesn't occur more than `most` times in its group: values of an axis repeat. Null values count like any other.

    Counts are aggregated on the map side and joined back, so that no group is gathered in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    on = F.lit(True)
    renamed = counts.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate([*keys, value])])
    for i, c in enumerate([*keys, value]):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return df.join(renamed, on, "left_anti")


def readable(df: DataFrame, text: str, confidence: str, least: int = 20, sure: float = 0.80) -> DataFrame:
    """Rows of text read off an image that are long and sure enough; null texts and confidences are not."""
    return df.where((F.length(text) >= least) & (F.col(confidence) >= sure))

