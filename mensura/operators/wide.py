"""The wide dataset: median pivot, rescaling, coverage, counts and distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.quantiles import beside_medians, medians

#: A number as the engines agree on it: no 'nan', 'inf', type letters or digit marks.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(raw: Column, strip_thousands: bool = False) -> Column:
    """Double of a raw value, null if it is no number. With strip_thousands, '12,000' is 12000, else null."""
    r = F.replace(raw, F.lit(","), F.lit("")) if strip_thousands else raw
    return F.when(r.rlike(NUMBER), F.trim(r).try_cast("double"))


def median_pivot(df: DataFrame, entity: str, variable: str, value: str, variables: Mapping[str, str], keep_unmapped: bool = False) -> DataFrame:
    """A row per entity with the median of each variable (variable -> column).

    Null values are left out. With keep_unmapped, entities whose values all have a null or other variable stay as rows
    of nulls; without, they are left out, as are null entities either way.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(entity).isNotNull())
    if not keep_unmapped:
        rows = rows.where(F.col(variable).isin(*variables))
    cells = medians(rows.select(entity, F.when(F.col(variable).isin(*variables), F.col(variable)).alias("_variable"), F.col(value).alias("_value")), [entity, "_variable"], {"_median": F.col("_value")})
    return cells.groupBy(entity).agg(*[F.max(F.when(F.col("_variable") == v, F.col("_median"))).alias(c) for v, c in variables.items()])


def rescaled(df: DataFrame, columns: Sequence[str], above: float = 10.0, factor: float = 10.0, places: int = 3) -> DataFrame:
    """df with values above a bound divided by a factor and rounded: scores out of 100 as scores out of 10."""
    return df.withColumns({c: F.when(F.col(c) > above, F.round(F.col(c) / factor, places)).otherwise(F.col(c)) for c in columns})


def value_counts(df: DataFrame, entity: str, value: str, name: str = "rows_extracted") -> DataFrame:
    """Number of values that aren't null of each entity."""
    return df.groupBy(entity).agg(F.count(value).alias(name))


def melted(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """A row per key and column, null values included."""
    return wide.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], variable, value)


def coverage(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: n_filled, pct_filled (one decimal) and median (four decimals) over the rows."""
    rows = melted(wide, [], columns)
    counts = rows.groupBy("variable").agg(F.count("value").alias("n_filled"), F.round(100 * F.count("value") / F.count("*"), 1).alias("pct_filled"))
    return beside_medians(counts, rows, ["variable"], {"_median": F.col("value")}).select("variable", "n_filled", "pct_filled", F.round("_median", 4).alias("median_value"))


def shares(df: DataFrame, key: str | Column, name: str = "share") -> DataFrame:
    """n and percentage of the total (two decimals) of each group; the total is over the groups' counts, not the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn(name, F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def histogram(df: DataFrame, keys: Sequence[str], value: str, most: int = 10) -> DataFrame:
    """keys, bin (from 0), n: equal-width bins between a group's least and greatest value, min(most, values) of them; the last is closed.

    Empty bins have no row; a group of equal values has them in its first bin.
    """
    rows = df.where(F.col(value).isNotNull())
    limits = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.least(F.lit(most), F.count("*")).alias("_bins"))
    joined = rows.join(limits, list(keys))
    at = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.col("_bins") - 1, F.floor((F.col(value) - F.col("_low")) * F.col("_bins") / (F.col("_high") - F.col("_low")))))
    return joined.groupBy(*keys, at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def presence(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """1 where a cell is filled, else 0."""
    return wide.select(key, *[F.col(c).isNotNull().cast("int").alias(c) for c in columns])


def without_empty_columns(df: DataFrame) -> DataFrame:
    """df without rows that are null throughout and without columns that are null throughout (one aggregation over the table)."""
    some = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.dropna(how="all").select(*[F.col(f"`{c}`") for c in df.columns if some[c]])


def row_median(columns: Sequence[str], factor: float = 1.0) -> Column:
    """Median of the columns of a row that aren't null, times a factor; null if all are."""
    values = F.array_sort(F.array_compact(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns])))
    n = F.size(values)
    middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return middle * factor


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with nulls of the columns replaced by the column's median over all rows (zero where it has no value). One row of medians comes to the driver."""
    middle = medians(df, [], {c: F.col(c) for c in columns}).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c] or 0.0))) for c in columns})
