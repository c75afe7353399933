"""Attribute–value rows into wide tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_wide(
    rows: DataFrame,
    entity: str,
    attribute: str,
    value: str,
    attributes: Mapping[str, str],
    parse: Mapping[str, Column] | Column,
) -> DataFrame:
    """One row per entity with a typed column per known attribute.

    rows hold resolved entity and attribute names and raw values. attributes maps an attribute's name to its
    column's name. parse is the typed form of the raw value (null: it can't be cast). Each entity's pairs become a
    map from attribute to value, from which the known keys are projected.

    Several values of one cell give their lower median (exact, from the counts of its distinct
    values). Rows are reduced per (entity, attribute, value) before entities are put together, so a hot entity costs one
    row per attribute and distinct value. Null entities or attributes are left out; an attribute that isn't known is kept in `other`
    with its number of values; cast failures are kept in `cast_failures` (attribute -> number of raw values that
    are filled but can't be cast; see cast_failures() for the values). An entity all of whose values fail keeps a
    row of nulls. Empty input gives an empty table of the same columns. Extra columns of rows don't matter.
    """
    typed = parse if isinstance(parse, Column) else F.coalesce(*[F.when(F.col(attribute) == k, v) for k, v in parse.items()])
    counted = (
        rows.select(F.col(entity).alias("_entity"), F.col(attribute).alias("_attribute"), F.col(value).alias("_raw"), typed.alias("_typed"))
        .where(F.col("_entity").isNotNull() & F.col("_attribute").isNotNull())
        .groupBy("_entity", "_attribute", "_typed")
        .agg(F.count("_typed").alias("_n"), F.count_if(F.col("_raw").isNotNull() & F.col("_typed").isNull()).alias("_failed"))
    )
    cell = Window.partitionBy("_entity", "_attribute")
    below = F.sum("_n").over(cell.orderBy("_typed").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_below", below).withColumn("_all", F.sum("_n").over(cell))
    cells = ranked.groupBy("_entity", "_attribute").agg(
        F.min(F.when(F.col("_below") * 2 >= F.col("_all"), F.col("_typed"))).alias("_value"), F.sum("_failed").alias("_failed"), F.sum("_n").alias("_n")
    )
    known = F.col("_attribute").isin(*attributes)
    entries = lambda when, x: F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct("_attribute", x)))))
    maps = cells.groupBy("_entity").agg(
        entries(known & F.col("_value").isNotNull(), "_value").alias("_pairs"),
        entries(known & (F.col("_failed") > 0), "_failed").alias("cast_failures"),
        entries(~known, F.col("_n")).alias("other"),
    )
    return maps.select(
        F.col("_entity").alias(entity),
        *[F.try_element_at("_pairs", F.lit(k)).alias(c) for k, c in attributes.items()],
        "cast_failures",
        "other",
    )


def cast_failures(rows: DataFrame, entity: str, attribute: str, value: str, typed: Column) -> DataFrame:
    """(entity, attribute, value, n): each filled raw value that can't be cast, with its number of rows."""
    return rows.where(F.col(value).isNotNull() & typed.isNull()).groupBy(entity, attribute, value).agg(F.count("*").alias("n"))


def filled_cells(wide: DataFrame, entity: str, columns: Mapping[str, str], name: str = "normalized_variable") -> DataFrame:
    """(entity, name) of each cell of a wide table that isn't null; columns: attribute -> column."""
    pairs = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(a)) for a, c in columns.items()])))
    return wide.select(entity, pairs.alias(name))
