"""Queries p2, p4 and p5: the general problems over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import file_key, filled, name_key, strip, unify
from mensura.functions.names import ascii_column, paper_keys, resolve_variable, variable_names
from mensura.functions.numbers import plain_number, quantity
from mensura.operators.diff import differences
from mensura.operators.eav import cast_failures, filled_cells, to_wide
from mensura.operators.profile import changes, profile
from mensura.sources.tables import spread, table

MEASURED = (
    "fat_concentration_wt_pct", "protein_concentration_wt_pct", "temperature_c", "homogenization_rpm", "pressure_mpa", "processing_time_s", "participants_n",
    "viscosity_pa_s", "d90_um", "d43_um", "sensory_thickness", "sensory_creaminess", "friction_coefficient", "rows_extracted",
)


def evaluation_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Every difference of evaluation_results and its copy, with both values, keys in comparable form."""
    results, copy = table(spark, folder, "evaluation_results"), table(spark, folder, "evaluation_results_copy")
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    verdict = F.when(filled(F.col("verdict")), F.lower(strip(F.col("verdict"))))
    key = lambda c: F.lower(F.regexp_replace(unify(F.col(c)), r"(?U)[\s\u200B-\u200D\u2060\uFEFF]+", ""))
    return differences(
        results, copy,
        keys={c: (key(c), key(c)) for c in ("variable", "study_id")},
        fields={c: (number(c), plain_number(F.col(c))) for c in ("gt_value", "pipeline_value")} | {"verdict": (verdict, verdict)},
        tolerance=0.0005,
        latest=(F.col("evaluated_at"), F.col("copied_at")),
        only_left="only_in_results", only_right="only_in_copy",
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluation_differences(spark, folder)
    names = variable_names(table(spark, folder, "variable_guide"))
    studies = table(spark, folder, "example_data").where("study_id is not null").groupBy(name_key(F.col("study_id")).alias("_study")).agg(F.min(strip(F.col("study_id"))).alias("_spelled"))
    return found.join(studies, name_key(F.col("study_id")) == F.col("_study"), "left").select(
        F.coalesce(resolve_variable(F.col("variable"), names), F.col("variable")).alias("variable"), F.coalesce("_spelled", "study_id").alias("study_id"), "field_name"
    )


def _resolved(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    guide = table(spark, folder, "variable_guide")
    names = variable_names(guide)
    rows = spread(table(spark, folder, "extended_with_ocr").select("paper", "normalized_variable", "value")).select(file_key(F.col("paper")).alias("paper_key"), F.coalesce(resolve_variable(F.col("normalized_variable"), names), F.when(filled(F.col("normalized_variable")), strip(F.col("normalized_variable")))).alias("normalized_variable"), F.when(filled(F.col("value")), F.col("value")).alias("value"))
    return rows, {v: ascii_column(v) for v in sorted(set(names.values()))}


def p4_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per paper with a double column per variable; beside them, as text, the cast failures by variable, and the
    values of attributes that variable_guide doesn't have, by their spelling."""
    rows, columns = _resolved(spark, folder)
    wide = to_wide(rows, "paper_key", "normalized_variable", "value", columns, quantity(F.col("value")))
    papers = paper_keys(table(spark, folder, "paper_headers"))
    listed = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|"), F.lit(""))
    return wide.join(papers, "paper_key").select("paper", *columns.values(), listed("cast_failures").alias("cast_failures"), listed("other").alias("other"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    _, columns = _resolved(spark, folder)
    return filled_cells(p4_wide(spark, folder), "paper", columns)


def p4_cast_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Each filled value that is no quantity, by paper and variable, with its rows."""
    rows, columns = _resolved(spark, folder)
    papers = paper_keys(table(spark, folder, "paper_headers"))
    return cast_failures(rows.where(F.col("normalized_variable").isin(*columns)), "paper_key", "normalized_variable", "value", quantity(F.col("value"))).join(papers, "paper_key").select("paper", "normalized_variable", "value", "n")


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every column of wide_format_dataset, load by load."""
    df = table(spark, folder, "wide_format_dataset")
    out = profile(df, "load_id", [c for c in df.columns if c != "load_id"])
    rare = F.coalesce(F.array_join(F.transform(F.map_entries("rare_masks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|"), F.lit(""))
    return out.withColumns({"load_id": F.col("load_id").cast("long"), "rare_masks": rare, "mask_divergence": F.round("mask_divergence", 9)})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "wide_format_dataset")
    return changes(profile(df, "load_id", MEASURED)).select(F.col("load_id").cast("long").alias("load_id"), "column_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p4_found": p4_found, "p4_wide": p4_wide, "p4_cast_failures": p4_cast_failures, "p5_found": p5_found, "p5_profile": p5_profile,
}
