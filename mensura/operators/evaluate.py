"""Evaluation of extracted against collected values, and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.quantiles import beside_medians
from mensura.schema import ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE


def match_class(truth: Column, got: Column, relative: Column | None = None) -> Column:
    """miss (nothing extracted), hit (within tolerance) or off; null where there is no truth.

    Tolerance is relative (of the truth; never met if it is 0) or, where `relative` is false, absolute. NaN is missing.
    """
    t, g = F.nanvl(truth, F.lit(None)), F.nanvl(got, F.lit(None))
    near = F.coalesce(F.try_divide(F.abs(g - t), F.abs(t)) <= RELATIVE_TOLERANCE, F.lit(False))
    close = F.abs(g - t) <= ABSOLUTE_TOLERANCE
    within = near if relative is None else F.when(relative, near).otherwise(close)
    return F.when(t.isNull(), None).when(g.isNull(), "miss").when(within, "hit").otherwise("off")


def detail(df: DataFrame, truth: str, got: str, relative: Column | None = None) -> DataFrame:
    """df with match, the raw error and relative_error, and abs_error and rel_error_pct rounded to four and two places (null where not defined)."""
    t, g = F.nanvl(F.col(truth), F.lit(None)), F.nanvl(F.col(got), F.lit(None))
    error = F.abs(g - t)
    share = 100 * F.try_divide(error, F.abs(t))
    return df.withColumns({"match": match_class(F.col(truth), F.col(got), relative), "error": error, "relative_error": share, "abs_error": F.round(error, 4), "rel_error_pct": F.round(share, 2)})


def summary(detailed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys: tp, fp, fn, precision, recall, f1 (three decimals, 0 where not defined), mean_abs_error (four) and median_rel_error_pct (one), of the raw errors.

    A value out of tolerance is a false positive only; a missing one a false negative only; rows without truth are skipped.
    """
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    known = detailed.where(F.col("match").isNotNull())
    counts = known.groupBy(*keys).agg(
        F.count_if(F.col("match") == "hit").alias("tp"), F.count_if(F.col("match") == "off").alias("fp"), F.count_if(F.col("match") == "miss").alias("fn"),
        F.round(F.avg("error"), 4).alias("mean_abs_error"),
    )
    counts = beside_medians(counts, known, keys, {"_median": F.col("relative_error")}).withColumn("median_rel_error_pct", F.round("_median", 1))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(share(2 * p * r, p + r), 3).alias("f1"), "mean_abs_error", "median_rel_error_pct")


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """By keys: n, rmse, mae, r2. Rows with a null are left out; r2 is null where the actual values don't vary."""
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull())
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(a - p, F.lit(2.0)))).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"),
        (1 - F.try_divide(F.sum(F.pow(a - p, F.lit(2.0))), F.var_pop(a) * F.count("*"))).alias("r2"),
    )


def best(df: DataFrame, keys: Sequence[str], name: str, score: str) -> DataFrame:
    """By keys: the name of highest score (the first in order on ties) and the score. Null scores come last."""
    top = df.groupBy(*keys).agg(F.min(F.struct(F.coalesce(-F.col(score), F.lit(float("inf"))).alias("s"), F.col(name).alias("n"), F.col(score).alias("v"))).alias("_top"))
    return top.select(*keys, F.col("_top.n").alias(name), F.col("_top.v").alias(score))
