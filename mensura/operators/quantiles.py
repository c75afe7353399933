"""Exact medians of groups of any size, without a buffer that grows with the group."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.session import cut

#: Values of a group up to which the mergeable sketch is exact.
MOST = 20_000


def _alike(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys in which null equals null; the right side has them as _k0, _k1 and so on."""
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.lit(True))
    return left.join(right, on, how).drop(*[f"_k{j}" for j in range(len(keys))])


def medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], most: int = MOST) -> DataFrame:
    """keys with the exact median of each of the values (name -> column); the mean of the two middle ones of an even number.

    Nulls and NaN are left out; a group without values has a null. No keys: one row. Null keys are a group of their own.

    Every group is reduced on the map side to a sketch that is exact up to `most` values. For larger groups the same sketch brackets
    the median: in a second pass over their rows, which only runs if there are such groups, the values below the bracket
    are counted and those inside it, a few in 10,000, are put in order. So a group of any share of the rows is worked on
    by all tasks, and none is gathered.
    """
    names, n_keys = list(values), len(keys)
    rows = df.select(*keys, *[F.nanvl(v.cast("double"), F.lit(None)).alias(f"_v{i}") for i, v in enumerate(values.values())])
    points = [0.5 - 1 / most, 0.5, 0.5 + 0.25 / most, 0.5 + 1 / most]
    sketches = [F.struct(F.percentile_approx(f"_v{i}", points, 4 * most).alias("b"), F.count(f"_v{i}").alias("n")).alias(f"_s{i}") for i in range(len(names))]
    table = cut(rows.groupBy(*keys).agg(*sketches))
    out = table.select(*keys, *[((F.col(f"_s{i}.b")[1] + F.col(f"_s{i}.b")[2]) / 2).alias(n) for i, n in enumerate(names)])
    large = functools.reduce(lambda a, b: a | b, [F.col(f"_s{i}.n") > most for i in range(len(names))])
    if table.where(large).isEmpty():
        return out
    for i, name in enumerate(names):
        marks = table.where(F.col(f"_s{i}.n") > most).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col(f"_s{i}.b")[0].alias("_lo"), F.col(f"_s{i}.b")[3].alias("_hi"), F.col(f"_s{i}.n").alias("_n"))
        near = _alike(rows.select(*keys, F.col(f"_v{i}").alias("_v")).where("_v is not null"), marks, keys, "inner").where("_v <= _hi")
        counts = near.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).otherwise(F.lit(float("-inf"))).alias("_x")).agg(F.count("*").alias("_c"))
        upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_x")))
        exact = upto.groupBy(*keys).agg(((rank(F.floor((F.col("_n") - 1) / 2)) + rank(F.floor(F.col("_n") / 2))) / 2).alias("_exact"))
        if n_keys:
            out = _alike(out, exact.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_exact"), keys, "left")
        else:
            out = out.join(exact, how="left")  # a row each
        out = out.withColumn(name, F.coalesce("_exact", name)).drop("_exact")
    return out


def beside_medians(table: DataFrame, df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """table (keys and other columns) with the medians of df's groups beside them; null keys meet null keys."""
    middle = medians(df, keys, values)
    return _alike(table, middle.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *values), keys, "left")
