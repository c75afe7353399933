"""Column-level data quality profile of large tables, load by load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.session import cut

#: A mask is rare in a column and load if a smaller share of the filled values has it.
RARE_SHARE = 0.01
#: Half width, in share of rank, of the bracket in which an exact quantile is looked for.
BRACKET = 0.0005
#: Brackets (a row per load, column and quantile) up to which they are sent to every task.
MOST_BRACKETS = 200_000
QUANTILES = (0.25, 0.5, 0.75)


def mask(text: Column) -> Column:
    """Character-class mask of a value: runs of capitals A, small letters a, digits 9, blanks one blank; marks stay."""
    m = F.regexp_replace(text, r"\p{Lu}+", "A")
    m = F.regexp_replace(m, r"[\p{L}&&[^A]]+", "a")
    m = F.regexp_replace(m, r"\p{N}+", "9")
    return F.regexp_replace(m, r"(?U)\s+", " ")


def cells(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load, column_name, value as text, number if numeric, n): each distinct filled value of each load and column, with its rows.

    NaN counts as null. Counting distinct values first takes hot values together before the shuffle.
    """
    kinds = dict(df.dtypes)
    clean = {c: F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("double", "float") else F.col(c) for c in columns}
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    clean[c].cast("string").alias("value"),
                    (clean[c].cast("double") if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal") else F.lit(None).cast("double")).alias("number"),
                )
                for c in columns
            ]
        )
    )
    rows = df.select(F.col(load).alias("load_id"), pairs.alias("_c"))
    return rows.where("_c.value is not null").groupBy("load_id", F.col("_c.column_name").alias("column_name"), F.col("_c.value").alias("value"), F.col("_c.number").alias("number")).agg(F.count("*").alias("n"))


def _quantiles(df: DataFrame, held: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, q1, median, q3): exact quantiles without gathering a column in one task.

    A mergeable sketch brackets each quantile; the values below the bracket are only counted, those inside it, a
    share of 2 * BRACKET of the ranks, are put in order. An even number gives the mean of the two middle values
    (other quantiles: linear interpolation).
    """
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz", "binary")]
    if not numeric:
        return df.sparkSession.createDataFrame([], "load_id long, column_name string, q1 double, median double, q3 double")
    points = [x for p in QUANTILES for x in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    sketch = df.groupBy(F.col(load).alias("load_id")).agg(
        *[
            F.struct(
                F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), [float(x) for x in points], int(4 / BRACKET)).alias("b"),
                F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias("filled"),
            ).alias(f"_{i}")
            for i, c in enumerate(numeric)
        ]
    )
    one = sketch.select("load_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}.b").alias("b"), F.col(f"_{i}.filled").alias("filled")) for i, c in enumerate(numeric)])).alias("s"))
    # a rank position is (filled - 1) * p; its neighbours lie in the bracket or one rank beside it (under, over)
    wanted = one.where("s.filled > 0").select(
        "load_id", "s.column_name", "s.filled",
        F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(p).alias("p"), F.col("s.b")[2 * i].alias("lo"), F.col("s.b")[2 * i + 1].alias("hi")) for i, p in enumerate(QUANTILES)])).alias("w"),
    ).select("load_id", "column_name", "filled", "w.*")
    rows = wanted.limit(MOST_BRACKETS + 1).collect()  # a row per load, column and quantile; the bound is checked
    brackets = F.broadcast(df.sparkSession.createDataFrame(rows, wanted.schema)) if len(rows) <= MOST_BRACKETS else wanted
    numbers = held.where("number is not null").select(F.col("load_id").alias("_load"), F.col("column_name").alias("_column"), "number", "n")
    joined = numbers.join(brackets, F.col("_load").eqNullSafe(F.col("load_id")) & (F.col("_column") == F.col("column_name"))).drop("_load", "_column")
    keys = ["load_id", "column_name", "q"]
    sides = joined.groupBy(*keys).agg(F.sum(F.when(F.col("number") < F.col("lo"), F.col("n"))).alias("below"), F.max(F.when(F.col("number") < F.col("lo"), F.col("number"))).alias("under"), F.min(F.when(F.col("number") > F.col("hi"), F.col("number"))).alias("over"))
    sides = sides.select(F.col("load_id").alias("_load"), F.col("column_name").alias("_column"), F.col("q").alias("_q"), F.coalesce("below", F.lit(0)).alias("below"), "under", "over")
    order = Window.partitionBy(*keys).orderBy("number")
    inside = joined.where("number >= lo and number <= hi").withColumn("upto", F.sum("n").over(order))
    placed = inside.join(sides, F.col("_load").eqNullSafe(F.col("load_id")) & (F.col("_column") == F.col("column_name")) & (F.col("_q") == F.col("q"))).withColumns({"at": (F.col("filled") - 1) * F.col("p"), "last": F.col("below") + F.col("upto") - 1})
    rank = lambda f: F.when(F.first("below") > F.first(f(F.col("at"))), F.first("under")).otherwise(F.coalesce(F.min(F.when(F.col("last") >= f(F.col("at")), F.col("number"))), F.first("over")))
    got = placed.groupBy(*keys).agg(F.first("at").alias("at"), rank(F.floor).alias("x"), rank(F.ceil).alias("y"))
    exact = got.select(*keys, (F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))).alias("v"))
    return exact.groupBy("load_id", "column_name").agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys in which null equals null."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, on, "left").drop(*[f"_right_{k}" for k in keys])


def profile(df: DataFrame, load: str, columns: Sequence[str], rare: float = RARE_SHARE) -> DataFrame:
    """A row per load and column: counts, null share, distinct values, range, quantiles, masks, and what changed.

    load_id, column_name, n_rows, n_filled, null_share, n_distinct, distinct_share, min_value, max_value (as text for
    text columns, else null: see min_number, max_number), q1, median, q3, iqr, dominant_mask (the most frequent
    mask, smallest on ties), n_masks, rare_masks (masks of a smaller share than `rare` -> rows), n_violations (rows
    with such a mask), mask_divergence (Jensen-Shannon divergence, base 2, between the mask shares of this load and
    the load with the next smaller id; null for the first). NaN counts as null. A column of nulls has zero counts
    and null statistics. A null load is a load of its own and comes first. Empty input gives an empty table.
    """
    held = cut(cells(df, load, columns))  # every figure but the null share comes from these
    totals = df.groupBy(F.col(load).alias("load_id")).agg(F.count("*").alias("n_rows"))
    base = totals.withColumn("column_name", F.explode(F.array(*map(F.lit, columns))))
    stats = held.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_filled"), F.count("*").alias("n_distinct"), F.min("number").alias("min_number"), F.max("number").alias("max_number"),
        F.min(F.when(F.col("number").isNull(), F.col("value"))).alias("min_value"), F.max(F.when(F.col("number").isNull(), F.col("value"))).alias("max_value"),
    )
    masks = held.groupBy("load_id", "column_name", mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"))
    share = masks.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("load_id", "column_name")))
    mined = share.groupBy("load_id", "column_name").agg(
        F.min_by("mask", F.struct(-F.col("n"), "mask")).alias("dominant_mask"), F.count("*").alias("n_masks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("share") < rare, F.struct("mask", "n"))))).alias("rare_masks"),
        F.coalesce(F.sum(F.when(F.col("share") < rare, F.col("n"))), F.lit(0)).alias("n_violations"),
    )
    order = Window.orderBy(F.col("load_id").asc_nulls_first())  # over a row per load
    loads = totals.select("load_id", F.lag("load_id").over(order).alias("before"), F.row_number().over(order).alias("nth"))
    now = _beside(share, loads.select("load_id", "nth"), ["load_id"]).select("column_name", "mask", "nth", "share")
    m = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log2(2 * F.col(a) / (F.col(a) + F.col(b)))).otherwise(0.0)
    pairs = now.select("column_name", "mask", "nth", "share", F.lit(0.0).alias("old")).unionByName(now.select("column_name", "mask", (F.col("nth") + 1).alias("nth"), F.lit(0.0).alias("share"), F.col("share").alias("old")))
    gap = pairs.groupBy("column_name", "nth", "mask").agg(F.sum("share").alias("p"), F.sum("old").alias("r")).groupBy("column_name", "nth").agg(
        F.when((F.sum("p") > 0) & (F.sum("r") > 0), F.sum(0.5 * m("p", "r") + 0.5 * m("r", "p"))).alias("mask_divergence")
    )
    quantiles = _quantiles(df, held, load, columns)
    out = _beside(base, loads.select("load_id", "nth"), ["load_id"])
    for part in (stats, mined, quantiles):
        out = _beside(out, part, ["load_id", "column_name"])
    out = _beside(out, gap, ["column_name", "nth"])
    filled = F.coalesce("n_filled", F.lit(0))
    return out.select(
        "load_id", "column_name", "n_rows", filled.alias("n_filled"), (1 - filled / F.col("n_rows")).alias("null_share"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.try_divide("n_distinct", "n_filled").alias("distinct_share"), "min_number", "max_number", "min_value", "max_value", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        "dominant_mask", F.coalesce("n_masks", F.lit(0)).alias("n_masks"), "rare_masks", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), "mask_divergence",
    )


def changes(profiled: DataFrame, null_share: float = 0.15, median: float = 1.5, iqr: float = 2.0, distinct: float = 3.0) -> DataFrame:
    """(load_id, column_name, reasons): loads and columns of a profile that differ from the load with the next smaller id.

    A difference of the null share by more than null_share, or of median, interquartile range or distinct values per
    filled value by more than a factor. If exactly one of two figures is zero or negative, or both are and differ,
    that is a difference; a figure that is null on one side only (no filled values) is one as well.
    """
    w = Window.partitionBy("column_name").orderBy(F.col("load_id").asc_nulls_first())  # a row per load
    pairs = profiled.select("load_id", "column_name", "null_share", "median", "iqr", "distinct_share", F.lag(F.struct("null_share", "median", "iqr", "distinct_share")).over(w).alias("old"))

    def apart(c: str, factor: float) -> Column:
        x, y = F.col(c), F.col(f"old.{c}")
        return (
            F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull())
            .when((x <= 0) | (y <= 0), ((x <= 0) != (y <= 0)) | (x != y))
            .otherwise(F.greatest(x, y) > factor * F.least(x, y))
        )

    tests = {"null_share": F.abs(F.col("null_share") - F.col("old.null_share")) > null_share, "median": apart("median", median), "iqr": apart("iqr", iqr), "distinct_share": apart("distinct_share", distinct)}
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return pairs.where("old is not null").select("load_id", "column_name", reasons.alias("reasons")).where(F.size("reasons") > 0)
