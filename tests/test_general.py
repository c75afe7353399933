"""The problems of the core: differences, wide tables, profiles."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mensura.functions.numbers import quantity
from mensura.operators import diff
from mensura.operators.diff import differences
from mensura.operators.eav import cast_failures, filled_cells, to_wide
from mensura.operators.profile import changes, profile

def same(*names):
    return {n: (F.col(n), F.col(n)) for n in names}


SCHEMA = "k string, j string, a double, s string, left_value int"


def found(df):
    return sorted((r.k or "", r.j or "", r.field_name) for r in df.collect())


def brute(left, right):
    a, b = {r[:2]: r for r in left}, {r[:2]: r for r in right}
    out = [(k, "only_in_left") for k in a.keys() - b.keys()] + [(k, "only_in_right") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        x, y = a[k], b[k]
        miss = lambda v: v is None or v != v
        if miss(x[2]) != miss(y[2]) or (not miss(x[2]) and not miss(y[2]) and abs(x[2] - y[2]) > 0.01):
            out.append((k, "a"))
        if (x[3] is None) != (y[3] is None) or (x[3] is not None and x[3] != y[3]):
            out.append((k, "s"))
    return sorted((k[0] or "", k[1] or "", f) for k, f in out)


@pytest.mark.parametrize("seed", range(2))
def test_differences_against_brute_force(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (rng.choice(["x", "y", None]), f"k{i}", rng.choice([None, float("nan"), 1.0, 1.005, 2.0]), rng.choice([None, "", "u", "v"]), 1)
    left = [row(i) for i in range(300) if rng.random() < 0.8]
    keys = {r[:2] for r in left}
    right = [(*r[:2], *row(0)[2:]) for r in left if rng.random() < 0.7] + [r for i in range(300, 340) if (r := row(i))[:2] not in keys]
    a, b = spark.createDataFrame(left + left[:20], SCHEMA), spark.createDataFrame(right + right[:30], SCHEMA)
    got = differences(a, b, same("k", "j"), same("a", "s"), tolerance=0.01, rows_per_bucket=7)
    assert found(got) == brute(left, right)


def test_differences_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(None, None, 1.0, "z", 0)], SCHEMA)
    assert found(differences(none, none, same("k", "j"), same("a", "s"))) == []
    assert found(differences(one, none, same("k", "j"), same("a", "s"))) == [("", "", "only_in_left")]
    assert found(differences(none, one, same("k", "j"), same("a", "s"))) == [("", "", "only_in_right")]
    assert found(differences(one, one, same("k", "j"), same("a", "s"))) == []
    hot = spark.range(3000).select(F.lit("h").alias("k"), F.when(F.col("id") < 2000, "same").otherwise(F.col("id").cast("string")).alias("j"), F.lit(1.0).alias("a"), F.lit("q").alias("s"))
    assert differences(hot, hot, same("k", "j"), same("a", "s")).count() == 0
    late = spark.createDataFrame([("x", "y", 1.0, "old", 1), ("x", "y", 1.0, "new", 2)], SCHEMA)
    now = spark.createDataFrame([("x", "y", 1.0, "new", 0)], SCHEMA)
    assert found(differences(late, now, same("k", "j"), same("a", "s"), latest=(F.col("left_value"), F.col("left_value")))) == []


def test_colliding_hashes_are_told_apart():
    a = pa.table({"_hash": pa.array([5, 5, 9], pa.int64()), "k": ["a", "b", "c"]})
    b = pa.table({"_hash": pa.array([5, 5, 9], pa.int64()), "k": ["b", "a", "d"]})
    x, to_y, y, to_x = diff._aligned(a, b, ["k"])
    assert [(x["k"][i].as_py(), y["k"][int(j)].as_py()) for i, j in enumerate(to_y) if j >= 0] == [("a", "a"), ("b", "b")]
    assert list(to_x) == [0, 1, -1]


def test_wide(spark):
    rows = [("p", "v1", "1"), ("p", "v1", "3"), ("p", "v1", "2"), ("p", "v2", "x"), ("q", "v2", None), ("q", "odd", "5"), (None, "v1", "9"), ("q", None, "9"), ("r", "v2", "7 µm"), ("r", "v2", "7 µm"), ("s", "v1", "< 3")]
    df = spark.createDataFrame(rows, "e string, a string, v string").withColumn("cast_failures", F.lit(1))
    wide = {r.e: r for r in to_wide(df, "e", "a", "v", {"v1": "one", "v2": "two"}, quantity(F.col("v"))).collect()}
    assert set(wide) == {"p", "q", "r", "s"}
    assert (wide["p"].one, wide["p"].two, wide["p"].cast_failures) == (2.0, None, {"v2": 1})
    assert (wide["q"].one, wide["q"].other) == (None, {"odd": 1}) and wide["r"].two == 7.0 and wide["s"].cast_failures == {"v1": 1}
    cells = filled_cells(to_wide(df, "e", "a", "v", {"v1": "one", "v2": "two"}, quantity(F.col("v"))), "e", {"v1": "one", "v2": "two"}, "a")
    assert sorted(map(tuple, cells.collect())) == [("p", "v1"), ("r", "v2")]
    assert sorted((r.v, r.n) for r in cast_failures(df, "e", "a", "v", quantity(F.col("v"))).collect()) == [("< 3", 1), ("x", 1)]
    assert to_wide(df.limit(0), "e", "a", "v", {"v1": "one"}, quantity(F.col("v"))).count() == 0


def test_profile_against_pandas(spark):
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"load": n, "x": np.where(rng.random(m) < 0.2, np.nan, np.round(rng.lognormal(0, 1, m), 3)), "y": rng.integers(0, 3, m), "s": rng.choice(["ab-1", "ab-22", "Ab", "zz zz"], m, p=[0.5, 0.48, 0.005, 0.015])}) for n, m in ((1, 1), (2, 2), (3, 3), (5, 1500), (9, 2000))]
    data = pd.concat(frames)
    df = spark.createDataFrame(data).withColumn("x", F.when(F.col("y") == 7, None).otherwise(F.col("x"))).withColumn("z", F.lit(None).cast("double"))
    got = {(r.load_id, r.column_name): r for r in profile(df, "load", ["x", "y", "s", "z"]).collect()}
    assert len(got) == 20
    for n, g in data.groupby("load"):
        r, v = got[n, "x"], g.x.dropna()
        assert (r.n_rows, r.n_filled, r.n_distinct) == (len(g), len(v), v.nunique())
        if len(v):
            assert [r.q1, r.median, r.q3] == pytest.approx(list(v.quantile([0.25, 0.5, 0.75])))
            assert (r.min_number, r.max_number) == (v.min(), v.max())
        assert got[n, "z"].n_filled == 0 and got[n, "z"].null_share == 1.0 and got[n, "z"].median is None
    s = got[9, "s"]
    assert s.dominant_mask == "a-9" and set(s.rare_masks) == {"Aa"} and s.n_violations == s.rare_masks["Aa"] and 0 <= s.mask_divergence < 0.05
    assert got[1, "s"].mask_divergence is None


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (4, 10.0)], "load int, x double")
    got = {r.load_id: r for r in profile(df, "load", ["x"]).collect()}
    assert got[None].median == 1.5 and got[4].median == 10.0
    assert [(r.load_id, r.reasons) for r in changes(profile(df, "load", ["x"])).collect()] == [(4, ["median", "iqr"])]
    assert profile(df.limit(0), "load", ["x"]).count() == 0
    hot = spark.range(20000).select(F.lit(1).alias("load"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert profile(hot, "load", ["x"]).first().median == pytest.approx(np.median([5.0 if i % 3 == 0 else i for i in range(20000)]))


def test_median_of_a_large_cell_is_exact(spark):
    from mensura.operators.eav import to_wide

    rows = spark.range(200_001).selectExpr("'p' AS paper", "'a' AS name", "cast(id * id AS string) AS value").repartition(4)
    assert to_wide(rows, "paper", "name", "value", {"a": "a"}, F.col("value").cast("double")).first().a == 100_000.0**2
