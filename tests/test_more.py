"""Exact medians, workbooks, the models' study, image and table plans, and cases of the filters."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura import session
from mensura.functions.names import ascii_column
from mensura.operators import classify, evaluate, filters, layout, ml, trees
from mensura.operators.eav import to_wide
from mensura.operators.quantiles import beside_medians, medians
from mensura.plans import extraction
from mensura.schema import TARGETS
from mensura.sources import workbook


def test_medians_of_groups_of_any_size(spark):
    """One group has nine rows in ten and more values than the sketch holds exactly; null keys, nulls, NaN and ties."""
    rng = random.Random(1)
    rows = [("hot", rng.gauss(50, 3), None if rng.random() < 0.5 else float(rng.randint(1, 9))) for _ in range(18_000)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1.0, 2.5, -3.0, 1e300]), None) for _ in range(1500)] + [("none", None, None), ("one", 4.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    want = {}
    for k, i in itertools.product({r[0] for r in rows}, (1, 2)):
        values = [r[i] for r in rows if r[0] == k and r[i] is not None and r[i] == r[i]]
        want[k, i] = statistics.median(values) if values else None
    for most in (1000, 50_000):
        got = medians(df, ["k"], {"x": F.col("v"), "y": F.col("w")}, most).collect()
        assert {(r.k, i): v for r in got for i, v in ((1, r.x), (2, r.y))} == want
    every = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    assert medians(df, [], {"x": F.col("v")}, 1000).first().x == statistics.median(every) == medians(df, [], {"x": F.col("v")}).first().x
    assert medians(df.limit(0), ["k"], {"x": F.col("v")}).count() == 0 and medians(df.limit(0), [], {"x": F.col("v")}).first().x is None
    beside = beside_medians(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], {"x": F.col("v")}).collect()
    assert {r.k: r.x for r in beside} == {k: v for (k, i), v in want.items() if i == 1}


def test_lower_median_of_a_cell_of_many_values(spark):
    rows = spark.range(10_001).select(F.lit("p").alias("e"), F.lit("d90").alias("a"), F.col("id").cast("string").alias("v")).unionByName(spark.createDataFrame([("p", "unknown thing", "7"), ("p", None, "1"), ("p", "d90", "x")], "e string, a string, v string"))
    got = to_wide(rows, "e", "a", "v", {"d90": "d90"}, F.col("v").try_cast("double")).first()
    assert got.d90 == 5000.0 and got.cast_failures == {"d90": 1} and got.other == {"unknown thing": 1}


def test_noise_and_names_are_stripped_of_any_blank(spark):
    rows = [(" MUFA ", True, None), (" MUFA", True, None), ("oil\t", False, "Oil_type"), (" Friction", False, "Friction_coefficient"), ("ab ", True, None), (None, True, None), ("", True, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "e string").select("e", filters.is_noise(F.col("e")).alias("n"), classify.variable(F.col("e")).alias("v")).collect()
    assert [(r.e, r.n, r.v) for r in got] == rows


def test_rows_without_a_value_keep_their_unit(spark):
    rows = [(None, "wt%", "dependency"), ("ten", "wt%", "proximity"), ("10", "wt%", "pattern"), ("400", "wt%", "pattern"), ("", "wt%", "pattern")]
    df = spark.createDataFrame(rows, "value string, unit string, relation_method string").withColumn("normalized_variable", F.lit("Fat_concentration_wt%"))
    assert [tuple(r)[:3] for r in filters.nullify(df).collect()] == [(None, "wt%", "dependency"), (None, None, "none"), ("10", "wt%", "pattern"), (None, None, "none"), (None, None, "none")]


def test_ticks_are_of_an_image_each(spark):
    df = spark.createDataFrame([("p", "img1", "5")] * 3 + [("p", "img2", "5")] * 3 + [("p", "img3", "5")] * 4, "paper string, source string, value string")
    assert sorted({r.source for r in filters.without_ticks(df, ["paper", "source"], "value").collect()}) == ["img1", "img2"]


def test_summary_takes_raw_errors(spark):
    df = spark.createDataFrame([(None, 3.0, 3.00004), (None, 3.0, 3.00004), ("v", 3.0, None), ("v", 0.0, 1.0), ("v", None, 1.0)], "variable string, gt double, got double")
    got = {r.variable: r for r in evaluate.summary(evaluate.detail(df, "gt", "got"), ["variable"]).collect()}
    assert got[None].tp == 2 and got[None].mean_abs_error == 0.0 and got[None].median_rel_error_pct == 0.0
    assert (got["v"].tp, got["v"].fp, got["v"].fn, got["v"].mean_abs_error, got["v"].median_rel_error_pct) == (0, 1, 1, 1.0, None)


def test_rows_of_words_by_jumps():
    import numpy as np

    rng = random.Random(0)
    for n in (0, 1, 5, 400):
        y = np.array(sorted(rng.choice([rng.uniform(0, 60), 7.0]) for _ in range(n)))
        want, row, anchor = [], -1, 0.0
        for v in y:
            if row < 0 or abs(v - anchor) > 4:
                row, anchor = row + 1, v
            want.append(row)
        assert layout._rows_of(y, 4.0).tolist() == want


def test_levelled_table(spark):
    """Six numbers without the targeted one, seven with it; a label takes its place; text ends a row; no level, no row."""
    lines = ["20% MCT oil", "1", "A", "20% MCT oil", "1,5", "2", "3", "4", "5", "6", "B", "20% olive", "1", "7", "2", "3", "4", "5", "6", "20% MCT oil", "1", "12ab", "2", "3", "4", "5", "6", "8", "9", "20% MCT oil", "1", "2", "end", "3", "4", "5", "6"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "page int, line_no int, line string")
    rows = layout.levelled_columns(layout.levelled_lines(df, "page", ["20% MCT", "20% Olive"]), ["page", "line_no", "level", "name"])
    got = [tuple(r) for r in rows.orderBy("line_no").collect()]
    assert got == [
        (1, 3, "A", "20% MCT", 1.5, None, 2.0, 3.0, 4.0, 5.0, 6.0), (1, 11, "B", "20% Olive", 1.0, 7.0, 2.0, 3.0, 4.0, 5.0, 6.0), (1, 19, "B", "20% MCT", 1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0),
    ]
    long = layout.levelled_observations(rows.where("line_no = 3"), ["page"], F.lit(20.0)).collect()
    assert sorted((r.variable, r.value, r.unit) for r in long) == [("Fat_concentration_wt%", 20.0, "wt%"), ("Viscosity_Pa_s", 0.002, "Pa.s"), ("d90_µm", 6.0, "µm")]


def test_tables_of_words(spark):
    table = [(1, 10.0 + 40 * c, 20.0 + 12 * r, f"{r}{c}") for r in range(4) for c in range(3)]
    text = [(1, 10.0, 200.0 + 12 * r, w) for r, w in enumerate(["just", "some", "text", "below", "it"])] + [(2, 1.0, 1.0, "5"), (3, None, 1.0, "5")]
    got = layout.data_blocks(spark.createDataFrame(table + text, "page int, x double, y double, text string"), "page").where("page = 1")
    cells = {(r.row_no, r.column_no): r.text for r in got.collect()}
    assert {cells[r, c] for r in range(4) for c in range(3)} == {f"{r}{c}" for r in range(4) for c in range(3)}


def test_images(spark):
    size = "paper string, source string, width int, height int"
    images = spark.createDataFrame([("p", "a", 300, 300), ("p", "small", 100, 300), ("p", "few", 300, 300), ("q", "empty", 300, 300), (None, "a", 300, 300), ("p", "null", None, 300)], size)
    texts = [f"d90 = {i}O nm" for i in range(1, 5)] + ["7 rpm"] * 12
    boxes = [("p", s, i, float(i // 4 * 40), t, 0.9) for s in ("a", "small", "null") for i, t in enumerate(texts)] + [("p", "few", 0, 0.0, "d90 = 5 nm and 12 rpm of it", 0.9), ("p", "a", 99, 0.0, "d90 = 9 nm", 0.5), (None, "a", 1, 0.0, "d90 = 9 nm", 0.9), ("p", "a", None, None, None, None)]
    rows, figures = extraction.image_observations(images, spark.createDataFrame(boxes, "paper string, source string, nth int, y double, text string, conf double"))
    assert sorted(r.value for r in rows.collect()) == [10.0, 20.0, 30.0, 40.0]  # the digit is repaired, '7 rpm' is an axis tick
    assert {r.paper: tuple(r)[1:] for r in figures.collect()} == {"p": (2, 1, 4), "q": (1, 0, 0)}


def test_study_of_models(spark, tmp_path):
    rng = random.Random(2)
    x = [rng.uniform(0, 10) for _ in range(40)]
    rows = [(f"p{i:02}", v if i % 9 else None, rng.random(), 2.0 * v + 1 if i < 30 else None, v if i < 8 else None, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "paper string, a double, b double, y double, z double, w double")
    models = lambda n, d: {"forest": ml.forest("features", "label", trees=3, depth=4), "ridge": ml.ridge(10.0, n, d, "features", "label")}
    held = F.col("paper").isin([f"p{i:02}" for i in range(7)])
    scores, predictions = ml.study(df, "paper", ["a", "b"], {"y": 15, "z": 5, "w": 5}, held, models, str(tmp_path))
    got = {(r.target, r.model): r for r in scores.collect()}
    assert set(got) == {("y", "forest"), ("y", "ridge"), ("z", "forest"), ("z", "ridge")}
    assert got["y", "ridge"].split == "hold-out" and got["y", "ridge"].n == 7 and got["z", "ridge"].split == "leave-one-out" and got["z", "ridge"].n == 8
    assert sum(r.best for r in got.values()) == 2
    best = next(r for r in got.values() if r.target == "y" and r.best)
    assert best.importances[0].feature == "a" and sum(s.share for s in best.importances) == pytest.approx(1)
    papers = {(r.target, r.paper) for r in predictions.collect()}
    assert papers == {("y", f"p{i:02}") for i in range(7)} | {("z", f"p{i:02}") for i in range(8)}
    again = ml.load(spark, f"{tmp_path}/model_y")
    assert ml.predict(again, df, ["a", "b"]).count() == 40 and ml.load(spark, f"{tmp_path}/none") is None
    with pytest.raises(ValueError, match="hold out"):
        ml.leave_each_out(spark.range(201).selectExpr("id k", "1.0 a", "2.0 y"), "k", ["a"], "y", {})


def test_workbooks(spark, tmp_path):
    a = spark.createDataFrame([("x<&>", 1.5, None, True), (None, None, 3, False), ("ü\n2", -2e-9, 4, None)], "name string, v double, n int, flag boolean")
    b = spark.range(3).selectExpr("id", "'x' AS name")
    workbook.write_workbook(spark, {"first": a, "second sheet": b}, f"{tmp_path}/w.xlsx", {"first": {"v": "Pa·s"}})
    got = workbook.sheets(spark, str(tmp_path))
    rows = {(r.paper, r.sheet, r.row_no): r.fields for r in got.collect()}
    assert rows["w", "first", 1] == {"name": None, "v": "Pa·s"} or rows["w", "first", 1]["v"] == "Pa·s"
    assert rows["w", "first", 2]["name"] == "x<&>" and float(rows["w", "first", 2]["v"]) == 1.5 and rows["w", "first", 2]["flag"] == "1"
    assert rows["w", "first", 4]["name"] == "ü\n2" and float(rows["w", "first", 4]["v"]) == -2e-9
    assert {k[2] for k in rows if k[1] == "second sheet"} == {1, 2, 3}
    below = workbook.sheets(spark, str(tmp_path), header_row=2).where("sheet = 'first'").collect()  # a header below a preamble
    assert {r.row_no for r in below} == {3, 4} and set(below[0].fields) >= {"x<&>", "1.5"}
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    assert [r.paper for r in workbook.sheets(spark, str(tmp_path)).where("error is not null").collect()] == ["broken"]
    with pytest.raises(ValueError, match="one name"):
        workbook.workbook_bytes({"n" * 40: b, "n" * 35: b})


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(type("S", (), {"sparkContext": Context, "conf": Conf}))


def test_cut_tables_can_be_cleared(spark):
    import os

    folder = session.shared_folder(spark)
    before = set(os.listdir(folder))
    assert session.cut(spark.range(5)).count() == 5
    made = set(os.listdir(folder)) - before
    assert len(made) == 1
    session.clear(spark)
    assert not made & set(os.listdir(folder))


def test_targets_are_columns():
    assert all(ascii_column(t) for t in TARGETS)


def test_forest_grows_whole_trees_by_exact_splits(spark, tmp_path):
    """Trees split until every label is told apart, by their own tasks; the model is kept, read again and gives the same."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 400, (600, 2)).astype(float)
    df = spark.createDataFrame([(i, *v, float(v[0] * 3 % 97 + v[1])) for i, v in enumerate(x.tolist())], "k int, a double, b double, y double")
    model = ml.train(df, ["a", "b"], "y", ml.forest("features", "label", trees=20, depth=30))
    grown = model.stages[-1].trees.collect()
    assert sorted(r.tree for r in grown) == list(range(20))
    assert min(len(r.feature) for r in grown) > 2 * 300  # as many leaves as a bootstrap sample has labels; 32 bins a feature tell fewer apart
    got = ml.predict(model, df, ["a", "b"]).toPandas()
    assert len(got) == 600 and np.abs(np.log1p(got["y"]) - np.log1p(got["predicted"])).mean() < 0.2
    ml.save(model, str(tmp_path / "forest"))
    again = ml.predict(ml.load(spark, str(tmp_path / "forest")), df, ["a", "b"]).toPandas()
    assert np.allclose(got.sort_values("k")["predicted"], again.sort_values("k")["predicted"])
    assert sum(ml.weights(model)) == pytest.approx(1)


def test_a_tree_is_the_best_of_all_splits():
    x = np.array([[0.0, 1], [1, 0], [2, 5], [3, 4], [4, 9]])
    y, times = np.array([1.0, 1, 5, 5, 9]), np.array([1.0, 2, 1, 0, 3])
    ranks = np.stack([np.argsort(np.argsort(c)) for c in x.T])
    feature, threshold, child, value, gain = trees.grow(x, ranks, np.argsort(ranks, axis=1, kind="stable"), times, times * y, times * y * y, 30)
    assert trees.fall(x, feature, threshold, child, value).tolist() == [1, 1, 5, 5, 9]  # the fourth isn't in the sample
    assert (feature >= 0).sum() == 2 and gain.sum() == pytest.approx((times * y * y).sum() - (times * y).sum() ** 2 / times.sum())
    equal = trees.grow(x, ranks, np.argsort(ranks, axis=1, kind="stable"), times, times, times, 30)
    assert equal[0].tolist() == [-1] and equal[3].tolist() == [1.0]


def test_boosted_trees_run_in_one_task(spark):
    """Rounds begin at the labels' mean and each takes a step; a fit makes a handful of jobs, however many rounds."""
    x = np.random.default_rng(3).normal(size=(80, 2))
    df = spark.createDataFrame([(i, *v, float(np.expm1(1.0 if v[0] > 0 else 3.0))) for i, v in enumerate(x.tolist())], "k int, a double, b double, y double")
    spark.sparkContext.setJobGroup("boosted", "")
    got = ml.predict(ml.train(df, ["a", "b"], "y", ml.boosted("features", "label", rounds=40, step=0.05)), df, ["a", "b"]).toPandas()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    label, n = np.log1p(got["y"]), len(x)
    mean = label.mean()
    assert np.allclose(np.log1p(got["predicted"]), label + (mean - label) * 0.95**40)
    assert len(jobs) < 40 and n == len(got)
