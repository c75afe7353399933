"""The extraction operators."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mensura.operators import classify, evaluate, filters, layout, ml, patterns, text, wide
from mensura.operators.long import append, read, union, unpivot
from mensura.schema import TEXT_PATTERNS
from mensura.plans.extraction import observations
from mensura.sources import files, optional
from mensura.streaming.incremental import append_stream


def greedy(sentence):
    """An independent fold: patterns in order, matches from the left, no overlaps."""
    taken, out = [], []
    for variable, pattern, unit in TEXT_PATTERNS:
        for m in re.finditer(pattern, sentence, re.I):
            if not any(m.start() < e and s < m.end() for s, e in taken):
                taken.append(m.span())
                out.append((m.start(), variable, m[0], m[1], m[2] if unit is None else unit))
    return out


def test_patterns_against_a_fold(spark):
    rng = random.Random(1)
    bits = ["d90 = 5 µm", "5 µm", "12,000 rpm", "13.5 rpm", "1.5 bar", "5 mPa·s", "0.3 Pa·s", "20 °C", "for 30 s", "50 s-1", "50 s⁻1", "50 s⁻¹", "d0.5=5 nm", "d4,3 7 mm", "8 pre-trained panelists", "3 wt.%", "9 N", "2 mL", "6 mm/s", ", ", " and ", "x", "5", ".", " ", "N"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["", "no number"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, sentence string").withColumn("start", F.lit("clash"))
    got = {}
    for r in patterns.TEXT.extract(df, "sentence").collect():
        got.setdefault(r.i, []).append((r.start, r.variable, r.entity, r.value, r.unit))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(greedy(t)), t
    assert -1 not in got


@pytest.mark.parametrize(("sentence", "want"), [("d90 = 5 µm", [("d90_µm", "5")]), ("5 mPa·s", [("Pressure_MPa", "5")]), ("1.5 bar", [("Pressure_bar", "5")]), ("13.5 rpm", [("Homogenization_rpm", "5")]), ("12,000 rpm", [("Homogenization_rpm", "12,000")]), ("50 s⁻¹", [])])
def test_pattern_quirks(spark, sentence, want):
    df = spark.createDataFrame([(sentence,)], "sentence string")
    assert [(r.variable, r.value) for r in patterns.TEXT.extract(df, "sentence").collect()] == want


def test_text(spark):
    df = spark.createDataFrame([("Title Abstract Body one.\nReferences\nx",), ("no marks",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.body(F.col("t"))).collect()] == ["Abstract Body one.", "no marks", None, ""]
    assert [r[0] for r in df.select(text.clean(F.col("t"))).collect()] == ["Title Abstract Body one. References x", "no marks", None, ""]
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(text.repair_digits, "5mL lO5 5mol  word B2") == "5mL 105 5m01 word 82"
    assert one(text.study_label, "1-s2.0-S0417220X074479895-main") == "S0417220X07447" and one(text.study_label, "effect-of-something-very-long-v2") == "effect-of-something-ve"
    assert one(text.paper_label, "effect-of-guar-gum-and") == "effect of guar gum" and one(text.variable_label, "Fat_concentration_wt%") == "Fat concentration (wt%)"
    assert one(text.stem, "file:/a/b.c/x.y.pdf") == "x.y"
    parts = text.sentences(spark.createDataFrame([(1, "This is a first sentence. Short. And a second one here, 5.5 µm wide! 9 of them were long enough."), (2, None), (3, "")], "i int, t string"), "t")
    assert [(r.i, r.sentence_no) for r in parts.collect()] == [(1, 0), (1, 2), (1, 3)]


def test_filters(spark):
    df = spark.createDataFrame([("pH", "dependency"), ("pH", "pattern"), ("Fig. 3", None), ("viscosity", None), ("shear rate", "pattern"), (None, "table"), ("12.5", "ocr"), ("results", "ocr"), ("ABC", "ocr")], "entity string, relation_method string")
    kept = {(r.entity, r.relation_method) for r in filters.without_noise(df).collect()}
    assert kept == {("pH", "pattern"), ("viscosity", None)}
    v = spark.createDataFrame([("Temperature_C", "200"), ("Temperature_C", "200.1"), ("Temperature_C", "x"), ("other", "1e9"), (None, "5"), ("Homogenization_rpm", "12,000"), ("Temperature_C", None)], "n string, v string")
    assert [r[0] for r in v.select(filters.in_range(F.col("n"), F.col("v"))).collect()] == [True, False, True, True, True, True, True]
    rows = spark.createDataFrame([("p", "1")] * 4 + [("p", "2")] * 3 + [("p", None)] * 5 + [(None, "1")], "paper string, v string")
    assert sorted(((r.paper or "", r.v) for r in filters.without_ticks(rows, ["paper"], "v").collect()), key=str) == [("", "1"), ("p", "2"), ("p", "2"), ("p", "2")]
    n = spark.createDataFrame([("Temperature_C", "three", "°C", "dependency"), ("Temperature_C", "999", "°C", "pattern"), ("Temperature_C", "20", "°C", "pattern")], "normalized_variable string, value string, unit string, relation_method string")
    assert [tuple(r)[1:] for r in filters.nullify(n).collect()] == [(None, None, "none"), (None, None, "none"), ("20", "°C", "pattern")]


def test_classify(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert [one(classify.category, e) for e in ("Olive oil", "whey", "cream emulsion", "phenol", "zzz", None)] == ["Oil / Fat", "Protein", "Emulsion", "pH", None, None]
    assert one(classify.variable, " Casein ") == "Protein_type" and one(classify.confidence, "none") == 4
    assert [one(classify.sheet_method, s) for s in ("x_OCR", "a_table", "1-s2.0-S1-mainext", "1-s2.0-S1-mainex", None)] == ["OCR", "Table", "Table", "NLP", "NLP"]
    df = spark.createDataFrame([("we mixed 5 then 7 rpm",)], "s string").select(classify.words(F.col("s")).alias("w"))
    at = classify.nearest_number(F.col("w"), F.lit(3.0))
    assert df.select(at, classify.unit_after(F.col("w"), at)).first()[:] == (2, None)
    assert df.select(classify.unit_after(F.col("w"), F.lit(4))).first()[0] == "rpm"


def test_wide(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "a", 4.0), ("p", None, 5.0), ("q", None, 1.0), ("r", "a", None), (None, "a", 1.0), ("s", "b", 95.0)], "e string, v string, x double")
    kept = {r.e: r.a for r in wide.median_pivot(df, "e", "v", "x", {"a": "a", "b": "b"}, keep_unmapped=True).collect()}
    assert kept == {"p": 2.5, "q": None, "s": None}
    table = wide.median_pivot(df, "e", "v", "x", {"a": "a", "b": "b"})
    assert {r.e for r in table.collect()} == {"p", "s"} and {r.b for r in wide.rescaled(table, ["b"]).collect()} == {None, 9.5}
    assert {r.variable: (r.n_filled, r.pct_filled) for r in wide.coverage(table, ["a", "b"]).collect()} == {"a": (1, 50.0), "b": (1, 50.0)}
    h = spark.createDataFrame([("k", float(x)) for x in range(11)] + [("one", 3.0)] * 4, "k string, x double")
    assert sorted((r.k, r.bin, r.n) for r in wide.histogram(h, ["k"], "x").collect())[-2:] == [("k", 9, 2), ("one", 0, 4)]
    m = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (float("nan"), 2.0, None)], "a double, b double, c double")
    assert [r[0] for r in m.select(wide.row_median(["a", "b", "c"], 10)).collect()] == [20.0, None, 20.0]
    assert wide.without_empty_columns(spark.createDataFrame([(1, None), (None, None)], "a int, b int")).collect() == [(1,)]
    assert [r.a for r in wide.imputed(m.select("a").where("not isnan(a) or a is null"), ["a"]).collect()] == [1.0, 1.0]


def test_long(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "k int, a double, b double")
    assert sorted(map(tuple, unpivot(df, ["k"], [("x", F.col("a") / 1000), ("x", F.col("a")), ("y", F.col("b"))]).collect())) == [(1, "x", 0.002), (1, "x", 2.0)]
    both = union([df, spark.createDataFrame([(3, "z")], "k int, s string")])
    assert both.columns == ["k", "a", "b", "s"] and both.count() == 3
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "paper string, value double")
    append(rows, store)
    append(rows, store)
    assert read(spark, store).where("paper = 'p'").count() == 2


def test_evaluate(spark):
    rows = [("v", 10.0, 12.0), ("v", 10.0, 12.1), ("v", 10.0, None), ("v", None, 3.0), ("v", 0.0, 0.0), ("v", float("nan"), 1.0), ("v", 5.0, float("nan"))]
    df = spark.createDataFrame(rows, "variable string, t double, g double")
    d = evaluate.detail(df, "t", "g")
    assert [r.match for r in d.collect()] == ["hit", "off", "miss", None, "off", None, "miss"]
    s = evaluate.summary(d, ["variable"]).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall) == (1, 2, 2, 0.333, 0.333)
    m = evaluate.regression_metrics(spark.createDataFrame([("k", 1.0, 1.0), ("k", 3.0, 2.0), ("k", None, 1.0)], "k string, a double, p double"), ["k"], "a", "p").first()
    assert (m.n, m.mae, m.r2) == (2, 0.5, 0.5) and m.rmse == pytest.approx(math.sqrt(0.5))
    b = spark.createDataFrame([("t", "b", 0.5), ("t", "a", 0.5), ("t", "c", None)], "t string, m string, r double")
    assert evaluate.best(b, ["t"], "m", "r").first().m == "a"


def test_word_rows_and_grid(spark):
    words = [("p", float(x), float(y), t) for x, y, t in ((0, 0, "a"), (0, 3, "b"), (0, 6, "c"), (0, 9, "d"), (0, 12, "e"), (50, 1, "z"), (55, 1, "y"))] + [("p", None, 1.0, "gone")]
    rows = layout.word_rows(spark.createDataFrame(words, "page string, x double, y double, text string"), "page")
    got = sorted((r.row_no, r.position, r.text) for r in rows.collect())
    assert [(n, t) for n, _, t in got] == [(0, "a"), (0, "b"), (0, "z"), (0, "y"), (1, "c"), (1, "d"), (2, "e")]
    cells = {(r.row_no, r.column_no): r.text for r in layout.grid(rows, "page").collect()}
    assert cells == {(0, 0): "a b", (0, 1): "z y", (1, 0): "c d", (2, 0): "e"}
    assert layout.word_rows(rows.select("page", "x", "y", "text").limit(0), "page").count() == 0


def machine(rows, absorbed=2, least=3):
    """A literal state machine over (row_no, qualifies)."""
    blocks, open_, missed = [], [], 0
    for n, ok in [*rows, (None, False)]:
        if ok:
            open_.append(n)
            missed = 0
        elif open_ and n is not None and missed < absorbed:
            open_.append(n)
            missed += 1
        else:
            if len(open_) >= least:
                blocks.append((open_[0], open_[-1]))
            open_, missed = [], 0
    return blocks


def test_table_blocks_against_a_state_machine(spark):
    rng = random.Random(4)
    pages = {p: [rng.random() < rng.choice([0.2, 0.5, 0.8]) for _ in range(rng.randint(1, 30))] for p in range(60)}
    df = spark.createDataFrame([(p, i, 5, 0.5 if ok else 0.1) for p, oks in pages.items() for i, ok in enumerate(oks)], "page int, row_no long, n_filled long, numeric_share double")
    got = {}
    for r in layout.table_blocks(df, "page").orderBy("page", "block_no").collect():
        got.setdefault(r.page, []).append((r.first_row, r.last_row))
    assert got == {p: b for p, oks in pages.items() if (b := machine(list(enumerate(oks))))}


def test_layout_lines(spark):
    lines = ["A", "MCT oil", "1,5", "12ab", "2", "note", "3", "B", "Olive oil", "4"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "page int, line_no int, line string")
    assert [(r.level, r.name, r.numbers) for r in layout.levelled_lines(df, "page", ["MCT oil", "Olive oil"]).orderBy("line_no").collect()] == [("A", "MCT oil", [1.5, 2.0]), ("B", "Olive oil", [4.0])]
    rows = layout.design_rows(spark.createDataFrame([("3 1 0,5 0.2 10",), ("30 1 1 1 1",), ("3 1 2 3",), ("a 3 1 2 3 4",)], "line string"), [], "line")
    assert sorted(r.run for r in rows.collect()) == [3, 3]
    boxes = spark.createDataFrame([("t", float(y), 0.9) for y in (0, 5, 9, 40, 41, 42, 80, 81, 82, 120, 121, 122)] + [("t", 200.0, 0.1)] * 4 + [("u", 1.0, 0.9)], "page string, y double, conf double")
    assert {r.page: (r.n_boxes, r.n_rows, r.table_like) for r in layout.table_like(boxes, "page", F.col("conf") >= 0.8).collect()} == {"t": (16, 4, True), "u": (1, 0, False)}


def test_ridge_and_leave_one_out(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 2))
    y = np.exp(x @ [0.3, -0.2] + 1 + rng.normal(0, 0.1, 12)) - 1
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(99, None, 1.0, 1.0)], "k int, a double, b double, y double")

    def solve(x, t):
        m, c = x.mean(0), t.mean()
        beta = np.linalg.solve((x - m).T @ (x - m) + 10 * np.eye(2), (x - m).T @ (t - c))
        return beta, c - m @ beta

    got = {r.term: r.coefficient for r in ml.ridge_coefficients(df.withColumn("y", F.log1p("y")), ["a", "b"], "y").collect()}
    beta, intercept = solve(x, np.log1p(y))
    assert [got["a"], got["b"], got["intercept"]] == pytest.approx([*beta, intercept])
    for r in ml.leave_one_out(df, "k", ["a", "b"], "y").collect():
        rest = np.arange(12) != r.k
        beta, intercept = solve(x[rest], np.log1p(y[rest]))
        assert r.predicted == pytest.approx(np.expm1(x[r.k] @ beta + intercept))
    assert ml.leave_one_out(df.limit(0), "k", ["a", "b"], "y").count() == 0
    deviation, n = float(np.log1p(y).std()), 12
    model = ml.train(df.dropna(), ["a", "b"], "y", ml.ridge(10, n, deviation, "features", "label"))
    assert list(model.stages[-1].coefficients) == pytest.approx(list(solve(x, np.log1p(y))[0]))
    assert ml.predict(model, df, ["a", "b"]).count() == 13
    assert ml.hold_out(df, F.col("k").isin(1, 2), "y") is None
    parts = ml.hold_out(df.dropna(), F.col("k") < 5, "y", 5, 5)
    got = ml.compare(*parts, "k", ["a", "b"], "y", {"ridge": ml.ridge(10, 7, deviation, "features", "label"), "forest": ml.forest("features", "label", 3, 3)})
    assert sorted({(r.k, r.model) for r in got.collect()}) == [(k, m) for k in range(5) for m in ("forest", "ridge")]
    ml.save(model, str(tmp_path / "model"))
    assert ml.load(spark, str(tmp_path / "model")).transform(df.dropna()).count() == 12 and ml.load(spark, str(tmp_path / "none")) is None
    assert ml.summary_row(df, "k", ["a"], {"y": "y"}, {"y": "b"}).columns == ["k", "feat_a", "pred_y", "actual_y"]
    assert ml.importances(["a", "b"], [1.0, -3.0]) == [("b", 0.75), ("a", 0.25)]


def test_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"ok")
    (tmp_path / "y.pdf").write_bytes(b"bad")
    (tmp_path / "z.txt").write_text("line\nline")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"n": len(content)}]

    docs = files.binary_documents(spark, str(tmp_path))
    assert sorted(((r.paper, r.n, r.error) for r in files.parsed(docs, parse, "n long").collect()), key=str) == [("x", 2, None), ("y", None, "ValueError: broken")]
    assert files.text_documents(spark, str(tmp_path)).first().text == "line\nline"
    (tmp_path / "t.csv").write_text("\n".join([f"note{i},," for i in range(6)] + ["Study,a,b", "S1,1,2", "S2,3,"]))
    got = files.csv_below_preamble(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["Study", "a", "b"] and [tuple(r) for r in got.collect()] == [("S1", "1", "2"), ("S2", "3", None)]
    files.write_csv(got, str(tmp_path / "out"))
    assert files.csv(spark, str(tmp_path / "out"), "Study string, a int, b int").agg(F.sum("a")).first()[0] == 4
    with pytest.raises(RuntimeError):
        optional.pdf_text(b"") if __import__("importlib").util.find_spec("fitz") is None else (_ for _ in ()).throw(RuntimeError)


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("p", "Abstract We heated the whole emulsion to 80 °C for 30 s. Then it was stored."), ("q", None)], "paper string, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(source)
    append_stream(spark.readStream.schema(docs.schema).parquet(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.normalized_variable, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {(r.normalized_variable, r.value) for r in observations(docs).collect()} == {("Temperature_C", 80.0), ("Processing_time_s", 30.0), ("Emulsion_system", 80.0)}


def test_observations(spark):
    texts = [("p", "Title. Abstract The viscosity of the mixture reached 0.3 Pa·s after some time. The whole panel of 12 participants was trained first. Olive oil was then heated to 999 °C without any harm. References\nviscosity 5"), ("q", None), ("r", "")]
    got = {(r.entity, r.value_raw, r.unit, r.relation_method, r.normalized_variable, r.confidence) for r in observations(spark.createDataFrame(texts, "paper string, text string")).collect()}
    assert ("0.3 Pa·s", "0.3", "Pa·s", "pattern", "Viscosity_Pa_s", 1.0) in got and ("12 participants", "12", "", "pattern", "Participants_n", 1.0) in got
    assert ("viscosity", "0.3", "pa·s", "proximity", "Viscosity_Pa_s", 3.0) in got and ("participants", "12", None, "proximity", "Participants_n", 3.0) in got
    assert not any(e == "999 °C" for e, *_ in got)


def test_more_layout(spark):
    words = [("p", 10.0 * i, 0.0, t) for i, t in enumerate(["3", "1", "0,5", "0.2", "10"])] + [("p", 900.0, 0.0, "99"), ("p", 10.0, 50.0, "7")]
    got = layout.left_column_design(spark.createDataFrame(words, "page string, x double, y double, text string"), "page", 1000.0).collect()
    assert [(r.run, r.block, r.orange_oil_pct) for r in got] == [(3, 1, 10.0)]
    table = spark.createDataFrame([("1", "x", "2,5"), ("2", "4", None), ("3", None, None)], "n string, `6` string, `7` string")
    assert [tuple(r) for r in layout.positional(table, ["n"], {"run": ("n",), "v": ("6", "7")}, 2).collect()] == [(1.0, 2.5), (2.0, 4.0)]
    rows = spark.createDataFrame([("x" * 20, 0.8), ("x" * 19, 0.9), ("x" * 30, 0.7), (None, 0.9), ("x" * 30, None)], "t string, c double")
    assert filters.readable(rows, "t", "c").count() == 1


def test_tree_queries_have_the_reference_size(spark, small, monkeypatch):
    from mensura.plans import reference

    seen, real = [], ml.train
    monkeypatch.setattr(ml, "train", lambda df, features, target, model: seen.append((len(features), target, model)) or real(df, features, target, ml.ridge(10.0, 5, 1.0, "features", "label")))
    monkeypatch.setattr(reference, "TARGETS", dict.fromkeys(reference.TARGETS, 1))
    got = [reference.forest_predictions(spark, small), reference.boosted_predictions(spark, small)]
    assert all(len(g.columns) == 6 and g.columns[:2] == ["paper", "predicted_viscosity"] for g in got)
    assert {n for n, _, _ in seen} == {6} and len({t for _, t, _ in seen}) == 5 and len(seen) == 10
    assert all(m.getNumTrees() == 300 and m.getMaxDepth() == 30 for _, _, m in seen[:5]) and all(m.getMaxIter() == 200 for _, _, m in seen[5:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25))
def test_row_anchors(ys):
    y = np.sort(np.array(ys, float))
    rows = layout._rows_of(y, 4)
    for n in set(rows.tolist()):
        own = y[rows == n]
        assert (np.abs(own - own[0]) <= 4).all()
