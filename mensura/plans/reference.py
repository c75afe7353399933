"""Queries of the extraction operators, each over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.names import ascii_column
from mensura.operators import classify, evaluate, filters, layout, ml, patterns, text, wide
from mensura.operators.long import union, unpivot
from mensura.operators.quantiles import beside_medians, medians
from mensura.plans import extraction
from mensura.schema import EVALUATED, FEATURE_PATTERNS, FEATURES, IMAGE_NAMES, IMAGE_RANGED, INPUTS, OIL_TYPES, OIL_WORDS, OUTPUTS, PROTEIN_WORDS, RANGES, SENSORY, TARGETS
from mensura.session import cut
from mensura.sources.files import numbered
from mensura.sources.tables import spread, table

#: Variables of the wide dataset with their columns.
VARIABLES = {
    v: ascii_column(v)
    for v in (
        "Fat_concentration_wt%", "Oil_concentration_wt%", "Protein_concentration_wt%", "Concentration_wt%", "Temperature_C", "Homogenization_rpm", "Pressure_MPa", "Pressure_bar", "Volume_mL", "Shear_rate_s-1",
        "Processing_time_s", "Participants_n", "Viscosity_Pa_s", "d90_µm", "d50_µm", "d43_µm", "d32_µm", "Particle_size_µm", "Sensory_thickness", "Sensory_creaminess", "Sensory_smoothness", "Friction_coefficient",
        "Sliding_speed_mm_s", "Normal_force_N",
    )
}
COLUMNS = list(VARIABLES.values())
VISCOSITIES = tuple(f"viscosity_at_{p}_mpas" for p in ("0_1s1", "1s1", "10s1", "50s1", "100s1", "100rpm", "60rpm"))
CURATED = ("d90_um", "fat_concentration_pct", "mean_thickness_10", "mean_creaminess_10", "sample_preparation_temperature_c", "viscosity_measurement_temperature_c")


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    """Long rows with their value as a number, as the wide dataset takes them."""
    return table(spark, folder, "extended_with_ocr").select("row_id", "paper", F.col("normalized_variable").alias("variable"), F.col("value").alias("value_raw"), wide.number(F.col("value")).alias("value"), "unit", "relation_method", "sheet", "entity", "source", "loaded_at")


def _pivot(spark: SparkSession, folder: str) -> DataFrame:
    return wide.median_pivot(_observations(spark, folder), "paper", "variable", "value", VARIABLES)


def wide_median_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return _pivot(spark, folder)


def wide_unmapped_kept(spark: SparkSession, folder: str) -> DataFrame:
    pivot = wide.median_pivot(_observations(spark, folder), "paper", "variable", "value", VARIABLES, keep_unmapped=True)
    empty = F.lit(True)
    for c in COLUMNS:
        empty = empty & F.col(c).isNull()
    return pivot.select("paper", empty.alias("nothing_mapped"))


def wide_rescaled(spark: SparkSession, folder: str) -> DataFrame:
    return wide.rescaled(_pivot(spark, folder), [VARIABLES[v] for v in SENSORY]).select("paper", *[VARIABLES[v] for v in SENSORY])


def wide_with_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = wide.value_counts(_observations(spark, folder), "paper", "value")
    return wide.rescaled(_pivot(spark, folder), [VARIABLES[v] for v in SENSORY]).join(counts, "paper", "left")


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    names = {c: v for v, c in VARIABLES.items()}
    report = wide.coverage(_pivot(spark, folder), COLUMNS)
    name = classify.lookup(F.col("variable"), names)
    return report.select(name.alias("variable"), text.variable_label(name).alias("label"), classify.role(name).alias("var_role"), "n_filled", "pct_filled", "median_value")


def presence_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return wide.presence(_pivot(spark, folder), "paper", COLUMNS)


def method_share(spark: SparkSession, folder: str) -> DataFrame:
    valued = _observations(spark, folder).where("value is not null").withColumn("method", classify.sheet_method(F.col("sheet")))
    return wide.shares(valued, "method", "pct")


def sheets_per_method(spark: SparkSession, folder: str) -> DataFrame:
    sheets = _observations(spark, folder).select("sheet").where("sheet is not null").distinct()
    return sheets.groupBy(classify.sheet_method(F.col("sheet")).alias("method")).agg(F.count("*").alias("n_sheets"))


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _observations(spark, folder).agg(F.count_distinct("paper").alias("n_papers"), F.count_distinct("variable").alias("n_variables"), F.count_distinct("entity").alias("n_entities"), F.count("value").alias("n_values"), F.count("*").alias("n_rows"))


def value_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder).where("value is not null and variable is not null")
    stats = rows.groupBy("variable").agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).where("n >= 3")
    return beside_medians(stats, rows, ["variable"], {"median_value": F.col("value")})


def histogram_bins(spark: SparkSession, folder: str) -> DataFrame:
    return wide.histogram(_observations(spark, folder).where(F.col("variable").isin(*VARIABLES)), ["variable"], "value")


def extraction_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder)
    return rows.groupBy("paper").agg(F.count("*").alias("n_rows"), F.count_if(F.col("relation_method") == "pattern").alias("n_pattern"), F.count_if(F.coalesce(F.col("relation_method") != "pattern", F.lit(True))).alias("n_other"), F.count("value").alias("n_valued"))


def pattern_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "extended_with_ocr").select("row_id", "sentence"))
    return patterns.TEXT.extract(rows, "sentence").select("row_id", "start", "variable", "entity", "value", "unit")


def pattern_extract_images(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "extended_with_ocr").where("source is not null").select("paper", "sentence"))
    found = patterns.IMAGE.extract(rows, "sentence").where(filters.in_range(F.col("variable"), F.col("value"), {v: RANGES[v] for v in IMAGE_RANGED}))
    return found.groupBy("variable").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def regex_distinct_hits(spark: SparkSession, folder: str) -> DataFrame:
    t = F.lower("text")
    hits = {"temperatures": (r"\d+(?:\.\d+)?\s*°c", 0), "concentrations": (r"\d+(?:\.\d+)?\s*wt\.?\s*%", 0), "participants": (r"(\d+)\s+participants", 1), "sizes": (r"\d+(?:\.\d+)?\s*[µμu]m", 0)}
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *[F.array_join(patterns.distinct_hits(t, p, g), "|").alias(n) for n, (p, g) in hits.items()], F.array_join(patterns.contained(t, OIL_TYPES), "|").alias("oils"))


def feature_medians(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("paper", "text"))
    names = {n: ascii_column(n) for n, _ in FEATURE_PATTERNS}
    return patterns.feature_medians(docs, ["paper"], "text", FEATURE_PATTERNS, names)


def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", patterns.flag(F.col("text"), PROTEIN_WORDS).alias("protein_type"), patterns.flag(F.col("text"), OIL_WORDS).alias("oil_fat_type"))


def body_slice(spark: SparkSession, folder: str) -> DataFrame:
    b = text.body(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.length(b), F.lit(0)).cast("bigint").alias("n_body"), F.md5(b).alias("body_md5"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    c = text.clean(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.length(c), F.lit(0)).cast("bigint").alias("n_clean"), F.md5(c).alias("clean_md5"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return text.sentences(spread(table(spark, folder, "documents").select("doc_id", "text")), "text").select("doc_id", "sentence_no", "sentence")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return text.lines(table(spark, folder, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("bigint").alias("longest"))


def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_noise(_observations(spark, folder)).select("row_id", "entity")


def classify_normalise(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("entity")
    return _observations(spark, folder).select("entity", "relation_method", "variable").distinct().select(
        "entity", "relation_method", "variable", classify.category(e).alias("category"), classify.variable(e).alias("named"), classify.variable(e, IMAGE_NAMES).alias("named_in_image"),
        classify.pattern_category(F.col("variable")).alias("pattern_category"), classify.confidence(F.col("relation_method")).cast("double").alias("confidence"),
    )


def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder).where("value_raw is not null")
    return rows.groupBy("variable", filters.in_range(F.col("variable"), F.col("value_raw")).alias("plausible")).agg(F.count("*").alias("n"))


def nullified_values(spark: SparkSession, folder: str) -> DataFrame:
    return filters.nullify(_observations(spark, folder), variable="variable", value="value_raw").select("row_id", "value_raw", "unit", "relation_method")


def proximity_link(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extended_with_ocr").where("sentence is not null").select("row_id", classify.words(F.col("sentence")).alias("_w"))
    at = classify.nearest_number(F.col("_w"), (F.size("_w") - 1) / 2)
    return rows.select("row_id", at.cast("bigint").alias("at"), F.get("_w", at).alias("number"), classify.unit_after(F.col("_w"), at).alias("unit")).where("at is not null")


def axis_tick_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_ticks(_observations(spark, folder).where("source is not null"), ["paper", "source"], "value_raw").select("row_id", "value_raw")


def digit_repair(spark: SparkSession, folder: str) -> DataFrame:
    r = text.repair_digits(F.col("text"))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.md5(r).alias("repaired_md5"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("paper")
    return table(spark, folder, "paper_headers").select("paper", text.study_label(p).alias("study_label"), text.paper_label(p).alias("paper_label"), text.stem(F.concat(F.lit("in/"), p, F.lit(".pdf"))).alias("stem"))


def unpivot_long(spark: SparkSession, folder: str) -> DataFrame:
    curated = table(spark, folder, "example_data")
    pairs = [("d90_um", F.nanvl("d90_um", F.lit(None).cast("double"))), *[("viscosity_pa_s", F.nanvl(F.col(c), F.lit(None).cast("double")) / 1000) for c in VISCOSITIES], ("fat_concentration_wt", F.nanvl("fat_concentration_pct", F.lit(None).cast("double")))]
    return unpivot(curated, ["row_no"], pairs)


def union_observations(spark: SparkSession, folder: str) -> DataFrame:
    long = table(spark, folder, "extended_with_ocr").select("paper", F.col("normalized_variable").alias("variable"), "unit", "relation_method")
    tables = table(spark, folder, "wide_format_dataset").where("viscosity_pa_s is not null").select("paper", F.lit("Viscosity_Pa_s").alias("variable"), F.col("load_id").cast("string").alias("load_id"))
    return union([long, tables]).groupBy("variable", "unit", "relation_method", "load_id").agg(F.count("*").alias("n"))


def group_median(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "example_data").withColumn("study", F.trim("study_id"))
    return medians(rows, ["study"], {c: F.col(c) for c in CURATED})


def row_median(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "example_data").select("row_no", wide.row_median(VISCOSITIES, 0.001).alias("viscosity_pa_s"))


def design_outputs_join(spark: SparkSession, folder: str) -> DataFrame:
    design = table(spark, folder, "example_data").select(F.trim("study_id").alias("study_id"), "row_no", "oil_type")
    outputs = table(spark, folder, "evaluation_results").select("study_id", "variable", "verdict")
    # each side is counted first, so that a study's rows aren't paired
    runs = design.groupBy("study_id").agg(F.count("*").alias("_runs"), F.min("oil_type").alias("first_oil"))
    found = outputs.groupBy("study_id", "variable", "verdict").agg(F.count("*").alias("_found"))
    return found.join(runs, "study_id").select("study_id", "variable", "verdict", (F.col("_runs") * F.col("_found")).alias("n_rows"), "first_oil")


def key_mapping_lookup(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "variable_guide").select("variable", "label", "var_type")
    return table(spark, folder, "evaluation_results").join(names, "variable", "left").groupBy("label", "var_type").agg(F.count("*").alias("n"))


def semi_anti_split(spark: SparkSession, folder: str) -> DataFrame:
    results, copy = table(spark, folder, "evaluation_results").select("variable", "study_id"), table(spark, folder, "evaluation_results_copy").select("variable", "study_id").distinct()
    both = results.join(copy, ["variable", "study_id"], "left_semi").withColumn("side", F.lit("held"))
    rest = results.join(copy, ["variable", "study_id"], "left_anti").withColumn("side", F.lit("rest"))
    return both.unionByName(rest).groupBy("variable", "side").agg(F.count("*").alias("n"))


def _detail(spark: SparkSession, folder: str) -> DataFrame:
    relative = ~F.col("variable").isin(*SENSORY)
    return evaluate.detail(table(spark, folder, "evaluation_results").select("variable", "study_id", "gt_value", "pipeline_value"), "gt_value", "pipeline_value", relative)


def eval_detail(spark: SparkSession, folder: str) -> DataFrame:
    return _detail(spark, folder).select("variable", "study_id", "match", "abs_error", "rel_error_pct")


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(_detail(spark, folder), ["variable"])


def truth_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Collected against extracted values of five variables: each study's medians, through the paper that prints its author and
    year (of several the first by name), against the paper's medians. Rows without a collected value can't be judged and have a null match."""
    curated = table(spark, folder, "example_data").withColumn("study_id", F.trim("study_id"))
    sources = {"d90_µm": ("d90_um",), "Viscosity_Pa_s": VISCOSITIES, "Sensory_thickness": ("mean_thickness_10",), "Sensory_creaminess": ("mean_creaminess_10",), "Temperature_C": ("sample_preparation_temperature_c", "viscosity_measurement_temperature_c")}
    columns = [c for cs in sources.values() for c in cs]
    study = medians(curated, ["study_id"], {c: F.col(c) for c in columns})
    truth = study.select("study_id", *[wide.row_median(sources[v], factor).alias(VARIABLES[v]) for v, factor, _ in EVALUATED])
    headers = table(spark, folder, "paper_headers").select("paper", F.regexp_extract("year_line", r"((?:19|20)[0-9]{2})", 1).alias("_year"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("author_line"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("_author"))
    ids = curated.select("study_id", F.regexp_extract(F.lower("study_id"), "^[a-z]+", 0).alias("_author"), F.regexp_extract("study_id", r"((?:19|20)[0-9]{2})", 1).alias("_year")).where("_year <> ''").distinct()
    named = ids.join(headers, ["_author", "_year"]).groupBy("study_id").agg(F.min("paper").alias("paper"))
    got = wide.rescaled(_pivot(spark, folder), [VARIABLES[v] for v in SENSORY]).select("paper", *[F.col(VARIABLES[v]).alias(f"_{VARIABLES[v]}") for v, _, _ in EVALUATED])
    both = truth.join(named, "study_id").join(got, "paper", "left")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(VARIABLES[v]).alias("gt"), F.col(f"_{VARIABLES[v]}").alias("got"), F.lit(r).alias("relative")) for v, _, r in EVALUATED]))
    rows = both.select("study_id", "paper", each.alias("_e")).select("study_id", "paper", "_e.*")
    return evaluate.detail(rows, "gt", "got", F.col("relative"))


def truth_detail(spark: SparkSession, folder: str) -> DataFrame:
    figure = lambda c, places: F.round(F.col(c) + 1e-9, places)  # noqa: E731  (halves go up, whatever the last bit of a sum)
    rows = truth_evaluation(spark, folder).where("match is not null")
    return rows.select("variable", "study_id", figure("gt", 4).alias("gt_value"), figure("got", 4).alias("pipeline_value"), figure("error", 4).alias("abs_error"), figure("relative_error", 2).alias("rel_error_pct"), "match")


def truth_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(cut(truth_evaluation(spark, folder).select("variable", "match", "error", "relative_error")), ["variable"])


def _images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Images with boxes of text, made of lineitem's figures: an image per part, sizes and texts by line."""
    items = numbered(table(spark, folder, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    paper, source = F.concat(F.lit("p"), F.col("l_partkey") % 40), F.concat(F.lit("img"), "l_partkey")
    number = F.col("l_quantity").cast("int").cast("string")
    words = F.element_at(F.array(F.concat(number, F.lit(" °C")), F.concat(number, F.lit("O rpm")), F.concat(number, F.lit(" MPa")), F.concat(number, F.lit("% fat")), F.concat(number, F.lit(",5 mL")), F.concat(F.lit("d90 = "), number, F.lit(" nm"))), (1 + F.col("l_orderkey") % 6).cast("int"))
    boxes = items.select(paper.alias("paper"), source.alias("source"), "nth", ((F.col("l_orderkey") % 8) * 20).cast("double").alias("y"), words.alias("text"), (1 - F.col("l_discount") * 3).alias("conf"))
    parts = table(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 40).alias("paper"), F.concat(F.lit("img"), "p_partkey").alias("source"), (F.col("p_size") * 20).alias("width"), (100 + F.col("p_partkey") % 400).alias("height"))
    return parts, boxes


def image_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of images by variable, from boxes of text."""
    rows, _ = extraction.image_observations(*_images(spark, folder))
    return rows.groupBy("normalized_variable", "unit").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_images"), F.sum("value").alias("total"))


def image_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Images, useful images and rows of each paper."""
    return extraction.image_observations(*_images(spark, folder))[1]


def data_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that numbers on pages make, with their cells."""
    cells = layout.data_blocks(_boxes(spark, folder), "page")
    return cells.groupBy("page", "block_no").agg(F.count_distinct("row_no").alias("n_filled_rows"), F.count_distinct("column_no").alias("n_columns"), F.count("*").alias("n_cells"), F.sum(F.length("text")).alias("n_chars"))


def variable_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The variables that have values: inputs, outputs, then others, each in its usual order, with label, unit and role."""
    name = F.col("variable")
    order = F.coalesce(*[F.when(name == v, i) for i, v in enumerate((*INPUTS, *OUTPUTS))], F.lit(len(INPUTS) + len(OUTPUTS)))
    rows = _observations(spark, folder).where("value is not null and variable is not null").groupBy("variable").agg(F.count("*").alias("n_values"), F.count_distinct("paper").alias("n_papers"))
    return rows.select("variable", order.alias("place"), text.variable_label(name).alias("label"), classify.unit(name).alias("unit"), classify.role(name).alias("var_role"), "n_values", "n_papers")


def corpus_observations(spark: SparkSession, folder: str) -> DataFrame:
    """All observations that the whole texts of documents give, counted by variable and method."""
    found = cut(extraction.observations(spread(table(spark, folder, "documents").select("paper", "text"))).select("normalized_variable", "relation_method", "value"))
    keys = ["normalized_variable", "relation_method"]
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count("value").alias("n_numbers"))
    return beside_medians(counts, found, keys, {"median_value": F.col("value")}).withColumn("median_value", F.round("median_value", 6))


def _held_papers(rows: DataFrame) -> Column:
    """The hold-out list of these tables: of each target five papers, those with most targets, of several the first by name."""
    targets = [VARIABLES[v] for v in TARGETS]
    filled = functools.reduce(lambda a, b: a + b, [F.col(t).isNotNull().cast("int") for t in targets])
    firsts = [rows.where(F.col(t).isNotNull()).orderBy(F.desc(filled), "paper").limit(5).select("paper") for t in targets]
    return F.col("paper").isin([r.paper for r in functools.reduce(DataFrame.unionByName, firsts).distinct().collect()])


def _modelled(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], dict[str, int]]:
    """The wide dataset as the models take it, with its features (all that are measured columns) and targets."""
    features, targets = [VARIABLES[v] for v in FEATURES if v in VARIABLES], {VARIABLES[v]: n for v, n in TARGETS.items()}
    rows = wide.rescaled(_pivot(spark, folder), [VARIABLES[v] for v in SENSORY]).select("paper", *features, *targets)
    return cut(rows), features, targets


def _models(n: int, deviation: float) -> dict[str, object]:
    """The three models with the reference's parameters; trees as deep as the library's limit of 30."""
    return {"forest": ml.forest("features", "label", depth=30), "boosted": ml.boosted("features", "label"), "ridge": ml.ridge(10.0, n, deviation, "features", "label")}


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Each target's three models on held-out papers, the best one marked, with the importances of its refit."""
    rows, features, targets = _modelled(spark, folder)
    scores, _ = ml.study(rows, "paper", features, targets, _held_papers(rows), _models)
    return scores.withColumn("importances", F.array_join(F.transform("importances", lambda x: F.concat_ws(":", x["feature"], F.round(x["share"], 4).cast("string"))), "|"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Places of numbers on pages, made of lineitem's figures."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("page"), (F.col("l_linenumber") * 25 + F.col("l_suppkey") % 3).cast("double").alias("x"), ((F.col("l_orderkey") % 40) * 6 + F.col("l_partkey") % 4).cast("double").alias("y"),
        F.col("l_quantity").cast("int").cast("string").alias("text"), F.col("l_discount").alias("conf"),
    )


def word_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.word_rows(_boxes(spark, folder), "page")
    return rows.groupBy("page", "row_no").agg(F.count("*").alias("n_words"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.sum(F.col("position") * F.col("x")).alias("spread"))


def word_grid(spark: SparkSession, folder: str) -> DataFrame:
    cells = layout.grid(layout.word_rows(_boxes(spark, folder), "page"), "page")
    return cells.groupBy("page", "column_no").agg(F.count("*").alias("n_cells"), F.sum(F.length("text")).alias("n_chars"))


def _row_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of pages with filled cells and numeric shares, made of orders' figures: a row per order of a customer."""
    orders = numbered(table(spark, folder, "orders"), ["o_custkey"], ["o_orderkey"])
    return orders.select(F.col("o_custkey").alias("page"), (F.col("nth") - 1).alias("row_no"), (F.col("o_orderkey") % 7).alias("n_filled"), ((F.col("o_orderkey") % 11) / 10).alias("numeric_share"))


def table_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return layout.table_blocks(_row_shares(spark, folder), "page").withColumn("block_no", F.col("block_no").cast("bigint"))


def table_layout_gate(spark: SparkSession, folder: str) -> DataFrame:
    boxes = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("page"), ((F.col("l_suppkey") % 50) * 9).cast("double").alias("y"), F.col("l_discount").alias("conf"))
    return layout.table_like(boxes, "page", F.col("conf") >= 0.02).withColumn("n_rows", F.col("n_rows").cast("bigint"))


def numeric_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric share of the lines of documents, words as cells."""
    cells = text.lines(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("line_no").alias("row_no"), F.posexplode(classify.words(F.col("line"))).alias("column_no", "text"))
    shares = layout.numeric_share(cells, "doc_id")
    return shares.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum("n_filled").alias("n_filled"), F.round(F.sum("numeric_share"), 6).alias("shares"))


def design_matrix(spark: SparkSession, folder: str) -> DataFrame:
    lines = text.lines(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return layout.design_rows(lines, ["doc_id", "line_no"], "line")


def levelled_table(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of customers' pages: the order status letter as level, oils as row names, prices as numbers."""
    orders = table(spark, folder, "orders")
    names = [F.when(F.col("o_orderkey") % 3 == 0, "MCT oil").when(F.col("o_orderkey") % 3 == 1, "Olive oil").otherwise("note")]
    parts = F.array(F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B"), *names, F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(",5")), F.lit("12ab"), (F.col("o_custkey") % 70).cast("string"))
    lines = orders.select(F.col("o_custkey").alias("page"), "o_orderkey", F.posexplode(parts).alias("_i", "line")).select("page", (F.col("o_orderkey") * 5 + F.col("_i")).alias("line_no"), "line")
    found = layout.levelled_lines(lines, "page", ["MCT oil", "Olive oil"])
    return found.select("page", "line_no", "level", "name", F.size("numbers").cast("bigint").alias("n_numbers"), F.round(F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prices predicted by the mean of their part's brand and size."""
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    means = {"brand": "p_brand", "size": "p_size"}
    out = []
    for name, key in means.items():
        mean = rows.groupBy(key).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("predicted"))
        out.append(rows.join(mean, key).select(F.lit(name).alias("model"), F.col("l_returnflag").alias("target"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("actual"), "predicted"))
    return union(out)


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = evaluate.regression_metrics(_predictions(spark, folder), ["target", "model"], "actual", "predicted")
    return m.select("target", "model", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.best(regression_metrics(spark, folder), ["target"], "model", "r2")


def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    return wide.imputed(_pivot(spark, folder), [VARIABLES["Temperature_C"], VARIABLES["Pressure_MPa"]]).select("paper", VARIABLES["Temperature_C"], VARIABLES["Pressure_MPa"])


def ridge_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("quantity"), F.log1p("l_extendedprice").alias("price"))
    return ml.ridge_coefficients(rows, ["quantity"], "price").select("term", F.round("coefficient", 8).alias("coefficient"))


def ridge_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out predictions of viscosity for every paper that has one."""
    rows, features, _ = _modelled(spark, folder)
    target = VARIABLES["Viscosity_Pa_s"]
    return ml.leave_one_out(wide.imputed(rows.where(F.col(target).isNotNull()), features), "paper", features, target)


def _predicted(spark: SparkSession, folder: str, model) -> DataFrame:  # noqa: ANN001
    """Each target of every paper by a model on all features, fitted on the papers that have the target.

    Features that are no measured column of the tables are left out; null ones are filled with the medians of the papers that have
    the target. A target that too few papers have is null.
    """
    given, features, targets = _modelled(spark, folder)
    have = given.agg(*[F.count(t).alias(t) for t in targets]).first()
    names = {t: "predicted_viscosity" if t == VARIABLES["Viscosity_Pa_s"] else f"predicted_{t}" for t in targets}

    def one(target: str) -> DataFrame:
        if have[target] < targets[target]:
            return given.select("paper", F.lit(None).cast("double").alias(names[target]))
        known = given.where(F.col(target).isNotNull())
        middle = {c: v or 0.0 for c, v in medians(known, [], {c: F.col(c) for c in features}).first().asDict().items()}
        got = ml.predict(ml.train(known.fillna(middle), features, target, model.copy()), given.select("paper", *features).fillna(middle), features, names[target])
        return got.select("paper", names[target])

    out = given.select("paper")
    for part in ml.side_by_side(spark, one, list(targets)):
        out = out.join(part, "paper", "left")
    return out.select("paper", *names.values())


def forest_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of every paper by forests of 300 trees, as deep as the library's limit of 30."""
    return _predicted(spark, folder, ml.forest("features", "label", depth=30))


def boosted_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of every paper by 200 rounds of boosted trees."""
    return _predicted(spark, folder, ml.boosted("features", "label"))


def new_paper_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Papers' texts to predicted targets: features read from each paper's texts, 0 where there is none, into a ridge of each
    target; beside them the values extracted, where there are any."""
    rows, features, targets = _modelled(spark, folder)
    docs = spread(table(spark, folder, "documents").where("paper is not null").select("paper", "text"))
    found = patterns.feature_medians(docs, ["paper"], "text", FEATURE_PATTERNS, {n: VARIABLES[n] for n, _ in FEATURE_PATTERNS})
    have = rows.agg(*[F.count(t).alias(t) for t in targets]).first()
    seen = cut(found.select("paper", *features))
    out, predicted = seen, {}
    for target, least in targets.items():
        if have[target] >= least:
            known = wide.imputed(rows.where(F.col(target).isNotNull()), features)
            m = known.agg(F.count("*").alias("n"), F.stddev_pop(F.log1p(target)).alias("d")).first()
            got = ml.predict(ml.train(known, features, target, ml.ridge(10.0, m.n, m.d or 1.0, "features", "label")), seen, features, f"_{target}")
            out = out.join(got.select("paper", f"_{target}"), "paper", "left")
            predicted[target] = f"_{target}"
    return ml.summary_row(out.join(rows.select("paper", *targets), "paper", "left"), "paper", features, predicted, {t: t for t in predicted})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        wide_median_pivot, wide_unmapped_kept, wide_rescaled, wide_with_counts, coverage_report, presence_matrix, method_share, sheets_per_method, distinct_counts, value_stats, histogram_bins, extraction_counts,
        pattern_extract, pattern_extract_images, regex_distinct_hits, feature_medians, keyword_flags, body_slice, clean_text, sentence_split, document_lines, noise_filter, classify_normalise, range_filter,
        nullified_values, proximity_link, axis_tick_filter, digit_repair, labels, unpivot_long, union_observations, group_median, row_median, design_outputs_join, key_mapping_lookup, semi_anti_split, eval_detail,
        eval_summary, word_rows, word_grid, table_blocks, table_layout_gate, numeric_cells, design_matrix, levelled_table, corpus_observations, regression_metrics, best_model, impute_median, model_comparison, ridge_fit, ridge_leave_one_out,
        forest_predictions, boosted_predictions, new_paper_predictions, truth_detail, truth_summary, image_enrichment, image_statistics, data_blocks, variable_catalogue,
    )
}
