"""The whole way from documents to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators import classify, filters, layout
from mensura.operators.long import union
from mensura.operators.patterns import IMAGE, TEXT, PatternLibrary
from mensura.operators.text import body, clean, repair_digits, sentences
from mensura.operators.wide import number
from mensura.schema import IMAGE_RANGED, OBSERVATION, RANGES, TEXT_NAMES
from mensura.session import cut

#: Entities that the rule-based finder knows, longest first, as one pattern.
_KNOWN = r"(?<![a-z0-9])(" + "|".join(sorted(TEXT_NAMES, key=lambda n: (-len(n), n))) + r")(?![a-z0-9])"


def _found_by_patterns(parts: DataFrame, library: PatternLibrary) -> DataFrame:
    found = library.extract(parts, "sentence")
    return found.select("paper", "sentence", "entity", F.lit("QUANTITY").alias("entity_label"), "value", "unit", F.lit("pattern").alias("relation_method"), classify.pattern_category(F.col("variable")).alias("category"), F.col("variable").alias("normalized_variable"))


def _linked(parts: DataFrame) -> DataFrame:
    """Known entities of a sentence, each with the nearest number and the unit after it: a rule in place of a language model's entities and parse."""
    low = F.lower("sentence")
    words = parts.select("paper", "sentence", F.array_distinct(F.regexp_extract_all(low, F.lit(_KNOWN), 1)).alias("_e"), classify.words(F.col("sentence")).alias("_w"))
    each = words.select("paper", "sentence", "_w", F.explode_outer("_e").alias("entity")).where("entity is not null")
    head = F.split_part("entity", F.lit(" "), F.lit(1))
    place = F.array_position(F.transform("_w", lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")), head)
    centre: Column = F.when(place > 0, place - 1 + F.size(F.split("entity", " ")) / 2 - 0.5).otherwise((F.size("_w") - 1) / 2)
    at = classify.nearest_number(F.col("_w"), centre)
    linked = each.withColumn("_at", at)
    return linked.select(
        "paper", "sentence", "entity", F.lit("ENTITY").alias("entity_label"), F.get("_w", F.col("_at")).alias("value"), classify.unit_after(F.col("_w"), F.col("_at")).alias("unit"),
        F.when(F.col("_at").isNotNull(), "proximity").otherwise("none").alias("relation_method"), classify.category(F.col("entity")).alias("category"), classify.variable(F.col("entity")).alias("normalized_variable"),
    )


def observations(documents: DataFrame, paper: str = "paper", text: str = "text", library: PatternLibrary = TEXT, entities: bool = True) -> DataFrame:
    """Observations of documents: values found by patterns and, with entities, known entities linked to the nearest number.

    Body, sentences, patterns and links, then in this order: noise, words for numbers and implausible values (taken back),
    further noise words, rows without a value that no pattern found (left out), confidence. Narrow and stateless, so the same for a table and a
    stream. Null and empty texts give no row.
    """
    parts = sentences(documents.select(F.col(paper).alias("paper"), body(F.col(text)).alias("_text")), "_text")
    rows = _found_by_patterns(parts, library)
    if entities:
        rows = union([rows, _linked(parts)])
    kept = filters.nullify(filters.without_noise(rows)).where((F.col("relation_method") == "pattern") | F.col("value").isNotNull())
    return kept.select(
        "paper", "sentence", "entity", "entity_label", F.col("value").alias("value_raw"), number(F.col("value")).alias("value"), "unit", "relation_method", "category", "normalized_variable",
        classify.confidence(F.col("relation_method")).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source"),
    ).to(OBSERVATION)


def image_observations(images: DataFrame, boxes: DataFrame, side: int = 150, sure: float = 0.80, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Observations of images, and by paper: images, useful images, rows.

    images: (paper, source, width, height); boxes: (paper, source, nth, y, text, conf), the text read off them in reading order
    nth. Images smaller than `side` either way are skipped; the texts of sure boxes are put together and their digits
    repaired; images with fewer than `least` characters, or not laid out like a table, give nothing. What the image
    patterns find in the others, without values that repeat within an image (ticks of an axis), then without implausible ones,
    are the observations. Null papers, sources, sizes and texts give nothing; an image without boxes counts as an image.
    """
    large = images.where((F.col("width") >= side) & (F.col("height") >= side)).select("paper", "source").dropna().distinct()
    here = cut(boxes.where("text is not null and conf is not null").join(large, ["paper", "source"]).withColumn("_image", F.struct("paper", "source")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda b: b["text"]), " ")  # an image is what fits in one
    texts = here.where(F.col("conf") >= sure).groupBy("_image").agg(joined.alias("_text")).withColumn("_text", repair_digits(F.col("_text"))).where(F.length("_text") >= least)
    tables = layout.table_like(here, "_image", F.col("conf") >= sure).where("table_like").select("_image")
    useful = cut(texts.join(tables, "_image").select(F.col("_image.paper").alias("paper"), F.col("_image.source").alias("source"), clean(F.col("_text")).alias("sentence")))
    found = IMAGE.extract(useful, "sentence")
    kept = filters.without_ticks(found, ["paper", "source"], "value").where(filters.in_range(F.col("variable"), F.col("value"), {v: RANGES[v] for v in IMAGE_RANGED}))
    rows = kept.select(
        "paper", "sentence", "entity", F.lit("QUANTITY").alias("entity_label"), F.col("value").alias("value_raw"), number(F.col("value")).alias("value"), "unit", F.lit("ocr").alias("relation_method"), classify.pattern_category(F.col("variable")).alias("category"),
        F.col("variable").alias("normalized_variable"), F.lit(1.0).alias("confidence"), "source",
    ).to(OBSERVATION)
    rows = cut(rows)
    count = lambda df, name: df.groupBy("paper").agg(F.count("*").alias(name))
    figures = count(large, "images_found").join(count(useful, "useful_images"), "paper", "left").join(count(rows, "rows_extracted"), "paper", "left")
    return rows, figures.na.fill(0)
